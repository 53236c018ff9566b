"""The block tree of an HTML page: elements that lay out blocks, and the text blocks between them.

A text block is the text between two block boundaries; inline elements do not part
it. Markup that is never shown as running text (scripts, styles, the head, form
controls, embedded media) is passed over. Missing, stray and unclosed tags are
tolerated as browsers do for the common cases.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title select template svg math canvas audio video object button datalist".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr caption ul label".split()
)
# An opening tag ends an open element of these names, up to the nearest of the limits.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody"), ("table",)),
    "tfoot": (("thead", "tbody"), ("table",)), "option": (("option",), ("select", "datalist")),
}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*+)(?:>|\Z))"
    r"|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAMED = ("class", "id", "role", "itemprop")


class Node(NamedTuple):
    parent: int  # -1: the root
    tag: str  # "" for a text block
    names: tuple[str, ...]  # lower-case parts of its class, id, role and itemprop
    text: str
    linked: int  # characters of the text inside links


def parse(html: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root. Not recursive."""
    nodes = [Node(-1, "root", (), "", 0)]
    stack, open_tags = [0], {}
    parts: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                nodes.append(Node(stack[-1], "", (), text, min(linked, len(text))))
            parts.clear()
        linked = in_link = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text)

    def close(place: int) -> None:
        flush()
        while len(stack) > place:
            tag = nodes[stack.pop()].tag
            open_tags[tag] -= 1

    while match := _TAG.search(html, at):
        if match.start() > at:
            say(html[at : match.start()])
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name == "a":
                in_link = 0
            elif open_tags.get(name):
                place = len(stack) - 1
                while nodes[stack[place]].tag != name:
                    place -= 1
                close(place)
            elif name in BLOCKS:
                flush()
            continue
        if match["loose"] is not None and not html.endswith(">", 0, at):
            break  # the page ends within a tag
        if name == "head":
            end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at)
            if end:
                flush()
                at = end.start()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if name in ("button", "select", "title"):
                flush()
            at = end.end() if end else len(html)
        elif name == "a":
            in_link = 1
        elif name == "br":
            parts.append(" ")
        elif name == "hr":
            flush()
        elif name in VOID:
            continue
        elif name in BLOCKS or "-" in name:
            flush()
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                ends, limits = CLOSES[name]
                if any(open_tags.get(tag) for tag in ends):
                    place = found = len(stack)
                    while place > 1 and (tag := nodes[stack[place - 1]].tag) not in limits:
                        place -= 1
                        if tag in ends:
                            found = place
                            if name not in ("tr",):
                                break
                    close(found)
            names = _names(match["attrs"] if match["attrs"] is not None else match["loose"])
            nodes.append(Node(stack[-1], name, names, "", 0))
            stack.append(len(nodes) - 1)
            open_tags[name] = open_tags.get(name, 0) + 1
    else:
        if at < len(html):
            say(html[at:])
    flush()
    return nodes


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    found = []
    for key, *values in _ATTR.findall(attrs):
        key = key.lower()
        if key in _NAMED:
            found += [part.lower() for value in values for part in _PART.findall(unescape(value))]
        elif key == "style" and "display:none" in "".join(values).replace(" ", "").lower():
            found.append("hidden")
    return tuple(dict.fromkeys(found))
