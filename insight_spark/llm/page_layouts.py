"""Labelled pages to learn from: the texts of real pages laid out in many ways.

A page whose own markup says which part is the article gives a title, paragraphs and
the short texts around them. They are laid out anew with and without telling
elements and names, with menus, notices, adverts, sidebars, forms and comments in
varying places. Blocks of the article begin with ``MARK``.
"""

from __future__ import annotations

import random
from html import escape

MARK = "\ue000"
# Names by which pages tell their parts.
NAMES = {
    "menu": "nav navigation menu navbar topnav breadcrumb breadcrumbs links toolbar tabs pagination pager skip",
    "header": "header masthead top topbar branding logo site-header banner",
    "footer": "footer foot bottom copyright legal colophon credits site-footer imprint",
    "sidebar": "sidebar side aside rail widget widgets related recommended trending popular recent archive tags more secondary complementary",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay message disclaimer announcement subscribe paywall hidden",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense teaser partner",
    "form": "form search newsletter signup login contact register poll survey",
    "comments": "comments comment comment-list discussion replies reply responses respond disqus feedback thread reviews",
    "social": "share social sharing follow tools print actions meta",
    "main": "main content article post entry story text body page primary maincontent post-content entry-content article-body articleBody story-body blog-post document copy prose markdown",
    "neutral": "wrapper container row col inner outer section block box grid layout center wide left right wrap",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "main": "main", "notice": "alert"}
_COMMENT_HEADS = ("Comments", "3 comments", "Discussion", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "What readers say")
_SKIPS = ("Skip to content", "Skip to main content", "Zum Inhalt", "Aller au contenu", "Menu", "Back to top")
_AUTHORS = ("anna", "Bob K.", "guest_17", "María", "J. Doe", "léa", "Uwe", "anonymous")
_BUTTONS = ("Search", "Subscribe", "Sign up", "Send", "OK", "Log in", "Accept")
_WORDS = "the of and to in a is that for it on with as was at by this from or an be are not have which their has but".split()


class Layout:
    """One page; ``texts`` are paragraphs of the article, ``others`` paragraphs of other pages, ``short`` snippets."""

    def __init__(self, rng: random.Random, title: str, texts: list[str], others: list[str], short: list[str]):
        self.rng, self.title, self.texts = rng, title, texts
        self.others, self.short = others or [_words(rng, 30)], short or [_words(rng, 4)]
        self.telling = rng.random() < 0.85  # names say what a part is
        self.elements = rng.random() < 0.6  # elements do
        self.own_element = self.elements and rng.random() < 0.8  # one is the article's own
        self.closed = rng.random() < 0.8  # paragraphs have end tags

    def page(self) -> str:
        rng = self.rng
        main = self.main()
        column = [self.sidebar()] if rng.random() < 0.5 else []
        body = [*column, main] if rng.random() < 0.5 else [main, *column]
        if rng.random() < 0.45:
            body.insert(body.index(main) + 1, self.comments())
        if rng.random() < 0.2:
            body = ["<table><tr>", *[f"<td{self.named('neutral', 0.3)}>{part}</td>" for part in body], "</tr></table>"]
        head = [part() for part, odds in ((self.header, 0.5), (self.menu, 0.8), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.15)) if rng.random() < odds]
        if rng.random() < 0.3:
            rng.shuffle(head)
        tail = [part() for part, odds in ((self.advert, 0.2), (self.notice, 0.15), (self.form, 0.15), (self.menu, 0.2), (self.footer, 0.85)) if rng.random() < odds]
        if rng.random() < 0.15:
            head.insert(0, f'<a href="#main"{self.named("menu", 0.5)}>{rng.choice(_SKIPS)}</a>')
        inside = "".join([*head, *body, *tail])
        for _ in range(rng.randrange(3)):
            inside = f"<div{self.named('neutral', 0.7)}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>{escape(self.title)}</title></head><body>{inside}</body></html>"

    def named(self, kind: str, odds: float = 1.0) -> str:
        rng = self.rng
        if not (self.telling or kind == "neutral") or rng.random() > odds:
            return ""
        name = rng.choice(NAMES[kind])
        if rng.random() < 0.25:
            name += rng.choice(("-1", "-box", "_area", " " + rng.choice(NAMES["neutral"]), "-wrapper", "-inner", "-section"))
        if kind in ROLES and rng.random() < 0.15:
            return f' role="{ROLES[kind]}"'
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def part(self, kind: str, element: str, inside: str) -> str:
        """The part under its own element, or a plain one with a telling name."""
        used = self.own_element if kind == "main" else self.elements and element != "div" and self.rng.random() < 0.8
        if used:
            return f"<{element}{self.named(kind, 0.4)}>{inside}</{element}>"
        tag = self.rng.choice(("div", "div", "section"))
        return f"<{tag}{self.named(kind)}>{inside}</{tag}>"

    def link(self) -> str:
        return f'<a href="#">{escape(" ".join(self.rng.choice(self.short).split()[: self.rng.randint(1, 6)]))}</a>'

    def link_list(self) -> str:
        links = [self.link() for _ in range(self.rng.randint(2, 9))]
        way = self.rng.randrange(4)
        if way < 2:
            return f"<ul>{''.join(f'<li>{a}</li>' for a in links)}</ul>"
        return (" | " if way == 2 else " ").join(links)

    def sentence(self) -> str:
        text = self.rng.choice(self.others if self.rng.random() < 0.3 else self.short)
        words = text.split()
        return escape(" ".join(words[: self.rng.randint(3, 40)]))

    def menu(self) -> str:
        return self.part("menu", "nav", self.link_list())

    def header(self) -> str:
        rng = self.rng
        inside = f"<div{self.named('header', 0.5)}>{self.link()}</div>"
        if rng.random() < 0.5:
            inside += f"<p>{self.sentence()}</p>"
        if rng.random() < 0.4:
            inside += self.menu()
        return self.part("header", "header", inside)

    def footer(self) -> str:
        rng = self.rng
        inside = f"&copy; {rng.randint(1999, 2030)} {self.sentence()}"
        if rng.random() < 0.5:
            inside = f"<p>{inside}</p>"
        if rng.random() < 0.5:
            inside = self.link_list() + inside
        return self.part("footer", "footer", inside)

    def sidebar(self) -> str:
        boxes = []
        for _ in range(self.rng.randint(1, 4)):
            inside = f"<h3>{self.sentence()}</h3>" if self.rng.random() < 0.7 else ""
            inside += self.link_list() if self.rng.random() < 0.7 else f"<p>{self.sentence()}</p>"
            boxes.append(f"<div{self.named('sidebar', 0.5)}>{inside}</div>")
        return self.part("sidebar", "aside", "".join(boxes))

    def notice(self) -> str:
        inside = f"<p>{self.sentence()}</p>" if self.rng.random() < 0.6 else self.sentence()
        if self.rng.random() < 0.5:
            inside += f"<button>{self.rng.choice(_BUTTONS)}</button>"
        return f"<{(tag := self.rng.choice(('div', 'div', 'section', 'p')))}{self.always('notice')}>{inside if tag != 'p' else self.sentence()}</{tag}>"

    def always(self, kind: str) -> str:
        """A telling name even on a page that has no others: nothing else tells such a part."""
        kept, self.telling = self.telling, True
        name = self.named(kind)
        self.telling = kept
        return name

    def advert(self) -> str:
        inside = self.sentence() if self.rng.random() < 0.6 else f"<p>{self.sentence()}</p>"
        if self.rng.random() < 0.3:
            inside = f'<a href="#">{inside}</a>'
        tag = "aside" if self.elements and self.rng.random() < 0.2 else "div"
        return f"<{tag}{self.always('advert')}>{inside}</{tag}>"

    def form(self) -> str:
        rng = self.rng
        fields = "".join(f"<label>{self.sentence()}</label><input name=x>" for _ in range(rng.randint(1, 3)))
        inside = f"<form{self.named('form', 0.4)}>{fields}<button>{rng.choice(_BUTTONS)}</button></form>"
        if rng.random() < 0.4:
            inside = f"<p>{self.sentence()}</p>{inside}"
            return f"<div{self.always('form')}>{inside}</div>"
        return inside

    def comments(self) -> str:
        rng = self.rng
        items = []
        for _ in range(rng.randint(1, 6)):
            text = escape(" ".join(rng.choice(self.others).split()[: rng.randint(3, 60)]))
            author = escape(rng.choice(_AUTHORS))
            inside = f"<b>{author}</b> <p>{text}</p>" if rng.random() < 0.6 else f"<div>{author}</div><div>{text}</div>"
            tag = rng.choice(("div", "li", "article" if self.own_element else "div"))
            items.append(f"<{tag}{self.always('comments') if rng.random() < 0.7 else ''}>{inside}</{tag}>")
        inside = "".join(items)
        if rng.random() < 0.3:
            inside = f"<ol>{inside}</ol>"
        head = f"<h{rng.randint(2, 4)}>{rng.choice(_COMMENT_HEADS)}</h{3}>" if rng.random() < 0.7 else ""
        end = self.form() if rng.random() < 0.3 else ""
        return f"<{(tag := rng.choice(('section', 'div')))}{self.always('comments')}>{head}{inside}{end}</{tag}>"

    def block(self, text: str) -> str:
        rng, said = self.rng, MARK + escape(text)
        way = rng.random()
        if way < 0.06:
            return f"<blockquote>{said}</blockquote>"
        if way < 0.1:
            return f"<pre>{said}</pre>"
        if way < 0.16:
            words = text.split()
            cut = max(1, len(words) // 3)
            rows = [" ".join(words[i : i + cut]) for i in range(0, len(words), cut)]
            return f"<ul>{''.join(f'<li>{MARK}{escape(r)}</li>' for r in rows)}</ul>"
        if way < 0.2:
            return f"<table><tr><td>{said}</td><td>{MARK}{rng.randint(1, 99)}</td></tr></table>"
        if way < 0.24:
            return f"<figure><figcaption>{said}</figcaption></figure>"
        if way < 0.32:
            words = text.split()
            at = rng.randrange(len(words))
            linked = escape(" ".join(words[at : at + 3]))
            said = f'{MARK}{escape(" ".join(words[:at]))} <a href="#">{linked}</a> {escape(" ".join(words[at + 3:]))}'
        if way < 0.4:
            said = f"<b>{said}</b>"
        if way < 0.46:
            return f"<div>{said}</div>"
        return f"<p>{said}" + ("</p>" if self.closed else "")

    def main(self) -> str:
        rng = self.rng
        blocks = []
        for number, text in enumerate(self.texts):
            if number and rng.random() < 0.1:
                head = f"h{rng.randint(2, 4)}"
                blocks.append(f"<{head}>{MARK}{escape(' '.join(text.split()[:4]))}</{head}>")
            blocks.append(self.block(text))
        for part, odds in ((self.advert, 0.3), (self.sidebar, 0.12), (self.notice, 0.12), (self.form, 0.06)):
            if rng.random() < odds:
                blocks.insert(rng.randint(0, len(blocks)), part())
        inside = "".join(blocks)
        if rng.random() < 0.3:
            inside = f"<div{self.named('main')}>{inside}</div>"
        title = f"<h1>{MARK}{escape(self.title)}</h1>" if self.title else ""
        if title and rng.random() < 0.15 and self.elements:
            title = f"<header>{title}</header>"
        inside = title + inside
        if rng.random() < 0.25:
            social = f"<div{self.always('social')}>{self.link_list()}</div>"
            inside = social + inside if rng.random() < 0.5 else inside + social
        if rng.random() < 0.2:
            inside += self.comments()
        if rng.random() < 0.2 and self.elements:
            inside += f"<footer>{self.sentence() + ' ' + self.link() if rng.random() < 0.5 else self.link_list()}</footer>"
        element = rng.choice(("article", "article", "main"))
        out = self.part("main", element, inside)
        if rng.random() < 0.25:
            out = f"<{(tag := 'main' if self.own_element and element != 'main' else 'div')}{self.named('main', 0.6)}>{out}</{tag}>"
        return out


def _words(rng: random.Random, count: int) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(count)) + "."


def layouts(seen: list[tuple[str, list[str], list[str]]], count: int, seed: int = 13) -> list[str]:
    """``count`` pages made from (title, paragraphs, short texts) of real pages; from plain words where there are none."""
    rng = random.Random(seed)
    if not seen:
        seen = [(_words(rng, 5), [_words(rng, rng.choice((2, 8, 30, 80))) for _ in range(8)], [_words(rng, 3) for _ in range(8)]) for _ in range(20)]
    pages = []
    for _ in range(count):
        title, texts, _ = rng.choice(seen)
        _, others, short = rng.choice(seen)
        start = rng.randrange(max(1, len(texts) - 12))
        few = texts[start : start + rng.randint(1, 12)] or [title or "."]
        if rng.random() < 0.15:  # a very short article
            few = [" ".join(text.split()[: rng.randint(1, 15)]) for text in few[:2]]
        pages.append(Layout(rng, title, [t for t in few if t.split()] or ["."], [t for t in others if t.split()], [t for t in short if t.split()]).page())
    return pages
