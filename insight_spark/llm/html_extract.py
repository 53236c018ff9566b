"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text block is a node that is content or not. A node's own
potential is a weighted sum of what can be seen of it, a parent and a child share a
potential by the kind of the child. Sum-product messages pass up to the root and
down again, which is exact on a tree, and give each node its marginal. The weights
maximise the likelihood of labelled pages: the expected counts of what is seen, from
the same two passes, are drawn to the counts under the labels.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import map_chunks, text_column
from insight_spark.llm.html_tree import Node, parse
from insight_spark.llm.page_layouts import MARK, NAMES, layouts

# Pages to learn from, their length, and the layouts made of them.
SAMPLE = 500
SAMPLE_CHARS = 30_000
LAYOUTS = 1800
WIDTH = 1 << 14  # hashed places of what is seen
ROUNDS = 200
CHUNK_NODES = 200_000
KNOWN = sorted({part for names in NAMES.values() for name in names for part in name.lower().split("-")}, key=len, reverse=True)
_AROUND = frozenset("nav aside footer form dialog menu".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dd dt address summary caption label legend".split())
_KINDS = {"": 0} | dict.fromkeys(_FLOW, 1) | dict.fromkeys(("div", "section", "center", "fieldset", "details"), 2)
_KINDS |= dict.fromkeys(_AROUND | {"header"}, 3) | dict.fromkeys(("article", "main", "body", "html", "root"), 4)
_KINDS |= dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), 5) | dict.fromkeys(("ul", "ol", "dl", "figure"), 6)
KINDS = 8


class Model(NamedTuple):
    weights: np.ndarray  # per hashed feature, for content
    edges: np.ndarray  # kind of the child, label of the parent, label of the child


class Forest(NamedTuple):
    """Nodes of several pages, a parent always before its children."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes by depth, the roots first
    feature: np.ndarray  # hashed features, node after node
    owner: np.ndarray  # their nodes


def _hashed(name: str, cache: dict[str, int] = {}) -> int:
    place = cache.get(name)
    if place is None:
        place = crc32(name.encode()) % WIDTH
        if len(cache) < 100_000:
            cache[name] = place
    return place


def _bin(value: float, limits: tuple[float, ...]) -> int:
    return sum(value >= limit for limit in limits)


def _known(part: str, cache: dict[str, str] = {}) -> str:
    """The part, or the longest known name it begins or ends with."""
    found = cache.get(part)
    if found is None:
        found = part if part in KNOWN else next((k for k in KNOWN if len(k) > 3 and (part.startswith(k) or part.endswith(k))), part)
        if len(cache) < 100_000:
            cache[part] = found
    return found


def _seen(nodes: list[Node]) -> list[list[int]]:
    """Hashed features of every node of a page."""
    count = len(nodes)
    chars, linked, words, blocks, heads = ([0] * count for _ in range(5))
    for i in range(count - 1, -1, -1):
        node = nodes[i]
        if not node.tag:
            chars[i], linked[i], words[i], blocks[i] = len(node.text), node.linked, node.text.count(" ") + 1, 1
        heads[i] += node.tag == "h1"
        if node.parent >= 0:
            for total in (chars, linked, words, blocks, heads):
                total[node.parent] += total[i]
    tags = Counter(node.tag for node in nodes)
    marked = tags["article"] + tags["main"] > 0
    inside = [False] * count
    out = []
    for i, node in enumerate(nodes):
        dense = _bin(linked[i] / chars[i], (0.01, 0.34, 0.67, 0.99)) if chars[i] else 5
        if node.tag:
            each = _bin(words[i] / max(1, blocks[i]), (2, 5, 10, 20))
            names = [f"t={node.tag}", f"td={node.tag},{dense}", f"head={heads[i] > 0}"]
            if node.tag not in _FLOW and node.tag not in ("article", "main"):  # short ones are no less the article
                names += [f"d={dense}", f"w={_bin(words[i], (1, 10, 50, 200))}", f"e={each}", f"de={dense},{each}"]
            for part in node.names:
                names.append(f"n={_known(part)}")
            names.append("named" if node.names else "bare")
            if node.tag in ("article", "main", "h1"):
                names.append(f"only={node.tag},{tags[node.tag] == 1}")
        else:
            above = nodes[node.parent]
            long = _bin(words[i], (2, 5, 10, 25, 50))
            names = [f"b={dense}", f"l={long}", f"bl={dense},{long}", f"a={above.tag}", f"end={node.text[-1] in '.!?:;'}", f"al={above.tag},{min(long, 3)}"]
            if "©" in node.text or "|" in node.text:
                names.append("sign=" + ("c" if "©" in node.text else "p"))
        names.append("bias" if node.tag else "text")
        if marked and i:  # where the page has an element for its article
            inside[i] = inside[node.parent] or node.tag in ("article", "main")
            names += [f"where={inside[i]}", f"where={inside[i]},{node.tag}"]
        out.append([_hashed(name) for name in names])
    return out


def forest(pages: list[list[Node]]) -> Forest:
    parent, kind, depth, feature, sizes = [], [], [], [], []
    for nodes in pages:
        base = len(parent)
        for node, seen in zip(nodes, _seen(nodes)):
            above = node.parent + base if node.parent >= 0 else -1
            parent.append(above)
            depth.append(depth[above] + 1 if above >= 0 else 0)
            kind.append(_KINDS.get(node.tag, 7))
            feature += seen
            sizes.append(len(seen))
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    cuts = np.searchsorted(deep[order], np.arange(1, deep.max() + 1)) if len(deep) else []
    return Forest(
        np.array(parent, np.int64), np.array(kind, np.int64), np.split(order, cuts),
        np.array(feature, np.int64), np.repeat(np.arange(len(sizes)), sizes),
    )


def marginals(model: Model, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
    """P(content) per node, and P(parent's label, child's label) per node that has a parent (others 0)."""
    count = len(trees.parent)
    inside = np.zeros((count, 2))
    inside[:, 1] = np.bincount(trees.owner, model.weights[trees.feature], count)
    edge = model.edges[trees.kind]  # node, label of the parent, label of the node
    upward = np.zeros((count, 2))
    for level in trees.levels[:0:-1]:  # from the deepest to those below the roots
        sent = np.logaddexp(edge[level, :, 0] + inside[level, None, 0], edge[level, :, 1] + inside[level, None, 1])
        upward[level] = sent
        above = trees.parent[level]
        for label in (0, 1):
            inside[:, label] += np.bincount(above, sent[:, label], count)
    whole = inside.copy()
    pairs = np.zeros((count, 2, 2))
    for level in trees.levels[1:]:
        rest = whole[trees.parent[level]] - upward[level]
        joint = rest[:, :, None] + edge[level] + inside[level, None, :]
        whole[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -50, 50))), pairs


def fit(pages: list[list[Node]], labels: list[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Weights of the greatest likelihood (with a small penalty on their size) for pages whose nodes are labelled."""
    trees = forest(pages)
    truth = np.concatenate(labels).astype(np.int64)
    model = Model(np.zeros(WIDTH), np.zeros((KINDS, 2, 2)))
    child = np.flatnonzero(trees.parent >= 0)
    wanted = np.zeros((KINDS, 2, 2))
    np.add.at(wanted, (trees.kind[child], truth[trees.parent[child]], truth[child]), 1)
    scale = 1 / len(truth)
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in model]
    for step in range(1, rounds + 1):
        content, pairs = marginals(model, trees)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, trees.kind[child], pairs[child])
        slopes = (
            np.bincount(trees.feature, (truth - content)[trees.owner], WIDTH) * scale - 1e-5 * model.weights,
            (wanted - expected) * scale - 1e-5 * model.edges,
        )
        for value, slope, (mean, square) in zip(model, slopes, memory):
            mean *= 0.9
            mean += 0.1 * slope
            square *= 0.99
            square += 0.01 * slope**2
            value += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model


def _element_labels(nodes: list[Node], told: dict[int, int]) -> np.ndarray:
    """Labels of all nodes from those of the text blocks: an element is content if most characters below it are."""
    good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if not nodes[i].tag:
            (good if told[i] else bad)[i] += len(nodes[i].text)
        if nodes[i].parent >= 0:
            good[nodes[i].parent] += good[i]
            bad[nodes[i].parent] += bad[i]
    return (good > bad).astype(np.int64)


def told_by_markup(nodes: list[Node]) -> dict[int, int] | None:
    """Labels of a page's text blocks where its own elements tell them: inside article or main, outside what stands
    around a text. None where there is neither or both hold other articles."""
    inside, around = [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            inside[i] = inside[node.parent] or node.tag in ("article", "main")
            around[i] = around[node.parent] or node.tag in _AROUND
    found = {i: int(inside[i] and not around[i]) for i, node in enumerate(nodes) if not node.tag}
    return found if sum(node.tag == "article" for node in nodes) <= 1 and any(found.values()) else None


def _marked(html: str) -> tuple[list[Node], np.ndarray]:
    nodes, told = [], {}
    for i, node in enumerate(parse(html)):
        if not node.tag:
            told[i] = int(MARK in node.text)
            node = node._replace(text=node.text.replace(MARK, "").strip() or ".")
        nodes.append(node)
    return nodes, _element_labels(nodes, told)


def learn(sampled: list[str], count: int = LAYOUTS) -> Model:
    """A model from pages that tell their article themselves, and from their texts laid out anew."""
    pages, labels, texts = [], [], []
    for html in sampled:
        nodes = parse(html)
        told = told_by_markup(nodes)
        if told is None:
            continue
        pages.append(nodes)
        labels.append(_element_labels(nodes, told))
        good = [i for i, label in told.items() if label]
        heads = [i for i in good if nodes[nodes[i].parent].tag in ("h1", "h2")]
        title = nodes[heads[0]].text if heads else ""
        texts.append((title, [nodes[i].text for i in good if i not in heads[:1]], [nodes[i].text for i, label in told.items() if not label]))
    for html in layouts(texts, count):
        nodes, label = _marked(html)
        pages.append(nodes)
        labels.append(label)
    return fit(pages, labels)


def train(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Learned from at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the id and the page.

    Without any such page, plain words are laid out instead.
    """
    html = F.col(html_col).cast("string")
    given = df.select(F.xxhash64(F.col(id_col).cast("string"), html).alias("order"), html.alias("html"))
    # Only about four times as many pages as are wanted come to the driver, however many tasks look for them.
    share = min(1.0, 4 * sample / max(1, df.count()))
    chosen = given.filter(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    taken = chosen.filter(F.length("html").between(1, SAMPLE_CHARS)).orderBy("order", "html").limit(sample).collect()
    return learn([row["html"] for row in taken])


def main_texts(model: Model, htmls: list[str]) -> list[str]:
    """The content blocks of each page in page order, joined by a space."""
    out: list[str] = []
    pages: list[list[Node]] = []

    def judge() -> None:
        content, _ = marginals(model, forest(pages))
        at = 0
        for nodes in pages:
            out.append(" ".join(n.text for i, n in enumerate(nodes) if not n.tag and content[at + i] >= 0.5))
            at += len(nodes)
        pages.clear()

    held = 0
    for html in htmls:
        pages.append(parse(html))
        held += len(pages[-1])
        if held >= CHUNK_NODES:
            judge()
            held = 0
    if pages:
        judge()
    return out


def extract(
    df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: id, url, text, n_chars. Null, empty and text-free pages have an empty text.

    Rows are judged one by one: repeated rows and null ids stay, an empty table gives no
    rows, other columns are not read. Pages of any length are taken whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(shared.value, text_column(chunk, "html").to_pylist())
        lengths = pa.array([len(text) for text in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*chunk.columns[:2], pa.array(texts, pa.string()), lengths], names=["id", "url", "text", "n_chars"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    given = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    found = map_chunks(given, work, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
