import html
import itertools
import random
import re

import numpy as np
import pytest

from insight_spark.llm import html_extract, page_layouts, queries
from insight_spark.llm.html_tree import parse


def blocks(page):
    return [n.text for n in parse(page) if not n.tag]


def article_by_template(page):
    """The article of the given tables' pages, taken from their fixed frame."""
    inside = re.search("<article>(.*)</article>", page or "", re.S)
    parts = re.split("</?(?:p|h1)>", inside.group(1)) if inside else []
    texts = (" ".join(html.unescape(re.sub("</?b>", "", part.replace("<br>", " "))).split()) for part in parts)
    return " ".join(t for t in texts if t)


@pytest.fixture(scope="module")
def sampled(spark, small):
    return [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]


@pytest.fixture(scope="module")
def model(sampled):
    return html_extract.learn(sampled)


def test_blocks_of_a_tree():
    page = """<!doctype html><head><title>x < y</title><script>var a="</p>";</script></head><body>lead&nbsp;in<p>one <b>two</b><i>three</i>
    <p>four<br>five<div>six<!-- <p>no --> seven</div></p>eight<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>
    <style>p{}</style>1 < 2 &lt;b&gt; &copy &amp;amp; &#8364;<svg><text>no</text></svg><textarea><p>no</textarea> end <a href='x>y'>z</a> <a title="q"""
    assert blocks(page) == ["lead in", "one twothree", "four five", "six seven", "eight", "a", "b", "c", "d", "e", "f", "g", "1 < 2 <b> © &amp; € end z"]
    tags = {n.text: parse(page)[n.parent].tag for n in parse(page) if not n.tag}
    assert tags["c"] == "li" and tags["g"] == "td" and tags["eight"] == "body"


@pytest.mark.parametrize("page", ["", " ", "<", "</", "<p", "<!--", "<!-- a -- b", "<script>", "</p></div>", "<a><b><i>", "<x-y><p>", "<p>&#0;&#xD800;&bogus;", "<div/>" * 5, "<td>a<td>b"])
def test_broken_pages_do_not_fail(page, model):
    assert isinstance(html_extract.main_texts(model, [page])[0], str)


def test_deep_and_long_pages(model):
    deep = "<div>" * 20_000 + "bottom" + "</span>" * 20_000
    assert blocks(deep) == ["bottom"]
    quotes = "<a title='x" * 20_000 + "<p>" * 20_000 + "y"
    assert blocks("<p>" + "word " * 300_000)[0].count("word") == 300_000
    html_extract.main_texts(model, [deep, quotes, "<li>x" * 20_000])


def test_marginals_are_sums_over_all_labellings():
    rng = random.Random(5)
    pages = [parse("<div><p>a</p><ul><li>b<li>c</ul></div><nav>d</nav>"), parse("x"), parse("<p>y<p>z")]
    trees = html_extract.forest(pages)
    draw = np.random.default_rng(2)
    given = html_extract.Model(draw.normal(size=html_extract.WIDTH), draw.normal(size=(html_extract.KINDS, 2, 2)))
    content, pairs = html_extract.marginals(given, trees)
    scores = np.bincount(trees.owner, given.weights[trees.feature], len(trees.parent))
    for first, nodes in zip((0, len(pages[0]), len(pages[0]) + len(pages[1])), pages):
        at = range(first, first + len(nodes))
        total, one, two = 0.0, np.zeros(len(nodes)), np.zeros((len(nodes), 2, 2))
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            score = sum(scores[i] * labels[i - first] for i in at)
            score += sum(given.edges[trees.kind[i], labels[trees.parent[i] - first], labels[i - first]] for i in at if trees.parent[i] >= 0)
            weight = np.exp(score)
            total += weight
            one += weight * np.array(labels)
            for i in at:
                if trees.parent[i] >= 0:
                    two[i - first, labels[trees.parent[i] - first], labels[i - first]] += weight
        assert np.allclose(content[list(at)], one / total) and np.allclose(pairs[list(at)], two / total)
    assert rng


def test_pages_of_the_table(spark, small, sampled, model):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op13_html_extract"](spark, small).collect()}
    want = {r["page_id"]: article_by_template(r["html"]) for r in rows}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and {r["url"] for r in got.values()} == {r["url"] for r in rows}


def test_layouts_never_seen(model):
    """Nine of ten layouts exactly right, with words and names in other places than those learned from."""
    texts = []
    rng = random.Random(8)
    for _ in range(40):
        paras = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 90))) + "." for _ in range(10)]
        texts.append((f"title w{rng.randrange(99)} here", paras, [" ".join(f"s{rng.randrange(99)}" for _ in range(rng.randint(1, 12))) for _ in range(9)]))
    right = caught = wanted = given = 0
    pages = page_layouts.layouts(texts, 300, seed=77)
    for page in pages:
        nodes, labels = html_extract._marked(page)
        content = html_extract.marginals(model, html_extract.forest([nodes]))[0] >= 0.5
        leaf = np.array([not n.tag for n in nodes])
        right += (content == labels)[leaf].all()
        caught += (content & (labels == 1))[leaf].sum()
        wanted += labels[leaf].sum()
        given += content[leaf].sum()
    assert right / len(pages) > 0.85 and caught / wanted > 0.95 and caught / given > 0.98


ARTICLE = ["How the harbour was rebuilt", "The old harbour had been silted up for decades when the council met in spring.", "Work began at once.", "By autumn the first ships came in, and the town held a feast that lasted three days.", "Nobody had expected so many guests."]
BODY = "".join(f"<p>{t}</p>" for t in ARTICLE[1:])
PAGES = {
    "blog": f"""<html><body><header id="masthead"><a href="/">My blog</a><p>Notes from the coast</p></header><nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>
    <div id="content"><article class="post"><h1 class="entry-title">{ARTICLE[0]}</h1><div class="entry-content">{BODY}</div></article>
    <div id="comments"><h2>2 comments</h2><ol class="comment-list"><li><b>Ann</b><p>I was there and I remember the feast very well, thank you for this.</p></li><li><b>Bo</b><p>Great read.</p></li></ol>
    <form><label>Your comment</label><textarea></textarea><button>Post</button></form></div></div>
    <aside class="sidebar"><h3>Recent posts</h3><ul><li><a href="/x">The mill</a></li><li><a href="/y">The church</a></li></ul></aside><footer class="site-footer"><p>&copy; 2024 My blog. All rights reserved.</p></footer></body></html>""",
    "divs": f"""<body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class="topnav"><a href=1>News</a> | <a href=2>Sport</a> | <a href=3>Contact</a></div>
    <div class="wrapper"><div class="main"><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><div class="ad">Buy cheap shoes today!</div><p>{ARTICLE[2]}<p>{ARTICLE[3]}<p>{ARTICLE[4]}</div><div class="related"><h4>More stories</h4><a href=4>Storm</a> <a href=5>Flood</a></div></div>
    <div class="footer">Copyright 2020 The Paper | <a href=6>Imprint</a></div></body>""",
    "main": f"""<body><nav><a href=1>A</a><a href=2>B</a></nav><main><h1>{ARTICLE[0]}</h1>{BODY}<aside>Also read: <a href=9>the mill</a></aside></main><section class="newsletter"><p>Sign up for our letter.</p><form><input></form></section><footer>&copy; us</footer></body>""",
    "table": f"""<table><tr><td class="menu"><a href=1>Home</a><br><a href=2>Links</a><br><a href=3>Guestbook</a></td><td class="content"><h1>{ARTICLE[0]}</h1>{BODY}</td></tr></table><div id="bottom">&copy; 1999 Webmaster</div>""",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(model, name):
    assert html_extract.main_texts(model, [PAGES[name]]) == [" ".join(ARTICLE)]


# The words of the tables' pages in other frames, one clue at a time.
LONG = "Thoner of ndingor enhewh thouea thesstnd, ingnd. Retion of ineding that the edhely whth esth anlyes st inedtionor erlynd."
SHORT = "Ed sher threble the andanonen retiea attionha."
TITLE = "Onor haonnt thha on thly wh"
INSIDE = f"<h1>{TITLE}</h1><p>{LONG}</p><p>Sh is.</p><p>{SHORT}</p>"
WANT = f"{TITLE} {LONG} Sh is. {SHORT}"
OTHER = "Nicht aulich für sch erüver enau sch der."
HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>'
NAV = '<nav><ul><li><a href="/The">The</a></li><li><a href="/and">and</a></li><li><a href="/to">to</a></li></ul></nav>'
FOOT = '<footer>&copy; tiontion.example.net &middot; En laleenéelle la des et.</footer></body></html>'
FRAMES = {
    "base": HEAD + NAV + f'<div class="ad">{OTHER}</div><article>{INSIDE}</article>' + FOOT,
    "main": HEAD + NAV + f'<main>{INSIDE}</main>' + FOOT,
    "div content": HEAD + NAV + f'<div id="content">{INSIDE}</div>' + FOOT,
    "div post": HEAD + f'<div class="menu"><a href=1>Home</a> <a href=2>About</a></div><div class="post">{INSIDE}</div><div class="footer">{OTHER} &copy; 2020</div>',
    "header elem": HEAD + f'<header><h2>{OTHER}</h2><p>{SHORT}</p></header>' + NAV + f'<article>{INSIDE}</article>' + FOOT,
    "sidebar aside": HEAD + NAV + f'<article>{INSIDE}</article><aside><h3>Recent</h3><p>{OTHER}</p><p>{LONG}</p></aside>' + FOOT,
    "sidebar div": HEAD + NAV + f'<article>{INSIDE}</article><div class="sidebar"><h3>Recent</h3><p>{OTHER}</p><p>{LONG}</p></div>' + FOOT,
    "cookie": HEAD + NAV + f'<div class="cookie-notice"><p>{OTHER}</p><button>OK</button></div><article>{INSIDE}</article>' + FOOT,
    "cookie id": HEAD + NAV + f'<div id="cookie-consent">{LONG}</div><article>{INSIDE}</article>' + FOOT,
    "notice in article": HEAD + NAV + f'<article><div class="notice">{OTHER}</div>{INSIDE}</article>' + FOOT,
    "ad in article": HEAD + NAV + f'<article><h1>{TITLE}</h1><p>{LONG}</p><div class="ad">{OTHER}</div><p>Sh is.</p><p>{SHORT}</p></article>' + FOOT,
    "ad aside in article": HEAD + NAV + f'<article><h1>{TITLE}</h1><p>{LONG}</p><aside class="ad">{OTHER}</aside><p>Sh is.</p><p>{SHORT}</p></article>' + FOOT,
    "comments section": HEAD + NAV + f'<article>{INSIDE}</article><section class="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div><div class="comment"><p>{SHORT}</p></div></section>' + FOOT,
    "comments id": HEAD + NAV + f'<article>{INSIDE}</article><div id="comments"><h3>Comments</h3><ul><li>{LONG}</li><li>{SHORT}</li></ul></div>' + FOOT,
    "comments in article": HEAD + NAV + f'<article>{INSIDE}<section id="comments"><h3>2 comments</h3><p>{LONG}</p><p>{SHORT}</p></section></article>' + FOOT,
    "comment articles": HEAD + NAV + f'<article>{INSIDE}</article><section class="comments"><article class="comment">{LONG}</article><article class="comment">{SHORT}</article></section>' + FOOT,
    "form": HEAD + NAV + f'<form action="/s"><label>{OTHER}</label><input name=q><button>Go</button></form><article>{INSIDE}</article>' + FOOT,
    "newsletter form": HEAD + NAV + f'<article>{INSIDE}</article><form class="newsletter"><p>{OTHER}</p><input type=email><button>Subscribe</button></form>' + FOOT,
    "form in article": HEAD + NAV + f'<article>{INSIDE}<form><p>{OTHER}</p><select><option>a<option>b</select></form></article>' + FOOT,
    "table": HEAD + f'<table><tr><td><ul><li><a href=1>The</a></li><li><a href=2>and</a></li></ul></td><td>{INSIDE}</td></tr></table>' + FOOT,
    "article header": HEAD + NAV + f'<article><header><h1>{TITLE}</h1></header><p>{LONG}</p><p>Sh is.</p><p>{SHORT}</p></article>' + FOOT,
    "article footer": HEAD + NAV + f'<article>{INSIDE}<footer>Posted in <a href=1>foo</a></footer></article>' + FOOT,
    "share": HEAD + NAV + f'<article>{INSIDE}<div class="share"><a href=1>Tweet</a> <a href=2>Share</a></div></article>' + FOOT,
    "related": HEAD + NAV + f'<article>{INSIDE}<div class="related-posts"><h3>Related</h3><ul><li><a href=1>{OTHER}</a></li><li><a href=2>{SHORT}</a></li></ul></div></article>' + FOOT,
    "lists": HEAD + NAV + f'<article><h1>{TITLE}</h1><ul><li>{LONG}</li><li>Sh is.</li></ul><blockquote>{SHORT}</blockquote></article>' + FOOT,
    "sections": HEAD + NAV + f'<article><h1>{TITLE}</h1><section><p>{LONG}</p></section><section><p>Sh is.</p><p>{SHORT}</p></section></article>' + FOOT,
    "popup": HEAD + f'<div class="popup"><p>{LONG}</p></div>' + NAV + f'<article>{INSIDE}</article>' + FOOT,
    "breadcrumb": HEAD + NAV + f'<div class="breadcrumb"><a href=1>The</a> &gt; <a href=2>and</a> &gt; to</div><article>{INSIDE}</article>' + FOOT,
    "hidden": HEAD + NAV + f'<div style="display:none">{OTHER}</div><article>{INSIDE}</article>' + FOOT,
    "h2 headings": HEAD + NAV + f'<article><h1>{TITLE}</h1><h2>{LONG}</h2><p>Sh is.</p><h3>{SHORT}</h3></article>' + FOOT,
    "skip": HEAD + f'<a href="#main">Skip to content</a>' + NAV + f'<article>{INSIDE}</article>' + FOOT,
    "dialog": HEAD + NAV + f'<dialog open><p>{OTHER}</p></dialog><article>{INSIDE}</article>' + FOOT,
    "alert": HEAD + NAV + f'<div class="alert alert-info" role="alert">{OTHER}</div><article>{INSIDE}</article>' + FOOT,
    "promo": HEAD + NAV + f'<article>{INSIDE}</article><section class="promo"><p>{OTHER}</p></section><section class="sponsored"><p>{SHORT}</p></section>' + FOOT,
    "gdpr": HEAD + NAV + f'<section class="gdpr"><p>{OTHER}</p></section><article>{INSIDE}</article>' + FOOT,
    "newsletter div": HEAD + NAV + f'<article>{INSIDE}</article><div class="newsletter"><p>{OTHER}</p></div>' + FOOT,
    "bio": HEAD + NAV + f'<article>{INSIDE}</article><div class="author-bio"><p>{OTHER}</p></div>' + FOOT,
}


@pytest.mark.parametrize("name", FRAMES)
def test_frames_around_one_article(model, name):
    assert html_extract.main_texts(model, [FRAMES[name]]) == [WANT]


def test_nulls_repeats_clashes_and_empty_tables(spark, sampled, model):
    rows = [(1, "u", None, 5, "x"), (None, None, "", 6, "y"), (2, "v", PAGES["blog"], 7, "z"), (2, "v", PAGES["blog"], 7, "z"), (3, "w", "plain text", 8, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in html_extract.extract(frame, model).collect()), key=repr)
    text = " ".join(ARTICLE)
    assert [g for g in got if g[0] == 2] == [(2, "v", text, len(text))] * 2
    assert (1, "u", "", 0) in got and (None, None, "", 0) in got and len(got) == 5
    assert html_extract.extract(frame.limit(0), model).count() == 0
    bare = html_extract.train(frame.limit(0))
    assert html_extract.main_texts(bare, [PAGES["blog"]]) == [text]
