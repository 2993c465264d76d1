"""Main text of pages against their known articles."""

import html
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewell.llm import html_text as H

ARTICLE = "<p>The first paragraph of a story, with several words in it.</p><p>A second   one &amp; more,\n <i>of</i> it.<br>Line.</p><p>Ok.</p>"
TEXT = "The first paragraph of a story, with several words in it.\n\nA second one & more, of it. Line.\n\nOk."
LONG = "words and more words in a box that is as long as a paragraph would be, and then some more of them"

PAGES = {
    "article": f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>c</footer></body></html>",
    "main": f"<body><header><p>{LONG}</p></header><main>{ARTICLE}</main><aside><p>{LONG}</p></aside></body>",
    "named": f"<body><div id='page'><div class='nav-main'><p>{LONG}</p></div><div class='post-content'>{ARTICLE}</div><div class='sidebar'><p>{LONG}</p></div></div></body>",
    "plain": f"<body><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul><div>{ARTICLE}</div></body>",
    "comments": f"<body><article>{ARTICLE}<section id='comments'><article class='comment'><p>{LONG}</p></article></section></article></body>",
    "notices": f"<body><div class='cookie-notice'><p>{LONG}</p></div><div role='alert'>{LONG}</div><article>{ARTICLE}<form><p>{LONG}</p></form><div class='ad'>{LONG}</div></article></body>",
    "scripts": f"<body><article><script>var x = '<p>no</p>';</script><style>p {{}}</style>{ARTICLE}<!-- <p>no</p> --><noscript><p>{LONG}</p></noscript></article></body>",
    "unclosed": f"<body><article><p>{'The first paragraph of a story, with several words in it.'}<p>A second one &amp; more, <i>of it.<br>Line.<p>Ok.",
    "hidden": f"<body><article>{ARTICLE}<p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p aria-hidden=true>{LONG}</p></article></body>",
    "wrapped": f"<body class='has-sidebar'><div><div><article><div class='text'>{ARTICLE}</div></article></div></div></body>",
    "words": f"<body><div id=leftSidebar2><p>{LONG}</p></div><div class='ad1'>{LONG}</div><div class='usercomments x'><p>{LONG}</p></div><article class='story has-comments uploads'>{ARTICLE}</article></body>",
    "upper": f"<BODY><ARTICLE>{ARTICLE}</ARTICLE><DIV CLASS=\"Footer\">{LONG}</DIV></BODY>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_article(name):
    assert H.main_text(PAGES[name]) == TEXT


@pytest.mark.parametrize("source, text", [(None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("<!-- open", ""), ("<p>x", "x"), ("</p></div>x", "x"), ("&lt;b&gt; &#228;&nbsp;&eacute;", "<b> ä é"), ("<p a='>'>x</p>", "x"), ('<p a="b>x', '')])
def test_odd_sources(source, text):
    assert H.main_text(source) == text


def test_depth_and_length():
    assert H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(H.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").split("\n\n")) == 20_000


def test_links_lower_density():
    links = "".join(f"<a href=x{i}>some words of a link {i}</a> " for i in range(40))
    assert H.main_text(f"<body><div><div>{links}</div></div><div>{ARTICLE}</div></body>") == TEXT


@pytest.mark.parametrize(
    "inner, kept",
    [
        ("<h2 class='section-header'>Part two</h2>", "Part two"), ("<p class='form'>A form of words.</p>", "A form of words."), ("<p class='social-science'>A science.</p>", "A science."),
        ("<section class='notice-period'><p>Thirty days.</p></section>", "Thirty days."), ("<div class='search-results'><p>Found.</p></div>", "Found."),
        ("<p>We <span class='ad'>buy <span>x</span> now</span> go.</p>", "We go."), ("<script src='a.js'/>alert(1)</script>", ""), ("<p>Say <span class=ad>buy</p><p>next.</p>", "Say\n\nnext."),
        ("<div class='post-comments'><p>First!</p></div><div class='article-header'><p>By her.</p></div>", "By her."), ("<svg/><p>After a drawing.</p>", "After a drawing."), ("<p title='a>b' data-class='ad'>Whole.</p>", "Whole."),
    ],
)
def test_names_and_ends_are_those_of_the_page(inner, kept):
    assert H.main_text(f"<body><article>{ARTICLE}{inner}</article></body>") == "\n\n".join(filter(None, [TEXT, kept]))


@pytest.mark.parametrize("part", ["<a ", "<a x=\">\"", "<span class=ad>", "<div>", "<blockquote><td></td>", "<div></section>", "<!--", "</p ", "<li><ul>", "<script>x</script ", "<a href='", "<p><b class=ad>x"])
def test_hostile_pages_take_time_in_proportion(part):
    H.main_text(part * 1000)
    times = []
    for n in (15_000, 60_000):
        began = time.process_time()
        H.main_text(part * n)
        times.append(time.process_time() - began)
    assert times[1] < 9 * times[0] + 0.3


def plain_text(root):
    """The same choice by plain recursion over a tree of (children) lists and (text) leaves, on pages without article or main elements."""
    nodes, parent = [], {}

    def visit(x, up):
        nodes.append(x)
        parent[id(x)] = up
        for y in x:
            if isinstance(y, list):
                visit(y, x)

    visit(root, None)
    texts = lambda x: [t for y in x for t in (texts(y) if isinstance(y, list) else [y])]
    tags = lambda x: sum(1 + tags(y) for y in x if isinstance(y, list))
    chars = lambda t: (len(re.sub("<[^>]*>", "", t)), sum(map(len, re.findall("<a>(.*?)</a>", t))), t.count("<a>"))
    every = [chars(t) for t in texts(root)]
    share = sum(x[1] for x in every) / max(1, sum(x[0] for x in every))

    def density(t, found):
        c, lc, lt = (sum(x[k] for x in found) for k in range(3))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        value = math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
        return c / max(1, t) * (value / math.log(base) if base > 1 else value + 1)

    own = {id(x): density(tags(x), [chars(t) for t in texts(x)]) for x in nodes}
    total = {id(x): sum(own[id(y)] if isinstance(y, list) else density(0, [chars(y)]) for y in x) for x in nodes}
    core = max(enumerate(nodes), key=lambda k: (total[id(k[1])], k[0]))[1]
    path = [core]
    while parent[id(path[-1])] is not None:
        path.append(parent[id(path[-1])])
    least = min(own[id(x)] for x in path)
    dense = [x for x in nodes if not any(x is y for y in path) and own[id(x)] >= least and own[id(x)] > 0]

    def below(x):
        return [x] + [z for y in x if isinstance(y, list) for z in below(y)]

    smallest = next(x for x in path if all(any(d is z for z in below(x)) for d in dense))
    chosen = [smallest]
    if smallest is root and core is not root:
        chosen = [core] + [max(below(d), key=lambda z: total[id(z)]) for d in dense]
    out = []

    def write(x, inside):
        inside = inside or any(x is c for c in chosen)
        for y in x:
            if isinstance(y, list):
                write(y, inside)
            elif inside:
                out.append(re.sub("<[^>]*>", "", y))

    write(root, False)
    return "\n\n".join(out)


def test_choice_equals_the_plain_program():
    rng = random.Random(8)
    for _ in range(400):

        def tree(depth):
            out = []
            for _ in range(rng.randint(1, 4)):
                if depth and rng.random() < 0.7:
                    out.append(tree(depth - 1))
                elif not out or isinstance(out[-1], list):
                    words = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 20, 80, 300])))
                    out.append(f"{words}<a>{words[:9]}</a>" if rng.random() < 0.3 else words)
            return out

        root = tree(4)
        show = lambda x: "".join(f"<div>{show(y)}</div>" if isinstance(y, list) else y for y in x)
        assert H.main_text(f"<body>{show(root)}</body>") == plain_text(root)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (None, "<p>x</p>", None, "c"), (2, "<p>y</p>", "a", "b"), (2, "<p>y</p>", "a", "b")], "page_id long, html string, text string, _html string")
    got = H.extract(df)
    assert got.columns == ["page_id", "_html", "text"]
    assert sorted((r.page_id or 0, r.text, r._html) for r in got.collect()) == [(0, "x", "c"), (1, "", "b"), (2, "y", "b"), (2, "y", "b")]
    assert H.extract(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "<div><p>" + "word " * 400_000 + "</p></div>")], "page_id long, html string")
    assert H.extract(long).select(F.length("text")).first()[0] == 5 * 400_000 - 1
