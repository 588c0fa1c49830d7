"""Main text: the reader, the trees, the decoding against all choices, the given pages, and layouts the model has not seen."""

import html
import itertools
import re

import numpy as np
import pytest

from factorspark.llm import boosting, dom, layouts, main_text

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def fewer_layouts(monkeypatch):
    """Training takes its time; a part of the rendered pages is enough here."""
    monkeypatch.setattr(main_text, "RENDERED", 250)


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return main_text.learn(pages[:150])


def all_text(source):
    nodes = dom.Nodes()
    dom.read(nodes, source)
    return dom.lines([t for t in nodes.text if t], [b for t, b in zip(nodes.text, nodes.block, strict=True) if t])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<b>c</b> d\n e", "a\nbc d e"), ("<ul><li>x<li>y</ul>z", "x\ny\nz"),
        ("<p>a<!-- <p>no -->b</p><script>var t='</p>';</script>c", "ab\nc"), ("<head><title>no</title><p>yes", "yes"), ("a<br>b<br/>c", "a b c"),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n2\n3\n4"), ("<div>a</span></p></article>b</div>c", "ab\nc"), ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ('<p title="a > b">x</p><p hidden>no</p><p style="display: none">no</p>', "x"), ("<p>caf&eacute; &#233;&#xe9; &am &amp", "café éé &am &"),
        ("<div><p><b>open<br><p>next</div>after", "open\nnext\nafter"), ("<P>A</P><DIV CLASS=Nav>B</DIV>", "A\nB"), ("<select><option>a<option>b</select>", "a\nb"),
        ('<p class="unbalanced>x</p>', "x"), ("<script>never closed", ""), ("<!-- never closed <p>x", ""), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ],
)
def test_reader(source, want):
    assert all_text(source) == want


def test_reader_survives_depth():
    assert all_text("<div>" * 30_000 + "x" + "</div>" * 10) == "x"


def test_subtrees(pages):
    shape = main_text.read_pages(pages[:5] + ["", "x"])
    for k in range(len(shape.index)):
        below = {k}
        for j in range(k + 1, len(shape.index)):
            if shape.parent[j] in below:
                below.add(j)
        assert shape.end[k] == max(below) + 1 and shape.chars[k] == sum(len(shape.nodes.text[j]) for j in below)
        if k > 400:
            break


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    trees = boosting.train(x[:3000], y[:3000], 3, rounds=60)
    assert (boosting.log_probabilities(trees, x[3000:]).argmax(axis=1) == y[3000:]).mean() > 0.93


def consistent(states, shape):
    for k, up in enumerate(shape.parent):
        if shape.chars[k] == 0:
            continue
        if shape.is_text[k] and states[k] == main_text.DIVIDED:
            return False
        if up >= 0 and states[up] != main_text.DIVIDED and states[k] != states[up]:
            return False
    return True


@pytest.mark.parametrize("seed", range(12))
def test_decoding_is_the_best_consistent_choice(seed):
    source = ["<div>a<p>b</p><i></i></div>c", "<ul><li>a<li>b</ul>", "a<div><div>b</div></div>"][seed % 3]
    shape = main_text.read_pages([source])
    n = len(shape.index)
    logs = np.log(np.random.default_rng(seed).dirichlet([1, 1, 1], n))
    seen = [k for k in range(n) if shape.chars[k] > 0]
    best, answer = -np.inf, None
    for choice in itertools.product(range(3), repeat=len(seen)):
        states = np.zeros(n, dtype=int)
        states[seen] = choice
        if consistent(states, shape) and (value := logs[seen, choice].sum()) > best:
            best, answer = value, states
    assert (shape.decode(logs) == (shape.is_text & (answer == main_text.KEEP))).all()


def article(source):
    """What the given pages hold between their article tags."""
    inner = re.search("<article>(.*?)</article>", source, re.S)[1]
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark, pages):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = main_text.extract(df).collect()
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in df.collect()}
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_layouts_not_seen(model, pages):
    """Texts of other pages, other layouts: nearly all characters right, and most pages to the last word."""
    plain = main_text.read_pages(pages[150:])
    texts = sorted({t.strip() for t in plain.nodes.text if len(t.split()) >= 3})
    words = sorted({w for t in plain.nodes.text for w in t.split()})
    sources = layouts.render(texts, words, 200, seed=77)
    shape = main_text.read_pages(sources)
    marked = np.array([layouts.MARK in t for t in shape.nodes.text])
    clean = [s.replace(layouts.MARK, "") for s in sources]
    got = main_text.main_texts(model, clean)
    right = []
    for k, (a, b) in enumerate(zip(shape.nodes.pages, shape.nodes.pages[1:], strict=False)):
        at = a + np.flatnonzero(marked[a:b])
        right.append(dom.lines([shape.nodes.text[i].replace(layouts.MARK, "") for i in at], [shape.nodes.block[i] for i in at]) == got[k])
    assert np.mean(right) > 0.85


PARTS = """<body><div id="cookie-consent"><p>We use cookies to make this page better, and we share some of them with others.</p><button>Accept</button></div>
<div class="site-header"><a href="/">Daily News</a><ul class="menu"><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Money</a></li></ul></div>
<div class="wrap"><div class="{name}"><h1>Bridge opens after ten years</h1><p>The bridge over the river was opened on Monday, ten years after work had begun.</p>
<div class="ad-slot">Buy one, get one free, today only.</div><p>Short.</p><p>Drivers had waited, some of them <a href="/x">for hours</a>, to be the first to cross it.</p>
<ul><li>It is two miles long, and toll is free.</li><li>Trains will follow next year.</li></ul></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten things to know about trains</a></li><li><a href="/2">The best of the week</a></li></ul></div>
<form class="newsletter"><p>Get our news by mail, every day.</p><input name=m><button>Send</button></form>
<div id="comments"><h3>2 comments</h3><div class="comment"><b>anna</b><p>I have crossed it this morning, and it was a great view over the river and the hills.</p></div>
<div class="comment"><b>otto</b><p>What a waste of money, they should have built a tunnel under the river.</p></div></div></div>
<div class="footer"><p>&copy; 2024 Daily News. All rights reserved.</p></div></body>"""
ANSWER = """Bridge opens after ten years
The bridge over the river was opened on Monday, ten years after work had begun.
Short.
Drivers had waited, some of them for hours, to be the first to cross it.
It is two miles long, and toll is free.
Trains will follow next year."""


@pytest.mark.parametrize("name", ["article-body", "post", "entry-content", "q7"])
def test_page_by_hand(model, name):
    assert main_text.main_texts(model, [PARTS.replace("{name}", name)]) == [ANSWER]


SCHEMA = "page_id long, url string, html string, text string, place string"


def test_edges(spark, pages):
    long = pages[0].replace("</article>", "<p>more words here, and there.</p>" * 20_000 + "</article>")
    rows = [(1, "u", pages[0], "x", "x"), (1, "u", pages[0], "x", "x"), (None, None, pages[1], None, None), (3, "u", None, "x", "x"), (4, "u", "", "x", "x"), (5, "u", "<p>", "x", "x"), (6, "u", long, "x", "x")]
    got = main_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == article(pages[0]) and by[None]["text"] == article(pages[1])
    assert by[3]["text"] == by[4]["text"] == by[5]["text"] == "" and by[3]["n_chars"] == 0
    assert by[6]["text"].endswith("\n".join(["more words here, and there."] * 20_000)) and by[6]["n_chars"] == len(by[6]["text"])


def test_empty(spark):
    assert main_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["text"] for r in main_text.extract(spark.createDataFrame([(1, "u", None, "", ""), (2, "u", "", "", "")], SCHEMA)).collect()] == ["", ""]
