"""HTML extraction: blocks, the random field against enumeration, and whole pages of known text."""

import html
import itertools
import re

import numpy as np
import pytest

from orogrid.llm import dom, extraction
from orogrid.llm.queries import op13_html_extraction

SMALL = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in dom.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>one<p>two", ["one", "two"]), ("<p>a<b>b</b> c<br>d</p>", ["ab c d"]), ("<p>x<!-- <p>no</p> -->y</p>", ["xy"]), ("<script>var t='</p><p>no';</script><p>a", ["a"]),
        ("<head><title>T</title><style>p{}</style></head><body>b", ["b"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ('<p title="a > b">x</p>', ["x"]), ('<p title="open>x</p>', ["x"]),
        ("a < b and <3", ["a < b and <3"]), ("<p>cut <b", ["cut"]), ("<p>\n a \t b&nbsp;c　d\n</p>", ["a b c d"]), ("<script>never closed <p>x", []), ("<!-- open <p>x", []), ("</p></div>x", ["x"]), ("<p>&lt;b&gt; &#65;&#x42; &eacute &am", ["<b> AB é &am"]), ("<DIV CLASS=A>x</DIV>", ["x"]),
        ("<div>" * 5000 + "deep", ["deep"]), ("<p>" + "w " * 100_000, [("w " * 100_000).strip()]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    (a, b) = dom.blocks('<div class="Side-Bar x1" id=top><p><a href="/">link</a> text</p></div><p>after</p>')
    assert [e.tag for e in a.path] == ["div", "p"] and a.path[0].words == ("side", "bar", "x", "top") and a.link == 4
    assert [e.tag for e in b.path] == ["p"] and b.link == 0
    assert len(dom.blocks("<div>" * 5000 + "deep")[0].path) == dom.DEEP


def chains(seed):
    rng = np.random.default_rng(seed)
    size = [3, 1, 4, 2]
    first = np.cumsum([0, *size[:-1]])
    n = sum(size)
    return rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 2, n), first, rng.normal(size=(3, 2, 2)), size


def value(score, kind, label, edges):
    return sum(score[label == 1]) + sum(edges[kind[k], label[k - 1], label[k]] for k in range(1, len(label)))


def test_viterbi_equals_enumeration():
    for seed in range(10):
        score, kind, _, first, edges, size = chains(seed)
        got = extraction.viterbi(score, kind, first, edges)
        for lo, n in zip(first, size, strict=True):
            part = slice(lo, lo + n)
            best = max(value(score[part], kind[part], np.array(y), edges) for y in itertools.product((0, 1), repeat=n))
            assert np.isclose(value(score[part], kind[part], got[part], edges), best)


def test_likelihood_equals_enumeration():
    score, kind, label, first, edges, size = chains(5)

    def mean(score, edges):
        total = 0
        for lo, n in zip(first, size, strict=True):
            part = slice(lo, lo + n)
            total += value(score[part], kind[part], label[part], edges) - np.logaddexp.reduce([value(score[part], kind[part], np.array(y), edges) for y in itertools.product((0, 1), repeat=n)])
        return total / len(score)

    got, by_score, by_edge = extraction.likelihood(score, kind, label, first, edges)
    assert np.isclose(got, mean(score, edges))
    for k in range(len(score)):
        step = np.eye(len(score))[k] * 1e-5
        assert np.isclose(by_score[k], (mean(score + step, edges) - mean(score - step, edges)) / 2e-5, atol=1e-6)
    for k in itertools.product(range(3), range(2), range(2)):
        step = np.zeros_like(edges)
        step[k] = 1e-5
        assert np.isclose(by_edge[k], (mean(score, edges + step) - mean(score, edges - step)) / 2e-5, atol=1e-6)


def test_given_pages_give_their_articles(spark):
    """By another way: what stands between the article's tags, split at its block tags."""
    got = {r.page_id: r for r in op13_html_extraction(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = p.html[p.html.find("<article>") + 9 :].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id].text == "\n".join(x for x in want if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


LINES = ["Storm over the northern hills", "The storm came in from the west late on Monday, and by the morning most roads were closed.", "Power was back by noon.", "Officials said that repairs, which began at once, would take a week.", "“We were lucky”, said one resident; nobody was hurt."]
PARTS = {
    "menu": '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>', "top": "<header><h1>The Daily Example</h1><p>News since 1999</p></header>",
    "cookie": '<div class="cookie-notice"><p>We use cookies to improve your experience.</p><button>Accept</button></div>', "ad": '<div class="ad">Buy two, get one free, only this week in all our shops.</div>', "aside": '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">A calm sea</a></li></ul></aside>',
    "form": '<form action="/s"><label>Your e-mail</label><input name=q><button>Subscribe</button></form>', "comments": '<section id="comments"><h2>Comments</h2><div class="comment"><p>What a night, I have never seen rain like that in my life.</p></div><div class="comment"><p>Same here.</p></div></section>', "foot": "<footer><p>&copy; 2020 The Daily Example. All rights reserved.</p></footer>",
}


def laid_out(wrap, *, inner=(), outer=("menu", "top", "cookie", "ad"), after=("aside", "form", "comments", "foot")):
    body = f"<h1>{LINES[0]}</h1>" + "".join(f"<p>{html.escape(x)}</p>" + (PARTS[inner[k]] if k < len(inner) else "") for k, x in enumerate(LINES[1:]))
    return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(PARTS[x] for x in outer) + wrap.format(body) + "".join(PARTS[x] for x in after) + "</body></html>"


UNSEEN = [laid_out(w) for w in ("<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", '<div id="main"><div class="post">{}</div></div>')] + [laid_out("<article>{}</article>", inner=("ad", "form", "cookie", "comments"), after=("foot",)), laid_out('<main><article class="entry">{}</article></main>', outer=(), after=("comments",))]


def test_unseen_layouts(spark):
    rows = [(k, f"http://e/{k}", p) for k, p in enumerate(UNSEEN)]
    table = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    model = extraction.fit(extraction.labelled(extraction.training_pages(table)))
    got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[k].split("\n") for k in range(len(rows))] == [LINES] * len(rows)
    texts = [b.text for k in range(40) for b in dom.blocks(extraction.Layout(10**6 + k, []).page())]
    right = blocks = 0
    for seed in range(20_000, 20_200):
        page = dom.blocks(extraction.Layout(seed, texts).page())
        plain = [dom.Block(b.text, tuple(e._replace(main=False) for e in b.path), b.link) for b in page]
        label = [any(e.main for e in b.path) for b in page]
        kept = extraction.main_blocks([plain], model, {}, {})[0]
        right += sum(min(kept.count(t), sum(y and b.text == t for b, y in zip(page, label, strict=True))) for t in set(kept))
        blocks += max(len(kept), sum(label))
    assert right / blocks > 0.93  # a third of these parts have no telling name


def test_hard_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>"), (2, "v", "<article><p>Text.</p></article>"), (3, "w", "<article><p>" + "Long text, of many words. " * 20_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = extraction.main_texts(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 5), (3, len(("Long text, of many words. " * 20_000).strip()))]
    assert extraction.main_texts(df.where("page_id > 9")).count() == 0
