"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

Each block is labelled main or not. Its score comes from the tags, classes and ids of the elements around it and from its text (length,
share of links, punctuation, some words); neighbours are tied by weights that depend on whether they share their parent. The model is trained
in the driver on labelled pages and decoded by Viterbi in Arrow batches of whole pages.

Labelled pages are of two kinds. Pages of the table that mark their article by an ``article`` element (at most ``TRAIN_PAGES``, the
first by a hash, of at most ``TRAIN_CHARS`` characters each) label their own blocks. ``LAYOUTS`` more pages are laid out from the texts of
those in many other ways, with and without telling names: menus, side bars, notices, adverts, forms and comments around and inside
an article; each block is marked as it is laid out. This bounds the fit; decoding reads every block of every page.
"""

from __future__ import annotations

import html as html_
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .dom import Block, Element, blocks

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 300, 60_000, 700
STEPS, RATE, DECAY = 300, 0.3, 2e-5
_BOILER = re.compile(r"cookie|privacy|consent|subscri|newsletter|log ?in|sign ?(?:in|up)|share|comment|repl(?:y|ies)|advert|sponsor|promo|rights reserved|copyright|©|menu|search|submit|e-?mail|password|related|read more|follow us|terms", re.I)
_END = frozenset(".!?…:;。")
#: Elements in a marked article that are not the article's own text.
_ASIDE = frozenset("nav aside footer form menu dialog button".split())
_ASIDE_WORDS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo share social related sidebar newsletter subscribe cookie notice".split())


# fixed values: names that pages give to their parts, and what notices and forms say
_NAMES = {
    "main": ["content", "post", "entry", "entry-content", "article-body", "post-content", "story", "main-content", "page-content", "text", "body-copy", "article", "blog-post", "main"],
    "menu": ["menu", "navbar", "nav", "top-menu", "navigation", "breadcrumbs", "main-nav", "topbar"],
    "header": ["header", "masthead", "site-header", "branding", "page-header", "top"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "popular", "widget-area", "trending", "tags", "archive"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "cookie-banner", "alert", "banner", "notification", "paywall", "popup", "modal"],
    "advert": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "ad-container", "banner-ad", "adbox"],
    "form": ["newsletter", "subscribe", "signup", "search", "search-form", "login", "contact-form", "form"],
    "comments": ["comments", "comment-list", "comment", "responses", "discussion", "disqus", "replies", "reader-comments", "comment-body", "user-comments"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon", "page-footer", "legal"],
    "share": ["share", "social", "share-buttons", "social-links", "follow"],
}
#: What each word of a name tells of its part's use, by the names above.
_USES = {w: tuple(u for u, names in _NAMES.items() if any(w in n.split("-") for n in names)) for names in _NAMES.values() for n in names for w in n.split("-")}


@lru_cache(50_000)
def path_features(path: tuple[Element, ...]) -> tuple[str, ...]:
    found = {"bias"}
    for e in path:
        found.add(f"in {e.tag}")
        found.update(f"name {w}" for w in e.words)
        found.update(f"use {u}" for w in e.words for u in _USES.get(w, ()))
    if path:
        found.add(f"at {path[-1].tag}")
        found.update(f"own {w}" for w in path[-1].words)
        found.add("no names" if not any(e.words for e in path) else "names")
    if len(path) > 1:
        found.add(f"under {path[-2].tag} {path[-1].tag}")
    return tuple(sorted(found))


def shares(page: list[Block]) -> list[tuple[int, bool]]:
    """For each block the share of the page's text outside links that stands in blocks of its parent, in fifths, and whether no parent has more."""
    held: dict[tuple[Element, ...], int] = {}
    for b in page:
        held[b.path[:-1]] = held.get(b.path[:-1], 0) + len(b.text) - b.link
    total, most = sum(held.values()) or 1, max(held.values(), default=0)
    return [(5 * n // total, n == most) for n in (held[b.path[:-1]] for b in page)]


def text_key(block: Block, place: int, of: int, share: tuple[int, bool]) -> tuple:
    """A block's text in a few coarse figures, by which its score is looked up."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    marks = text.count(".") + text.count(",")
    return (
        min(10, n.bit_length()), min(8, words.bit_length()), 0 if not block.link else 1 + (3 * block.link > n) + (4 * block.link > 3 * n), min(3, 12 * marks // words if words > 2 else 0), text[-1] in _END, text[0].isupper(),
        min(2, len(_BOILER.findall(text))) if n < 160 else 0, 4 * place // of, place == 0, place == of - 1, *share,
    )


@lru_cache(50_000)
def text_features(key: tuple) -> tuple[str, ...]:
    chars, words, link, marks, ended, upper, boiler, quarter, first, last, fifth, most = key
    return (f"chars {chars}", f"words {words}", f"link {link}", f"marks {marks}", f"ended {ended}", f"upper {upper}", f"boiler {boiler}", f"quarter {quarter}", f"first {first}", f"last {last}", f"chars {chars} link {link}", f"words {words} ended {ended}", f"boiler {boiler} words {words}", f"share {fifth}", f"most {most}")


def tied(a: tuple[Element, ...], b: tuple[Element, ...]) -> int:
    """How near two neighbouring blocks stand: 0 in one element or in two of one kind under one parent, 1 under one grandparent, 2 apart."""
    if a[:-1] == b[:-1]:
        return 0
    return 1 if a[:-2] == b[:-2] else 2


class Model(NamedTuple):
    names: dict[str, int]
    weights: np.ndarray  # of features, for main
    edges: np.ndarray  # (kind, label before, label)


def viterbi(score: np.ndarray, kind: np.ndarray, first: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The best labels of all chains at once: ``score`` of label 1 by block, ``kind`` of the edge from the block before, ``first`` block of each chain."""
    size = np.diff(np.append(first, len(score)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best, back = np.zeros((len(score), 2)), np.zeros((len(score), 2), np.int8)
    best[:, 1] = score
    for t in range(1, int(size.max(initial=0))):
        at = first[: np.searchsorted(-size, -t)] + t  # the chains that are longer than t
        ways = best[at - 1][:, :, None] + edges[kind[at]]
        back[at] = ways.argmax(1)
        best[at] += ways.max(1)
    label = np.zeros(len(score), np.int8)
    label[first + size - 1] = best[first + size - 1].argmax(1)
    for t in range(int(size.max(initial=0)) - 1, 0, -1):
        at = first[: np.searchsorted(-size, -t)] + t
        label[at - 1] = back[at, label[at]]
    return label


def likelihood(score: np.ndarray, kind: np.ndarray, label: np.ndarray, first: np.ndarray, edges: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean log-likelihood of the labels by block, its gradients by score and by edge weight), by the forward-backward sums of all chains at once."""
    n = len(score)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[:, 1] = score
    steps = [first[: np.searchsorted(-size, -t)] + t for t in range(1, int(size.max(initial=0)))]
    for at in steps:
        ahead[at] += np.logaddexp.reduce(ahead[at - 1][:, :, None] + edges[kind[at]], axis=1)
    own = np.stack((np.zeros(n), score), 1)
    for at in reversed(steps):
        behind[at - 1] = np.logaddexp.reduce(edges[kind[at]] + (own[at] + behind[at])[:, None, :], axis=2)
    total = np.empty(n)
    total[first] = np.logaddexp.reduce(ahead[first + size - 1], axis=1)
    chain = np.zeros(n, np.int64)
    chain[first] = 1
    total = total[np.sort(first)][np.cumsum(chain) - 1]
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = np.exp(ahead[at - 1][:, :, None] + edges[kind[at]] + (own[at] + behind[at])[:, None, :] - total[at, None, None])
    by_edge = np.zeros_like(edges)
    np.add.at(by_edge, (kind[at], label[at - 1], label[at]), 1)
    np.subtract.at(by_edge, kind[at], pair)
    main = np.exp(ahead[:, 1] + behind[:, 1] - total)
    value = (score[label == 1].sum() + edges[kind[at], label[at - 1], label[at]].sum() - total[first].sum()) / max(1, n)
    return value, (label - main) / max(1, n), by_edge / max(1, n)


def fit(pages: Iterable[tuple[list[Block], list[bool]]]) -> Model:
    """A model of pages' blocks and their labels: Adam on the penalised likelihood. Pages without blocks don't count; without pages all weights are 0."""
    names: dict[str, int] = {}
    index, count, label, kind, first = [], [], [], [], []
    for page, main in pages:
        if page:
            first.append(len(label))
        for k, (block, y, share) in enumerate(zip(page, main, shares(page), strict=True)):
            own = [names.setdefault(f, len(names)) for f in (*path_features(block.path), *text_features(text_key(block, k, len(page), share)))]
            index += own
            count.append(len(own))
            label.append(int(y))
            kind.append(tied(page[k - 1].path, block.path) if k else 0)
    weights, edges = np.zeros(len(names)), np.zeros((3, 2, 2))
    if not label:
        return Model(names, weights, edges)
    index, label, kind, first = np.array(index), np.array(label), np.array(kind), np.array(first)
    start = np.cumsum(count) - np.array(count)
    x, mean, square = np.zeros(len(names) + edges.size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        weights, edges = x[: len(names)], x[len(names) :].reshape(3, 2, 2)
        _, by_score, by_edge = likelihood(np.add.reduceat(weights[index], start), kind, label, first, edges)
        slope = np.concatenate((np.bincount(index, np.repeat(by_score, count), len(names)), by_edge.ravel())) - DECAY * x
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        x = x + RATE * (1 - 0.9 * step / STEPS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(names, x[: len(names)], x[len(names) :].reshape(3, 2, 2))


def marked(page: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article, or None: blocks inside ``article`` and not inside an element of other use there."""
    out = []
    for b in page:
        inside = next((k for k, e in enumerate(b.path) if e.tag == "article"), None)
        out.append(inside is not None and not any(e.tag in _ASIDE or not _ASIDE_WORDS.isdisjoint(e.words) for e in b.path[inside:]))
    return out if any(out) else None


_NOTICES = ["We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our privacy policy.", "Please disable your ad blocker.", "Accept all cookies", "Your subscription has expired. Subscribe to read more.", "Breaking news: follow us for updates.", "Manage consent"]
_FORMS = ["Your e-mail address", "Subscribe to our newsletter", "Sign up", "Log in", "Search", "Submit", "Password", "Send", "Name", "Leave a comment", "Post reply"]
_MENU = ["Home", "About", "Contact", "News", "Sports", "Blog", "Products", "Login", "Sitemap", "Archive", "Next", "Previous"]
_FOOTERS = ["Copyright 2021 Example Inc. All rights reserved.", "© 2020 Example", "Terms of use", "Privacy policy", "Powered by Example", "Imprint", "Contact us"]
_LICENSES = ["All rights reserved.", "This work is licensed under CC BY 4.0.", "Released under a free license.", "Reprinted with permission."]
_FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi".split()


class Layout:
    """One laid-out page from a seed: an article among other parts, its own blocks marked."""

    def __init__(self, seed: int, texts: list[str]):
        self.r, self.texts = random.Random(seed), texts
        self.named = self.r.random()  # how often parts of this page have telling names
        self.semantic = self.r.random() < 0.5
        self.inside = False  # an article's other parts always have a telling name

    def line(self, low: int = 3, high: int = 60) -> str:
        r = self.r
        if self.texts and r.random() < 0.8:
            text = r.choice(self.texts)
            words = text.split(" ")
            cut = words[: r.randint(low, high)]
            return html_.escape(" ".join(cut))
        return " ".join(r.choice(_FILLER) for _ in range(r.randint(low, high))).capitalize() + r.choice([".", ".", "", "!"])

    def part(self, use: str, tags: list[str], inside: str) -> str:
        r = self.r
        tag = r.choice(tags) if self.semantic else "div"
        name = ""
        if self.inside or r.random() < self.named or (tag == "div" and use in ("comments", "advert", "notice") and r.random() < 0.8):
            name = f' {r.choice(["class", "class", "id"])}="{r.choice(_NAMES[use])}{r.choice(["", "", f" c{r.randint(1, 999)}", " clearfix"])}"'
        elif r.random() < 0.3:
            name = f' class="c{r.randint(1, 99999)}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        r, items = self.r, [f'<a href="/{k}">{self.r.choice(_MENU) if self.r.random() < 0.5 else self.line(1, 4)}</a>' for k in range(n)]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", ""]).join(items)

    def comments(self) -> str:
        r = self.r
        item = r.choice(["<li>{}</li>", "<div class=\"comment\">{}</div>", "<p>{}</p>", "<article class=\"comment\"><p>{}</p></article>", "<div><b>{}</b></div>"])
        title = r.choice(["<h2>Comments</h2>", "<h3>3 comments</h3>", "", "<h3>Responses</h3>"])
        items = "".join(item.format(self.line(2, 50)) for _ in range(r.randint(1, 6)))
        return self.part("comments", ["section", "div", "ol", "ul"], title + (f"<ol>{items}</ol>" if "<li>" in item else items))

    def other(self, use: str) -> str:
        r = self.r
        if use == "menu":
            return self.part(use, ["nav", "nav", "div", "ul", "menu"], self.links(r.randint(2, 9)))
        if use == "header":
            return self.part(use, ["header"], r.choice([f"<h1>{self.line(1, 4)}</h1>", f"<div>{self.line(1, 4)}</div>", f'<a href="/">{self.line(1, 3)}</a>']) + (self.links(3) if r.random() < 0.4 else "") + (f"<p>{self.line(2, 9)}</p>" if r.random() < 0.4 else ""))
        if use == "side":
            return self.part(use, ["aside"], f"<h3>{self.line(1, 3)}</h3>" + r.choice([self.links(r.randint(2, 6)), f"<p>{self.line(3, 30)}</p>", f"{self.line(3, 20)}", f"<ul><li>{self.line(2, 9)}</li><li>{self.line(2, 9)}</li></ul>"]))
        if use == "notice":
            return self.part(use, ["div", "section", "dialog", "div"], r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(r.choice(_NOTICES) if r.random() < 0.7 else self.line(4, 25)) + ("<button>OK</button>" if r.random() < 0.4 else ""))
        if use == "advert":
            return self.part(use, ["div", "aside", "div"], r.choice(["{}", "<p>{}</p>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(self.line(2, 25)))
        if use == "form":
            return f"<form>{''.join(r.choice(['<label>{}</label>', '<p>{}</p>', '{}<input>', '<button>{}</button>']).format(r.choice(_FORMS) if r.random() < 0.8 else self.line(1, 8)) for _ in range(r.randint(1, 4)))}</form>"
        if use == "footer":
            inside = r.choice([f"<p>{r.choice(_FOOTERS)}</p>", r.choice(_FOOTERS), f"&copy; {self.line(1, 4)} &middot; {self.line(2, 14)}", f"<p>{self.line(2, 14)}</p>"])
            return self.part(use, ["footer"], inside + (self.links(3) if r.random() < 0.3 else ""))
        if use == "share":
            return self.part(use, ["div", "ul"], self.links(r.randint(2, 4)))
        return self.comments()

    def article(self) -> str:
        r = self.r
        mark = lambda tag, inside: f"<{tag} data-main>{inside}</{tag}>"
        out = [mark("h1", self.line(1, 9))] if r.random() < 0.85 else []
        plain = r.choice(["p", "p", "p", "div"])
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                out.append(mark(plain, self.line(1, r.choice([6, 40, 120]))))
            elif kind < 0.8:
                out.append(mark(r.choice(["h2", "h3"]), self.line(1, 6)))
            elif kind < 0.86:
                out.append("<ul>" + "".join(mark("li", self.line(1, 15)) for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{mark('p', self.line(3, 40))}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr>{mark('td', self.line(1, 4))}{mark('td', self.line(1, 4))}</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.94:
                out.append(mark("pre", self.line(2, 20)))
            elif kind < 0.975:  # an article may say what notices say
                out.append(mark(plain, r.choice(r.choice([_NOTICES, _FORMS, _MENU, _FOOTERS, _LICENSES]))))
            else:
                out.append(mark(plain, f'{self.line(3, 20)} <a href="/y">{self.line(1, 4)}</a> {self.line(2, 20)}'))
        self.inside = True
        for use, often in (("advert", 0.35), ("share", 0.15), ("form", 0.2), ("notice", 0.2), ("side", 0.1), ("comments", 0.15)):
            if r.random() < often:
                out.insert(r.randint(0, len(out)), self.other(use))
        if r.random() < 0.25:
            out.append(self.comments())
        self.inside = False
        body = self.part("main", ["article", "article", "main", "section"], "".join(out))
        return f"<{r.choice(['main', 'div', 'section'])}>{body}</div>" if r.random() < 0.2 else body

    def page(self) -> str:
        r = self.r
        before = [u for u, often in (("notice", 0.3), ("header", 0.55), ("menu", 0.75), ("advert", 0.35), ("form", 0.2), ("side", 0.2)) if r.random() < often]
        after = [u for u, often in (("share", 0.2), ("comments", 0.45), ("side", 0.45), ("form", 0.25), ("advert", 0.25), ("notice", 0.2), ("menu", 0.15), ("footer", 0.8)) if r.random() < often]
        bare = r.random()
        before, after = [] if bare < 0.2 else before, [] if 0.1 < bare < 0.3 else after
        if r.random() < 0.2:
            r.shuffle(before)
            r.shuffle(after)
        body = "".join([*map(self.other, before), self.article(), *map(self.other, after)])
        return f"<html><head><title>{self.line(1, 6)}</title></head><body>{f'<div id=wrap>{body}</div>' if r.random() < 0.3 else body}</body></html>"


def labelled(pages: Iterable[str], layouts: int = LAYOUTS) -> Iterator[tuple[list[Block], list[bool]]]:
    """The blocks and labels of the pages that mark their article, and of ``layouts`` pages laid out from their texts."""
    texts = []
    for page in pages:
        page = blocks(page)
        main = marked(page)
        if main:
            texts += [b.text for b, y in zip(page, main, strict=True) if y]
            yield page, main
    for seed in range(layouts):
        page = blocks(Layout(seed, texts).page())
        main = [any(e.main for e in b.path) for b in page]
        yield [Block(b.text, tuple(e._replace(main=False) for e in b.path), b.link) for b in page], main


def training_pages(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> list[str]:
    """At most ``limit`` different pages of the table that mark an article, the first by a hash of their text, of at most ``TRAIN_CHARS`` characters each.

    The number of different pages sets the hash below which a page is looked at, so that about twice ``limit`` pages are gathered however many there are.
    """
    text = F.col(html)
    some = pages.where(text.contains("<article") & (F.length(text) <= TRAIN_CHARS)).select(F.xxhash64(text).alias("h"), text.alias("html"))
    n = some.agg(F.approx_count_distinct("h")).head()[0]
    low = -(1 << 63) + min(1 << 64, (2 * limit + 100 << 64) // max(1, n))
    few = some.where(F.col("h") < low) if low < 1 << 63 else some
    return [r["html"] for r in few.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(limit).collect()]


def main_blocks(pages: list[list[Block]], model: Model, known_paths: dict, known_texts: dict) -> list[list[str]]:
    """The texts of the main blocks of each page."""
    names, weights = model.names, model.weights

    def total(features: tuple[str, ...]) -> float:
        return math.fsum(weights[names[f]] for f in features if f in names)

    for known in (known_paths, known_texts):
        if len(known) > 100_000:
            known.clear()
    score, kind, first = [], [], []
    for page in pages:
        if page:
            first.append(len(score))
        before = None
        for k, (block, share) in enumerate(zip(page, shares(page), strict=True)):
            path, key = block.path, text_key(block, k, len(page), share)
            if path not in known_paths:
                known_paths[path] = total(path_features(path))
            if key not in known_texts:
                known_texts[key] = total(text_features(key))
            score.append(known_paths[path] + known_texts[key])
            kind.append(0 if before is None or before is path else tied(before, path))
            before = path
    label = iter(viterbi(np.array(score, np.float64), np.array(kind, np.int64), np.array(first, np.int64), model.edges).tolist()) if score else iter(())
    return [[b.text for b in page if next(label)] for page in pages]


def extracted(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: its main blocks in order, joined by line feeds.

    Pages are read whole. A page that is null, empty or without blocks has the empty text, nulls and repeats in page_id and url stay as they are, an
    empty table gives no rows, other columns are ignored. Of two best labellings the one that is not main at the first difference from the end is taken.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        texts: dict = {}
        for batch in batches:
            if batch.num_rows:
                found = main_blocks([blocks(x) if x else [] for x in batch.column(2).to_pylist()], shared.value, paths, texts)
                joined = ["\n".join(x) for x in found]
                columns = [batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array(list(map(len, joined)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``extracted`` with a model that is fitted on the table's own marked pages and on layouts of their texts."""
    return extracted(pages, fit(labelled(training_pages(pages, html))), page_id, url, html)
