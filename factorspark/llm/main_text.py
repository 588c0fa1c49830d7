"""Main text of web pages: boosted trees judge every node of the page, and one consistent choice is read off the tree.

Each element is kept, dropped or divided: all of its text belongs to the article, none, or some. A kept element has only
kept descendants and a dropped one only dropped ones; of all choices that obey this, the one of greatest total
log-probability is taken, by one pass up the tree and one down. Features describe the subtree (length, links, density of
text over elements, sentence marks), its place (depth, share of the page and of the parent, siblings) and the words of
its tag and naming attributes with those of its ancestors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import boosting, dom, layouts

SAMPLE_PAGES = 300  # at most twice as many are fetched
SAMPLE_CHARS = 20_000  # pages longer than that are not in the sample
RENDERED = 700
BATCH_CHARS = 4 << 20  # pages judged at a time; a longer page is a batch of its own
KEEP, DROP, DIVIDED = 0, 1, 2
GROUPS = (
    (dom.TEXT,), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("a",), ("div",), ("article", "main"), ("section",),
    ("nav", "aside", "footer", "header"), ("form", "input", "button", "select", "option", "textarea", "label"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"),
)
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
_NOT_ARTICLE = frozenset(("nav", "aside", "footer", "form"))


class Model(NamedTuple):
    trees: boosting.Trees
    odds: dict[str, float]  # log-odds of a name or tag to stand in the article


def _words_of(tag: str, names: tuple[str, ...]) -> tuple[str, ...]:
    return names if tag == dom.TEXT else (f"<{tag}>", *names)


class Shape:
    """Arrays of all nodes of a batch, and the features made of them."""

    def __init__(self, nodes: dom.Nodes):
        self.nodes = nodes
        self.parent, self.end, self.depth = (np.array(x, dtype=np.int64) for x in (nodes.parent, nodes.end, nodes.depth))
        n = len(self.parent)
        self.index = np.arange(n)
        self.is_text = np.array([t == dom.TEXT for t in nodes.tag], dtype=bool)
        self.above = np.maximum(self.parent, 0)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1)))
        self.page = np.repeat(np.arange(len(nodes.pages) - 1), np.diff(nodes.pages))
        self.chars = self.total(np.array([len(t) for t in nodes.text], dtype=float))

    def total(self, own: np.ndarray) -> np.ndarray:
        """Sum over each subtree; subtrees are ranges, as nodes are in document order."""
        sums = np.concatenate(([0.0], np.cumsum(own)))
        return sums[self.end] - sums[self.index]

    def down(self, own: np.ndarray, step) -> np.ndarray:
        """Carry values from ancestors to descendants, ``step`` (an element-wise function of two) at a time."""
        out = own.copy()
        for level in self.levels[1:]:
            out[level] = step(out[self.parent[level]], own[level])
        return out

    def features(self, odds: dict[str, float]) -> np.ndarray:
        nodes, n = self.nodes, len(self.index)
        inside_link = self.down(np.array([t == "a" for t in nodes.tag], dtype=float), np.maximum)
        own = np.array([len(t) for t in nodes.text], dtype=float)
        words = self.total(np.array([len(t.split()) for t in nodes.text], dtype=float))
        marks = self.total(np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in nodes.text], dtype=float))
        elements, texts = self.total((~self.is_text).astype(float)), self.total(self.is_text.astype(float))
        group = np.array([_GROUP.get(t, -1) for t in nodes.tag])
        counts = {k: self.total((group == k).astype(float)) for k in (1, 3, 9)}
        links, chars = self.total(own * inside_link), self.chars
        first = np.array(nodes.pages[:-1], dtype=np.int64)[self.page] if n else self.index
        sums = np.concatenate(([0.0], np.cumsum(own)))
        whole = np.maximum(chars[first], 1)
        scores = [[odds.get(w, 0.0) for w in _words_of(t, a)] or [0.0] for t, a in zip(nodes.tag, nodes.names, strict=True)]
        low, high = np.array([min(s) for s in scores]), np.array([max(s) for s in scores])
        low, high = np.minimum(low, 0), np.maximum(high, 0)
        low_above, high_above = self.down(low, np.minimum)[self.above], self.down(high, np.maximum)[self.above]
        near = self.down(low + high, lambda a, b: np.where(b != 0, b, a))
        # Siblings: children of one parent in order, with the numbers of their neighbours.
        by_parent = np.argsort(self.parent, kind="stable")
        same = np.zeros(n, dtype=bool)
        same[1:] = self.parent[by_parent][1:] == self.parent[by_parent][:-1]
        before, after = np.full(n, -1), np.full(n, -1)
        before[by_parent[1:][same[1:]]] = by_parent[:-1][same[1:]]
        after[by_parent[:-1][same[1:]]] = by_parent[1:][same[1:]]
        starts = np.flatnonzero(~same)
        sizes = np.diff(np.append(starts, n))
        siblings, place = np.zeros(n), np.zeros(n)
        siblings[by_parent] = np.repeat(sizes, sizes)
        place[by_parent] = np.arange(n) - np.repeat(starts, sizes)
        pair = self.parent * 64 + group + 1
        _, kind, alike = np.unique(pair, return_inverse=True, return_counts=True)

        def of(values, at):
            return np.where(at >= 0, values[at], 0.0)

        density = links / np.maximum(chars, 1)
        columns = [
            np.log1p(chars), density, np.log1p(elements), np.log1p(chars / (elements + 1)), marks / np.maximum(words, 1), np.log1p(words / np.maximum(texts, 1)),
            chars / whole, chars / np.maximum(chars[self.above], 1), self.depth, place / siblings, np.log1p(siblings), alike[kind] / siblings,
            sums[self.index] / whole - sums[first] / whole, (sums[self.end] - sums[first]) / whole, counts[1] / (elements + 1), counts[3] / (elements + 1), np.log1p(counts[9]),
            np.log1p(of(chars, before)), np.log1p(of(chars, after)), of(density, before), of(density, after), density[self.above], np.log1p(chars[self.above]),
            inside_link, low, high, low_above, high_above, near, of(low + high, before), of(low + high, after), *[group == k for k in range(len(GROUPS))],
        ]
        return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1) if n else np.zeros((0, len(columns)))

    def decode(self, logs: np.ndarray) -> np.ndarray:
        """Which text nodes are kept, under the best consistent choice; ``logs`` has a row per node and a column per state."""
        logs = np.where(self.chars[:, None] > 0, logs, 0.0)
        best = logs.copy()
        best[self.is_text, DIVIDED] = -np.inf
        for level in reversed(self.levels[1:]):
            level = level[self.chars[level] > 0]
            up = self.parent[level]
            np.add.at(best, (up, KEEP), best[level, KEEP])
            np.add.at(best, (up, DROP), best[level, DROP])
            np.add.at(best, (up, DIVIDED), best[level].max(axis=1))
        state = best.argmax(axis=1)
        for level in self.levels[1:]:
            given = state[self.parent[level]]
            state[level] = np.where(given == DIVIDED, state[level], given)
        return self.is_text & (state == KEEP)


def read_pages(sources: list[str]) -> Shape:
    nodes = dom.Nodes()
    for source in sources:
        dom.read(nodes, source)
    return Shape(nodes)


def main_texts(model: Model | None, sources: list[str]) -> list[str]:
    """The main text of each page."""
    if model is None:
        return [""] * len(sources)
    shape = read_pages(sources)
    kept = shape.decode(boosting.log_probabilities(model.trees, shape.features(model.odds)))
    nodes, out = shape.nodes, []
    for a, b in zip(nodes.pages, nodes.pages[1:], strict=False):
        at = a + np.flatnonzero(kept[a:b])
        out.append(dom.lines([nodes.text[k] for k in at], [nodes.block[k] for k in at]))
    return out


def states(shape: Shape, good: np.ndarray) -> np.ndarray:
    """Right state of each node, from the text nodes that belong to the article."""
    own = np.array([len(t) for t in shape.nodes.text], dtype=float)
    part = shape.total(own * good)
    return np.where(part == 0, DROP, np.where(part == shape.chars, KEEP, DIVIDED))


def learn(sources: list[str], seed: int = 3) -> Model | None:
    """Trees from a sample of pages: the pages that mark their article, and their texts in other layouts.

    A page with exactly one ``article`` element tells its own answer: what is in it, without navigation, asides, footers
    and forms. None when the sample has no text.
    """
    plain = read_pages(sources)
    texts = sorted({t.strip() for t in plain.nodes.text if len(t.split()) >= 3})
    words = sorted({w for t in plain.nodes.text for w in t.split() if len(w) < 30})
    if not words:
        return None
    article = np.array([t == "article" for t in plain.nodes.tag], dtype=float)
    out = np.array([t in _NOT_ARTICLE for t in plain.nodes.tag], dtype=float)
    good = (plain.down(article, np.maximum) > plain.down(out, np.maximum)) & plain.is_text
    once = np.bincount(plain.page, article, len(plain.nodes.pages) - 1) == 1
    made = read_pages(layouts.render(texts or words, words, RENDERED, seed))
    marked = np.array([layouts.MARK in t for t in made.nodes.text], dtype=bool)
    made.nodes.text = [t.replace(layouts.MARK, "") for t in made.nodes.text]
    made = Shape(made.nodes)
    # Log-odds of names and tags over text nodes below them, halved page by page, so that no name has seen its own answer.
    sides = [(plain, good, once[plain.page]), (made, marked, np.ones(len(made.page), dtype=bool))]
    counted = [[Counter(), Counter()], [Counter(), Counter()]]
    for shape, right, used in sides:
        own = np.array([1.0 if t else 0.0 for t in shape.nodes.text])
        inside, every = shape.total(own * right), shape.total(own)
        for k in np.flatnonzero(used & (every > 0) & ~shape.is_text):
            share = inside[k] / every[k]
            for w in _words_of(shape.nodes.tag[k], shape.nodes.names[k]):
                counted[shape.page[k] % 2][0][w] += share
                counted[shape.page[k] % 2][1][w] += 1 - share

    def log_odds(yes: Counter, no: Counter) -> dict[str, float]:
        return {w: float(np.log((yes[w] + 1) / (no[w] + 1))) for w in {*yes, *no} if yes[w] + no[w] >= 3}

    halves = [log_odds(*c) for c in counted]
    xs, ys = [], []
    for shape, right, used in sides:
        seen = used & (shape.chars > 0)
        for half in (0, 1):
            take = seen & (shape.page % 2 == half)
            xs.append(shape.features(halves[1 - half])[take])
            ys.append(states(shape, right)[take])
    trees = boosting.train(np.concatenate(xs), np.concatenate(ys), 3)
    return Model(trees, log_odds(counted[0][0] + counted[1][0], counted[0][1] + counted[1][1]))


def fit(pages: DataFrame) -> Model | None:
    """A model from about ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters, picked by a hash of id and url.

    The driver gets a few MB whatever the table. None for an empty table or one without text.
    """
    place = F.xxhash64("page_id", "url") / F.lit(2.0**64) + 0.5
    short = pages.select(place.alias("place"), F.col("html").cast("string").alias("html")).filter(F.length("html") <= SAMPLE_CHARS)
    rows = short.count()
    got = short.filter(F.col("place") < min(1.0, SAMPLE_PAGES / max(rows, 1))).limit(2 * SAMPLE_PAGES).collect()
    got = got or short.limit(SAMPLE_PAGES).collect()  # all rows of one id and url
    return learn([r["html"] for r in sorted(got)])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty page has the empty text, as has every page when the table holds no text. Pages are read whole,
    however long; equal pages get equal texts, repeated rows are returned each, ids and urls may be null.
    """
    ship(pages.sparkSession)
    model = fit(pages)
    held = pages.sparkSession.sparkContext.broadcast(model)  # trees of fixed size and the names of a bounded sample

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            sources, out, at = column.to_pylist(), [], 0
            while at < len(sources):
                to, size = at, 0
                while to < len(sources) and (to == at or size + len(sources[to] or "") <= BATCH_CHARS):
                    size += len(sources[to] or "")
                    to += 1
                out += main_texts(held.value, [s or "" for s in sources[at:to]])
                at = to
            yield pa.array(out, pa.string())

    out = pages.select("page_id", "url", texts(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
