"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over fixed-length byte windows; each filter's largest response in the window feeds a
softmax over languages. As the input is one byte out of 256, a filter of width w is w tables of 257 values (256 bytes
and padding), so a response is a sum of w look-ups. Training is numpy on the driver over a bounded sample of windows;
prediction runs in batches on the executors and reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .tokens import text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PAD = 256
SAMPLE_DOCS = 400  # per language, so the sample is bounded by the number of languages
SAMPLE_LANGS = 200
SAMPLE_WINDOWS = 5  # per sampled document
EPOCHS, BATCH, RATE = 8, 64, 0.02
NONE = "und"
_LETTER = r"\p{L}"
_FOLD = np.arange(257, dtype=np.uint16)
_FOLD[65:91] += 32


class Model(NamedTuple):
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 257, filters)
    bias: np.ndarray  # (widths * filters)
    dense: np.ndarray  # (widths * filters, languages)
    offset: np.ndarray  # (languages)


def window_matrix(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, WINDOW) byte numbers, padded with PAD."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < lengths[:, None]
    if not len(raw):
        return np.full(at.shape, PAD, dtype=np.uint16)
    return np.where(inside, _FOLD[raw[np.minimum(at, len(raw) - 1)]], PAD).astype(np.uint16)


def responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, positions, filters): the filters of one width at every place of every window."""
    width = len(table)
    last = x.shape[1] - width + 1
    out = np.take(table[0], x[:, :last], axis=0)
    for k in range(1, width):
        out += np.take(table[k], x[:, k : k + last], axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    top = np.concatenate([responses(x, t).max(axis=1) for t in model.tables], axis=1)
    return softmax(np.maximum(top + model.bias, 0) @ model.dense + model.offset)


def train(windows: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Cross-entropy by Adam over shuffled batches; the gradient of a maximum goes to the place that gave it."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    raw = np.frombuffer(b"".join(windows), dtype=np.uint8)
    sizes = np.array([len(w) for w in windows], dtype=np.int64)
    x = window_matrix(raw, np.cumsum(sizes) - sizes, sizes)
    y = np.array([langs.index(v) for v in labels])
    width = len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.3, (w, 257, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(width, np.float32), rng.normal(0, 0.3, (width, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            xb, n = x[pick], len(pick)
            *tables, bias, dense, offset = params
            full = [responses(xb, t) for t in tables]
            spots = [r.argmax(axis=1) for r in full]
            top = np.concatenate([np.take_along_axis(r, s[:, None], 1)[:, 0] for r, s in zip(full, spots, strict=True)], axis=1)
            hidden = np.maximum(top + bias, 0)
            wrong = softmax(hidden @ dense + offset)
            wrong[np.arange(n), y[pick]] -= 1
            wrong /= n
            back = (wrong @ dense.T) * (hidden > 0)
            grads = []
            for i, (t, s) in enumerate(zip(tables, spots, strict=True)):
                g, part = np.zeros_like(t), back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(t)):
                    np.add.at(g[k], (np.take_along_axis(xb, s + k, 1), np.arange(FILTERS)[None]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(langs, params[: len(WIDTHS)], *params[len(WIDTHS) :])


def learnable(divisor: int, held: int):
    """Rows that may be learnt from: crc32 of the doc_id's text is not ``held`` modulo ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor)) != held


def fit(docs: DataFrame, divisor: int = 4, held: int = 2) -> Model | None:
    """Train on ``SAMPLE_WINDOWS`` windows of at most ``SAMPLE_DOCS`` labelled documents of each of the ``SAMPLE_LANGS`` most frequent languages.

    Documents are picked by a hash of their id, and only ids and labels are ordered for it; windows are cut on the
    executors, so the driver gets a few MB whatever the corpus. None when there is nothing to learn from.
    """
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang")).filter(learnable(divisor, held) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGS).collect()
    if not counts:
        return None
    # About four times the sample passes a threshold on the hash that orders it, so that no task orders a whole language.
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * SAMPLE_DOCS / r["n"]))])
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = rows.withColumn("place", place).filter(F.col("place") < F.try_element_at(rate, F.col("lang")))
    picked = picked.withColumn("turn", turn).filter(F.col("turn") <= SAMPLE_DOCS)
    size = F.length("text")
    places = F.array_distinct(F.array(*[F.floor(F.greatest(size - WINDOW, F.lit(0)) * k / (SAMPLE_WINDOWS - 1)).cast("int") + 1 for k in range(SAMPLE_WINDOWS)]))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(_LETTER))
    cut = texts.join(F.broadcast(picked.select("doc_id", "lang").distinct()), "doc_id").select("doc_id", "lang", "text", F.explode(places).alias("place"))
    got = cut.select("doc_id", "lang", "place", F.expr(f"substring(text, place, {WINDOW})").alias("part")).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "doc_id", "place", "part"])
    return train([p.encode()[:WINDOW] for p in got.part], got.lang.tolist())


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best language number and its probability, averaged over the windows of each text by their length."""
    raw, offsets = text_bytes(column)
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][doc] - start)
    total = np.zeros((len(size), len(model.langs)))
    for a in range(0, len(doc), 1024):
        part = slice(a, a + 1024)
        p = probabilities(model, window_matrix(raw, start[part], length[part])) * length[part, None]
        np.add.at(total, doc[part], p)
    total /= np.maximum(size, 1)[:, None]
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def predictor(model: Model | None):
    """A column function: text -> struct<lang_pred string, score double>."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*model.langs, NONE], dtype=object) if model else np.array([NONE], dtype=object)
        for column in batches:
            if model:
                best, score = scores(model, column)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, _LETTER), False).to_numpy(zero_copy_only=False), bool)
                best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
            else:
                best, score = np.zeros(len(column), int), np.zeros(len(column))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, divisor: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang; other columns are ignored).

    A text that is null or has no letter gets ``und`` and score 0, as does every text when no row is labelled. Rows
    with a null doc_id are predicted but not learnt from. Equal texts get equal results; repeated rows are returned each.
    """
    ship(docs.sparkSession)
    guess = predictor(fit(docs, divisor, held))
    out = docs.select("doc_id", guess(F.col("text").cast("string")).alias("_p"), F.coalesce(~learnable(divisor, held), F.lit(False)).alias("held_out"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_known(docs: DataFrame, least: float = 0.3, divisor: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` that are not rejected (``und``, or a score under ``least``); columns as in ``docs``."""
    ship(docs.sparkSession)
    if docs.isEmpty():
        return docs
    guess = predictor(fit(docs, divisor, held))
    return docs.filter(guess(F.col("text").cast("string"))["score"] >= least)
