"""N-gram language model in Elias-Fano tries, trained and applied by exchanging blocks of counts.

Model (Jelinek-Mercer over two orders): ``P(w | v) = LAMBDA * c(v w) / c(v) + (1 - LAMBDA) * P(w)`` with
``P(w) = (c(w) + 1) / (N + V + 1)``; a context never trained on leaves ``P(w)``. A text is its words and one end token,
which is also the context of the first word.

1. Texts are packed into blocks: a sorted dictionary of word hashes and the stream of dictionary places.
2. Each block sends its dictionary with training counts to hash buckets and gets the corpus counts back.
3. Each block sends its word pairs, sorted, with the documents they occur in, to trie shards. A shard is chosen by the
   context word, and for a context that would outgrow a shard by the next word too; that depends on the context's
   count alone, so all blocks choose alike.
4. A shard builds its trie from the trained pairs. Level 1: the context hashes, with quantised weights of backing off and
   monotone pointers to their successors. Level 2: successors as places relative to their context, one ascending
   sequence over all contexts, with quantised smoothed probabilities. The levels are Elias-Fano sequences in a
   file that is mapped and searched for every pair of the shard, and removed with the task.
5. The documents' sums come back by block.

Words are told apart by 64-bit hashes, the contexts of one shard by 48 bits and the successors of one context by 28 bits.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, ship
from . import elias_fano
from .lang_cnn import learnable
from .packing import in_buckets, pack_ints, pack_sorted, squeeze, unpack_ints, unpack_sorted, unsqueeze
from .tokens import mix, parts, text_bytes, words

BLOCK_BYTES = 12 << 20
SHARDS = 2  # trie shards for each shuffle partition; a shard is what one task holds
ASKED = 1 << 18  # pairs looked up at a time
LAMBDA = 0.25
END = mix(np.array([0x656E64], dtype=np.uint64))[0]
CONTEXT, SUCCESSOR = np.uint64(16), np.uint64(36)  # low bits of a hash that a trie leaves out
CODES = 1 << 16  # steps of a quantised log10 probability
DEEPEST = 24.0  # probabilities are at least 10**-DEEPEST
UNIT = 1e6  # sums of log10 are carried as whole millionths, so that no order of addition matters


def quantise(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(-np.log10(np.maximum(p, 1e-300)), 0, DEEPEST) * ((CODES - 1) / DEEPEST)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) * (DEEPEST / (CODES - 1)))


def steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences inside runs of the given sizes, in which ``x`` ascends; the first of a run stays."""
    out = x.copy()
    out[1:] -= x[:-1]
    begin = np.cumsum(sizes) - sizes
    out[begin] = x[begin]
    return out


def unsteps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(x, dtype=np.uint64)
    begin = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begin] - x[begin], sizes)


_STATE = "block long, bucket int, dict binary, body binary"
_STATE_NAMES = ["block", "bucket", "dict", "body"]


def _blocks(batches):
    """Rows (doc_id, trained, text) to blocks: dictionary with training counts, documents with their streams."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        raw, offsets = text_bytes(batch.column(2))
        known = np.asarray(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        trained = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
            streams, counts = [], []
            for a, b in parts(offsets[first : last + 1]):
                own = offsets[first + a : first + b + 1]
                w = words(raw[own[0] : own[-1]], own - own[0])
                streams.append(np.insert(w.hashes, w.bounds[1:], END))
                counts.append(np.diff(w.bounds) + 1)
            stream, count = np.concatenate(streams), np.concatenate(counts)
            names, place = np.unique(stream, return_inverse=True)
            learnt = np.bincount(place[np.repeat(trained[first:last], count)], minlength=len(names))
            body = squeeze(ids[first:last].tobytes(), known[first:last].tobytes(), trained[first:last].tobytes(), pack_ints(count), pack_ints(place))
            dictionary = squeeze(pack_sorted(names), pack_ints(learnt))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([dictionary]), pa.array([body])], _STATE_NAMES)
            number += 1
            first = last


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, learnt = unsqueeze(data)
                names, learnt = unpack_sorted(names), unpack_ints(learnt)
                to = (names % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at = np.searchsorted(to[order], np.arange(buckets + 1))
                out = [(k, squeeze(pack_sorted(names[p]), pack_ints(learnt[p]))) for k in range(buckets) if at[k] < at[k + 1] for p in [order[at[k] : at[k + 1]]]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(out)), pa.array([k for k, _ in out], pa.int32()), pa.array([d for _, d in out])], _STATE_NAMES[:3])

    return run


def _tell(table: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's words for every block that asked, and the bucket's share of N and V under block -1."""
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    asked = [unsqueeze(d) for d in table.column("dict").to_pylist()]
    names = [unpack_sorted(k) for k, _ in asked]
    every, inverse = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack_ints(n) for _, n in asked]), len(every)).astype(np.uint64)
    told = total[inverse]
    edge = np.cumsum([0, *map(len, names)])
    rows = [(b, bucket, pack_ints(told[edge[i] : edge[i + 1]])) for i, b in enumerate(blocks)]
    rows.append((-1, bucket, np.array([total.sum(), (total > 0).sum()], dtype=np.uint64).tobytes()))
    types = [pa.int64(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _STATE_NAMES[:3])


def _pairs(buckets: int, shards: int, n: int, v: int):
    """A block's word pairs to trie shards, and what is known of its documents to one shard that passes it on."""

    def run(table: pa.Table) -> pa.Table:
        block, dictionary, body, told = table.column("block")[0].as_py(), None, None, {}
        for k, d, b in zip(*(table.column(c).to_pylist() for c in _STATE_NAMES[1:]), strict=True):
            if k < 0:
                dictionary, body = d, b
            else:
                told[k] = unpack_ints(d)
        names = unpack_sorted(unsqueeze(dictionary)[0])
        ids, known, trained, count, place = unsqueeze(body)
        trained, count, place = np.frombuffer(trained, bool), unpack_ints(count).astype(np.int64), unpack_ints(place).astype(np.int32)
        home = (names % np.uint64(buckets)).astype(np.int64)
        c = np.zeros(len(names), dtype=np.uint64)
        for k, counts in told.items():
            c[home == k] = counts
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        base = np.bincount(doc, np.log10((c + 1.0) / (n + v + 1.0))[place], len(count))
        seen = np.bincount(doc, (c > 0)[place], len(count)).astype(np.int64)
        rows = [(block, block % shards, 1, squeeze(ids, known, trained.tobytes(), pack_ints(count), pack_ints(seen), base.tobytes()))]
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[np.cumsum(count) - count] = np.searchsorted(names, END)
        order = np.argsort(before.astype(np.int64) * len(names) + place, kind="stable")
        before, place, doc = before[order], place[order], doc[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        often = np.diff(np.append(first, len(place)))
        a, b = before[first], place[first]
        # A context with a count beyond a shard's share is spread over several shards by the next word.
        spread = np.minimum(c * np.uint64(shards) // np.uint64(max(n, 1)) + np.uint64(1), np.uint64(shards))
        shard = ((mix(names)[a] + (names[b] >> np.uint64(8)) % spread[a]) % np.uint64(shards)).astype(np.int32)
        turn = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[turn], np.arange(shards + 1))
        p = quantise((c + 1.0) / (n + v + 1.0))
        learnt = trained.tobytes()
        for k in range(shards):
            if at[k] == at[k + 1]:
                continue
            pick = turn[at[k] : at[k + 1]]
            heads, sizes = np.unique(a[pick], return_counts=True)
            width = often[pick]
            spot = np.repeat(first[pick] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            rows.append((block, k, 0, squeeze(
                learnt, pack_sorted(names[heads] >> CONTEXT), pack_ints(sizes), pack_ints(c[heads]),
                pack_ints(steps(names[b[pick]] >> SUCCESSOR, sizes)), p[b[pick]].tobytes(), pack_ints(width), pack_ints(doc[spot]),
            )))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "shard", "kind", "data"])

    return run


def build_trie(heads: np.ndarray, counts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, together: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of the trie: context hashes ascending with their counts and numbers of successors, and the successors' 28-bit names and counts."""
    ends = np.cumsum(sizes)
    # Successors ascend inside a context; adding what all earlier contexts reach makes the level ascend as a whole.
    reach = successors[ends - 1] + np.uint64(1) if len(ends) else np.zeros(0, np.uint64)
    shift = np.concatenate((np.zeros(1, np.uint64), np.cumsum(reach, dtype=np.uint64)))
    of = np.repeat(np.arange(len(heads)), sizes)
    levels = {"context": elias_fano.build(heads), "pointer": elias_fano.build(np.concatenate(([0], ends)).astype(np.uint64))}
    levels |= {"shift": elias_fano.build(shift), "successor": elias_fano.build(successors + shift[of] if len(of) else successors)}
    out = {f"{name}.{k}": x for name, level in levels.items() for k, x in level.items()}
    out["backoff"] = quantise(np.full(len(heads), 1 - LAMBDA))
    out["weight"] = quantise(LAMBDA * together / np.maximum(counts[of], 1) if len(of) else np.zeros(0))
    return out


def save_trie(levels: dict[str, np.ndarray], path: str) -> dict[str, tuple[int, str, int]]:
    """Write the levels one after the other; returns where each lies."""
    places, at = {}, 0
    with open(path, "wb") as f:
        for name, x in levels.items():
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
            places[name] = (at, x.dtype.str, len(x))
            at += x.nbytes + -x.nbytes % 8
    return places


def map_trie(path: str, places: dict[str, tuple[int, str, int]]) -> dict[str, np.ndarray]:
    return {name: np.memmap(path, dtype=t, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, t) for name, (at, t, n) in places.items()}


def query_trie(trie: dict[str, np.ndarray], heads: np.ndarray, which: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (heads[which], successor): its own probability (0 if unseen), and per head the weight of backing off.

    Contexts are found in level 1, their pointers bound the successor search in level 2.
    """
    level = {name: {k: trie[f"{name}.{k}"] for k in ("head", "low", "bits", "zeros")} for name in ("context", "pointer", "shift", "successor")}
    at = elias_fano.find(level["context"], heads)
    real = np.maximum(at, 0)
    begin, end = elias_fano.get(level["pointer"], real).astype(np.int64), elias_fano.get(level["pointer"], real + 1).astype(np.int64)
    shift = elias_fano.get(level["shift"], real)
    backoff = np.where(at < 0, 1.0, dequantise(trie["backoff"][real]) if len(trie["backoff"]) else 1.0)
    end = np.where(at < 0, begin, end)
    seen = np.zeros(len(which))
    for a in range(0, len(which) if len(trie["weight"]) else 0, ASKED):
        part = slice(a, a + ASKED)
        own = which[part]
        spot = elias_fano.find(level["successor"], successors[part] + shift[own], begin[own], end[own])
        seen[part] = np.where(spot >= 0, dequantise(trie["weight"][np.maximum(spot, 0)]), 0.0)
    return seen, backoff


def _score(table: pa.Table) -> pa.Table:
    """One shard: train on its pairs, score them all, and give each block the sums of its documents."""
    out, v, c, w, p, own, begin = [], [], [], [], [], [], 0
    for block, kind, data in zip(*(table.column(k).to_pylist() for k in ("block", "kind", "data")), strict=True):
        if kind == 1:
            out.append((block, 1, data))
            continue
        trained, heads, sizes, counts, successors, prob, width, doc = unsqueeze(data)
        sizes = unpack_ints(sizes).astype(np.int64)
        v.append(np.repeat(unpack_sorted(heads), sizes))
        c.append(np.repeat(unpack_ints(counts), sizes))
        w.append(unsteps(unpack_ints(successors), sizes))
        p.append(np.frombuffer(prob, np.uint16))
        own.append((block, begin, np.frombuffer(trained, bool), unpack_ints(width).astype(np.int64), unpack_ints(doc).astype(np.int64)))
        begin += len(w[-1])
    if own:
        heads, which = np.unique(np.concatenate(v), return_inverse=True)
        counts = np.zeros(len(heads), dtype=np.uint64)
        counts[which] = np.concatenate(c)
        w, p = np.concatenate(w), np.concatenate(p)
        del v, c
        learnt = np.zeros(len(w), dtype=np.int64)
        for _, at, trained, width, doc in own:
            pair = np.repeat(np.arange(len(width)), width)
            learnt[at : at + len(width)] = np.bincount(pair[trained[doc]], minlength=len(width))
        order = np.lexsort((w, which))
        which, w = which[order], w[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (which[1:] != which[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        together = np.add.reduceat(learnt[order], first)
        has = together > 0
        some, sizes = np.unique(which[first][has], return_counts=True)
        levels = build_trie(heads[some], counts[some], sizes, w[first][has], together[has])
        folder = tempfile.mkdtemp(prefix="trie-")
        path = os.path.join(folder, "levels")
        try:
            trie = map_trie(path, save_trie(levels, path))
            seen, backoff = query_trie(trie, heads, which[first], w[first])
            del trie
        finally:
            os.unlink(path)
            os.rmdir(folder)
        deep = np.empty(len(w))
        deep[order] = -np.log10(seen[np.cumsum(new) - 1] + backoff[which] * dequantise(p[order]))
        for block, at, _, width, doc in own:
            pair = np.repeat(np.arange(len(width)), width)
            sums = np.bincount(doc, np.round(deep[at : at + len(width)] * UNIT)[pair])
            some = np.unique(doc)
            out.append((block, 0, squeeze(pack_sorted(some), pack_ints(sums[some].astype(np.uint64)))))
    types = [pa.int64(), pa.int32(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "kind", "data"])


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _collect(table: pa.Table) -> pa.Table:
    deep, base = [], None
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == 1:
            base = unsqueeze(data)
        else:
            deep.append([unpack_ints(x) if k else unpack_sorted(x) for k, x in enumerate(unsqueeze(data))])
    ids, known, trained, count, seen, score = base
    ids = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
    total = np.zeros(len(ids), dtype=np.int64)
    for doc, sums in deep:
        total[doc.astype(np.int64)] += sums.astype(np.int64)
    columns = [ids, pa.array(~np.frombuffer(trained, bool)), pa.array(unpack_ints(count).astype(np.int64)), pa.array(unpack_ints(seen).astype(np.int64)), pa.array(np.frombuffer(score, np.float64)), pa.array(total / -UNIT)]
    return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_documents(docs: DataFrame, divisor: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) for each row of ``docs`` (doc_id, text).

    Trained on rows whose crc32(doc_id as text) modulo ``divisor`` is not ``held``. ``base_score`` is the add-one unigram
    score, ``score`` the model's log10 probability of the text. A null or empty text is one end token. Rows with a null
    doc_id are not learnt from and not held out; repeated rows are learnt from and scored each; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    state, counted = shared_folder(spark, "lm-blocks"), shared_folder(spark, "lm-counts")
    trained = F.coalesce(learnable(divisor, held), F.lit(False))
    source = docs.select(F.col("doc_id").cast("long"), trained.alias("trained"), F.col("text").cast("string"))
    source.mapInArrow(_blocks, _STATE).write.option("compression", "zstd").parquet(state)
    blocks = spark.read.schema(_STATE).parquet(state)
    asked = blocks.select("block", "dict").mapInArrow(_ask(buckets), "block long, bucket int, dict binary")
    in_buckets(asked, "bucket", buckets, _tell, "block long, bucket int, dict binary").write.parquet(counted)
    told = spark.read.schema("block long, bucket int, dict binary").parquet(counted)
    parts_ = [np.frombuffer(bytes(r[0]), np.uint64) for r in told.filter("block = -1").select("dict").collect()]  # one per bucket
    n, v = (int(sum(int(p[k]) for p in parts_)) for k in (0, 1))
    both = blocks.unionByName(told.filter("block >= 0").withColumn("body", F.lit(None).cast("binary")))
    shards = SHARDS * buckets
    pairs = both.groupBy("block").applyInArrow(_pairs(buckets, shards, n, v), "block long, shard int, kind int, data binary")
    sums = in_buckets(pairs, "shard", shards, _score, "block long, kind int, data binary")
    out = sums.groupBy("block").applyInArrow(_collect, _RESULT)
    return out.withColumns({"train_tokens": F.lit(n).cast("long"), "held_out": F.col("held_out") & F.col("doc_id").isNotNull()})
