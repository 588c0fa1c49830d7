"""Jaccard join on word shingles with adaptive multi-match prefixes.

A text's set is its distinct word shingles (64-bit hashes cut to 48 bits; hash coincidence is the only source of
error, about 1e-11 for a pair). Texts with equal word sequences form one class. The steps, all spread by hash:

1. every block of texts sends, to each token bucket, its tokens in hash order with the classes that have them;
2. a bucket counts the classes of each token and passes on only tokens that at least two classes have;
3. these meet again by class. A class whose shared tokens make less than the threshold of its size links with
   nothing. The others order their tokens by (class count, hash) and choose the prefix: with ``l`` more tokens than
   the plain prefix filter needs, a partner must share at least ``min(l, l')`` prefix tokens, so a longer prefix
   costs more postings and leaves fewer candidates. ``l`` minimises the estimate
   ``postings + verify_cost * size * postings / l`` (postings / l bounds the partners met ``l`` times);
4. each class is verified against one leading class of each prefix token, which is linear in the postings and
   already joins large groups of near copies into components;
5. what can still link different components is met token by token, filtered by size and position, gathered into
   pairs of small blocks of classes, multi-matched on the prefixes and verified on the whole sets.

No candidate is dropped in step 5 but those that the bounds exclude, so every link between classes is found or its
ends are already in one component. Postings of very common prefix tokens are dealt over a grid of cells of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_folder, ship
from .components import connected_components
from .packing import in_buckets, join_blobs, pack_ints, pack_sorted, signed, split_blobs, unpack_ints, unpack_sorted
from .tokens import parts, shingles, text_bytes, words

BLOCK_BYTES = 1 << 23
CELL_POSTINGS = 2_000
BLOCK_TOKENS = 60_000
MAX_LENGTHENING = 64
VERIFY_COST = 0.1
_MASK = np.uint64((1 << 48) - 1)
_MESSAGE = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def distinct_tokens(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, token) of the distinct shingles of each text, and a class hash per text (of its word sequence)."""
    docs, tokens, classes = [], [], []
    for a, b in parts(offsets):
        w = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        d, t = shingles(w, size)
        t = t & _MASK
        # The class: the words' hashes at their places, summed.
        count = np.diff(w.bounds)
        place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], count)
        one = (w.hashes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        one ^= one >> np.uint64(32)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one * np.uint64(0xFF51AFD7ED558CCD), dtype=np.uint64)))
        classes.append(sums[w.bounds[1:]] - sums[w.bounds[:-1]])
        order = np.lexsort((t, d)) if b - a > 65_000 else np.argsort(t)
        d, t = d[order], t[order]
        if b - a <= 65_000:
            order = np.argsort(d.astype(np.uint16), kind="stable")
            d, t = d[order], t[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        docs.append(d[new] + a)
        tokens.append(t[new])
    none = np.zeros(0, np.uint64)
    return np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([none, *tokens]), np.concatenate([none, *classes])


def _send(size: int, buckets: int):
    def block(ids: np.ndarray, known: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        docs, tokens, classes = distinct_tokens(raw, offsets, size)
        n = np.bincount(docs, minlength=len(ids)).astype(np.uint64)
        home = int(classes[0] % np.uint64(buckets)) if len(classes) else 0
        yield home, 1, join_blobs(ids.tobytes(), known.tobytes(), classes.tobytes(), pack_ints(n))
        _, first, local = np.unique(classes, return_index=True, return_inverse=True)
        keep = np.zeros(len(ids), dtype=bool)
        keep[first] = True
        use = keep[docs]
        tokens, local = tokens[use], local[docs[use]]
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((tokens, bucket))
        tokens, local, bucket = tokens[order], local[order], bucket[order]
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        names, sizes = classes[first].tobytes(), pack_ints(n[first])
        for k in range(buckets):
            if at[k] < at[k + 1]:
                part = slice(at[k], at[k + 1])
                yield k, 0, join_blobs(names, sizes, pack_sorted(tokens[part]), pack_ints(local[part]))

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            known = np.asarray(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
                out = list(block(ids[first:last], known[first:last], raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE)
                first = last

    return run


def _count(buckets: int):
    """Of a token bucket: the tokens of two classes or more, dealt by class; lists of members go on as they are."""

    def run(table: pa.Table) -> pa.Table:
        tokens, names, sizes, out = [], [], [], []
        for bucket, kind, data in zip(*(table.column(k).to_pylist() for k in range(3)), strict=True):
            if kind == 1:
                out.append((bucket, 1, data))
                continue
            own, n, t, local = split_blobs(data)
            own, n, local = np.frombuffer(own, np.uint64), unpack_ints(n), unpack_ints(local).astype(np.int64)
            tokens.append(unpack_sorted(t))
            names.append(own[local])
            sizes.append(n[local].astype(np.uint32))
        if tokens:
            t, c, n = np.concatenate(tokens), np.concatenate(names), np.concatenate(sizes)
            del tokens, names, sizes
            order = np.argsort(t)
            t, c, n = t[order], c[order], n[order]
            many = np.zeros(len(t), dtype=bool)
            many[1:] = t[1:] == t[:-1]
            many[:-1] |= many[1:]
            t, c, n = t[many], c[many], n[many]
            order = np.lexsort((c, t))  # a class that several blocks hold counts once
            t, c, n = t[order], c[order], n[order]
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, n = t[new], c[new], n[new]
            _, inverse, df = np.unique(t, return_inverse=True, return_counts=True)
            df = df[inverse]
            shared = df > 1
            t, c, n, df = t[shared], c[shared], n[shared], df[shared]
            to = (c % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((t, c, to))
            t, c, n, df, to = t[order], c[order], n[order], df[order], to[order]
            at = np.searchsorted(to, np.arange(buckets + 1))
            for k in range(buckets):
                if at[k] < at[k + 1]:
                    part = slice(at[k], at[k + 1])
                    own, first, local = np.unique(c[part], return_index=True, return_inverse=True)
                    out.append((k, 0, join_blobs(own.tobytes(), pack_ints(n[part][first]), pack_ints(local), pack_ints(t[part]), pack_ints(df[part]))))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _MESSAGE.types, strict=True)], schema=_MESSAGE)

    return run


_CLASS = "class long, n long, m long, ell int, taken int, tokens array<long>"
_CLASS_ARROW = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("ell", pa.int32()), ("taken", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def prefix(n: int, df: np.ndarray, percent: int) -> tuple[int, int]:
    """(lengthening l, number of shared tokens in the prefix) for a set of ``n`` tokens of which ``df`` lists the shared ones' counts in order."""
    need = -(-percent * n // 100)
    alone = n - len(df)
    ell = np.arange(1, min(need, MAX_LENGTHENING) + 1)
    taken = np.clip(n - need + ell - alone, 0, len(df))
    postings = np.concatenate(([0], np.cumsum(df)))[taken]
    k = int(np.argmin(postings * (1 + VERIFY_COST * n / ell)))
    return int(ell[k]), int(taken[k])


def _classes(percent: int):
    """The classes of a class bucket that can link at all, with their shared tokens in order and their prefixes."""

    def run(table: pa.Table) -> pa.Table:
        names, sizes, tokens, dfs = [], [], [], []
        for data in table.column(2).to_pylist():
            own, n, local, t, df = split_blobs(data)
            local = unpack_ints(local).astype(np.int64)
            names.append(np.frombuffer(own, np.uint64)[local])
            sizes.append(unpack_ints(n)[local])
            tokens.append(unpack_ints(t))
            dfs.append(unpack_ints(df))
        c, n, t, df = map(np.concatenate, (names, sizes, tokens, dfs))
        order = np.lexsort((t, df, c))
        c, n, t, df = c[order], n[order], t[order], df[order]
        own, first, m = np.unique(c, return_index=True, return_counts=True)
        rows = []
        for k in np.flatnonzero(100 * m >= percent * n[first].astype(np.int64)):
            part = slice(first[k], first[k] + m[k])
            ell, taken = prefix(int(n[first[k]]), df[part].astype(np.int64), percent)
            rows.append((signed(own[k : k + 1])[0], int(n[first[k]]), int(m[k]), ell, taken, signed(t[part])))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(list(c), f) for c, f in zip(columns, _CLASS_ARROW.types, strict=True)], schema=_CLASS_ARROW)

    return run


def _members(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, known, classes, n = split_blobs(data)
            ids = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(np.frombuffer(classes, np.uint64))), pa.array(unpack_ints(n).astype(np.int64))], ["doc_id", "class", "n_shingles"])


def _similar(shared, nx, ny, percent: int):
    return 100 * shared >= percent * (nx + ny - shared)


_GRID = "token long, cell int, class long, comp long, n long, m long, spot int, short boolean, block long"


def _meet(percent: int):
    """Pairs of blocks that hold classes of different components which one of these tokens lets link."""

    def run(table: pa.Table) -> pa.Table:
        x = {k: table.column(k).to_numpy() for k in table.column_names}
        order = np.lexsort((x["cell"], x["token"]))
        x = {k: v[order] for k, v in x.items()}
        edge = np.flatnonzero((np.diff(x["token"]) != 0) | (np.diff(x["cell"]) != 0)) + 1
        found: set[tuple[int, int]] = set()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(order)], strict=True):
            if b - a < 2:
                continue
            y = {k: v[a:b] for k, v in x.items()}
            for i in np.flatnonzero(y["short"]).tolist():  # the smaller of the pair, by its shorter prefix
                n, m = y["n"][i] + y["n"], np.minimum(y["m"][i], y["m"])
                over = (y["n"] > y["n"][i]) | ((y["n"] == y["n"][i]) & (y["class"] > y["class"][i]))
                most = np.minimum(y["spot"][i], y["spot"]) + 1 + np.minimum(y["m"][i] - y["spot"][i], y["m"] - y["spot"]) - 1
                most = np.minimum(most, m)
                hit = over & (y["comp"] != y["comp"][i]) & (100 * y["n"][i] >= percent * y["n"]) & ((100 + percent) * most >= percent * n)
                if hit.any():
                    own = int(y["block"][i])
                    found.update((min(own, o), max(own, o)) for o in np.unique(y["block"][hit]).tolist())
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())})

    return run


def _verify(percent: int):
    """Links between the classes of two blocks: multi-match on the prefixes, then the whole sets."""

    def sets(rows):
        size = np.array([len(r["tokens"]) for r in rows])
        return np.concatenate([np.asarray(r["tokens"], dtype=np.int64) for r in rows]), np.repeat(np.arange(len(rows)), size), np.concatenate([np.arange(s) for s in size])

    def common(t1, r1, t2, r2, shape):
        order = np.argsort(t2, kind="stable")
        t2, r2 = t2[order], r2[order]
        lo, hi = np.searchsorted(t2, t1, "left"), np.searchsorted(t2, t1, "right")
        count = hi - lo
        out = np.zeros(shape[0] * shape[1], dtype=np.int64)
        step = 1 << 20
        total = np.concatenate(([0], np.cumsum(count)))
        a = 0
        while a < len(t1):  # bounded pieces: a very common token meets in parts
            b = max(a + 1, int(np.searchsorted(total, total[a] + step, "right")) - 1)
            at = np.repeat(lo[a:b] - (total[a:b] - total[a]), count[a:b]) + np.arange(total[b] - total[a])
            out += np.bincount(np.repeat(r1[a:b], count[a:b]) * shape[1] + r2[at], minlength=len(out))
            a = b
        return out.reshape(shape)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                (t1, r1, p1), (t2, r2, p2) = sets(left), sets(right)
                shape = (len(left), len(right))
                get = lambda rows, k: np.array([r[k] for r in rows])
                k1, k2 = p1 < get(left, "taken")[r1], p2 < get(right, "taken")[r2]
                match = common(t1[k1], r1[k1], t2[k2], r2[k2], shape)
                open_ = (match >= np.minimum(get(left, "ell")[:, None], get(right, "ell")[None])) & (get(left, "comp")[:, None] != get(right, "comp")[None])
                if not open_.any():
                    continue
                shared = common(t1, r1, t2, r2, shape)
                i, j = np.nonzero(open_ & _similar(shared, get(left, "n")[:, None], get(right, "n")[None], percent))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(get(left, "class")[i]), pa.array(get(right, "class")[j])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``size``-word shingles; words are runs of
    anything but space and 0x09-0x0D, A-Z lower-cased. A text with fewer words is one shingle; a null text or one
    without words has an empty set and links with nothing. ``component_id`` is the smallest doc_id that links reach.
    Rows with a null doc_id are returned with a null component and pass links on like any other; repeated rows are
    returned each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "bucket long, kind int, data binary"
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_send(size, buckets), schema)
    counted = shared_folder(spark, "near-tokens")
    in_buckets(sent, "bucket", buckets, _count(buckets), schema).write.parquet(counted)
    messages = spark.read.schema(schema).parquet(counted)
    members = messages.filter("kind = 1").select("data").mapInArrow(_members, "doc_id long, class long, n_shingles long")
    kept = shared_folder(spark, "near-classes")
    in_buckets(messages.filter("kind = 0"), "bucket", buckets, _classes(percent), _CLASS).write.parquet(kept)
    classes = spark.read.schema(_CLASS).parquet(kept)
    links = class_links(classes, percent)
    named = connected_components(links)
    ids = members.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    small = ids.join(named.withColumnRenamed("node", "class"), "class").groupBy("component").agg(F.min("low").alias("low"))
    per_class = ids.join(
        named.join(small, "component").select(F.col("node").alias("class"), F.col("low").alias("linked")), "class", "left"
    ).select("class", F.coalesce("linked", "low").alias("component_id"))
    own = members.filter("n_shingles > 0").join(per_class, "class").select("doc_id", "n_shingles", "component_id", "class")
    alone = members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class")
    return own.unionByName(alone).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def class_links(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes, enough that every linked pair is in one component of them."""
    spark = classes.sparkSession
    pick = F.posexplode(F.slice("tokens", 1, F.greatest("taken", F.lit(1)))).alias("spot", "token")
    postings = classes.filter("taken > 0").select("class", "n", "m", "ell", pick)
    lead = postings.groupBy("token").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("df")).filter("df > 1")
    sets = classes.select("class", "n", "tokens")
    stars = postings.join(lead.select("token", "leader"), "token").filter("leader <> class").select("class", "leader").distinct()
    shared = F.size(F.array_intersect("tokens", "its_tokens"))
    met = (
        stars.join(sets, "class")
        .join(sets.select(F.col("class").alias("leader"), F.col("n").alias("its_n"), F.col("tokens").alias("its_tokens")), "leader")
        .select("class", "leader", shared.alias("shared"), "n", "its_n")
    )
    met = cut(met.select("class", "leader", "shared", _similar(F.col("shared"), F.col("n"), F.col("its_n"), percent).alias("linked")))
    first = met.filter("linked").select(F.col("leader").alias("a"), F.col("class").alias("b"))
    comps = connected_components(first)
    # Classes that overlap one leader lie together in blocks of bounded size, linked or not.
    family = met.groupBy("class").agg(F.max_by("leader", F.struct("shared", "leader")).alias("family"))
    info = (
        classes.select("class", "n", "m", "ell", "taken", "tokens")
        .join(comps.select(F.col("node").alias("class"), F.col("component").alias("comp")), "class", "left")
        .join(family, "class", "left")
        .withColumns({"comp": F.coalesce("comp", "class"), "family": F.coalesce("family", "class")})
    )
    weight = info.groupBy("family").agg(F.ceil(F.sum("m") / BLOCK_TOKENS).alias("blocks"))
    info = cut(
        info.join(weight, "family")
        .withColumn("block", F.xxhash64("family", F.pmod(F.xxhash64("class"), "blocks")))
        .drop("blocks", "family")
    )
    wide = info.filter("taken > 0").select("class", "comp", "n", "m", "ell", "block", pick)
    mixed = wide.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("df"))
    mixed = mixed.filter("low <> high").select("token", F.ceil(F.col("df") / CELL_POSTINGS).cast("int").alias("cuts"))
    # The smaller of two sets needs 2t/(1+t) of its own size shared, so its prefix for that side is shorter.
    short = F.col("spot") + F.col("n") - F.col("m") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + F.col("ell")
    own = F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    cells = (
        wide.join(mixed, "token")
        .withColumns({"short": short, "own": own})
        .select("*", other.alias("other"))
        .withColumn("cell", F.least("own", "other") * F.col("cuts") + F.greatest("own", "other"))
        .select("token", "cell", "class", "comp", "n", "m", "spot", "short", "block")
    )
    bucket = F.pmod(F.xxhash64("token", "cell"), F.lit(8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    pairs = cells.groupBy(bucket.alias("bucket")).applyInArrow(_meet(percent), "x long, y long").distinct()
    blocks = info.groupBy("block").agg(F.collect_list(F.struct("class", "comp", "n", "ell", "taken", "tokens")).alias("rows"))
    second = (
        pairs.join(blocks.select(F.col("block").alias("x"), F.col("rows").alias("left")), "x")
        .join(blocks.select(F.col("block").alias("y"), F.col("rows").alias("right")), "y")
        .select("left", "right")
        .mapInArrow(_verify(percent), "a long, b long")
    )
    return cut(first.unionByName(second))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; columns as in ``docs``.

    Rows without a doc_id stay; rows repeated under one doc_id are one document, so one of them stays.
    """
    out = near_duplicates(docs, size, percent)
    named = out.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_component"))
    chosen = named.filter("_component = doc_id").select("doc_id")
    some = docs.filter(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return some.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)
