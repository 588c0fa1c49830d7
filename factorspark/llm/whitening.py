"""Whitening of embeddings along the leading components of their covariance, found by FEAST.

Vectors become whole numbers, so counts, sums and products about a centre are exact and the same however Spark deals
the rows. One pass adds up the dimensions, one the products of entries less the rounded mean, both per task and then
in Spark; the driver gets one number for each pair of dimensions. The intervals of the spectrum are solved by separate
tasks and put together by one Rayleigh-Ritz step.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import feast

MAX_DIMS = 4096  # the covariance is a local matrix: 134 MB at most
SCALE, SHIFT = 64, 1_000_000
MAX_SPREAD = 1 << 26  # of 64 * entry within a dimension, so that products of a few rows are exact in a double
_EXACT = 1 << 53
_HALF = 24  # bits of a remainder handled apart, so that no product leaves 64 bits


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # per dimension, exact
    values: np.ndarray  # eigenvalues, largest first
    vectors: np.ndarray  # (dimensions, components), unit columns
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are numbers: no null, NaN or infinity."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def whole(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) int64: floor(64 * entry) + 1000000 of a list column without nulls."""
    column = column.cast(pa.large_list(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat.reshape(len(column), -1)) + SHIFT).astype(np.int64)


def _sums(df: DataFrame) -> list:
    def run(batches: Iterator[pa.RecordBatch]):
        total = {}
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(b.column(0).cast(pa.large_list(pa.float64())).offsets.to_numpy())
            for d in np.unique(sizes):
                x = whole(b.column(0).filter(pa.array(sizes == d)))
                n, s, low, high = total.get(int(d), (0, 0, x.min(axis=0), x.max(axis=0)))
                total[int(d)] = (n + len(x), s + x.sum(axis=0), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        for d, (n, s, low, high) in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d), "s": s, "low": low, "high": high})

    parts = df.mapInArrow(run, "d int, i int, n long, s long, low long, high long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s")]
    return parts.groupBy("d", "i").agg(*exact, F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "i").limit(MAX_DIMS + 1).collect()


def _products(df: DataFrame, centre: np.ndarray, spread: int) -> np.ndarray:
    """Exact sums over the rows of the products of each two dimensions, less ``centre``: (d, d) Python integers."""
    d = len(centre)
    upper = np.triu_indices(d)
    step = max(1, _EXACT // max(1, spread * spread))

    def run(batches):
        total, held = np.zeros((d, d), np.int64), 0

        def cells():
            return pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "p": total[upper]})

        for b in batches:
            x = (whole(b.column(0)) - centre).astype(float) if b.num_rows else np.zeros((0, d))
            for a in range(0, len(x), step):
                part = x[a : a + step]
                if (held + len(part)) * spread * spread >= 1 << 62:
                    yield cells()
                    total[:], held = 0, 0
                total += (part.T @ part).astype(np.int64)  # whole numbers under 2^53: exact
                held += len(part)
        if held:
            yield cells()

    sums = df.mapInArrow(run, "i int, j int, p long").groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p"))
    out = np.zeros((d, d), dtype=object)
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["p"])
    return out


def fit(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """Exact sums and the leading components of all usable vectors of ``df``; None without any.

    Components whose eigenvalue is zero to rounding (dimensions that depend on others) are left out. ValueError if
    vectors differ in length, have over MAX_DIMS entries, or entries of a dimension spread over MAX_SPREAD / 64.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = df.filter(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    rows = _sums(vectors)
    if not rows:
        return None
    d, n = int(rows[0]["d"]), int(rows[0]["n"])
    if d > MAX_DIMS or len(rows) != d:
        raise ValueError("vectors must have one length, of at most " + str(MAX_DIMS))
    sums = [int(r["s"]) for r in rows]
    centre = np.array([s // n for s in sums], dtype=np.int64)
    spread = max(max(int(r["high"]) - c, c - int(r["low"])) + 1 for r, c in zip(rows, centre.tolist(), strict=True))
    if spread >= MAX_SPREAD:
        raise ValueError(f"entries of one dimension spread over {spread / SCALE}: scale the vectors first")
    rest = [s - n * c for s, c in zip(sums, centre.tolist(), strict=True)]
    products = _products(vectors, centre, spread)
    cov = np.array([[float(Fraction(n * products[i, j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    parts = feast.intervals(cov, components)
    if not parts:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), float(np.trace(cov)))
    held = spark.sparkContext.broadcast(cov)  # MAX_DIMS bounds it

    def solve(batches):
        for b in batches:
            for r in b.to_pylist():
                found, vectors = feast.eigenpairs(held.value, r["low"], r["high"], r["held"])
                yield pa.RecordBatch.from_pydict({"low": [r["low"]] * len(found), "vector": pa.array(list(vectors.T), pa.list_(pa.float64()))})

    tasks = spark.createDataFrame(parts, "low double, high double, held int").repartition(len(parts))
    found = sorted(tasks.mapInArrow(solve, "low double, vector array<double>").collect(), key=lambda r: (r["low"], r["vector"]))
    if len(found) != sum(p[2] for p in parts):
        raise ArithmeticError("inertia counts more eigenvalues than were found")
    values, vectors = feast.combine(cov, [np.array([r["vector"] for r in found]).T], components)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` with a usable vector, and a struct ``white`` beside their columns.

    ``white.whitened`` has one double per component; ``white.deviation`` (decimal) is the sum over dimensions of
    (n * x - S) ** 2, exact.
    """
    ship(df.sparkSession)
    n, sums = model.n, model.sums
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * c for s, c in zip(sums, centre.tolist(), strict=True)]
    high = np.array([r >> _HALF for r in rest], dtype=np.int64)
    low = np.array([r & ((1 << _HALF) - 1) for r in rest], dtype=np.int64)
    turn = model.vectors / np.sqrt(model.values)
    mean_rest = np.array([r / n for r in rest])

    @F.arrow_udf("struct<whitened: array<double>, squares: long, high: long, low: long>")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = whole(column).reshape(len(column), len(centre)) - centre
            white = (x - mean_rest) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.reshape(-1)))
            yield pa.StructArray.from_arrays([lists, *(pa.array(v, pa.int64()) for v in ((x * x).sum(axis=1), x @ high, x @ low))], ["whitened", "squares", "high", "low"])

    def number(value: int) -> Column:
        return F.lit(Decimal(value)).cast("decimal(38,0)")

    def wide(name: str) -> Column:
        return F.col("_white")[name].cast("decimal(20,0)")

    cross = wide("high") * number(1 << _HALF) + wide("low")
    deviation = number(n * n) * wide("squares") - number(2 * n) * cross + number(sum(r * r for r in rest))
    out = df.filter(usable(F.col(vector))).withColumn("_white", parts(F.col(vector).cast("array<double>")))
    white = F.struct(F.col("_white.whitened").alias("whitened"), deviation.cast("decimal(38,0)").alias("deviation"))
    return out.withColumn("white", white).drop("_white")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest entry, in absolute value, of the covariance of ``whitened`` (a column ``w`` of n arrays) less the identity.

    The whitened values are centred already, but for rounding: what their mean is off is taken from the products.
    """
    k = components
    upper = np.triu_indices(k)

    def run(batches):
        total, means = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = b.column(0).cast(pa.large_list(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if len(w):
                total += w.T @ w
                means += w.sum(axis=0)
        i, j = (pa.array(np.concatenate(x), pa.int32()) for x in ((upper[0], np.full(k, -1)), (upper[1], np.arange(k))))
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "p": np.concatenate((total[upper], means))})

    rows = whitened.select("w").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    cell = {(r["i"], r["j"]): r["p"] / n for r in rows}
    return max((abs(p - cell[-1, i] * cell[-1, j] - (i == j)) for (i, j), p in cell.items() if i >= 0), default=0.0)


def whitened_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Reads the columns ``key`` and ``vector`` only; other columns may have any name. Rows whose vector is null, empty
    or holds a null, NaN or infinite entry are left out; repeated rows and equal vectors count each; the key may be
    null. Vectors of up to MAX_DIMS entries are taken whole. Equal eigenvalues give some orthonormal basis of their
    space; components of eigenvalue 0 are left out, so one vector alone, or equal vectors only, give no row, as does
    an empty table. ``deviation`` is a LONG: a sum that does not fit one is an error, as any overflow in Spark.
    """
    model = fit(df, vector, components)
    if model is None or not len(model.values):
        none = df.select(F.col(key), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
        return none.limit(0)
    white = whiten(df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")), model, "_vector")
    k = len(model.values)
    error = identity_error(white.select(F.col("white.whitened").alias("w")), model.n, k)
    rows = white.select("_key", F.col("white.deviation").cast("long").alias("deviation"), F.posexplode("white.whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(float(v)) for v in model.explained])
    return rows.select(
        F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
