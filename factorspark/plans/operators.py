"""The formula operators: what each one is called, what it takes and which column it builds.

An operator is one of four shapes. ``Elementwise`` works on a row, ``Rolling`` and ``PairRolling`` on the
frame that ends at a row of one symbol, ``CrossSection`` on all symbols of a date. New ones are added with
:func:`register_operator`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import scalar as S
from ..operators import scale
from ..operators.scale import ordered_position


@dataclass(frozen=True)
class Operator:
    name: str
    fn: Callable
    operands: int = 1
    windowed = False
    scope = "row"

    @property
    def arity(self) -> int:
        return self.operands + (1 if self.windowed else 0)


@dataclass(frozen=True)
class Elementwise(Operator):
    """``fn(*columns) -> column``"""

    def column(self, *args: Column) -> Column:
        return self.fn(*args)


@dataclass(frozen=True)
class Rolling(Operator):
    """``fn(column, window, frames) -> column``; the last formula operand is the window (``20d``)."""

    windowed = True
    scope = "series"
    reach: Callable[[int], int] = lambda n: n - 1  # rows of history one value needs

    def column(self, args: list[Column], window: int, frames: R.Frames) -> Column:
        return self.fn(*args, window, frames)


@dataclass(frozen=True)
class PairRolling(Rolling):
    operands: int = 2


@dataclass(frozen=True)
class CrossSection(Operator):
    """``fn(frame, column name, result name, widest date) -> frame``, so it may choose a plan by size."""

    scope = "date"

    def apply(self, df: DataFrame, column: str, result: str, n_symbols: int) -> DataFrame:
        return self.fn(df, column, result, n_symbols)


@dataclass(frozen=True)
class SeriesFrame(Operator):
    """``fn(frame, column name, window, result name, frames) -> frame`` for recursions over a whole series."""

    windowed = True
    scope = "series_frame"
    reach: Callable[[int], int] = lambda n: n - 1

    def apply(self, df: DataFrame, column: str, window: int, result: str, frames: R.Frames) -> DataFrame:
        return self.fn(df, column, window, result, frames)


def cs_rank(df: DataFrame, column: str, result: str, n_symbols: int) -> DataFrame:
    """0-based ordinal rank over the number of present values; ties by symbol."""
    x = F.col(column)
    if n_symbols <= scale.MAX_GROUP_ROWS:
        day = Window.partitionBy("date")
        place = F.row_number().over(day.orderBy(x.asc_nulls_last(), "symbol")) - 1
        return df.withColumn(result, F.when(x.isNotNull(), place / F.count(x).over(day)))
    counts = df.groupBy("date").agg(F.count(column).alias("_n"))
    placed = ordered_position(df, ["date"], [x.asc_nulls_last(), F.col("symbol")], "_at")
    return (
        placed.join(counts, "date")
        .withColumn(result, F.when(x.isNotNull(), F.col("_at") / F.col("_n")))
        .drop("_at", "_n")
    )


EMA_CHUNK = 1024  # rows whose steps are composed by one running sum
_UNDERFLOW = 300.0  # the product of a chunk's factors stays above exp(-300)


def recursive_ema(df: DataFrame, column: str, window: int, result: str, frames: R.Frames) -> DataFrame:
    """Exponential mean over the whole history of a symbol, seeded by its first value; missing rows keep the last mean.

    One step is an affine map e -> a * e + b. Inside a chunk the maps are composed by running sums of ln a and of b over
    the product so far, chunks are composed by a fold over their last rows, and each row applies its own map to what its
    chunk begins with. Missing rows count for the decay: after g rows the old mean weighs (1 - alpha) ** g.
    """
    alpha = 2.0 / (window + 1)
    series = frames.series()
    so_far, before = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(Window.unboundedPreceding, -1)
    keep = [*df.columns, result]
    x = F.col("_x")
    df = df.withColumn("_x", F.col(column).cast("double"))
    if window <= 1:
        return df.withColumn(result, F.last(x, ignorenulls=True).over(so_far)).select(*keep)
    decay = math.log1p(-alpha)
    size = max(1, min(EMA_CHUNK, int(-_UNDERFLOW / decay)))
    df = df.withColumn("_pos", F.row_number().over(series))
    df = df.withColumns({"_prev": F.last(F.when(x.isNotNull(), F.col("_pos")), ignorenulls=True).over(before), "_chunk": F.floor((F.col("_pos") - 1) / size)})
    old = F.exp(F.lit(decay) * (F.col("_pos") - F.col("_prev")))
    opens = x.isNotNull() & F.coalesce(F.floor((F.col("_prev") - 1) / size) < F.col("_chunk"), F.lit(True))
    df = df.withColumns({
        "_a": F.coalesce(old / (old + alpha), F.lit(0.0)),
        "_b": F.when(F.col("_prev").isNull(), x).otherwise(alpha / (old + alpha) * x),
        "_opens": opens,
    })
    # A chunk's first value may follow a long gap, so its factor is kept out of the product that others are divided by.
    inner = x.isNotNull() & ~F.col("_opens")
    chunk = Window.partitionBy(*frames.keys, "_chunk").orderBy(frames.order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "_log": F.coalesce(F.sum(F.when(inner, F.ln("_a"))).over(chunk), F.lit(0.0)),
        "_a0": F.max(F.when(F.col("_opens"), F.col("_a"))).over(chunk),
        "_b0": F.max(F.when(F.col("_opens"), F.col("_b"))).over(chunk),
    })
    df = df.withColumn("_sum", F.coalesce(F.sum(F.when(inner, F.col("_b") * F.exp(-F.col("_log")))).over(chunk), F.lit(0.0)))
    product = F.exp("_log")
    df = df.withColumns({"_a": F.coalesce(product * F.col("_a0"), F.lit(1.0)), "_b": F.coalesce(product * (F.col("_b0") + F.col("_sum")), F.lit(0.0))})
    ends = F.collect_list(F.when(F.col("_pos") % size == 0, F.struct("_a", "_b"))).over(before)
    start = F.aggregate(ends, F.lit(0.0), lambda e, m: m["_a"] * e + m["_b"])
    seen = F.count(x).over(so_far)
    return df.withColumns({"_seen": seen, "_start": start}).withColumn(result, F.when(F.col("_seen") > 0, F.col("_a") * F.col("_start") + F.col("_b"))).select(*keep)


def ema_reach(n: int) -> int:
    """Rows after which a value's weight in an exponential mean is under 2**-60 of the whole, so that no digit depends on it."""
    return math.ceil(60 * math.log(2) / -math.log1p(-2.0 / (n + 1))) if n > 1 else 0


def _table(ops: list[Operator]) -> dict[str, Operator]:
    return {op.name: op for op in ops}


CORE = _table(
    [
        Elementwise("Abs", S.absolute),
        Elementwise("Sign", S.sign),
        Elementwise("Log", S.log),
        CrossSection("CSRank", cs_rank),
        Elementwise("Add", S.add, 2),
        Elementwise("Sub", S.sub, 2),
        Elementwise("Mul", S.mul, 2),
        Elementwise("Div", S.div, 2),
        Elementwise("Pow", S.power, 2),
        Elementwise("Greater", S.greater, 2),
        Elementwise("Less", S.less, 2),
        Rolling("Ref", R.ref, reach=lambda n: n),
        Rolling("Delta", R.delta, reach=lambda n: n),
        Rolling("Mean", R.mean),
        Rolling("Sum", R.total),
        Rolling("Std", R.std),
        Rolling("Var", R.var),
        Rolling("Skew", R.skew),
        Rolling("Kurt", R.kurt),
        Rolling("Max", R.maximum),
        Rolling("Min", R.minimum),
        Rolling("Med", R.lower_median),
        Rolling("Mad", R.mad),
        Rolling("Rank", R.rank),
        Rolling("WMA", R.wma),
        Rolling("EMA", R.ema),
        Rolling("DEMA", R.ema),
        Rolling("TEMA", R.ema),
        Rolling("RSI", R.rsi),
        PairRolling("Cov", R.cov),
        PairRolling("Corr", R.corr),
    ]
)

# The protected math library, usable in formulas under these names.
PROTECTED = _table(
    [
        Elementwise("Sqrt", S.sqrt_floor),
        Elementwise("PDiv", S.protected_div, 2),
        Elementwise("PSqrt", S.protected_sqrt),
        Elementwise("PLog", S.protected_log),
        Elementwise("PInv", S.protected_inv),
        Elementwise("Sigmoid", S.sigmoid),
        Elementwise("Neg", F.negative),
        Elementwise("Sin", F.sin),
        Elementwise("Cos", F.cos),
        Elementwise("Tan", F.tan),
        Elementwise("Tanh", F.tanh),
        Elementwise("Exp", S.exp),
        Elementwise("Inv", S.inverse),
    ]
)

_USER: dict[str, Operator] = {}


def register_operator(op: Operator, spark=None) -> Operator:
    """Add an operator for all later formulas. With a session, an elementwise one is tried on a 10-row probe."""
    if not op.name.isidentifier():
        raise ValueError(f"operator name {op.name!r} must be an identifier")
    if op.name in CORE:
        raise ValueError(f"{op.name} is a built-in operator")
    if op.operands < 1:
        raise ValueError("an operator takes at least one operand")
    if spark is not None and op.scope == "row":
        for make in (lambda i: F.lit(1.0), lambda i: F.lit(0.0), lambda i: F.lit(-1.0), lambda i: F.col("id") - 5.0):
            probe = spark.range(10).select(op.column(*[make(i) for i in range(op.operands)]).cast("double").alias("v"))
            if probe.filter(F.isnan("v") | (F.abs("v") == float("inf"))).count():
                raise ValueError(f"{op.name} gives NaN or an infinity on plain input")
    _USER[op.name] = op
    return op


def unregister_operator(name: str) -> None:
    _USER.pop(name, None)


def operators(dialect: str = "core") -> dict[str, Operator]:
    from .dialects import OVERRIDES

    return {**CORE, **PROTECTED, **OVERRIDES[dialect], **_USER}
