"""Completeness, coverage and report tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.formula import DEFAULT, Days, Feature, FormulaError, FormulaOptions, is_valid, parse
from ..plans.operators import operators
from ..session import ship
from .panel import asof_lookup
from .scale import measured_side


def _unpivot(row: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One aggregate row with columns ``<field>_<name>`` to one row per name."""
    entries = [F.struct(F.lit(n).alias("feature"), *[F.col(f"{f}_{n}").alias(out) for f, out in fields.items()]) for n in names]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def missing_by_feature(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, missing, total, percentage); one pass for all features."""
    aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"m_{c}") for c in features]
    row = df.agg(F.count(F.lit(1)).alias("_total"), *aggs).withColumns({f"t_{c}": F.col("_total") for c in features})
    out = _unpivot(row, features, {"m": "missing", "t": "total"})
    return out.withColumn("percentage", F.try_divide(F.col("missing") * 100.0, F.col("total")))


def finite_coverage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull() & (F.abs(c) < float("inf")), 1.0).otherwise(0.0)).alias(f"c_{c}") for c in features])
    return _unpivot(row, features, {"c": "coverage"})


def completeness_by_symbol(df: DataFrame, prices: Sequence[str], volume: str, fundamentals: Sequence[str]) -> DataFrame:
    """Days, whether any price or the volume is missing somewhere, whether fundamentals never appear, last date."""
    any_price = F.lit(False)
    for c in prices:
        any_price = any_price | F.col(c).isNull()
    seen = F.lit(False)
    for c in fundamentals:
        seen = seen | F.col(c).isNotNull()
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        F.max(any_price).alias("price_missing"),
        F.max(F.col(volume).isNull()).alias("volume_missing"),
        (~F.max(seen)).alias("fundamentals_missing"),
        F.max("date").alias("last_date"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, symbols, trading days and the date range. Distinct counts are two small aggregates."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumns(
        {
            "symbols": df.select("symbol").distinct().agg(F.count(F.lit(1))).scalar(),
            "days": df.select("date").distinct().agg(F.count(F.lit(1))).scalar(),
        }
    )


def validate_portfolio(portfolio: DataFrame, data: DataFrame, features: Sequence[str], day, histories: Sequence[int] = (10, 20, 40)) -> DataFrame:
    """Per name: the features missing on the latest date up to ``day``, whether its history is long enough, completeness.

    A name without a row on that date misses every feature, however good its older rows are.
    """
    upto = data.filter(F.col("date") <= F.lit(day).cast("date"))
    latest = upto.filter(F.col("date") == upto.agg(F.max("date")).scalar()).select("symbol", *features)
    rows = upto.groupBy("symbol").agg(F.count(F.lit(1)).alias("history"))
    names = measured_side(portfolio.select("symbol").distinct())
    joined = names.join(latest, "symbol", "left").join(rows, "symbol", "left").withColumn("history", F.coalesce("history", F.lit(0)))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in features]))
    return joined.select(
        "symbol",
        "history",
        F.array_join(missing, ",").alias("missing"),
        *[(F.col("history") >= n).alias(f"history_{n}") for n in histories],
        (F.size(missing) == 0).alias("complete"),
    )


def complete_share(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count(F.lit(1)).alias("names"), (F.avg(F.col("complete").cast("double")) * 100.0).alias("complete_percentage"))


# --- formulas as data ----------------------------------------------------------------------------


def formula_usage(formulas: DataFrame, col: str = "expr") -> DataFrame:
    """Per formula: features used, operators used, windows, the longest window."""
    text = F.col(col)
    features = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$(\w+)"))))
    ops = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z]\w*)\("))))
    days = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(-?\d+)d\b")), lambda v: v.cast("int"))
    return formulas.select(
        col,
        F.array_join(features, ",").alias("features"),
        F.array_join(ops, ",").alias("operators"),
        F.coalesce(F.array_max(days), F.lit(0)).alias("longest_window"),
    )


def feature_usage(formulas: DataFrame, col: str = "expr") -> DataFrame:
    """(feature, formulas): how many formulas use each feature."""
    used = formulas.select(col, F.explode(F.array_distinct(F.regexp_extract_all(col, F.lit(r"\$(\w+)")))).alias("feature"))
    return used.groupBy("feature").agg(F.count(F.lit(1)).alias("formulas"))


def candidate_validity(lines: DataFrame, options: dict[str, FormulaOptions] | None = None, col: str = "line") -> DataFrame:
    """(total, distinct, duplicate_rate, valid_<set>, valid_rate_<set>) of candidate formula lines.

    Lines are trimmed and counted first, so the check runs once per distinct line however often it repeats.
    """
    ship(lines.sparkSession)
    options = options or {"default": DEFAULT}
    distinct = (
        lines.select(F.trim(col).alias("line")).filter(F.col("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    )
    schema = "n long, " + ", ".join(f"{k} boolean" for k in options)

    def check(batches):
        for pdf in batches:
            flags = {k: [is_valid(t, o) for t in pdf["line"]] for k, o in options.items()}
            yield pd.DataFrame({"n": pdf["n"], **flags})

    total, unique = F.sum("n"), F.count(F.lit(1))
    return distinct.mapInPandas(check, schema).agg(
        total.alias("total"),
        unique.alias("distinct_lines"),
        (1.0 - unique / total).alias("duplicate_rate"),
        *[F.sum(F.col(k).cast("long")).alias(f"valid_{k}") for k in options],
        *[F.avg(F.col(k).cast("double")).alias(f"valid_rate_{k}") for k in options],
    )


def register_formula_table(spark: SparkSession, name: str = "formula_info", options: FormulaOptions = DEFAULT) -> None:
    """A table function for SQL: ``FROM candidates, LATERAL formula_info(line)`` gives one row per text.

    (valid, canonical, fault, features, longest_window): the formula in its canonical form, or what is wrong with it; a
    missing text is a fault like any other.
    """
    ship(spark)

    class FormulaInfo:
        def eval(self, text: str):
            try:
                if text is None:
                    raise FormulaError("no text")
                tree = parse(text, options)
            except FormulaError as e:
                yield False, None, str(e), None, None
                return
            nodes = list(tree.walk())
            features = sorted({n.name for n in nodes if isinstance(n, Feature)})
            yield True, str(tree), None, features, max((n.n for n in nodes if isinstance(n, Days)), default=0)

    spark.udtf.register(name, F.udtf(FormulaInfo, returnType="valid boolean, canonical string, fault string, features array<string>, longest_window int"))


# The windows of the two candidate grids.
MINING_WINDOWS = (1, 5, 10, 20, 40)
FUNCTION_WINDOWS = (10, 20, 30, 40, 50)


def candidate_grid(spark: SparkSession, features: Sequence[str], windows: Sequence[int] = MINING_WINDOWS, ops: Sequence[str] | None = None) -> DataFrame:
    """(expr, op, feature, window): every one-operand rolling operator over every feature and window."""
    names = list(ops) if ops else sorted(n for n, o in operators().items() if o.scope == "series" and o.operands == 1)
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("op"))
    grid = grid.select("op", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    grid = grid.select("op", "feature", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))
    return grid.select(F.format_string("%s($%s,%dd)", "op", "feature", "window").alias("expr"), "op", "feature", "window")


# --- reports -------------------------------------------------------------------------------------


def ensemble_report(pool: DataFrame, contributions: DataFrame, windows: DataFrame, top: int = 10) -> DataFrame:
    """(section, key, value): window ICs, contributions, the heaviest formulas, the weight distribution."""
    sections = [
        windows.select(F.lit("window_ic").alias("section"), F.col("window").alias("key"), F.col("ic").alias("value")),
        contributions.select(F.lit("contribution"), "window", F.col("in_final").cast("double")),
        pool.orderBy(F.abs("weight").desc(), "expr").limit(top).select(F.lit("top_weight"), "expr", "weight"),
        _unpivot(
            pool.agg(
                F.count(F.lit(1)).cast("double").alias("v_count"),
                F.avg("weight").alias("v_mean"),
                F.stddev_samp("weight").alias("v_std"),
                F.min("weight").alias("v_min"),
                F.max("weight").alias("v_max"),
                F.count(F.when(F.col("weight") > 0, 1)).cast("double").alias("v_positive"),
                F.count(F.when(F.col("weight") < 0, 1)).cast("double").alias("v_negative"),
            ),
            ["count", "mean", "std", "min", "max", "positive", "negative"],
            {"v": "value"},
        ).select(F.lit("weights"), "feature", "value"),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.union(s)
    return out


def rolling_summary(windows: DataFrame) -> DataFrame:
    """Averages of the per-window ICs; windows without a value do not count."""
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg("train_ic").alias("train_ic"),
        F.avg("deploy_ic").alias("deploy_ic"),
        F.avg("deploy_rank_ic").alias("deploy_rank_ic"),
    )
