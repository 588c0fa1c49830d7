"""The feature store, exports and JSON artifacts."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

KEYS = ("symbol", "date", "session")


def write_store(long: DataFrame, path: str, partition_by: Sequence[str] = ("date", "session"), rows_per_file: int = 5_000_000) -> None:
    """Parquet with zstd, one folder per (date, session); only folders present in ``long`` are replaced.

    The rebalance hint lets AQE split a heavy (date, session) over several tasks and pack light ones together.
    """
    (
        long.hint("rebalance", *partition_by)
        .sortWithinPartitions(*partition_by, "symbol")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_store(
    spark: SparkSession,
    path: str,
    start,
    end,
    feature_patterns: Sequence[str] | None = None,
    symbols: Sequence[str] | None = None,
    sessions: Sequence[str] | None = None,
) -> DataFrame:
    return select_features(spark.read.parquet(path), start, end, feature_patterns, symbols, sessions)


def select_features(df: DataFrame, start, end, feature_patterns=None, symbols=None, sessions=None) -> DataFrame:
    """Filters on partition columns prune folders, the column patterns prune the scan."""
    out = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if sessions:
        out = out.filter(F.col("session").isin(list(sessions)))
    if symbols is not None:
        out = out.filter(F.col("symbol").isin(list(symbols)))
    if feature_patterns:
        keep = [c for c in df.columns if c in KEYS or any(fnmatch.fnmatch(c, p) for p in feature_patterns)]
        out = out.select(*keep)
    return out


def export(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> None:
    """``parquet``, ``csv`` and/or ``per_symbol_csv`` (a folder per symbol, sorted by date).

    The range shuffle lets several tasks write a symbol with very many rows, each a stretch of its dates. ``df`` is computed
    once: text is written from the Parquet export or, without one, from stored rows.
    """
    if "parquet" in formats:
        df.write.mode("overwrite").parquet(f"{path}/parquet")
        df = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet")
    elif "per_symbol_csv" in formats:  # the range shuffle reads its rows twice
        df = stored(df, "export")
    if "csv" in formats:
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    if "per_symbol_csv" in formats:
        (
            df.withColumn("_symbol", F.col("symbol"))
            .repartitionByRange("_symbol", "date")
            .sortWithinPartitions("_symbol", "date")
            .write.mode("overwrite")
            .option("header", "true")
            .partitionBy("_symbol")
            .csv(f"{path}/per_symbol")
        )


# --- JSON artifacts ------------------------------------------------------------------------------

POOL_SCHEMA = "exprs array<string>, weights array<double>"


def explode_pool(pools: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, expr, weight) from rows with ``exprs`` and ``weights``."""
    return pools.select(*keys, F.posexplode(F.arrays_zip("exprs", "weights")).alias("idx", "_e")).select(
        *keys, "idx", F.col("_e.exprs").alias("expr"), F.col("_e.weights").alias("weight")
    )


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    """(pool, idx, expr, weight); ``pool`` is the file name."""
    raw = spark.read.schema(POOL_SCHEMA).option("multiLine", "true").json(path)
    return explode_pool(raw.withColumn("pool", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)), "pool")


def pack_pools(members: DataFrame, key: str = "pool_id") -> DataFrame:
    """One row per pool with its formulas and weights in order. A pool has at most a few hundred members."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "expr", "weight")))
    return members.groupBy(key).agg(ordered.alias("_m")).select(key, F.col("_m.expr").alias("exprs"), F.col("_m.weight").alias("weights"))


def write_pools(members: DataFrame, path: str, key: str = "pool_id") -> None:
    pack_pools(members, key).write.mode("overwrite").partitionBy(key).json(path)


def write_factor_sets(windows: DataFrame, path: str) -> None:
    """One JSON folder per deploy month, and a manifest.

    ``windows``: (deploy_month, deploy_range, window_idx, train_ic, deploy_ic, expressions, weights).
    """
    full = windows.withColumns({"version": F.lit("1.0"), "n_factors": F.size("expressions"), "export_timestamp": F.current_timestamp()})
    full.write.mode("overwrite").partitionBy("deploy_month").json(f"{path}/factors")
    manifest(windows).write.mode("overwrite").json(f"{path}/manifest")


def manifest(windows: DataFrame) -> DataFrame:
    names = F.array_sort(F.collect_list(F.concat("deploy_month", F.lit(".json"))))
    return windows.agg(F.count(F.lit(1)).alias("n_windows"), names.alias("files"))


def read_factor_sets(spark: SparkSession, path: str) -> DataFrame:
    """(month, exprs, weights) for portfolio.factor_sets_as_of."""
    schema = "deploy_month string, expressions array<string>, weights array<double>"
    raw = spark.read.schema(schema).json(f"{path}/factors")
    return raw.select(F.to_date("deploy_month", "yyyy_MM").alias("month"), F.col("expressions").alias("exprs"), "weights")


def write_ranked(df: DataFrame, path: str, top: int | None = None, bottom: int | None = None) -> None:
    """A ranked table as CSV: whole, and optionally its first and last rows."""
    df.orderBy("rank").write.mode("overwrite").option("header", "true").csv(f"{path}/all")
    if top:
        df.orderBy("rank").limit(top).write.mode("overwrite").option("header", "true").csv(f"{path}/top")
    if bottom:
        df.orderBy(F.col("rank").desc()).limit(bottom).write.mode("overwrite").option("header", "true").csv(f"{path}/bottom")


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
