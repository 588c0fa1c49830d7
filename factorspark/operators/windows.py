"""Walk-forward windows as a table, joined to the panel by range: all windows are evaluated in one job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.formula import DEFAULT, FormulaOptions
from .metrics import pool_daily
from .panel import Panel
from .scale import join_in_span


def rolling_windows(
    spark: SparkSession, first_train, deploy_start, deploy_end, train_months: int = 12, test_months: int = 1, step_months: int = 1
) -> DataFrame:
    """(window_idx, train_start, train_end, deploy_start, deploy_end, deploy_month), one row per step.

    Training ends the day before deployment; deployment ends are capped, training starts floored.
    """
    start, end, floor = (F.lit(d).cast("date") for d in (deploy_start, deploy_end, first_train))
    steps = F.sequence(start, end, F.make_interval(months=F.lit(step_months)))
    rows = spark.range(1).select(F.posexplode(steps).alias("window_idx", "deploy_start"))
    capped = F.least(F.add_months("deploy_start", test_months), end)
    # Once a window reaches the end, no later one starts.
    before_end = F.col("window_idx") == 0
    earlier_end = F.add_months("deploy_start", test_months - step_months)
    return rows.filter((F.col("deploy_start") < end) & (before_end | (earlier_end < end))).select(
        "window_idx",
        F.greatest(F.add_months("deploy_start", -train_months), floor).alias("train_start"),
        F.date_sub("deploy_start", 1).alias("train_end"),
        "deploy_start",
        capped.alias("deploy_end"),
        F.date_format("deploy_start", "yyyy_MM").alias("deploy_month"),
    )


def window_of_month(windows: DataFrame, month: str) -> DataFrame:
    return windows.filter(F.col("deploy_month") == month.replace("-", "_"))


def window_of_index(windows: DataFrame, idx: int) -> DataFrame:
    return windows.filter(F.col("window_idx") == idx)


def horizon_windows(spark: SparkSession, end, validation_months: int = 3, months: tuple[int, ...] = (12, 6, 3)) -> DataFrame:
    """Training windows of several lengths that end where the validation window starts, and that window itself."""
    stop = F.lit(end).cast("date")
    cut = F.add_months(stop, -validation_months)
    spans = [F.struct(F.lit(f"{m}m").alias("window"), F.add_months(cut, -m).alias("start_date"), F.date_sub(cut, 1).alias("end_date")) for m in months]
    spans.append(F.struct(F.lit("validation").alias("window"), cut.alias("start_date"), stop.alias("end_date")))
    return spark.range(1).select(F.explode(F.array(*spans)).alias("_w")).select("_w.*")


def in_windows(df: DataFrame, windows: DataFrame, start: str = "start_date", end: str = "end_date", kind: str = "window") -> DataFrame:
    """One copy of each row per window that covers its date."""
    side = windows.select(kind, F.col(start).alias("_s"), F.col(end).alias("_e"))
    return join_in_span(df, side, "date", "_s", "_e").drop("_s", "_e")


def train_test_split(df: DataFrame, test_months: int) -> DataFrame:
    """``is_test`` marks the last months of the data."""
    last = df.agg(F.max("date")).scalar()
    return df.withColumn("is_test", F.col("date") > F.add_months(last, -test_months))


def walk_forward(
    panel: Panel, pool: Mapping[str, float], target: str, windows: DataFrame, options: FormulaOptions = DEFAULT
) -> DataFrame:
    """(window_idx, train_ic, deploy_ic, deploy_rank_ic) of a fixed pool; NULL where a part has no dates.

    Daily ICs do not depend on the window, so they are made once and the tiny (date, ic, rank_ic) series is
    what gets copied per window.
    """
    daily = pool_daily(panel, pool, target, options)
    covered = join_in_span(daily, windows, "date", "train_start", "deploy_end")
    trains = F.col("date").between(F.col("train_start"), F.col("train_end"))
    deploys = F.col("date").between(F.col("deploy_start"), F.col("deploy_end"))
    per = covered.groupBy("window_idx").agg(
        F.avg(F.when(trains, F.col("ic"))).alias("train_ic"),
        F.avg(F.when(deploys, F.col("ic"))).alias("deploy_ic"),
        F.avg(F.when(deploys, F.col("rank_ic"))).alias("deploy_rank_ic"),
    )
    return windows.select("window_idx", "deploy_month").join(per, "window_idx", "left")
