"""Readers of zipped and plain bar files, dimensions and fundamentals.

Files are found and filtered by path before anything is opened; every file is unpacked and parsed by the task
that holds it.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

PRICE_SCALE = 10_000.0  # fixed value: prices are stored as integers of this fraction
_PRICES = ("open", "high", "low", "close")


def _wanted(path: Column, pattern: str, symbols: Sequence[str] | None) -> Column:
    symbol = F.upper(F.regexp_extract(path, pattern, 1))
    return symbol.isin([s.upper() for s in symbols]) if symbols else F.lit(True)


_MINUTE = r"([^/]+)/\d{8}_trade\.zip$"
_MINUTE_DAY = r"(\d{8})_trade\.zip$"


def _any_case(symbol: str) -> str:
    """The file pattern that a name fulfils in upper and lower case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c if c.isascii() and (c.isalnum() or c in "._-=") else "?" for c in symbol)


def _minute_archives(spark: SparkSession, root: str, symbols: Sequence[str] | None, start, end) -> DataFrame:
    """(path, content) of the wanted archives. The filters stand on the file's metadata, so other files are not opened.

    With ``symbols`` only their folders are listed, where ``root`` holds any of them; else all below ``root`` are.
    """
    if symbols:
        folders = f"{root.rstrip('/')}/{{{','.join(map(_any_case, symbols))}}}"
        at = spark._jvm.org.apache.hadoop.fs.Path(folders)
        root = folders if at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_trade.zip").load(root)
    path = F.col("_metadata.file_path")
    day = F.to_date(F.regexp_extract(path, _MINUTE_DAY, 1), "yyyyMMdd")
    files = files.filter(_wanted(path, _MINUTE, symbols))
    if start is not None:
        files = files.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        files = files.filter(day <= F.lit(end).cast("date"))
    return files.select("path", "content")


def _minute_member(path: str, content: bytes) -> tuple[bytes | None, str | None]:
    """The CSV of an archive, or what is wrong with it."""
    symbol, name = path.split("/")[-2:]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            wanted = f"{name[:8]}_{symbol}_minute_trade.csv".lower()
            found = [n for n in names if n.lower() == wanted] or (names if len(names) == 1 else [])
            return (z.read(found[0]), None) if found else (None, f"no member {wanted}")
    except (zipfile.BadZipFile, zlib.error) as e:
        return None, str(e) or "broken archive"


def broken_minute_zips(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """(path, fault) of the archives that :func:`read_minute_zips` passes over."""
    ship(spark)

    def faults(batches):
        for pdf in batches:
            found = [(p, _minute_member(p, c)[1]) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([x for x in found if x[1]], columns=["path", "fault"])

    return _minute_archives(spark, root, symbols, start, end).mapInPandas(faults, "path string, fault string")


def read_minute_zips(
    spark: SparkSession, root: str, symbols: Sequence[str] | None = None, start=None, end=None, broken: str = "skip"
) -> DataFrame:
    """``<root>/<symbol>/<YYYYMMDD>_trade.zip``, each with one headerless CSV of milliseconds and scaled prices.

    (symbol, datetime, open, high, low, close, volume). Days and symbols without a file are simply absent. The CSV is
    the member named after the day and the symbol, or the only one. An archive without it, or one that cannot be read,
    counts as a missing day; ``broken="raise"`` stops there instead, and :func:`broken_minute_zips` lists them.
    """
    files = _minute_archives(spark, root, symbols, start, end)
    strict = broken == "raise"
    ship(spark)

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text, fault = _minute_member(path, content)
                if fault and strict:
                    raise ValueError(f"{path}: {fault}")
                if fault:
                    continue
                bars = pd.read_csv(io.BytesIO(text), header=None, names=["ms", *_PRICES, "volume"])
                bars.insert(0, "path", path)
                yield bars.astype({"ms": "int64", **{c: "float64" for c in (*_PRICES, "volume")}})

    raw = files.mapInPandas(unpack, "path string, ms long, open double, high double, low double, close double, volume double")
    day = F.to_date(F.regexp_extract("path", _MINUTE_DAY, 1), "yyyyMMdd")
    return _scaled_minutes(raw, F.regexp_extract("path", _MINUTE, 1), day)


def _scaled_minutes(raw: DataFrame, symbol: Column, day: Column) -> DataFrame:
    stamp = F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + F.col("ms"))
    return raw.select(
        F.upper(symbol).alias("symbol"),
        stamp.alias("datetime"),
        *[(F.col(c) / PRICE_SCALE).alias(c) for c in _PRICES],
        F.col("volume").cast("double").alias("volume"),
    )


def read_minute_csv(spark: SparkSession, root: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """The same rows from unpacked ``<YYYYMMDD>_<symbol>_minute_trade.csv`` files: a native columnar CSV scan."""
    raw = (
        spark.read.schema("ms long, open double, high double, low double, close double, volume double")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_minute_trade.csv")
        .csv(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    pattern = r"\d{8}_([^/]+)_minute_trade\.csv$"
    day = F.to_date(F.regexp_extract("path", r"(\d{8})_[^/]+_minute_trade\.csv$", 1), "yyyyMMdd")
    return _scaled_minutes(raw.filter(_wanted(F.col("path"), pattern, symbols)), F.regexp_extract("path", pattern, 1), day)


def read_daily_zips(
    spark: SparkSession, root: str, symbols: Sequence[str] | None = None, start=None, end=None, scale: float = PRICE_SCALE, broken: str = "skip"
) -> DataFrame:
    """``<root>/<symbol>.zip`` with daily rows dated ``YYYYMMDD`` or ``YYYYMMDD HH:MM``; dates inclusive.

    Inside the zip the CSV may be named with or without the dots of the symbol, or be the only file. An archive without
    it, or one that cannot be read, is passed over, or stops the scan with ``broken="raise"``.
    """
    strict = broken == "raise"
    pattern = r"([^/]+)\.zip$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root)
    files = files.filter(_wanted(F.col("_metadata.file_path"), pattern, symbols)).select("path", "content").withColumn("symbol", F.upper(F.regexp_extract("path", pattern, 1)))

    ship(spark)

    def unpack(batches):
        for pdf in batches:
            for symbol, content in zip(pdf["symbol"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names, low = z.namelist(), symbol.lower()
                        found = [n for n in (low.replace(".", "") + ".csv", low + ".csv") if n in names] or (names if len(names) == 1 else [])
                        text = z.read(found[0]) if found else None
                except (zipfile.BadZipFile, zlib.error):
                    text = None
                if text is None:
                    if strict:
                        raise ValueError(f"{symbol}: broken archive")
                    continue
                rows = pd.read_csv(io.BytesIO(text), header=None, names=["day", *_PRICES, "volume"], dtype={"day": str})
                rows.insert(0, "symbol", symbol)
                yield rows.astype({c: "float64" for c in (*_PRICES, "volume")})

    raw = files.select("symbol", "content").mapInPandas(
        unpack, "symbol string, day string, open double, high double, low double, close double, volume double"
    )
    out = raw.select(
        "symbol",
        F.to_date(F.split(F.trim("day"), " ")[0], "yyyyMMdd").alias("date"),
        *[(F.col(c) / F.lit(float(scale))).alias(c) for c in _PRICES],
        "volume",
    )
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out


def union_symbols(frames: Sequence[DataFrame], symbols: Sequence[str] | None = None) -> DataFrame:
    """Union of per-source frames, absent columns NULL, restricted to ``symbols``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.filter(F.col("symbol").isin(list(symbols))) if symbols is not None else out


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return normalise_keys(spark.read.parquet(path))


def normalise_keys(df: DataFrame) -> DataFrame:
    """``date`` as DATE, ``symbol`` in upper case."""
    return df.withColumns({"date": F.to_date("date"), "symbol": F.upper("symbol")})


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", "true").csv(path)
    return raw.select("symbol", F.col("shares_outstanding").cast("double")).distinct()
