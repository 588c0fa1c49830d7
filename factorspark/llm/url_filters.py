"""URL filters: every URL is expanded into host-suffix and path-prefix expressions and looked up by hash prefix.

A rule is a host and a path prefix. The SHA-256 of each expression ``host path`` is looked up by its first bytes in an
equi-join, the full digest then confirms it, and the longest confirmed rule of a URL decides. A URL is expanded no deeper
than the deepest rule, which loses nothing, as no rule is deeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import measured_side

PREFIX_HEX = 8  # four bytes


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for a null URL or one without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, depth: int) -> Column:
    """The host and its parent domains of at most ``depth`` labels."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.greatest(n - depth, F.lit(0)), n - 1), lambda k: F.concat_ws(".", F.slice(labels, k + 1, n)))


def path_prefixes(path: Column, depth: int) -> Column:
    """The beginnings of the path that end in one of its first ``depth`` slashes; none for a path without a slash."""
    parts = F.split(path, "/", depth + 1)
    n = F.size(parts)
    cut = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.concat(F.concat_ws("/", F.slice(parts, 1, k)), F.lit("/")))
    return F.when(n > 1, cut).otherwise(F.array().cast("array<string>"))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``rules`` has (verdict, host, path); a path ends in ``/``, a host is in lower case. A rule fits its host and all
    subdomains when the URL's path starts with the rule's. The longest fitting rule (in characters, host and path)
    decides; between equally long ones the longer host, then ``block``. Without one, ``rule`` is null and the verdict is
    ``default``. Rules given twice count once; null or empty URLs fit no rule. Rows with a null page_id and repeated rows
    are judged each. Empty tables give an empty result, or the default for all. Other columns are ignored.
    """
    ruled = rules.select("verdict", F.col("host").alias("_rhost"), F.col("path").alias("_rpath")).distinct()
    ruled = ruled.withColumn("_digest", digest(F.col("_rhost"), F.col("_rpath")))
    deep = ruled.agg(
        F.coalesce(F.max(F.size(F.split("_rhost", "\\."))), F.lit(1)), F.coalesce(F.max(F.length("_rpath") - F.length(F.replace("_rpath", F.lit("/")))), F.lit(1))
    ).first()
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Hosts and path beginnings repeat over many URLs, so each pair is looked up once.
    places = parsed.select("host", path_prefixes(F.col("path"), deep[1]).alias("_paths")).filter(F.size("_paths") > 0).distinct()
    wide = places.select("host", "_paths", F.explode(host_suffixes(F.col("host"), deep[0])).alias("_suffix"))
    wide = wide.select("host", "_paths", "_suffix", F.explode("_paths").alias("_begin"))
    wide = wide.withColumn("_full", digest(F.col("_suffix"), F.col("_begin"))).withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    listed = measured_side(ruled.withColumn("_short", F.substring("_digest", 1, PREFIX_HEX)))
    hit = wide.join(listed, "_short").filter(F.col("_full") == F.col("_digest"))
    name = F.concat("_rhost", "_rpath")
    rank = F.struct(F.length(name), F.length("_rhost"), (F.col("verdict") == "block"), name)
    best = hit.groupBy("host", "_paths").agg(F.max_by(F.struct(name.alias("rule"), "verdict"), rank).alias("_best"))
    out = parsed.withColumn("_paths", path_prefixes(F.col("path"), deep[1])).join(best, ["host", "_paths"], "left")
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
