"""WARC archives: written by Spark's text writer, read back exactly, and assembled into one nested row per capture.

Every capture is three records: the request, the response (or a revisit of a response with an equal payload) and a
metadata record; request and metadata name the response in ``WARC-Concurrent-To``. A record ends in two line breaks,
which is the writer's line separator, so the files are plain WARC/1.1 (in one gzip member each).
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import measured_side
from ..session import cut, ship

LEAST_REVISIT = 100  # bytes of the smallest payload that is worth a revisit
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_BATCH = 8 << 20
_RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string,"
    " headers map<string,string>, http_header string, payload string"
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\t", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, more: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *more]
    fields += [("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of ``pages`` (page_id, url, html) in ``folder``.

    Of captures with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the smallest page_id (null last) is
    the response and the others revisit it. A null html is an empty payload, a null URL an empty URI. Rows equal in all
    three columns are one capture, whose records are written once for each of them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\x00-\\x20]", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), F.col("url").isNull().alias("no_url"), html.alias("html"))
    named = rows.withColumn("digest", F.sha2("html", 256))
    named = named.withColumn("rid", _urn(F.lit("response"), F.col("page_id"), F.col("uri"), F.col("no_url"), F.col("digest")))
    # Only names meet by digest, and a payload that very many pages have is combined before the shuffle. The revisits
    # join the pages as a broadcast when they are few, so that payloads move only when they must.
    names = cut(named.filter(F.octet_length("html") >= LEAST_REVISIT).select("rid", "digest", "page_id"))
    lead = F.min(F.struct(F.col("page_id").isNull(), "page_id", "rid")).alias("lead")
    first = names.groupBy("digest").agg(lead, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.col("lead.rid").alias("lead"))
    marks = cut(names.join(first, "digest").filter("rid <> lead").select("rid", "lead").distinct())
    joined = named.join(measured_side(marks), "rid", "left")
    length = F.octet_length("html").cast("string")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(_END))
    rid, page, uri_ = F.col("rid"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("uri")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record("response", rid, uri_, [digest], "application/http; msgtype=response", F.concat(header, F.col("html")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", rid, uri_, [digest, profile, ("WARC-Refers-To", F.col("lead"))], "application/http; msgtype=response", header)
    host = F.regexp_extract(uri_, "://([^/?#]*)", 1)
    target = F.regexp_extract(uri_, "://[^/?#]*(.*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))
    together = [("WARC-Concurrent-To", rid)]
    request = _record("request", _urn(F.lit("request"), rid), uri_, together, "application/http; msgtype=request", asked)
    fields = F.concat(F.lit("pageId: "), page, F.lit("\r\n"))
    metadata = _record("metadata", _urn(F.lit("metadata"), rid), uri_, together, "application/warc-fields", fields)
    records = F.concat_ws(_END, request, F.when(F.col("lead").isNull(), response).otherwise(revisit), metadata)
    out = joined.select(records.alias("value")).write.option("lineSep", _END).option("compression", "gzip")
    out.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 20_000).text(folder)


def parse(data: bytes):
    """The records of one archive, by their lengths: (headers, block)."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k: v.lstrip(" ") for k, _, v in (line.partition(":") for line in lines)}
        begin = head + 4
        end = begin + int(headers["Content-Length"])
        yield headers, data[begin:end]
        at = end + 4


_NAMES = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "headers", "http_header", "payload"]
_TYPES = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]


def _read(batches):
    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            data = data.as_py()
            for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                header, _, payload = block.partition(b"\r\n\r\n") if h.get("Content-Type", "").startswith("application/http") else (b"", b"", block)
                digest = h.get("WARC-Payload-Digest", "").partition(":")[2] or None
                rows.append((
                    h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"),
                    digest, list(h.items()), header.decode(errors="replace"), payload.decode(errors="replace"),
                ))
                size += len(block) + 500
                if size > _BATCH:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in ``folder``: ids, links, headers, and the block as HTTP header and payload."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(_read, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, target_uri, request, response, metadata, n_request, n_metadata), the three as structs.

    Request and metadata records belong to the response or revisit that they name in ``concurrent_to``; a record that
    names none stands for itself. Of several requests or metadata records of one capture the one with the smallest
    id is given, and the counts tell how many there were; a capture without a record of a kind has null there. Records that
    occur twice count once in the choice. No records give no rows.
    """
    part = F.struct("record_id", "type", "refers_to", "payload_digest", "http_header", "payload")
    pick = lambda kind: F.min(F.when(kind, part))
    is_response = F.col("type").isin("response", "revisit")
    key = F.when(is_response, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    return records.groupBy(key.alias("capture_id")).agg(
        F.min("target_uri").alias("target_uri"), pick(F.col("type") == "request").alias("request"), pick(is_response).alias("response"),
        pick(F.col("type") == "metadata").alias("metadata"), F.count_if(F.col("type") == "request").alias("n_request"),
        F.count_if(F.col("type") == "metadata").alias("n_metadata"),
    )
