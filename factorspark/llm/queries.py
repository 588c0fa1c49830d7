"""The registered queries of this subpackage with their SQL; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder
from . import decontam, lang_cnn, line_clean, main_text, mixing, near_join, ngram_lm, pii, sharding, spelling, url_filters, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""


@query("op9_near_join", NEAR_SQL)
def op9_near_join(spark, folder):
    return near_join.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_balanced_shards")
def op3_balanced_shards(spark, folder):
    return sharding.balanced_shards(table(spark, folder, "documents"))


DOMAINS = {f"src{k}": ("web", "books", "forums", "code")[k // 5] for k in range(20)}
WEIGHTS = {"web": 5, "books": 3, "forums": 1, "code": 2, "web/en": 2, "books/de": 3, "books/en/src5": 4, "code/en/src16": 2}


def _fill_sql(depth: int) -> str:
    """CTEs of one level of the tree: nodes with their room, then their shares, then the leaves under them."""
    keys = mixing.LEVELS[: depth + 1]
    by, parent = ", ".join(keys), ", ".join(keys[:-1])
    part = f"PARTITION BY {parent} " if parent else ""
    path = " || '/' || ".join(keys)
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    order = f"{part}ORDER BY room / weight NULLS LAST, {keys[-1]}"
    return f"""
n{depth} AS (SELECT {by}, sum(room) AS room, max(budget) AS budget, CASE {path} {cases} ELSE 1 END AS weight FROM l{depth} GROUP BY {by}),
a{depth} AS (SELECT *, coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{depth} WINDOW w AS ({order})),
b{depth} AS (SELECT *, done + room * rest / weight <= budget AS filled FROM a{depth}),
c{depth} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN room END) OVER (p), 0) AS taken,
    sum(CASE WHEN NOT filled THEN weight END) OVER (p) AS open_weight FROM b{depth} WINDOW p AS ({part})),
l{depth + 1} AS (SELECT l.* EXCLUDE (budget),
    CASE WHEN filled THEN CAST(c.room AS DOUBLE) ELSE (c.budget - taken) * weight / open_weight END AS budget
  FROM l{depth} l JOIN c{depth} c USING ({by})),"""


MIX_SQL = f"""
WITH base AS (
  SELECT doc_id, CASE coalesce(source, '') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAINS.items())} ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len({WORDS.format("coalesce(text, '')")}) AS tokens FROM documents),
l0 AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * 4 AS room,
    (SELECT CAST(sum(tokens) AS DOUBLE) FROM base) AS budget FROM base GROUP BY 1, 2, 3),
{"".join(_fill_sql(d) for d in range(3))}
e AS (SELECT *, coalesce(CAST(floor(budget / nullif(tokens, 0)) AS BIGINT), 0) AS whole FROM l3),
t AS (SELECT b.*, e.whole, floor(e.budget - e.whole * e.tokens) AS more, md5('11:' || e.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM base b JOIN e USING (domain, lang, source)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY turn, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT doc_id, domain, lang, source, tokens,
  CAST(CASE WHEN tokens > 0 THEN whole + CASE WHEN upto <= more THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS times FROM u"""


@query("op5_source_mixing", MIX_SQL)
def op5_source_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), DOMAINS, WEIGHTS, share=1.0, epochs=4)


LEAK_SQL = f"""
WITH i AS (SELECT item_id, {WORDS.format("lower(coalesce(text, ''))")} AS ws FROM benchmark),
ig AS (SELECT item_id, len(ws) AS n, [array_to_string(ws[k:k+4], ' ') FOR k IN range(1, len(ws) - 3)] AS its FROM i WHERE len(ws) >= 5),
d AS (SELECT doc_id, {WORDS.format("lower(coalesce(text, ''))")} AS ws FROM documents),
dg AS (SELECT doc_id, [array_to_string(ws[k:k+4], ' ') FOR k IN range(1, len(ws) - 3)] AS g FROM d WHERE len(ws) >= 5),
ia AS (SELECT DISTINCT n, unnest(its) AS h, generate_subscripts(its, 1) - 1 AS q FROM ig),
da AS (SELECT doc_id, unnest(g) AS h, generate_subscripts(g, 1) - 1 AS p FROM dg),
w AS (SELECT DISTINCT doc_id, p - q AS start, n FROM da JOIN ia USING (h)),
wg AS (SELECT doc_id, start, n, g[greatest(start, 0) + 1 : least(start + n - 4, len(g))] AS own FROM w JOIN dg USING (doc_id)),
x AS (SELECT doc_id, item_id, greatest(start, 0) AS start, len(own) + len(its) AS joint,
    coalesce(list_sum([least(len([y FOR y IN own IF y = h]), len([y FOR y IN its IF y = h])) FOR h IN list_intersect(own, its)]), 0) AS shared
  FROM wg JOIN ig USING (n)),
y AS (SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(shared AS DOUBLE) / (joint - shared) AS similarity FROM x
  WHERE 100 * shared >= 75 * (joint - shared))
SELECT doc_id, item_id, start, similarity FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


@query("op6_benchmark_decontamination", LEAK_SQL)
def op6_benchmark_decontamination(spark, folder):
    found = decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


@query("op7_byte_cnn_language")
def op7_byte_cnn_language(spark, folder):
    return lang_cnn.identify(table(spark, folder, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN lead END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND lead <> page_id AS again FROM q)"""


@query("op2_warc_transactions", WARC_SQL)
def op2_warc_transactions(spark, folder):
    target = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), target)
    captures = warc.assemble(warc.read_archives(spark, target))
    page = F.regexp_extract("metadata.payload", "pageId: (-?[0-9]+)", 1)
    own = cut(captures.select(
        F.when(page != "", page.cast("long")).alias("page_id"), "capture_id", F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("lead"), F.octet_length("response.payload").cast("long").alias("bytes"), F.sha2("response.payload", 256).alias("digest"),
    ))
    lead = own.filter("record_type = 'response'").select(
        F.col("capture_id").alias("lead"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("its_bytes"), F.col("digest").alias("its_digest")
    )
    return own.join(lead, "lead", "left").select(
        "page_id", F.coalesce("its_bytes", "bytes").alias("payload_bytes"), F.coalesce("its_digest", "digest").alias("payload_digest"), "record_type", "refers_to"
    )


LINE_END = f"right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {line_clean.TAIL})"
CLEAN_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT *, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT *, [x FOR x IN list_distinct(ls) IF
    2 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= length(x)
    AND 10 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) <= length(x)
    AND (length(x) < 20 OR 2 * length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) <= length(regexp_replace(x, '[^\p{{L}}]', '', 'g')))
    AND length(x) - length(replace(x, '|', '')) < 2
    AND NOT regexp_matches(lower(x), '{"|".join(line_clean.BOILERPLATE)}')
    AND (regexp_matches({LINE_END}, '[.!?;:。！？][\x22''’”»)\]]*$') OR len({WORDS.format("x")}) >= {line_clean.FEWEST})
    AND NOT regexp_matches({LINE_END}, '(\.\.\.|…)[\x22''’”»)\]]*$')] AS good FROM l),
r AS (SELECT doc_id, unnest([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] FOR i IN range(1, len(ws) - 1)]) AS run,
    unnest(range(1, len(ws) - 1)) AS spot FROM d WHERE len(ws) >= 4),
s AS (SELECT doc_id, spot FROM r QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([spot, spot + 1, spot + 2]) AS p FROM s) GROUP BY doc_id),
c AS (SELECT g.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(good) AS n_good_lines,
    len({WORDS.format("array_to_string(good, chr(10))")}) AS good_words FROM g LEFT JOIN n ON n.doc_id = g.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_good_lines, base_failed,
  NOT base_failed AND 100 * good_words >= {line_clean.LEAST_KEPT} * n_words AS kept FROM f"""


@query("op4_line_first_cleaning", CLEAN_SQL)
def op4_line_first_cleaning(spark, folder):
    out = line_clean.clean(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_good_lines", "base_failed", "kept"
    )


@query("op8_disclosing_terms")
def op8_disclosing_terms(spark, folder):
    out = pii.sanitise(table(spark, folder, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_terms")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

URL_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(v, h, b) AS (VALUES {RULE_ROWS}),
m AS (SELECT q.*, h || b AS rule, v FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m"""


@query("op10_url_expressions", URL_SQL)
def op10_url_expressions(spark, folder):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filters.judge(table(spark, folder, "pages"), rules)


@query("op1_elias_fano_lm")
def op1_elias_fano_lm(spark, folder):
    return ngram_lm.score_documents(table(spark, folder, "documents"))


@query("op11_pivotal_spelling")
def op11_pivotal_spelling(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_feast_whitening")
def op12_feast_whitening(spark, folder):
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


@query("op13_dom_trees")
def op13_dom_trees(spark, folder):
    return main_text.extract(table(spark, folder, "pages"))
