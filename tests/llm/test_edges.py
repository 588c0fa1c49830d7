"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest

from factorspark.llm import decontam, lang_cnn, line_clean, mixing, near_join, ngram_lm, pii, sharding, url_filters, warc
from factorspark.session import shared_folder

TEXT = "one two three four five six seven eight nine ten"
LONG = " ".join(f"word{k % 997}" for k in range(60_000))
CLASHES = ["class", "token", "bucket", "key", "row", "label", "score", "lang_pred", "start", "hit", "chosen", "_text", "_words", "_row", "n", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def rows(*items):
    return [(i, t, la, s, None, *["x"] * len(CLASHES)) for i, t, la, s in items]


ITEMS = [
    (1, TEXT, "en", "src0"), (2, TEXT.upper(), "en", "src0"), (2, TEXT.upper(), "en", "src0"), (3, None, None, None), (4, "", "en", "src1"),
    (None, TEXT, "de", None), (5, LONG, "en", "src2"), (6, LONG + " tail", None, "src2"), (7, " \n\t ", "fr", ""), (8, "zwei drei", "de", "src9"), (9, "12 34!", "en", "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(*ITEMS), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


ALL = sorted((i for i, *_ in ITEMS), key=str)


def test_near_join(docs, none):
    got = near_join.near_duplicates(docs)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["n_shingles"] == 6
    assert by[6]["component_id"] == 5 and by[8]["n_shingles"] == 1 and by[8]["component_id"] == 8
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[7]["component_id"] == 7
    assert by[None]["component_id"] is None
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted([1, 3, 4, 5, 7, 8, 9, None], key=str)
    assert near_join.near_duplicates(none).count() == near_join.keep_one(none).count() == 0


def test_language(docs, none):
    got = lang_cnn.identify(docs)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    for k in (3, 4, 7, 9):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[5]["lang_pred"] in ("en", "de", "fr") and 0 <= by[5]["score"] <= 1
    kept = lang_cnn.keep_known(docs, least=0.0001)
    assert kept.columns == docs.columns and not {3, 4, 7, 9} & set(ids(kept))
    assert lang_cnn.identify(none).count() == lang_cnn.keep_known(none).count() == 0
    assert lang_cnn.identify(docs.withColumn("lang", docs["lang"].substr(9, 0))).count() == len(ITEMS)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "too short", "x"), (1, TEXT, "x")], "item_id long, text string, start string")
    got = decontam.contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in got.collect()} == {(1, 1, 1.0), (2, 1, 1.0), (None, 1, 1.0)}
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and ids(kept) == [3, 4, 5, 6, 7, 8, 9]
    assert decontam.contaminated(none, items).count() == decontam.contaminated(docs, items.limit(0)).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs, {"src0": "web"}, {"web": 3, "web/en": 2}, share=1.0, epochs=2)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["times"] == by[4]["times"] == by[7]["times"] == 0 and by[1]["domain"] == "web" and by[3]["source"] == ""
    assert mixing.keep_mixed(docs, {}, {}, 1.0).columns == docs.columns
    assert ids(mixing.keep_mixed(docs, {}, {}, 1.0)) == sorted([1, 2, 2, None, 5, 6, 8, 9], key=str)
    assert mixing.mix(none, {}, {}).count() == mixing.keep_mixed(none, {}, {}, 0.5).count() == 0


def test_sharding(docs, none):
    got = sharding.balanced_shards(docs, 4)
    assert ids(got) == ALL
    places = [(r["shard"], r["slot"]) for r in got.collect()]
    assert sorted(places) == [(s, k) for s in range(4) for k in range(len(ITEMS) // 4 + (s < len(ITEMS) % 4))]
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[3]["size"], by[3]["text_crc32"], by[3]["linked"]) == (1, 0, False) and by[1]["linked"]
    assert sharding.balanced_shards(none).count() == 0


def test_cleaning(docs, none):
    got = line_clean.clean(docs)
    assert ids(got) == ALL and set(CLASHES) <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["n_words"] == by[4]["n_words"] == by[7]["n_words"] == 0 and by[3]["base_failed"]
    assert by[5]["n_words"] == 60_000 and by[5]["n_repeat_words"] == 60_000
    assert line_clean.keep_good(docs).columns == docs.columns
    assert line_clean.clean(none).count() == 0


def test_cleaning_by_endings(spark):
    """Menus, cut-off headings and licence lines fail, prose stays, also when its lines are wrapped."""
    prose = "\n".join(f"Line{k} tells{k} of{k} some{k} odd{k} things{k}" if k % 2 else f"goes{k} on{k} with{k} more{k}." for k in range(20))
    menu = "\n".join(f"{name} {k}" for k in range(20) for name in ("Home", "About us", "Contact"))
    heads = "\n".join(f"The story number {k} of the long and winding ..." for k in range(20))
    notice = "Licensed under the Apache License, Version 2.0."
    texts = spark.createDataFrame([(1, f"{prose}\n{notice}"), (2, menu), (3, heads)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_clean.clean(texts).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == prose
    assert not got[2]["kept"] and got[2]["n_good_lines"] == 0 and not got[3]["kept"] and got[3]["n_good_lines"] == 0


def test_language_model(docs, none):
    got = ngram_lm.score_documents(docs)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[5]["n_tokens"] == 60_001 and by[1]["score"] < 0
    assert not by[None]["held_out"] and by[1]["base_score"] == by[2]["base_score"]
    assert ngram_lm.score_documents(none).count() == 0


def test_personal_data(docs, none):
    got = pii.sanitise(docs)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["spans"] == by[4]["spans"] == "" and by[3]["clean_text"] == "" and by[5]["clean_text"] == LONG
    assert pii.sanitise(none).count() == 0


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "a.net", "/x/"), ("block", "net", "/")]
    ruled = spark.createDataFrame(rules, "verdict string, host string, path string")
    urls = [(1, "http://A.NET/x/y?q"), (2, "http://b.net"), (3, None), (4, ""), (5, "no scheme"), (None, "s://net/"), (6, "s://xnet/"), (6, "s://xnet/"), (7, "s://c.b.a.net/" + "x/" * 5000), (8, "s://a.net/X/#/x/")]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in urls], "page_id long, url string, rule string, verdict string")
    got = {(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, ruled).collect()}
    assert got == {
        (1, "a.net", "a.net/x/", "allow"), (2, "b.net", None, "allow"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "", None, "allow"),
        (None, "net", "net/", "block"), (6, "xnet", None, "allow"), (7, "c.b.a.net", "a.net/x/", "allow"), (8, "a.net", "net/", "block"),
    }
    assert url_filters.judge(pages, ruled).count() == len(urls)
    assert url_filters.judge(pages.limit(0), ruled).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, ruled.limit(0), "block").collect()} == {"block"}


def test_archives(spark):
    big = "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 100
    items = [(1, "http://a/b c\r\nx", big), (2, "http://a/2", big), (3, None, None), (4, "", ""), (None, "u://v", big), (2, "http://a/2", big), (5, "x", "short")]
    pages = spark.createDataFrame([(*x, "x", "x") for x in items], "page_id long, url string, html string, digest string, lead string")
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(pages, folder)
    got = {r["metadata"]["payload"].strip(): r for r in warc.assemble(warc.read_archives(spark, folder)).collect()}
    assert len(got) == 6 and all(r["n_request"] == r["n_metadata"] == 1 + (k == "pageId: 2") for k, r in got.items())
    assert got["pageId: 1"]["response"]["payload"] == big and got["pageId: 1"]["response"]["type"] == "response"
    for k in ("pageId: 2", "pageId:"):
        assert got[k]["response"]["type"] == "revisit" and got[k]["response"]["refers_to"] == got["pageId: 1"]["capture_id"]
    assert got["pageId: 3"]["response"]["payload"] == "" and got["pageId: 5"]["response"]["payload"] == "short"
    empty = shared_folder(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0
