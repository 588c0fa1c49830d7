"""Line-first cleaning: rules judge every line, failing lines go, and a text that loses too much goes as a whole.

A line fails when it is navigation (fields between bars, or hardly any words and no sentence mark at its end: menus,
headings), is cut off (an ellipsis at its end), shouts or is full of symbols, carries a boilerplate phrase (cookies, terms,
sign-up, licences), or repeats an earlier line of its text. What is left must be a large enough part of the words; a text must also pass the base rules on length and repeated runs of words. Everything is a
column expression over one row's text, with no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]"
# Fixed phrases of boilerplate, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use cookies", "javascript",
    "lorem ipsum", "click here", "sign up", "log in", "subscribe", "read more", "share this", "powered by",
    "licensed under", "released under", "copyright",
)
FEWEST = 6  # words of a line without a sentence mark at its end
ENOUGH = f"^[\\x20\\x09-\\x0D]*(?:[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+){{{FEWEST - 1}}}[^\\x20\\x09-\\x0D]"
TAIL = 64  # characters at the end of a line, without white space, in which marks are looked for
CLOSED = "[.!?;:\u3002\uFF01\uFF1F][\"'\u2019\u201D\u00BB)\\]]*$"
CUT_OFF = "(?:\\.\\.\\.|\u2026)[\"'\u2019\u201D\u00BB)\\]]*$"
LEAST_KEPT = 50  # percent of a text's words that its good lines must hold


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def measured(line: Column) -> Column:
    """What the rules need of a line with words, each made once."""
    return F.struct(
        line.alias("line"), F.lower(line).alias("low"), F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(TAIL)).alias("tail"), F.length(line).alias("n"),
        F.length(F.regexp_replace(line, "[^\\p{L}]", "")).alias("letters"), F.length(F.regexp_replace(line, "[^\\p{Lu}]", "")).alias("upper"),
        F.length(F.regexp_replace(line, SYMBOLS, "")).alias("symbols"),
    )


def line_passes(m: Column) -> Column:
    """Whether a line (as :func:`measured`) is kept: cheap rules first, phrases last."""
    n, letters = m["n"], m["letters"]
    shape = (2 * letters >= n) & (10 * m["symbols"] <= n) & ((n < 20) | (2 * m["upper"] <= letters))
    ending = ~m["tail"].rlike(CUT_OFF) & (m["tail"].rlike(CLOSED) | m["line"].rlike(ENOUGH))
    bars = n - F.length(F.replace(m["line"], F.lit("|")))
    return shape & ending & (bars < 2) & ~reduce(Column.__or__, [F.contains(m["low"], F.lit(p)) for p in BOILERPLATE])


def repeated_words(words: Column) -> Column:
    """Words of ``words`` (a stored column) inside 3-word runs found twice or more; runs are compared by 64-bit hashes.

    Runs are sorted with their places; those equal to a neighbour are the repeated ones, and the union of their
    three words each is counted by the distances between their places.
    """
    run = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))
    return F.when(F.size(words) >= 4, run).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def clean(docs: DataFrame, least_kept: int = LEAST_KEPT) -> DataFrame:
    """All columns of ``docs`` that the result does not define, then the counts, ``clean_text``, ``base_failed`` and ``kept``.

    Per row (text; null is empty): ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word that equal an earlier one), ``n_repeat_words``, ``n_lines`` with words and
    ``n_good_lines``, ``clean_text`` (the good lines), ``base_failed`` (under 50 words, or more than half of them in
    repeated runs) and ``kept``: not failed and at least ``least_kept`` percent of the words in good lines. Rows are
    independent, so repeated rows and null ids need no care; an empty text fails; an empty table gives an empty result;
    a very long text is read whole, as one row.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_good_lines", "clean_text", "base_failed", "kept"]
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c not in made]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Each step's arrays are columns of their own, read by several expressions of the next, so that each is made once.
    one = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"), words_of(text).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    two = one.select(
        "_row", "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.transform(F.array_distinct("_lines"), measured).alias("_unique"),
        repeated_words(F.col("_words")).alias("_runs"),
    )
    three = two.select(
        "_row", "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_unique")).cast("long").alias("n_dup_lines"),
        F.filter("_unique", line_passes)["line"].alias("_good"),
        F.when(F.size(F.array_distinct("_runs.h")) < F.size("_runs"), F.sort_array("_runs")).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")).alias("_runs"),
    )
    same = lambda x, i, by: F.coalesce(F.get("_runs", i + by)["h"] == x["h"], F.lit(False))
    four = three.withColumn(
        "_places", F.sort_array(F.transform(F.filter("_runs", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["at"]))
    ).withColumn("clean_text", F.array_join("_good", "\n"))
    gap = F.transform("_places", lambda at, i: F.least(F.coalesce(F.get("_places", i + 1) - at, F.lit(3)), F.lit(3)))
    five = four.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.size("_good").cast("long").alias("n_good_lines"), "clean_text",
        F.aggregate(gap, F.lit(0), lambda total, x: total + x).cast("long").alias("n_repeat_words"),
        F.size(words_of(F.col("clean_text"))).cast("long").alias("_good_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    six = five.withColumn("base_failed", failed)
    enough = 100 * F.col("_good_words") >= least_kept * F.col("n_words")
    return six.withColumn("kept", ~F.col("base_failed") & enough).select(*rest, *made)


def keep_good(docs: DataFrame, least_kept: int = LEAST_KEPT) -> DataFrame:
    """The kept rows of ``docs`` with the cleaned text in place of the text; columns as in ``docs``."""
    out = clean(docs, least_kept).filter("kept").withColumn("text", F.col("clean_text"))
    return out.select(*docs.columns)
