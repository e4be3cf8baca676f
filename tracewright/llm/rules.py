"""Quality rules with DataFrame functions only.

Two kinds: measures of one document (words, symbols, repeated lines, repeated
word windows), and line frequency across the documents of a host. Lines are
normalised and hashed, distinct documents are counted per host and line, lines
above the limit are removed as boilerplate, and documents of which little is
left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.windows import with_window_hashes
from tracewright.session import staged

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
FILLED = r"[^\x20\x09-\x0D]"
#: Least words of a text, before and after lines are removed.
LEAST_WORDS = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def repeated_words(order: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. ``order``: (hash, place) of the windows, sorted."""
    both = F.zip_with(
        F.slice(order, 1, F.greatest(F.size(order) - 1, F.lit(0))),
        F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    return F.size(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))


def line_hash(line: Column) -> Column:
    """Of the line in lower case, with numbers as 0 and gaps as one space."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "0"), r"\s+", " "))


def line_hashes(text: Column) -> Column:
    """The distinct hashes of the lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(FILLED)), line_hash))


def without_lines(text: Column, hashes: Column) -> Column:
    """``text`` without the lines of these hashes; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(FILLED) & F.array_contains(hashes, line_hash(x)))), "\n")


def text_key(host: str) -> list[Column]:
    """What lines to remove depends on: the host and the text, the latter by 128 bits of hashes."""
    text = F.coalesce("text", F.lit(""))
    return [F.col(host).alias("host"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, key, the text as it is, and the measures of the document alone.

    Windows are compared by 64-bit hashes within a document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *text_key(host), F.col("text").alias("own"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("n", F.size("words"))
    rows = with_window_hashes(rows, "words", [3]).withColumnRenamed("_w3", "windows")
    rows = rows.withColumn("filled", F.filter("lines", lambda x: x.rlike(FILLED)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("order", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return rows.select(
        "doc_id",
        "host",
        "t1",
        "t2",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAPS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(repeats, repeated_words(F.col("order"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("own").alias("text"),
    )


def boilerplate(lines: DataFrame, least: int) -> DataFrame:
    """(host, h) of the lines that at least ``least`` documents of the host hold, however many it has."""
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    return counted.select(F.col("host").alias("b_host"), F.col("h").alias("b_h"))


def quality_rules(docs: DataFrame, host: str = "source", least: int = 10, depleted: float = 0.5) -> DataFrame:
    """Measures of every whole text, the base verdict, the text without boilerplate lines, and the verdict on what is left.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows. text: without the lines that ``least`` documents of the host
    hold, all else as it was. kept: not base_failed, at least 50 words are left, and
    those removed are at most ``depleted`` of all. A line counts once a
    document, however often it stands there, and goes wherever it stands. Null
    and empty texts have no words and fail; rows without a host are a host of
    their own; repeated rows count and are judged each; extra columns are
    ignored.
    """
    held = staged(docs.select(*text_key(host), line_hashes(F.coalesce("text", F.lit(""))).alias("lines")), "lines")
    # one row for each document and line, made within the row: no shuffle by document
    distinct = held.select("host", "t1", "t2", F.explode("lines").alias("h"))
    common = boilerplate(distinct.select("host", "h"), least)
    lost = distinct.join(common, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("h") == F.col("b_h")))
    lost = lost.groupBy(F.col("host").alias("l_host"), F.col("t1").alias("l_t1"), F.col("t2").alias("l_t2")).agg(F.collect_set("h").alias("lost"))
    same = F.col("host").eqNullSafe(F.col("l_host")) & (F.col("t1") == F.col("l_t1")) & (F.col("t2") == F.col("l_t2"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measures(docs, host).join(lost, same, "left").withColumn("text", F.when(F.col("lost").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("lost"))))
    judged = judged.withColumn("left", F.when(F.col("lost").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("text")))))
    gone = F.col("n_words") - F.col("left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("left") >= LEAST_WORDS) & (gone <= depleted * F.col("n_words"))).alias("kept"),
        gone.alias("n_boilerplate_words"),
        "text",
    )
