"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows, normalised and hashed, are a hash set that is
broadcast when its measured size allows and shuffled by hash otherwise. Every
window of a training document probes it; hits are verified word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.windows import packed, with_window_hashes
from tracewright.session import staged

#: What stands between words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Capitals beyond A-Z: texts with any of them are lower-cased letter by letter.
_OTHER_CAPITALS = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    one_by_one = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(_OTHER_CAPITALS), one_by_one).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """hash, size, item_id and words of each distinct window; an item shorter than ``window`` is one window; a null text has none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    items = items.withColumn("size", F.least("n", F.lit(window)))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most ``window`` numbers
    hashed = with_window_hashes(items, "words", sorted(sizes))
    own = [F.when(F.col("size") == k, F.col(f"_w{k}")) for k in sorted(sizes)]
    hashes = F.coalesce(*own) if own else F.array().cast("array<bigint>")
    each = hashed.select("item_id", "size", "words", F.posexplode(hashes).alias("at", "hash"))
    return each.select("item_id", "size", F.slice("words", F.col("at") + 1, F.col("size")).alias("item_words"), "hash").distinct()


def placed(size: int) -> Column:
    return F.transform(f"_w{size}", lambda h, i: F.struct((i + 1).alias("at"), F.lit(size).alias("size"), h.alias("hash")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 64 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` (row, doc_id, n_words) with the windows found in each: at, size, item_id; at 0 is the row itself."""
    found = benchmark_windows(benchmark, window)
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(F.array_join("item_words", " ")) + 16 * F.size("item_words") + 64), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    # where the table is broadcast, a row of its own that each document finds, so that one pass also returns those without a hit
    mark = found.sparkSession.range(1).select(F.lit(None).cast(found.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("item_words"), F.lit(0).cast("long").alias("hash"))
    table = found.select("item_id", "size", "item_words", "hash")
    small = size["bytes"] <= broadcast_bytes
    table = (table.union(mark) if small else table).withColumnsRenamed({"hash": "b_hash", "size": "b_size"})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = rows if small else staged(rows, "words")
    sizes = sorted(size["sizes"])  # at most ``window`` numbers
    rows = with_window_hashes(rows, "words", sizes)
    columns = ("row", "doc_id", *keep, "n_words", "words") if small else ("row",)
    if len(sizes) == 1:  # the place in the array is the place in the text
        first = F.array(F.lit(0).cast("long"))
        each = rows.select(*columns, F.posexplode(F.concat(first, F.col(f"_w{sizes[0]}"))).alias("at", "hash"))
        each = each.withColumn("size", F.when(F.col("at") == 0, 0).otherwise(F.lit(sizes[0])))
        each = each if small else each.where("at > 0")
    else:
        listed = [placed(k) for k in sizes]
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash")))
        each = rows.select(*columns, F.explode(F.concat(first, *listed) if small or not listed else F.concat(*listed)).alias("x")).select(*columns, "x.at", "x.size", "x.hash")
    match = (F.col("hash") == F.col("b_hash")) & (F.col("size") == F.col("b_size"))
    if small:
        joined = each.join(F.broadcast(table), match)
    else:  # hashes alone are shuffled; the words come back for what was found
        joined = each.hint("merge").join(table.hint("merge"), match).join(rows.select("row", "doc_id", *keep, "n_words", "words"), "row")
    same = (F.col("at") == 0) | (F.slice("words", F.greatest("at", F.lit(1)), F.col("size")) == F.col("item_words"))
    columns = ("row", "doc_id", *keep, "n_words", "at", "size", "item_id")
    if small:
        return joined.where(same).select(*columns)
    # and the rows themselves beside the join, so that they don't all meet at one hash
    own = rows.withColumns({"at": F.lit(0), "size": F.lit(0), "item_id": F.lit(None).cast(found.schema["item_id"].dataType)})
    return joined.where(same & (F.col("at") > 0)).select(*columns).union(own.select(*columns))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: words, words inside an occurring window, items with occurring windows, and the verdict.

    Null and empty texts have no words and are clean; repeated rows are
    judged each; items that share a window all count, those without item_id
    only in n_hit and the verdict; a benchmark without words leaves all clean; extra columns are ignored.
    """
    found = hits(docs, benchmark, window, broadcast_bytes)
    one = F.when(F.col("at") > 0, F.struct("at", "size"))
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set(one).alias("places"), F.collect_set(F.when(F.col("at") > 0, F.col("item_id").cast("string"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["size"] - 1))))
    return by_row.select(
        "doc_id",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def text_keys(text: Column) -> dict[str, Column]:
    """128 bits of hashes of a text: equal texts are judged alike, whatever their doc_id."""
    text = F.coalesce(text, F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def with_text_key(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``own``, beside t1 and t2."""
    return docs.select(packed(docs), *(c.alias(n) for n, c in text_keys(F.col("text")).items()))


def found_by_text(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    return hits(docs.select("doc_id", "text").withColumns(text_keys(F.col("text"))), benchmark, window, keep=("t1", "t2")).where("at > 0")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the contaminated rows, with or without doc_id. All columns as they were."""
    dirty = found_by_text(docs, benchmark, window).select("t1", "t2").distinct()
    return with_text_key(docs).join(dirty, ["t1", "t2"], "left_anti").select("own.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the words inside benchmark windows, and what follows each up to the next word, cut out of text."""
    text = F.coalesce("own.text", F.lit(""))
    found = found_by_text(docs, benchmark, window)
    cut = found.groupBy("t1", "t2").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))).alias("cut"))
    word = SEPARATORS[:-1].replace("[", "[^", 1).replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60") + "+"
    gap = word[:-1].replace("[^", "[", 1) + "*"
    units = F.regexp_extract_all(text, F.lit(f"{word}{gap}"), F.lit(0))
    lead = F.regexp_extract(text, f"^{gap}", 0)
    kept = F.array_join(F.filter(F.col("units"), lambda u, i: ~F.array_contains(F.col("cut"), i + 1)), "")
    joined = with_text_key(docs).join(cut, ["t1", "t2"], "left").withColumn("units", F.when(F.col("cut").isNotNull(), units))
    own = [F.col("own")[c].alias(c) if c != "text" else F.when(F.col("cut").isNull(), F.col("own.text")).otherwise(F.concat(lead, kept)).alias("text") for c in docs.columns]
    return joined.select(*own)
