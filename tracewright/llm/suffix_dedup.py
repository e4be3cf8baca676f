"""Removal of repeated byte strings by suffix arrays.

1. Every string of the length looked for belongs to an anchor in it, so equal
   strings meet under equal anchors. Anchors that occur once are dropped.
2. Equal stretches under one anchor are pre-aggregated to one with a weight.
3. Anchors with several stretches send their bytes to suffix arrays, sorted in
   two stages; adjacent common prefixes tell which strings repeat.
4. The stretches of an anchor that has more than ``most`` of them (a passage in
   very many documents) are split by a second anchor, and go through the same
   steps under both: what lies inside the passage becomes equal, what reaches
   beyond it parts. So no anchor gathers its stretches in one task. What still
   has more after ROUNDS splits is counted by string, as an aggregation that
   combines on the map side.
5. Repeated strings go back to all places of their stretches, and each
   document loses the bytes that they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import map_batches, texts_of
from tracewright.llm.shingles import _TABLE, U, mixed, powers
from tracewright.llm.suffixes import anchors, repeated_starts, runs, split
from tracewright.session import staged

STRETCH = ["anchor", "content", "width", "place"]
#: Bytes put into one suffix array, but for a single anchor's.
BATCH = 256 << 10
#: How often the stretches of a hot anchor are split by a further one.
ROUNDS = 3


def marked(docs: DataFrame, length: int) -> DataFrame:
    """Per row: doc_id, n_bytes, the digest of the whole text, and its stretches by anchor."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.encode() for t in texts_of(batch)]
        found = anchors(texts, length)
        sizes = np.cumsum([0] + [len(f) for f in found])
        rows = np.concatenate(found)
        fields = [pa.array(rows[:, 0], pa.int32()), pa.array(rows[:, 1], pa.int16()), pa.array(rows[:, 2], pa.int16()), pa.array(rows[:, 3]), pa.array(rows[:, 4])]
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "width", "place", "anchor", "content"]))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "sha256": [hashlib.sha256(t).hexdigest() for t in texts], "stretches": lists}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, sha256 string, stretches array<struct<start:int,width:smallint,place:smallint,anchor:bigint,content:bigint>>")


def string_hashes(data: bytes, length: int) -> np.ndarray:
    """Hashes of all strings of ``length``, in order."""
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, U), np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up, dtype=U)))
    return mixed((total[length:] - total[:-length]) * down[: len(data) - length + 1]).view(np.int64)


def small(df: DataFrame, rows: int, row_bytes: int, most_bytes: int) -> DataFrame:
    """``df``, to be broadcast if ``rows`` of ``row_bytes`` (as Spark holds them in memory) stay within ``most_bytes``."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def with_lists(wanted: DataFrame, docs: DataFrame, most_bytes: int) -> DataFrame:
    """text and the stretches ``wanted`` of it (STRETCH, doc_id, start, n), for documents that have any."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*STRETCH, "start", "n")).alias("wanted"))
    lists = small(lists, wanted.count(), 96, most_bytes)  # a struct of 6 fields and its place in the list; a document has one at least
    return docs.select("doc_id", "text").join(lists, "doc_id")


def bytes_of(wanted: DataFrame, docs: DataFrame, length: int, most_bytes: int, hashed: bool = False) -> DataFrame:
    """``wanted`` stretches with their bytes, or with their strings' hashes instead."""

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for text, wanted_here in zip(texts_of(batch), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            for w in wanted_here:
                own = data[w["start"] : w["start"] + w["width"] + length]
                rows.append((*(w[c] for c in STRETCH), w["n"], string_hashes(own, length) if hashed else own))
        return dict(zip((*STRETCH, "n", "data"), map(list, zip(*rows, strict=True)), strict=True))

    schema = f"anchor long, content long, width smallint, place smallint, n long, data {'array<long>' if hashed else 'binary'}"
    return map_batches(with_lists(wanted, docs, most_bytes).select("text", "wanted"), run, schema)


PARENT = [f"of_{c}" for c in STRETCH]


def parts_of(wanted: DataFrame, docs: DataFrame, length: int, most_bytes: int, turn: int) -> DataFrame:
    """``wanted`` stretches split by a further anchor: PARENT, offset in it, STRETCH of the part, n, doc_id and start of its bytes."""

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for doc_id, text, wanted_here in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            for w in wanted_here:
                parent = tuple(w[c] for c in STRETCH)
                for offset, width, place, anchor, content in split(data[w["start"] : w["start"] + w["width"] + length], w["anchor"], w["place"], length, turn).tolist():
                    rows.append((*parent, offset, anchor, content, width, place, w["n"], doc_id, w["start"] + offset))
        return dict(zip((*PARENT, "offset", *STRETCH, "n", "doc_id", "start"), map(list, zip(*rows, strict=True)), strict=True))

    own = "anchor long, {0}content long, {0}width smallint, {0}place smallint"
    schema = "of_" + own.format("of_") + ", offset int, " + own.format("") + ", n long, doc_id long, start int"
    return map_batches(with_lists(wanted, docs, most_bytes).select("doc_id", "text", "wanted"), run, schema)


def by_suffix_arrays(stretches: DataFrame, length: int) -> DataFrame:
    """STRETCH and spans: the runs of starts whose strings repeat. All of an anchor goes into one array."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def judge(rows):
            found = repeated_starts([r[5] for r in rows], [r[2] + 1 for r in rows], [r[4] for r in rows], length)
            out = [(r, runs(f)) for r, f in zip(rows, found, strict=True) if f.any()]
            columns = {c: [r[i] for r, _ in out] for i, c in enumerate(STRETCH)} | {"spans": [[{"lo": int(a), "hi": int(b)} for a, b in x] for _, x in out]}
            kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*STRETCH, "n", "data")), strict=True):
                if held and row[0] != held[-1][0] and size >= BATCH:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield judge(held)

    dealt = stretches.select(*STRETCH, "n", "data").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, content long, width smallint, place smallint, spans array<struct<lo:int,hi:int>>")


def by_counts(stretches: DataFrame) -> DataFrame:
    """The same for anchors with very many stretches: strings are counted by anchor, place and hash."""
    each = stretches.select(*STRETCH, "n", F.posexplode("data").alias("at", "hash")).withColumn("from", F.col("place") - F.col("at"))
    counted = each.groupBy(F.col("anchor").alias("_a"), F.col("from").alias("_f"), F.col("hash").alias("_h")).agg(F.sum("n").alias("_n")).where("_n > 1")
    hit = each.join(counted, (F.col("anchor") == F.col("_a")) & (F.col("from") == F.col("_f")) & (F.col("hash") == F.col("_h")))
    return hit.groupBy(*STRETCH).agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("spans"))


def repeated_spans(docs: DataFrame, rows: DataFrame, length: int, most: int, most_bytes: int) -> DataFrame:
    """doc_id and its runs of bytes covered by repeated strings (lo, hi: starts of strings, first and last)."""
    each = rows.where("doc_id is not null").select("doc_id", F.explode("stretches").alias("x")).select("doc_id", "x.*")
    twice = staged(each.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select(F.col("anchor").alias("_anchor")), "anchors")
    met = staged(each.join(small(twice, twice.count(), 32, most_bytes), F.col("anchor") == F.col("_anchor")).drop("_anchor"), "met")
    stretches = staged(met.groupBy(*STRETCH).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("at")), "stretches")
    spans = staged(spans_of(stretches, docs, length, most, most_bytes), "spans")
    back = met.select("doc_id", *STRETCH, "start").join(spans, STRETCH).select("doc_id", F.explode(moved("start")).alias("s"))
    by_doc = back.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    return by_doc.select("doc_id", joined_runs(F.col("spans"), length).alias("spans"))


def moved(by: str) -> Column:
    """The column ``spans``, each in the place that the column ``by`` gives it."""
    return F.transform("spans", lambda s: F.struct((F.col(by) + s["lo"]).alias("lo"), (F.col(by) + s["hi"]).alias("hi")))


def spans_of(stretches: DataFrame, docs: DataFrame, length: int, most: int, most_bytes: int, turn: int = 0) -> DataFrame:
    """STRETCH and the runs of its starts whose strings repeat. ``stretches``: STRETCH, how many there are (n), and where one lies (at)."""
    kinds = staged(stretches.groupBy(F.col("anchor").alias("_anchor")).agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    # small: no anchor's stretches meet in a task; large: an anchor is one row here, so that AQE splits those of a hot one
    counted = small(kinds, kinds.count(), 40, most_bytes)
    several = stretches.join(counted, F.col("anchor") == F.col("_anchor"))
    wanted = staged(several.select(*STRETCH, "n", "at.doc_id", "at.start", "kinds"), "wanted")
    found = by_suffix_arrays(staged(bytes_of(wanted.where(F.col("kinds") <= most), docs, length, most_bytes), "bytes"), length)
    # a stretch with copies and nothing else under its anchor is repeated as a whole
    alone = stretches.join(counted, F.col("anchor") == F.col("_anchor"), "left_anti").where("n > 1")
    found = found.unionByName(alone.select(*STRETCH, F.array(F.struct(F.lit(0).alias("lo"), F.col("width").cast("int").alias("hi"))).alias("spans")))
    hot = wanted.where(F.col("kinds") > most)
    if hot.isEmpty():
        return found
    if turn == ROUNDS:
        return found.unionByName(by_counts(staged(bytes_of(hot, docs, length, most_bytes, hashed=True), "hashes")))
    parts = staged(parts_of(hot, docs, length, most_bytes, turn), "parts")
    below = staged(parts.groupBy(*STRETCH).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "start")).alias("at")), "stretches")
    spans = staged(spans_of(below, docs, length, most, most_bytes, turn + 1), "spans")
    spans = small(spans, spans.count(), 128, most_bytes)
    # a stretch has few parts, so their lists are joined as they are
    lifted = parts.select(*PARENT, "offset", *STRETCH).join(spans, STRETCH).groupBy(*PARENT).agg(F.flatten(F.collect_list(moved("offset"))).alias("spans"))
    return found.unionByName(lifted.withColumnsRenamed(dict(zip(PARENT, STRETCH, strict=True))))


def joined_runs(spans: Column, length: int) -> Column:
    """Sorted runs of starts, those whose strings touch or overlap made one."""

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        return F.when((F.size(out) > 0) & (s["lo"] <= last["hi"] + length), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<lo:int,hi:int>>"), step)


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Runs of bytes (end exclusive) that the strings cover, in order."""
    out: list[tuple[int, int]] = []
    for s in spans:
        lo, hi = s["lo"], s["hi"] + length
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, length: int = 400, most: int = 256, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(all rows with n_bytes and digest, doc_id and what is left of those that lose bytes)."""
    rows = staged(marked(docs, length), "marked")
    spans = staged(repeated_spans(docs, rows, length, most, most_bytes), "doc_spans")
    n = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    both = docs.select("doc_id", "text").join(small(spans, n, 80, most_bytes), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
        for text, own in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
            data, cut, at = text.encode(), covered(own, length), 0
            parts = []
            for a, b in cut:
                parts.append(data[at:a])
                at = b
            out["n_removed"].append(sum(b - a for a, b in cut))
            out["n_spans"].append(len(cut))
            out["kept"].append(b"".join([*parts, data[at:]]))
        return {"doc_id": batch.column("doc_id")} | out

    return rows, map_batches(both, run, "doc_id long, n_removed long, n_spans long, kept binary")


def removed_repeats(docs: DataFrame, length: int = 400, most: int = 256) -> DataFrame:
    """Per row: bytes, bytes and runs removed, and the digest of what is left, over every whole text.

    A string also repeats where it starts elsewhere in its own text, overlaps
    included. Null, empty and shorter texts lose nothing; repeated rows repeat
    each other; rows without doc_id are not compared and lose nothing; extra
    columns are ignored; doc_id is expected to name one text.
    """
    rows, left = without_repeats(docs, length, most)
    left = left.select(F.col("doc_id").alias("_id"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["_id"])
    both = rows.select("doc_id", "n_bytes", "sha256").join(left, F.col("doc_id") == F.col("_id"), "left")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
