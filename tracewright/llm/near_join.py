"""N-gram Jaccard join by grouped prefixes.

Shingles have one global order: by how often their cell of a fixed-size count
occurs in the corpus, then by hash, so rare ones come first. Two sets that
link share so many of their first shingles (the prefix), and

1. equal sets are one representative, and representatives with identical
   prefix and size one group;
2. neighbours in the lists of a shingle, every list with its hub (the group
   that has the shingle first in its prefix), and members of a group with its first are
   verified; what links gives provisional components, which are once more held
   against the hubs of other components' lists;
3. only between provisional components, all pairs of groups that share enough
   prefix shingles for their sizes are expanded to members and verified.

Step 3 makes the result whole: a pair it leaves out either cannot link or is
connected already. Large families of near copies are connected in step 2 in
as many pairs as they have members, so nothing emits all pairs of a family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import map_batches, map_iterators, texts_of
from tracewright.llm.shingles import shingle_sets
from tracewright.llm.windows import packed
from tracewright.operators.components import connected_components
from tracewright.session import release, staged

CELL_BITS = 18


def cell_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each of the 2**CELL_BITS cells, a table of fixed size."""

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            sets = list(shingle_sets(texts_of(batch), size))
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(total[cells], pa.int64())})

    each = map_iterators(docs.select("text"), count, "cell int, n long")
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    found = each.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, number of shingles n, a 128-bit signature of the set, and its prefix."""
    told = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, size))

    def run(batch: pa.RecordBatch) -> dict:
        counts = told.value
        out: dict[str, list] = {"n": [], "sig1": [], "sig2": [], "prefix": []}
        for hashes in shingle_sets(texts_of(batch), size):
            n = len(hashes)
            out["n"].append(n)
            out["sig1"].append(int(hashes.sum(dtype=np.uint64).view(np.int64)) if n else 0)
            out["sig2"].append(int(np.bitwise_xor.reduce(hashes * np.uint64(0xBF58476D1CE4E5B9) ^ (hashes >> np.uint64(31))).view(np.int64)) if n else 0)
            order = np.argsort(counts[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
            first = order[: n - (percent * n + 99) // 100 + 1] if n else order
            out["prefix"].append(hashes[first].view(np.int64))
        return {"doc_id": batch.column("doc_id")} | out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, sig1 long, sig2 long, prefix array<long>")


def shingles_of(docs: DataFrame, ids: DataFrame, size: int, most_broadcast: int = 2_000_000) -> DataFrame:
    """rep and its set of shingles for the documents whose doc_id is among ``ids`` (rep)."""
    ids = staged(ids.distinct(), "ids")
    few = ids.count() <= most_broadcast  # 8 bytes each: at most 16 MB
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep"), "left_semi")

    def run(batch: pa.RecordBatch) -> dict:
        return {"rep": batch.column("doc_id"), "set": [h.view(np.int64) for h in shingle_sets(texts_of(batch), size)]}

    sets = staged(map_batches(chosen, run, "rep long, set array<long>").dropDuplicates(["rep"]), "sets")
    release(ids)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def checked(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, held against whole sets of the documents; only links are kept on disk."""
    pairs = staged(pairs, "pairs")
    sets = shingles_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")), size)
    found = staged(verified(pairs, sets, percent), "links")
    release(pairs, sets)
    return found


def closest(pairs: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """Of each a, the ``most`` b that it meets most often. Only for what goes first: the last step takes all pairs."""
    met = pairs.groupBy(a, b).agg(F.count("*").alias("_met"))
    rank = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("_met"), b))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= most).select(a, b)


def fit(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def enough(shared: Column, n: str, m: str, percent: int) -> Column:
    """Whether so many shared shingles, of sets of these sizes, can be those of linked ones. Whole numbers alone: linked sets share percent / (100 + percent) of the sum."""
    return (100 + percent) * shared >= percent * (F.col(n) + F.col(m))


def may_link(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups (xg, yg) whose prefixes share as many shingles as those of linked sets do."""
    own = [groups.select(F.col("gid").alias(f"{k}g"), F.col("n").alias(f"{k}n"), F.col("prefix").alias(f"{k}p")) for k in "xy"]
    both = pairs.join(own[0], "xg").join(own[1], "yg")
    # of the shingles after the prefixes all may be shared, of the side that has fewer
    after = F.greatest(F.col("xn") - F.size("xp"), F.col("yn") - F.size("yp"))
    return both.where(enough(F.size(F.array_intersect("xp", "yp")) + after, "xn", "yn", percent)).select(*pairs.columns)


def provisional(lists: DataFrame, of_group: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component so far; and the lists that hold several, with the most frequent one of each as main."""
    components = connected_components(found, "a", "b").select(F.col("node").alias("rep"), "component")
    units = staged(of_group.join(components, "rep", "left").select("rep", "gid", "n", F.coalesce("component", "rep").alias("comp")), "units")
    postings = lists.select("token", "gid", "n", "pos").join(units.select("gid", "comp").distinct(), "gid")
    sizes = postings.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("m.comp").alias("main"))
    return units, staged(postings.join(main, "token"), "mixed")


def links(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep) of every row with shingles, and verified links (a, b) between representatives."""
    filled = rows.where("n > 0 and doc_id is not null")
    reps = filled.groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    reps = staged(reps.withColumn("gh", F.xxhash64("prefix")), "reps")
    members = filled.select("doc_id", "n", "sig1", "sig2").join(reps.select("n", "sig1", "sig2", "rep"), ["n", "sig1", "sig2"]).select("doc_id", "rep")
    groups = staged(reps.groupBy("n", "gh").agg(F.min("rep").alias("gid"), F.first("prefix").alias("prefix")), "groups")
    of_group = staged(reps.select("rep", "n", "gh").join(groups.select("n", "gh", "gid"), ["n", "gh"]).select("rep", "gid", "n"), "members")

    # lists of the shingles, each in the order of size; a shingle of one group gives nothing
    listed = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    by = Window.partitionBy("token").orderBy("n", "gid")
    near = listed.select("token", "gid", "n", "pos", F.lag("gid").over(by).alias("p_gid"), F.lag("n").over(by).alias("p_n"), F.lead("n").over(by).alias("next_n"))
    fits = (100 * F.col("p_n") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("next_n"))
    lists = staged(near.where(fits), "lists")

    neighbours = lists.where(100 * F.col("p_n") >= percent * F.col("n")).select(F.col("gid").alias("a"), F.col("p_gid").alias("b"))
    # an original has few shingles of its own, so those it shares stand first in its prefix: the hub of a list
    hubs = lists.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("h"))
    to_hub = lists.join(hubs, "token").where((F.col("gid") != F.col("h.gid")) & fit("n", "h.n", percent)).select(F.col("gid").alias("a"), F.col("h.gid").alias("b"))
    near_pairs = closest(neighbours.union(to_hub), "a", "b").select(F.least("a", "b").alias("xg"), F.greatest("a", "b").alias("yg")).distinct()
    near_pairs = may_link(near_pairs, groups, percent).withColumnsRenamed({"xg": "a", "yg": "b"})
    first = near_pairs.distinct().union(of_group.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b")))
    one = checked(docs, first, size, percent)

    units, crossed = provisional(lists, of_group, one)
    hubs = crossed.where("comp = main").groupBy("token").agg(F.min(F.struct("pos", "gid", "n", "comp")).alias("h"))
    again = crossed.where("comp <> main").join(hubs, "token").where(fit("n", "h.n", percent)).select(F.struct("gid", "comp").alias("a"), F.struct(F.col("h.gid").alias("hub"), F.col("h.comp").alias("hub_comp")).alias("b"))
    again = closest(again, "a", "b").select(F.col("a.gid").alias("xg"), F.col("a.comp").alias("comp"), F.col("b.hub").alias("yg"), F.col("b.hub_comp").alias("hub_comp"))
    again = may_link(again, groups, percent).withColumnsRenamed({"xg": "gid", "yg": "hub"})
    right = units.groupBy(F.col("gid").alias("hub"), F.col("comp").alias("hub_comp")).agg(F.min("rep").alias("b"))
    again = again.join(units, ["gid", "comp"]).join(right, ["hub", "hub_comp"]).select(F.col("rep").alias("a"), "b").distinct()
    one = one.union(checked(docs, again, size, percent))
    release(units, crossed)

    units, mixed_lists = provisional(lists, of_group, one)
    per_unit = units.select("gid", "comp").distinct()
    # groups whose members fell into several components meet in every token of theirs
    mixed = per_unit.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select("gid")
    inside = units.join(mixed, "gid").select("gid", "rep", "comp")
    within = inside.alias("x").join(inside.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.comp") < F.col("y.comp"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

    x = mixed_lists.where("comp <> main").select("token", *(F.col(c).alias(f"x{c}") for c in ("gid", "comp", "n", "pos")))
    y = mixed_lists.select("token", *(F.col(c).alias(f"y{c}") for c in ("gid", "comp", "n", "pos", "main")))
    # members of the main component are never paired with each other
    crossing = x.join(y, "token").where("xgid <> ygid and xcomp <> ycomp and (ycomp = ymain or xcomp < ycomp)").where(fit("xn", "yn", percent))
    # the first shingle that two linked sets share leaves enough shingles after it in both
    crossing = crossing.where(enough(F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")), "xn", "yn", percent))
    # a pair may meet either way round, as its lists have different main components
    ends = {"xg": F.least("xgid", "ygid"), "xc": F.when(F.col("xgid") < F.col("ygid"), F.col("xcomp")).otherwise(F.col("ycomp")), "yg": F.greatest("xgid", "ygid"), "yc": F.when(F.col("xgid") < F.col("ygid"), F.col("ycomp")).otherwise(F.col("xcomp"))}
    pair = crossing.select(*(c.alias(n) for n, c in ends.items())).distinct()
    # and so many that their prefixes share a number of them
    likely = may_link(pair, groups, percent)
    left = units.select(F.col("gid").alias("xg"), F.col("comp").alias("xc"), F.col("rep").alias("a"))
    right = units.select(F.col("gid").alias("yg"), F.col("comp").alias("yc"), F.col("rep").alias("b"))
    second = likely.join(left, ["xg", "xc"]).join(right, ["yg", "yc"]).select("a", "b").union(within)
    two = checked(docs, second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), size, percent)
    release(lists, units, mixed_lists, groups, of_group)
    return members, one.union(two)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Words are runs without ASCII white space, A-Z lower-cased; two documents
    link if 100 * intersection >= ``percent`` * union of their shingles of
    ``size`` words. Fewer words are one shingle; null, empty and blank texts
    have none and link with nothing; repeated rows are equal and keep a row
    each; rows without doc_id come back without component; extra columns are
    ignored. doc_id is expected to name one text.
    """
    rows = staged(prefixes(docs, size, percent), "prefixes")
    members, found = links(docs, rows, size, percent)
    components = connected_components(found, "a", "b").select(F.col("node").alias("rep"), "component")
    # a representative is the smallest doc_id of its set, so the smallest of a component is one
    of_doc = members.distinct().join(components, "rep", "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("_component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, or any row if none has one. Repeated rows are near copies too.

    Where doc_id names one row each, it is the rows' name; else rows are
    numbered, which takes a few joins more.
    """
    named = docs.agg((F.count("*") == F.count_distinct("doc_id")).alias("u")).first()["u"]
    if named:
        lost = near_duplicates(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("lost"))
        return docs.join(lost, docs["doc_id"] == lost["lost"], "left_anti")  # of ``docs`` no column but its own is named
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs)), "rows")
    plain = rows.select("row", F.col("own.doc_id").alias("doc_id"), F.col("own.text").alias("text"))
    found = near_duplicates(plain.select(F.col("row").alias("doc_id"), "text"), size, percent).where("doc_id <> component_id")
    found = staged(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "copies")
    grouped = found.union(found.select("group", "group").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    kept = plain.select("row", "doc_id").join(grouped, "row").groupBy("group").agg(F.min(order).alias("o")).select(F.col("o.row").alias("row"))
    lost = grouped.select("row").join(kept, "row", "left_anti")
    return rows.join(lost, "row", "left_anti").select("own.*")
