"""Density clusters by grid cells, without the pairs inside a dense cell or between two of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.components import connected_components
from tracewright.session import release, staged

AXES = ("x", "y", "t")
BLOCK = ["day", "bx", "by", "bt"]
#: Cells a distance, so that all points of a cell are near each other (over the root of 3) and near points lie two cells apart at most.
PER_EPS = 1.75
#: So few pairs of points are compared at once.
COMPARED = 10_000_000
#: Halvings of a cell after which the points of boxes still open are compared, however many.
LEVELS = 30


def _box() -> Column:
    return F.struct(*(f(a).alias(n + a) for a in AXES for n, f in (("l", F.min), ("h", F.max))))


def _squared(of: Callable[[str], Column]) -> Column:
    x, y, t = (of(a) for a in AXES)
    return x * x + y * y + t * t


def least_apart(a: str, b: str) -> Column:
    """No more than the squared distance of any two points of two boxes, as rounding keeps order."""
    return _squared(lambda c: F.greatest(F.col(f"{a}.l{c}") - F.col(f"{b}.h{c}"), F.col(f"{b}.l{c}") - F.col(f"{a}.h{c}"), F.lit(0.0)))


def most_apart(a: str, b: str) -> Column:
    """No less than the squared distance of any two points of two boxes."""
    return _squared(lambda c: F.greatest(F.col(f"{a}.h{c}") - F.col(f"{b}.l{c}"), F.col(f"{b}.h{c}") - F.col(f"{a}.l{c}")))


def _apart(a: str, b: str) -> Column:
    return _squared(lambda c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))


def _blocks(df: DataFrame, low: Callable[[str], Column], high: Callable[[str], Column]) -> DataFrame:
    """A row for each block of 4 x 4 x 4 cells between two cells."""
    for c in AXES:
        df = df.withColumn(f"b{c}", F.explode(F.sequence(F.shiftright(low(c), 2), F.shiftright(high(c), 2))))
    return df


def meeting_cells(cells: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of cells, a < b, whose boxes come as near as ``eps``; whether each is dense and whether they adjoin."""
    rows = cells.select("day", "cell", "box", "dense", *(f"c{c}" for c in AXES))
    own = _blocks(rows, lambda c: F.col(f"c{c}"), lambda c: F.col(f"c{c}"))
    around = _blocks(rows, lambda c: F.col(f"c{c}") - 2, lambda c: F.col(f"c{c}") + 2)
    own, around = (df.select(*BLOCK, F.struct("cell", "box", "dense", *(f"c{c}" for c in AXES)).alias(n)) for df, n in ((own, "p"), (around, "q")))
    adjoin = F.greatest(*(F.abs(F.col(f"p.c{c}") - F.col(f"q.c{c}")) for c in AXES)) <= 1
    met = own.join(around, BLOCK).where((F.col("p.cell") < F.col("q.cell")) & (least_apart("p.box", "q.box") <= eps * eps))
    return met.select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), F.col("p.dense").alias("dense_a"), F.col("q.dense").alias("dense_b"), adjoin.alias("adjoin"))


def _parts(points: DataFrame, of: DataFrame, side: float, level: int) -> DataFrame:
    """Boxes of the points of the cells in ``of`` (a, b), by cells whose side is halved ``level`` times; ``up`` is the part of the level before."""
    wanted = of.select(F.explode(F.array("a", "b")).alias("_cell")).distinct()
    at = F.struct(*(F.floor(F.col(c) / side * float(1 << level)).alias(c) for c in AXES))
    inside = points.join(wanted, F.col("cell") == F.col("_cell"), "left_semi").withColumn("at", at)
    boxes = inside.groupBy("cell", "at").agg(_box().alias("box"), F.count("*").alias("n"))
    return boxes.withColumn("up", F.struct(*(F.shiftright(F.col(f"at.{c}"), 1).alias(c) for c in AXES)))


def _part_pairs(pairs: DataFrame, parts: DataFrame, eps: float) -> DataFrame:
    """Pairs of parts that may hold near points: of two cells, or of two parts of the level before (at_a, at_b)."""
    for s in "ab":
        own = parts.select(F.col("cell").alias("_c"), F.col("up").alias("_up"), F.col("at").alias(f"_at_{s}"), F.col("box").alias(f"box_{s}"), F.col("n").alias(f"n_{s}"))
        on = F.col(s) == F.col("_c")
        pairs = pairs.join(own, on & (F.col(f"at_{s}") == F.col("_up")) if f"at_{s}" in pairs.columns else on).drop("_c", "_up")
    sure = most_apart("box_a", "box_b") <= eps * eps
    return pairs.where(least_apart("box_a", "box_b") <= eps * eps).select("a", "b", F.col("_at_a").alias("at_a"), F.col("_at_b").alias("at_b"), "n_a", "n_b", sure.alias("sure"))


def touching_cells(pairs: DataFrame, points: DataFrame, eps: float, side: float) -> list[DataFrame]:
    """The pairs (a, b) of dense cells that hold two points at most ``eps`` apart.

    Parts of cells are told apart, or found near, by their boxes; parts that
    are neither are halved, until few pairs of their points are left, which
    are compared. Only what is still open is read again.
    """
    found = []
    if pairs.isEmpty():
        return found
    for level in range(1, LEVELS + 1):
        parts = _parts(points, pairs, side, level)
        tried = staged(_part_pairs(pairs.select("a", "b", *(c for c in ("at_a", "at_b") if c in pairs.columns)), parts, eps), "tried")
        found.append(staged(tried.where("sure").select("a", "b").distinct(), "touching"))
        release(pairs)
        pairs = staged(tried.join(found[-1], ["a", "b"], "left_anti"), "open")
        release(tried)
        left, cost = pairs.agg(F.count("*"), F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()
        if not left:
            return found
        if level == LEVELS or cost <= COMPARED:
            break
    for s in "ab":
        wanted = pairs.select(F.col(s).alias("_cell"), F.col(f"at_{s}").alias("_at")).distinct()
        at = F.struct(*(F.floor(F.col(c) / side * float(1 << level)).alias(c) for c in AXES))
        own = points.select("cell", at.alias("_own"), F.struct(*AXES).alias(f"p_{s}")).join(wanted, (F.col("cell") == F.col("_cell")) & (F.col("_own") == F.col("_at")), "left_semi")
        pairs = pairs.join(own, (F.col(s) == F.col("cell")) & (F.col(f"at_{s}") == F.col("_own"))).drop("cell", "_own")
    return [*found, staged(pairs.where(_apart("p_a", "p_b") <= eps * eps).select("a", "b").distinct(), "touching")]


def near_points(own: DataFrame, others: DataFrame, eps: float, side: float) -> DataFrame:
    """(p, q) of points of a day at most ``eps`` apart: each of ``own`` with all of ``others`` but itself, by blocks; others near an edge lie in several."""
    cell = lambda by: lambda c: F.floor((F.col(c) + by) / side)
    left = _blocks(own, cell(0.0), cell(0.0)).select(*BLOCK, F.struct("ord", *AXES).alias("p"))
    right = _blocks(others, cell(-1.0001 * eps), cell(1.0001 * eps)).select(*BLOCK, F.struct("ord", "cell", *AXES).alias("q"))
    return left.join(right, BLOCK).where((F.col("p.ord") != F.col("q.ord")) & (_apart("p", "q") <= eps * eps))


def clusters(points: DataFrame, eps: float, least: int) -> DataFrame:
    """The points that lie in a density cluster of their day, with its smallest core point as ``cluster``; staged.

    ``points``: day, ord (unique), x, y, t, and columns that are carried
    along; staged, and released here. A core point has ``least`` points at
    most ``eps`` from it, itself included; core points that near each other
    share a cluster; a border point joins the smallest near it. A cell of
    ``least`` points holds core points of one cluster alone, so it is handled
    as one: pairs of points are made only where one of them lies in a sparser
    cell, and written only where both do or once for a dense cell.
    """
    side = eps / PER_EPS
    carried = points.columns
    gridded = points.where(" and ".join(f"{c} is not null" for c in ("day", *AXES))).withColumns({f"c{c}": F.floor(F.col(c) / side) for c in AXES})
    cells = gridded.groupBy("day", *(f"c{c}" for c in AXES)).agg(F.min("ord").alias("cell"), F.count("*").alias("n"), _box().alias("box"))
    cells = staged(cells.withColumn("dense", (F.col("n") >= least) & (most_apart("box", "box") <= eps * eps)), "cells")
    held = staged(gridded.join(cells.select("day", *(f"c{c}" for c in AXES), "cell", "dense"), ["day", *(f"c{c}" for c in AXES)]).select(*carried, "cell", "dense"), "held")
    release(points)
    met = staged(meeting_cells(cells, eps), "met")

    # dense cells: first those that adjoin, nearly all of which touch; then the pairs that are still apart
    dense, sparse = held.where("dense"), held.where("not dense")
    both = met.where("dense_a and dense_b").select("a", "b", "adjoin")
    loops = cells.where("dense").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    adjoining = both.where("adjoin").select("a", "b")
    first = staged(_part_pairs(adjoining, _parts(dense, adjoining, side, 1), eps).where("sure").select("a", "b").distinct(), "first")
    joined = staged(connected_components(first.union(loops), "a", "b"), "joined")
    release(first)
    apart = both.select("a", "b")
    for s in "ab":
        apart = apart.join(joined.select(F.col("node").alias("_n"), F.col("component").alias(f"of_{s}")), F.col(s) == F.col("_n")).drop("_n")
    found = touching_cells(staged(apart.where("of_a <> of_b").select("a", "b"), "apart"), dense, eps, side)

    # points of sparse cells: with each other, and once with each dense cell that has near points
    beside = met.where("dense_a <> dense_b").select(F.when(F.col("dense_a"), F.col("a")).otherwise(F.col("b")).alias("_cell")).distinct()
    edge = dense.join(beside, F.col("cell") == F.col("_cell"), "left_semi")
    loose = staged(near_points(sparse, sparse, eps, side).select(F.col("p.ord").alias("p"), F.col("q.ord").alias("q")), "loose")
    edged = staged(near_points(sparse, edge, eps, side).groupBy(F.col("p.ord").alias("p"), F.col("q.cell").alias("q")).agg(F.count("*").alias("n")), "edged")
    counts = loose.select("p", F.lit(1).cast("bigint").alias("n")).union(edged.select("p", "n")).union(sparse.select("ord", F.lit(1).cast("bigint")))
    core = staged(counts.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("p").alias("core")), "core")
    of_core = lambda df, c, how="left_semi": df.join(core, F.col(c) == F.col("core"), how)

    edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for more in (*found, of_core(edged.select("p", "q"), "p"), of_core(of_core(loose.where("p < q"), "p"), "q"), core.select("core", F.col("core").alias("_same"))):
        edges = edges.union(more)
    own = staged(connected_components(edges, "a", "b").select("node", F.col("component").alias("cluster")), "own")
    border = of_core(edged.select("p", "q").union(of_core(loose, "q")), "p", "left_anti")
    border = border.join(own, F.col("q") == F.col("node")).groupBy(F.col("p").alias("node")).agg(F.min("cluster").alias("cluster"))
    placed = held.withColumn("_node", F.when(F.col("dense"), F.col("cell")).otherwise(F.col("ord"))).drop("cell", "dense")
    placed = staged(placed.join(own.unionByName(border), F.col("_node") == F.col("node")).drop("_node", "node"), "placed")
    release(cells, held, met, joined, *found, loose, edged, core, own)
    return placed
