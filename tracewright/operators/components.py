"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import release, staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0))).first())


def _joined_minimum(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, edges["u"] == lowest["_u"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(node, component) of every node in ``edges``; the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes, which
    takes about the logarithm of the longest path, squared at worst. A step is
    an aggregation with map-side combine and an equi-join that AQE can split,
    so a node with very many edges doesn't land in one task. Each round is
    written to the scratch folder. Edges with a null end are ignored; loops
    keep their node.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = staged(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        large = _joined_minimum(both, lowest).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        # now every edge goes from a larger to a smaller node
        lowest = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        joined = _joined_minimum(large, lowest)
        small = joined.select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before_now, now = now, staged(small, "edges")
        release(before_now)
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("u").alias("_node"), F.col("v").alias("_component"))
    return nodes.join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("_component", "node").alias("component"))
