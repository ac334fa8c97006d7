"""Connected components of a graph of edges, by alternating star contraction.

Every round hangs each node's larger neighbours on its smallest one (large star), then its smaller neighbours on the
smallest (small star), until all edges lead to the smallest node of their component. A round is a grouped minimum and
a join; nothing is gathered by component. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexwarden.workspace import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(links: DataFrame, kept: Column, label: str) -> tuple[DataFrame, DataFrame]:
    # The minima are written, so the join has two plain inputs and a hub's partition can be split.
    least = written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
    new = links.where(kept).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return new, least


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (a, b; long, any order, repeats allowed) to (node, component), component being the smallest node."""
    now = written(edges.where("a <> b").select("a", "b").distinct(), label)
    state = _state(now)
    while state[0]:
        large, _ = _star(_both_ways(now), F.col("v") > F.col("u"), label)
        large = written(large.where("a <> b").distinct(), label)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small, least = _star(down, F.lit(True), label)
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(own).where("a <> b").distinct(), label)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
