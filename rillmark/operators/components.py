"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list; component is the smallest node of its own.

    Large-star hangs each larger neighbour of a node on the node's smallest neighbour, small-star each
    smaller one; the rounds needed grow with the logarithm of the node count. Minima are aggregated
    before each shuffle and the edges of a hub are split by the join, so no node's neighbours meet in
    one task. Self-loops give a component of one; edges with a null end are left out; an empty edge
    list gives an empty result. Every round is a written table.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    loops = e.where("u = v").select(F.col("u").alias("node"))
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(_small_star(e))
    for _ in range(max_rounds):
        both_ways = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi")
        many_roots = e.groupBy("u").count().where("count > 1").select("u")
        if both_ways.union(many_roots).isEmpty():
            break  # every node hangs on one root, and no root hangs
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = materialize(_small_star(large))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).union(loops).distinct().join(found.select("node"), "node", "left_anti")
    return found.union(roots.select("node", F.col("node").alias("component")))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
