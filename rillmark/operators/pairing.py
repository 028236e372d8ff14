"""Pairs of items of different groups that share no source."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.ranking import running_sum
from rillmark.session import materialize


def _last(rows: list, seed: str) -> list[tuple[str, str]]:
    """Each item in hash order with the first unused one that it may be paired with."""
    order = sorted(((hashlib.sha256(f"{seed}:{r['k']}".encode()).hexdigest(), r["k"], r["g"], set(r["s"])) for r in rows), key=lambda r: r[:2])
    used, out = set(), []
    for i, (_, k, g, s) in enumerate(order):
        if k in used:
            continue
        for _, k2, g2, s2 in order[i + 1 :]:
            if k2 not in used and g2 != g and s.isdisjoint(s2):
                used |= {k, k2}
                out.append((k, k2))
                break
    return out


def cross_pairs(items: DataFrame, key: str, group: str, sources: str, seed: str = "pair", local_rows: int = 2000, idle: int = 20) -> DataFrame:
    """``a``, ``b``: every item in one pair at most, of another ``group`` and with disjoint ``sources`` (an array of strings).

    Of the items numbered by group and hash, position r is joined with r + n/2, which refuses only the
    surplus of a group of more than half; those refused and those with a source in common are numbered
    anew in the next round. The last ``local_rows`` are paired in hash order in the driver, so that no
    two items are left that could be paired. Items without a group are in no pair.
    """
    left = materialize(items.select(F.col(key).alias("k"), F.col(group).alias("g"), F.coalesce(sources, F.array().cast("array<string>")).alias("s")).where("g is not null"))
    spark, found, tries, turn = left.sparkSession, [], 0, 0
    while (n := left.count()) > local_rows:
        if left.select("g").distinct().limit(2).count() < 2:
            return _all(spark, found, [], left)
        half, turn = (n + 1) // 2, turn + 1
        placed = materialize(running_sum(left.withColumn("h", F.xxhash64("k", F.lit(turn))), ["g", "h", "k"], F.lit(1).cast("long"), "place"))
        one = placed.where(F.col("place") <= n - half).select("place", F.col("k").alias("a"), F.col("g").alias("ga"), F.col("s").alias("sa"))
        two = placed.where(F.col("place") > half).select((F.col("place") - half).alias("place"), F.col("k").alias("b"), F.col("g").alias("gb"), F.col("s").alias("sb"))
        pairs = materialize(one.join(two, "place").where((F.col("ga") != F.col("gb")) & ~F.arrays_overlap("sa", "sb")).select("a", "b"))
        if pairs.isEmpty():
            tries += 1
            if tries == 1 and not _possible(left, n):
                return _all(spark, found, [], left)
            if tries > idle:
                raise RuntimeError(f"{n} items are left that could not be paired in {idle} rounds")
            continue
        tries = 0
        found.append(pairs)
        used = pairs.select(F.col("a").alias("k")).union(pairs.select("b"))
        left = materialize(left.join(used, "k", "left_anti"))
    return _all(spark, found, _last(left.collect(), seed), left)


def _possible(left: DataFrame, n: int) -> bool:
    """Whether any two of the items left may be paired: an item has a partner unless all of other groups share a source."""
    each = left.select("k", "g", F.explode("s").alias("s"))
    other = each.select(F.col("k").alias("k2"), F.col("g").alias("g2"), "s")
    shared = each.join(other, "s").where("g <> g2").select("k", "k2").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("shared"))
    sized = left.join(left.groupBy("g").agg(F.count(F.lit(1)).alias("own")), "g").join(shared, "k", "left")
    return not sized.where(F.lit(n) - F.col("own") > F.coalesce("shared", F.lit(0))).isEmpty()


def _all(spark, found: list[DataFrame], last: list, left: DataFrame) -> DataFrame:
    kind = left.schema["k"].dataType.simpleString()
    out = spark.createDataFrame(last, f"a {kind}, b {kind}")
    for pairs in found:
        out = out.union(pairs)
    return out
