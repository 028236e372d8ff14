"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.ranking import row_number_in_groups
from rillmark.operators.components import connected_components
from rillmark.session import materialize, with_package

#: Most partial partitions that one task combines.
TASK_TUPLES = 4096


def clean_id(c: Column) -> Column:
    """An id in lower case without surrounding white space; a blank one is null."""
    bare = F.regexp_replace(F.lower(c), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    return F.when(bare != "", bare)


def scheme_components(filings: DataFrame, item_col: str, scheme_col: str) -> tuple[DataFrame, DataFrame]:
    """Schemes joined by items that stand under several of them, directly or through a chain.

    Returns ``schemes`` (``scheme``, ``component``) with every scheme, and ``items`` (``item``,
    ``component``) with every item that stands under one. Ids are compared by ``clean_id``; rows in
    which either is null or blank join nothing.
    """
    pairs = materialize(filings.select(clean_id(F.col(item_col)).alias("item"), clean_id(F.col(scheme_col)).alias("scheme")).where("item is not null and scheme is not null").distinct())
    least = pairs.groupBy("item").agg(F.min("scheme").alias("first"))
    edges = pairs.join(least, "item").where("scheme <> first").select(F.col("first").alias("src"), F.col("scheme").alias("dst"))
    joined = materialize(connected_components(edges))
    schemes = pairs.select("scheme").distinct().join(joined, F.col("scheme") == F.col("node"), "left").select("scheme", F.coalesce("component", "scheme").alias("component"))
    items = least.join(joined, F.col("first") == F.col("node"), "left").select("item", F.coalesce("component", "first").alias("component"))
    return schemes, items


def balanced_bins(components: DataFrame, key: str, weight: str, bins: int = 100) -> DataFrame:
    """Deal weighted components into ``bins`` nearly equal bins; returns ``key``, ``weight``, ``bin``.

    Of the components of one weight as many as divide evenly are dealt round, which changes no
    difference between bins. The few left of each weight (less than ``bins``) start as partial
    partitions of one heavy bin each, and the two whose bins differ most are combined again and again,
    heaviest bin onto lightest: the largest-differencing method, in tasks of at most ``TASK_TUPLES``
    partitions that each return one, until one is left. A component heavier than a bin's share stays
    whole. Null and non-positive weights count as 0 and are dealt like the rest.
    """
    c = components.select(key, F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long").alias("__w"))
    ranked = materialize(row_number_in_groups(c, ["__w"], F.xxhash64(key), "__r"))
    even = ranked.groupBy("__w").agg((F.floor(F.count(F.lit(1)) / bins) * bins).alias("__even"))
    ranked = ranked.join(even, "__w")
    dealt = ranked.where("__r <= __even").select(key, "__w", ((F.col("__r") - 1) % bins).cast("int").alias("bin"))
    left = materialize(ranked.where("__r > __even").select(key, "__w", F.xxhash64(key, "__w").alias("__tid")))
    place = left.select("__tid", F.lit(0).alias("__slot"), F.col("__tid").alias("__now"))
    state = left.select("__tid", F.concat(F.array("__w"), F.array_repeat(F.lit(0).cast("long"), bins - 1)).alias("sums"))
    count = state.count()
    while count > 1:
        tasks = -(-count // TASK_TUPLES)
        step = materialize(with_package(state).repartition(tasks, "__tid").mapInPandas(_difference, "__tid long, new_tid long, slots array<int>, sums array<long>"))
        place = materialize(
            place.join(step.where("slots is not null").select(F.col("__tid").alias("__now"), "new_tid", "slots"), "__now")
            .select("__tid", F.element_at("slots", F.col("__slot") + 1).alias("__slot"), F.col("new_tid").alias("__now"))
        )
        state = step.where("sums is not null").select(F.col("new_tid").alias("__tid"), "sums")
        count = state.count()
    rest = left.join(place, "__tid").select(key, "__w", F.col("__slot").alias("bin"))
    return dealt.union(rest).withColumnRenamed("__w", weight)


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combine the partial partitions of one task into one; where the bins of each went, and the sums."""
    table = [b for b in batches if len(b)]
    if not table:
        return
    rows = pd.concat(table, ignore_index=True).sort_values("__tid", ignore_index=True)
    sums = [np.sort(np.asarray(x))[::-1] for x in rows["sums"]]
    slots: list[np.ndarray] = []  # of each partition: where its bins lie in the one made of it
    for x in rows["sums"]:
        order = np.argsort(-np.asarray(x), kind="stable")
        slots.append(np.argsort(order))
    parent: list[int] = [-1] * len(sums)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    moved: dict[int, np.ndarray] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        to = np.argsort(order)
        k = len(sums)
        sums.append(total[order])
        parent.append(-1)
        parent[a] = parent[b] = k
        moved[a], moved[b] = to, to[::-1]
        heapq.heappush(heap, (-int(sums[k][0] - sums[k][-1]), k))
    root = heap[0][1]
    final: dict[int, np.ndarray] = {root: np.arange(len(sums[root]))}
    for k in range(len(sums) - 1, -1, -1):
        if parent[k] >= 0:
            final[k] = final[parent[k]][moved[k]]
    new = int(rows["__tid"].min())
    n = len(rows)
    yield pd.DataFrame({"__tid": rows["__tid"], "new_tid": [new] * n, "slots": [final[i][slots[i]].astype("int32") for i in range(n)], "sums": [None] * n})
    yield pd.DataFrame({"__tid": [new], "new_tid": [new], "slots": [None], "sums": [sums[root].astype("int64")]})


def allocate_bins(bin_weights: dict[int, int], targets: dict[str, float]) -> dict[int, str]:
    """Whole bins, heaviest first, each to the split furthest below its share. Bins are few by parameter."""
    total, got, to = sum(bin_weights.values()), dict.fromkeys(sorted(targets), 0), {}
    whole = sum(targets.values())
    for b, w in sorted(bin_weights.items(), key=lambda x: (-x[1], x[0])):
        split = max(got, key=lambda s: (targets[s] / whole * total - got[s], targets[s]))
        to[b] = split
        got[split] += w
    return to


def grouped_splits(
    records: DataFrame,
    key_col: str,
    item_col: str,
    filings: DataFrame,
    filing_item_col: str,
    filing_group_col: str,
    targets: dict[str, float],
    bins: int = 100,
) -> DataFrame:
    """One split for every record: ``key``, ``component``, ``split_name``.

    Records whose items are filed under the same group, directly or through a chain of groups, get the
    same split, and so do records of one item; shares count records. Items without a group stand
    alone, and a record with a null or blank item stands alone too. Keys must be unique and not null;
    other columns are ignored; an empty table gives an empty result. ``targets`` has few splits and their
    shares (scaled to sum to 1). A component larger than a split's target makes shares miss by as much.
    """
    _, items = scheme_components(filings, filing_item_col, filing_group_col)
    rows = records.select(F.col(key_col).alias("key"), clean_id(F.col(item_col)).alias("item"))
    at = F.when(F.col("item").isNull(), F.concat(F.lit("row:"), F.col("key").cast("string")))
    at = F.coalesce(at, F.concat(F.lit("group:"), F.col("component")), F.concat(F.lit("item:"), F.col("item")))
    rows = materialize(rows.join(items, "item", "left").select("key", at.alias("component")))
    weights = rows.groupBy("component").agg(F.count(F.lit(1)).alias("records"))
    dealt = materialize(balanced_bins(weights, "component", "records", bins))
    load = {r["bin"]: r["w"] for r in dealt.groupBy("bin").agg(F.sum("records").alias("w")).collect()}
    to = allocate_bins(load, targets)
    pairs = [F.lit(x) for b, s in sorted(to.items()) for x in (b, s)] or [F.lit(0), F.lit("")]
    named = dealt.select("component", F.element_at(F.create_map(*pairs), F.col("bin")).alias("split_name"))
    return rows.join(named, "component").select("key", "component", "split_name")


def split_shares(splits: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Records and share of each split beside its target; splits without records come out with 0."""
    spark = splits.sparkSession
    want = spark.createDataFrame(sorted((s, float(x)) for s, x in targets.items()), "split_name string, target_share double")
    n = splits.groupBy("split_name").agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))
    return want.join(n, "split_name", "left").fillna(0, ["records"]).withColumn("actual_share", F.when(total > 0, F.col("records") / total).otherwise(0.0))

