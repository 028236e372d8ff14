"""Top N items of every group, pruned by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillmark.session import with_package

#: Rows a task holds before it drops those beyond its N best of each group.
HELD_ROWS = 500_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Order-preserving numbers of the values from 0, null first; strings are compared by bytes."""
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One number for each combination of the parts' numbers."""
    out = parts[0]
    for p in parts[1:]:
        out = np.unique(out, return_inverse=True)[1].astype(np.int64) * (int(p.max(initial=0)) + 1) + p
    return out


def _best(rows: pa.Table, g: list[str], t: list[str], n: int) -> pa.Table:
    """The ``n`` best distinct items of each group of ``rows``; ``nth`` marks the last of a full group."""
    group = _joined([_codes(rows[c]) for c in g])
    ties = [_codes(rows[c]) for c in t]
    order = np.lexsort([*reversed(ties), rows["low"].to_numpy(), group])
    again = pd.Series(_joined([group, *ties])[order]).duplicated().to_numpy()
    order = order[~again]
    sorted_group = group[order]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    keep = rank < n
    return rows.select([*g, "low", *t]).take(pa.array(order[keep])).append_column("nth", pa.array(rank[keep] == n - 1))


def bounded_items(df: DataFrame, group_cols: list[str], score_col: str, tie_cols: list[str], n: int) -> DataFrame:
    """Items that may be among the ``n`` best of their group: ``key`` (struct of the group), ``low`` (negative score), ``t0``...

    Every partition keeps its ``n`` best items of each group it holds; its ``n``-th best is a lower bound of
    the group's ``n``-th best. So at most ``n`` rows a group and partition are shuffled. The strictest bound
    of each group is joined to them by the same partitioning and what ranks behind it goes.
    """
    g = [f"g{i}" for i in range(len(group_cols))]
    t = [f"t{i}" for i in range(len(tie_cols))]
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(group_cols, g)],
        (F.lit(0.0) - F.col(score_col).cast("double")).alias("low"),
        *[F.col(c).alias(a) for c, a in zip(tie_cols, t)],
    ).where(F.col("low").isNotNull() & ~F.isnan("low"))
    schema = T.StructType([*rows.schema.fields, T.StructField("nth", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, most = 0, HELD_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size >= most:
                held = [_best(pa.concat_tables(held), g, t, n).select(rows_names)]
                size = held[0].num_rows
                most = max(HELD_ROWS, 2 * size)
        if held:
            yield from _best(pa.concat_tables(held), g, t, n).cast(arrow).to_batches(max_chunksize=10_000)

    rows_names = [*g, "low", *t]
    local = with_package(rows).mapInArrow(local_best, schema).select(F.struct(*g).alias("key"), "low", *t, "nth").repartition("key")
    item = F.struct("low", *t)
    bound = local.groupBy("key").agg(F.min(F.when(F.col("nth"), item)).alias("bound"))
    # the item at the bound is kept by its mark, so both sides read the same columns and Spark shuffles them once
    return local.join(bound, "key", "left").where(F.col("bound").isNull() | (item < F.col("bound")) | F.col("nth")).select("key", "low", *t)


def top_n_per_group(df: DataFrame, group_cols: list[str], score_col: str, tie_cols: list[str], n: int, rank_col: str = "item_rank") -> DataFrame:
    """The ``n`` best items of each group: score from high to low, then ``tie_cols`` from low to high.

    An item is one value of ``tie_cols`` in its group, however many rows hold it; its best score
    counts. Rows with a null or NaN score do not count. Null group or tie values are values like any
    other and sort first. Groups with fewer items come out whole; an empty table gives an empty
    result. The result has the group, tie and score columns and the rank; other columns of ``df`` are
    ignored. The rows of every group, whatever its size, pass the partitions' lower bounds
    (``bounded_items``); the survivors are ranked.
    """
    t = [f"t{i}" for i in range(len(tie_cols))]
    once = bounded_items(df, group_cols, score_col, tie_cols, n).groupBy("key", *t).agg(F.min("low").alias("low"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("low", *t))).where(F.col("rank") <= n)
    return ranked.select(
        *[F.col(f"key.g{i}").alias(c) for i, c in enumerate(group_cols)],
        *[F.col(a).alias(c) for c, a in zip(tie_cols, t)],
        (F.lit(0.0) - F.col("low")).alias(score_col),
        F.col("rank").alias(rank_col),
    )
