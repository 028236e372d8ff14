"""Row numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.session import materialize


def row_number_in_groups(df: DataFrame, keys: list[str], order: Column, rank: str, salt_bits: int = 6) -> DataFrame:
    """Number the rows of each group from 1 by a BIGINT hash ``order``, without one task per group.

    The hash range is cut into ``2**salt_bits`` slices; rows are numbered inside a slice and shifted
    by the counts of the slices before it, so a group with a third of all rows spreads over that many
    tasks. Rows with null keys form a group of their own. Equal hashes get distinct numbers in an
    order that Spark chooses; pass a hash of a unique key.
    """
    sliced = df.withColumn("__order", order).withColumn("__slice", F.shiftright("__order", 64 - salt_bits).cast("int"))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, "__slice").orderBy("__order")
    same = F.col("__slice") == F.col("__s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    numbered = sliced.withColumn("__in", F.row_number().over(inside))
    return numbered.join(shift, same).withColumn(rank, (F.col("__in") + F.col("__shift")).cast("long")).select(*df.columns, rank)


def running_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` in the total order of the columns ``order``, over the whole table.

    The table is cut into ranges; each range is summed in its own task and shifted by the sums of those
    before it. ``order`` should be unique, as equal rows are summed in an order that Spark chooses.
    """
    ranged = materialize(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = sums.select("__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__shift"))
    inside = F.sum("__v").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__in", inside).join(shift, "__range").withColumn(out, F.col("__in") + F.col("__shift")).select(*df.columns, out)


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], rank: str) -> DataFrame:
    """Rank of each row in its group in the ascending order of the columns ``order``, equal rows sharing the first place.

    Counts of distinct values are summed over ranges of the whole table, so no group is sorted in one task.
    """
    counts = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__n"))
    upto = materialize(running_sum(counts, [*keys, *order], F.col("__n"), "__upto"))
    first = upto.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__n")).alias("__first")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = upto.join(F.broadcast(first) if not keys else first, same).select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, *order)], (F.col("__upto") - F.col("__n") - F.col("__first") + 1).alias(rank))
    same = F.lit(True)
    for c in (*keys, *order):
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return df.join(placed, same).select(*df.columns, rank)
