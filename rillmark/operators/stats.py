"""Paired statistics over per-query differences."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.ranking import running_sum
from rillmark.session import with_package


#: Draws of the reference's intervals and randomisation tests.
SAMPLES = 10_000
#: 16-bit bounds of the Poisson distribution of mean 1: a draw below the k-th bound counts its row at most k times.
POISSON = tuple(int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def _digests(key: str, blocks: int) -> bytes:
    return b"".join(hashlib.md5(f"{key}-{b}".encode()).digest() for b in range(blocks))


def resampled_sums(df: DataFrame, groups: list[str], key: str, value: str, samples: int, signs: bool = False) -> DataFrame:
    """``groups``, ``s`` (from 1), ``total``, ``weight``: sums of ``value`` over each of ``samples`` resamples of every group.

    A resample counts every row by its own draw from Poisson(1), the form of the bootstrap that needs
    neither row numbers nor a join: the draws come from the md5 of the row's ``key`` and each task adds up
    its rows. With ``signs`` every row has a random sign instead. Groups must be few; rows with a null
    value are left out; rows of equal key are drawn together.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    blocks = -(-samples // (128 if signs else 8))
    table = np.searchsorted(np.array(POISSON), np.arange(65536), side="right").astype(np.float64)

    def draws(key: str) -> np.ndarray:
        raw = _digests(key, blocks)
        if signs:
            return 1.0 - 2.0 * np.unpackbits(np.frombuffer(raw, np.uint8))[:samples]
        return table[np.frombuffer(raw, ">u2")[:samples]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            for k, part in b.groupby("key", sort=False, dropna=False):
                d = draws(k)
                for *g, _, v in part.itertuples(index=False, name=None):
                    total, weight = sums.setdefault(tuple(g), [np.zeros(samples), np.zeros(samples)])
                    total += d * v
                    weight += np.abs(d)
        for g, (total, weight) in sums.items():
            yield pd.DataFrame({**dict(zip(groups, g)), "s": np.arange(1, samples + 1), "total": total, "weight": weight})

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(groups)])
    parts = with_package(rows).mapInPandas(run, f"{types}s int, total double, weight double")
    return parts.groupBy(*groups, "s").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap_interval(df: DataFrame, groups: list[str], key: str, value: str, samples: int = SAMPLES, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean of each group with percentile bounds of its resampled means: ``groups``, ``mean``, ``low``, ``high``, ``n``."""
    means = resampled_sums(df, groups, key, value, samples).where("weight > 0").withColumn("m", F.col("total") / F.col("weight"))
    ends = means.groupBy(*groups).agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    seen = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    if not groups:
        seen, ends = seen.withColumn("__k", F.lit(1)), ends.withColumn("__k", F.lit(1))
    return seen.join(ends, groups or "__k").select(*groups, "mean", "low", "high", "n")


def sign_flip(df: DataFrame, groups: list[str], key: str, value: str, samples: int = SAMPLES, tolerance: float = 1e-12) -> DataFrame:
    """Two-sided sign randomisation of each group: ``groups``, ``observed`` mean, p = (as extreme + 1) / (samples + 1)."""
    flipped = resampled_sums(df, groups, key, value, samples, signs=True).withColumn("m", F.abs(F.col("total") / F.col("weight")))
    seen = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.avg(value).alias("observed"))
    if not groups:
        seen, flipped = seen.withColumn("__k", F.lit(1)), flipped.withColumn("__k", F.lit(1))
    extreme = (F.col("m") >= F.abs("observed") - tolerance).cast("long")
    both = flipped.join(F.broadcast(seen), groups or "__k")  # a row a group
    return both.groupBy(*groups).agg(F.max("observed").alias("observed"), ((F.sum(extreme) + 1) / F.lit(samples + 1.0)).alias("p"))


def exact_signs(df: DataFrame, groups: list[str], value: str, digits: int = 4) -> DataFrame:
    """One-sided exact sign randomisation of each group over all 2^m signs of its m nonzero differences: ``groups``, ``n``
    (all), ``nonzero``, ``effect`` (mean), ``p``; any number of differences.

    Differences, between -1 and 1, are taken in units of 10^-``digits``, so a group has at most 10^digits
    different sizes, however many rows: their counts are all that leaves the tasks. With K the sum of the
    sizes whose sign turns negative, P(sum >= observed) = P(K <= (all - observed) / 2). Its characteristic
    function is a product of cosines, and the exact distribution on the whole numbers follows from its values
    at ``all + 1`` frequencies, which are shared out among the tasks; a frequency is dropped as soon as its
    product is below 1e-20. Groups must be few; nulls are left out; without nonzero differences p is 1.
    """
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("d"), F.floor(F.col(value) * 10**digits + 0.5).alias("u"))
    seen = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("u") != 0).cast("long")).alias("nonzero"), F.avg("d").alias("effect"))
    if known.where(f"abs(u) > {10**digits}").limit(1).count():
        raise ValueError("differences must lie between -1 and 1")
    sizes = known.where("u <> 0").groupBy(*groups, F.abs("u").alias("size")).agg(F.count(F.lit(1)).alias("count"), F.sum("u").alias("sum")).orderBy(*groups, "size").collect()
    by: dict[tuple, list] = {}
    for r in sizes:
        by.setdefault(tuple(r[g] for g in groups), []).append((r["size"], r["count"], r["sum"]))
    spark, tails = df.sparkSession, None
    held = spark.sparkContext.broadcast([(g, np.array([x[:2] for x in v], dtype=np.int64), sum(x[2] for x in v)) for g, v in by.items()])
    for number, (_, table, observed) in enumerate(held.value):
        whole = int((table[:, 0] * table[:, 1]).sum())
        frequencies = spark.range(1, whole // 2 + 1).select(F.lit(number).alias("__test"), F.col("id").alias("j"))
        tails = frequencies if tails is None else tails.union(frequencies)
    schema = df.select(*groups).schema.fields + [T.StructField("__test", T.IntegerType())]
    named = spark.createDataFrame([(*g, i) for i, g in enumerate(by)], T.StructType(schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for test, part in b.groupby("__test"):
                _, table, observed = held.value[test]
                yield pd.DataFrame({"__test": [test], "part": [_tail_terms(part["j"].to_numpy(), table, observed)]})

    if tails is None:
        return seen.withColumn("p", F.lit(1.0))
    sums = with_package(tails).mapInPandas(run, "__test int, part double").groupBy("__test").agg(F.sum("part").alias("part"))
    limits = spark.createDataFrame([(i, *_limits(t, o)) for i, (_, t, o) in enumerate(held.value)], "__test int, whole long, most long")
    tail = named.join(limits, "__test").join(sums, "__test", "left")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("most") + 1 + 2 * F.coalesce("part", F.lit(0.0))) / (F.col("whole") + 1)))
    tail = tail.select(*[F.col(g).alias(f"__{g}") for g in groups], p.alias("p"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups] or F.lit(True)
    return seen.join(F.broadcast(tail), same, "left").select(*groups, "n", "nonzero", "effect", F.coalesce("p", F.lit(1.0)).alias("p"))


def _limits(table: np.ndarray, observed: int) -> tuple[int, int]:
    """The sum of all sizes, and the most that may turn negative."""
    whole = int((table[:, 0] * table[:, 1]).sum())
    return whole, (whole - observed) // 2


def _tail_terms(j: np.ndarray, table: np.ndarray, observed: int) -> float:
    """Sum over the frequencies ``j`` of the terms of P(K <= most), each standing for itself and its mirror image."""
    whole, most = _limits(table, observed)
    n = whole + 1

    def turn(times: np.ndarray | int) -> np.ndarray:
        return np.pi * ((j * times) % (2 * n)) / n

    product = np.ones(len(j))
    for size, count in table[np.argsort(-table[:, 1], kind="stable")]:
        product *= np.cos(turn(size)) ** count
        live = np.abs(product) > 1e-20
        if not live.all():
            j, product = j[live], product[live]
    terms = product * np.cos(turn(whole - most)) * np.sin(turn(most + 1)) / np.sin(turn(1))
    if n % 2 == 0:
        terms = np.where(2 * j == n, terms / 2, terms)
    return float(terms.sum())


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Holm-Bonferroni: ``adjusted`` = running maximum of (m - i) p in the order of p and name, at most 1."""
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(p, name)
    step = (F.count(F.lit(1)).over(whole) - F.row_number().over(order) + 1) * F.col(p)
    stepped = tests.withColumn("__step", F.least(F.lit(1.0), step))
    return stepped.withColumn("adjusted", F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho with average ranks of ties: ranks come from counts of distinct values, not from one sorted task."""

    def ranks(c: str, r: str) -> DataFrame:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        upto = running_sum(counts, [c], F.col("n"), "upto")
        return upto.select(c, (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias(r))

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))
