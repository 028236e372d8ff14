"""Rankings and graded judgments: the information-retrieval panel as one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_items(rows: DataFrame, keys: list[str], item: str, score: str, depth: int | None = None) -> DataFrame:
    """Rank the distinct items of each list: best score first, equal scores by item id.

    Null and NaN scores do not count; an item delivered twice counts once with its best score. With
    ``depth`` only the first items are kept, pruned before the shuffle of the window.
    """
    scored = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    once = scored.groupBy(*keys, item).agg(F.max(score).alias(score))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item)))
    return ranked if depth is None else ranked.where(F.col("rank") <= depth)


def judgments(qrels: DataFrame, query: str = "query_id", item: str = "chunk_id", grade: str = "relevance") -> DataFrame:
    """One grade per pair: null grades dropped, of conflicting ones the highest."""
    return qrels.where(F.col(grade).isNotNull()).groupBy(query, item).agg(F.max(grade).alias("grade"))


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_gains(judged: DataFrame, cutoff: int = 10, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Per query with positive judgments: their number and the ideal binary and graded discounted gains."""
    pos = Window.partitionBy(query).orderBy(F.desc("grade"), item)
    placed = judged.where("grade > 0").withColumn("place", F.row_number().over(pos))
    inside = F.col("place") <= cutoff
    return placed.groupBy(query).agg(
        F.count(F.lit(1)).alias("gold"),
        F.sum(F.when(inside, _discount(F.col("place"))).otherwise(0.0)).alias("ideal_binary"),
        F.sum(F.when(inside, F.col("grade") * _discount(F.col("place"))).otherwise(0.0)).alias("ideal_graded"),
    )


def metric_panel(ranked: DataFrame, qrels: DataFrame, keys: list[str], query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The twelve metrics of each ranked list whose query has a positive judgment.

    ``keys`` name a list and include the query. Precision divides by the cutoff, not by what was
    returned; nDCG uses linear gains; lists without a hit score 0. Queries without positive judgments
    are left out (inner join), as the strict panel refuses them.
    """
    judged = judgments(qrels, query, item)
    hits = ranked.where(F.col("rank") <= 10).join(judged.where("grade > 0"), [query, item], "left")
    hit = F.col("grade").isNotNull()

    def within(k: int, value: Column) -> Column:
        return F.when(hit & (F.col("rank") <= k), value)

    counted = hits.groupBy(*keys).agg(
        *[F.coalesce(F.min(within(k, F.col("rank"))), F.lit(0)).alias(f"first_{k}") for k in (5, 10)],
        *[F.count(within(k, F.lit(1))).alias(f"hits_{k}") for k in (5, 10)],
        F.coalesce(F.sum(within(10, _discount(F.col("rank")))), F.lit(0.0)).alias("dcg_binary"),
        F.coalesce(F.sum(within(10, F.col("grade") * _discount(F.col("rank")))), F.lit(0.0)).alias("dcg_graded"),
    )
    scored = counted.join(ideal_gains(judged, 10, query, item), query)
    out = {}
    for k in (5, 10):
        found = F.col(f"hits_{k}")
        out[f"mrr_at_{k}"] = F.when(F.col(f"first_{k}") > 0, F.lit(1.0) / F.col(f"first_{k}")).otherwise(0.0)
        out[f"recall_at_{k}"] = found / F.col("gold")
        out[f"hit_rate_at_{k}"] = (found > 0).cast("double")
        out[f"precision_at_{k}"] = found / F.lit(float(k))
        out[f"complete_evidence_recall_at_{k}"] = (found == F.col("gold")).cast("double")
    out["binary_ndcg_at_10"] = F.col("dcg_binary") / F.col("ideal_binary")
    out["graded_ndcg_at_10"] = F.col("dcg_graded") / F.col("ideal_graded")
    return scored.select(*keys, "gold", *[c.alias(n) for n, c in sorted(out.items())])


METRICS = (
    "mrr_at_5", "mrr_at_10", "recall_at_5", "recall_at_10", "hit_rate_at_5", "hit_rate_at_10", "precision_at_5", "precision_at_10",
    "binary_ndcg_at_10", "graded_ndcg_at_10", "complete_evidence_recall_at_5", "complete_evidence_recall_at_10",
)


def summarize(panel: DataFrame, system: str, category: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Macro means per system and per system and category in one pass; ``category`` is ``all`` on the totals."""
    grouped = panel.rollup(system, category).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    return grouped.where("level < 3").select(system, F.when(F.col("level") == 0, F.coalesce(F.col(category), F.lit("unknown"))).otherwise("all").alias(category), "n", *metrics)


def violations(rules: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """One row per broken rule and key; each frame of ``rules`` holds the offending keys in its first column."""
    parts = [df.select(F.lit(rule).alias("rule"), df[df.columns[0]].cast("string").alias(key)) for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def cohen_kappa(pairs: DataFrame, left: str, right: str, top_grade: int = 2) -> DataFrame:
    """Unweighted and quadratic kappa of two raters' grades 0..``top_grade``, from marginals and moments.

    Pairs with a null grade do not count; without expected disagreement kappa is 1 if there is none, else 0.
    """
    p = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("double").alias("l"), F.col(right).cast("double").alias("r"))
    grades = p.select(F.explode(F.array(F.struct(F.col("l").alias("g"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("r").alias("g"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x"))
    same = grades.groupBy("x.g").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b")).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("same"), F.lit(1).alias("k"))
    seen = p.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg((F.col("l") != F.col("r")).cast("double")).alias("off"), F.avg(F.pow(F.col("l") - F.col("r"), 2)).alias("square"),
        (F.avg(F.col("l") * F.col("l")) + F.avg(F.col("r") * F.col("r")) - 2 * F.avg("l") * F.avg("r")).alias("chance_square"), F.lit(1).alias("k"),
    )
    chance_off = 1 - F.col("same") / (F.col("pairs") * F.col("pairs"))

    def kappa(observed: Column, expected: Column) -> Column:
        return F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected)

    top = F.lit(float(top_grade**2))
    return seen.join(same, "k").select("pairs", kappa(F.col("off"), chance_off).alias("kappa"), kappa(F.col("square") / top, F.col("chance_square") / top).alias("quadratic_kappa"))
