"""Ranking operators: BM25, lexical overlap, exact vector search, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.ranking import running_sum
from rillmark.functions.text import word_tokens
from rillmark.session import materialize, shuffle_partitions, with_package


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """Best ``k`` items of each query by score rounded to six places, equal ones by item id; adds ``rank``."""
    rounded = scored.withColumn(score, F.round(score, 6))
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Most (query, term) rows that are broadcast to the postings; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Bm25Index:
    """Postings and statistics of a corpus, written once and joined by every query batch."""

    def __init__(self, docs: DataFrame, key: str, text: str) -> None:
        toks = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), word_tokens(F.col(text)).alias("toks"))
        self.docs = toks.select("doc")
        each = toks.select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
        self.postings = materialize(each.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf")))
        size = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("avgdl")).first()
        self.n, self.avgdl = size["n"], size["avgdl"] or 1.0
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        self.terms = materialize(df.select("term", "df", raw.alias("raw")))
        self.floor = 0.25 * (self.terms.agg(F.avg("raw")).first()[0] or 0.0)

    def idf(self, kind: str) -> Column:
        if kind == "lucene":
            return F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return F.when(F.col("raw") < 0, F.lit(self.floor)).otherwise(F.col("raw"))

    def search(self, queries: DataFrame, query: str, text: str, k: int = 10, k1: float = 1.5, b: float = 0.75, idf: str = "okapi") -> DataFrame:
        """Top ``k`` documents of each query: ``query``, ``doc``, ``score``, ``rank``.

        Repeated query words count as often as they stand. Only postings of query words are joined, so
        the work follows the matches, not queries times documents. Queries without a known word and null
        queries have no rows.
        """
        return top_k(self.scores(queries, query, text, [(k1, b)], idf).drop("k1", "b"), query, "doc", "score", k)

    def search_padded(self, queries: DataFrame, query: str, text: str, k: int, negative: bool = True) -> DataFrame:
        """Top ``k`` over all documents of each query with words: documents without any of them score 0 and follow by id.

        A query with fewer than ``k`` positive scores and m matched documents finds its padding among the
        first ``k`` + m ids, so no query meets all documents. Without ``negative`` scores below 0 go.
        """
        scored = materialize(self.scores(queries, query, text, [(1.5, 0.75)]).drop("k1", "b").withColumn("score", F.round("score", 6)))
        best = top_k(scored if negative else scored.where("score >= 0"), query, "doc", "score", k).drop("rank")
        asked = queries.where(F.col(text).isNotNull() & (F.size(word_tokens(F.col(text))) > 0)).select(query)
        matched = scored.groupBy(query).agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("score") > 0, 1)).alias("p"))
        short = asked.join(matched, query, "left").where(f"coalesce(p, 0) < {k}").select(query, F.explode(F.expr(f"sequence(1L, {k} + coalesce(m, 0L))")).alias("place"))
        placed = running_sum(self.docs, ["doc"], F.lit(1).cast("long"), "place")
        pad = short.join(placed, "place").select(query, "doc").join(scored.select(query, "doc"), [query, "doc"], "left_anti").withColumn("score", F.lit(0.0))
        return top_k(best.unionByName(pad.select(best.columns)), query, "doc", "score", k)

    def scores(self, queries: DataFrame, query: str, text: str, grid: list[tuple[float, float]], idf: str = "okapi") -> DataFrame:
        """Scores for every parameter pair of ``grid`` in one pass over the postings."""
        terms = queries.where(F.col(text).isNotNull()).select(query, F.explode(word_tokens(F.col(text))).alias("term"))
        terms = terms.groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
        weighted = terms.join(self.terms, "term").select(query, "term", (self.idf(idf) * F.col("qtf")).alias("w"))
        weighted = materialize(weighted)
        few = weighted.count() <= BROADCAST_ROWS
        asked = weighted.select("term").distinct()
        # partitioned by document before the join, so that a document's scores are summed where its postings lie
        own = self.postings.join(F.broadcast(asked) if few else asked, "term", "left_semi").repartition(shuffle_partitions(asked), "doc")
        hits = own.join(F.broadcast(weighted) if few else weighted, "term")
        if len(grid) > 1:
            hits = hits.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("k1"), F.lit(y).alias("b")) for x, y in grid])).alias("g")).select("*", "g.k1", "g.b")
        else:
            hits = hits.withColumns({"k1": F.lit(grid[0][0]), "b": F.lit(grid[0][1])})
        norm = F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("dl") / F.lit(self.avgdl))
        part = F.col("w") * F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + norm)
        return hits.groupBy(query, "doc", "k1", "b").agg(F.sum(part).alias("score"))

    def overlap(self, queries: DataFrame, query: str, text: str, k: int, stop: tuple[str, ...]) -> DataFrame:
        """Lexical fallback: sum of ln((N+1)/(df+1))+1 over shared words, over the root of the document's distinct words."""
        terms = queries.where(F.col(text).isNotNull()).select(query, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term")).where(~F.col("term").isin(*stop))
        weight = F.log(F.lit(self.n + 1.0) / (F.col("df") + 1)) + 1
        distinct = self.postings.groupBy("doc").agg(F.count(F.lit(1)).alias("kinds"))
        summed = self.postings.join(terms.join(self.terms, "term").select(query, "term", weight.alias("w")), "term").groupBy(query, "doc").agg(F.sum("w").alias("s"))
        return top_k(summed.join(distinct, "doc").select(query, "doc", (F.col("s") / F.sqrt("kinds")).alias("score")), query, "doc", "score", k)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", block: int = 1024, owner: str | None = None) -> DataFrame:
    """Exact top ``k`` of every query vector against all rows: ``query``, ``item``, ``score``, ``rank``; a row is no hit of itself.

    Queries are few against the rows: they go to the tasks in blocks of ``block`` and each batch of rows
    is multiplied with a block at once; a batch passes on its ``k`` best per query, which are ranked after
    one small shuffle. ``l2`` scores 1 / (1 + squared distance). Null vectors take no part. With ``owner``
    (an integer column) the result has instead the best row of every owner for each query: ``query``,
    ``owner``, ``item``, ``score``; of equal rows the smallest id.
    """
    import numpy as np
    import pandas as pd

    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    many = -(-q.count() // block)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v"), (F.col(owner) if owner else F.lit(0)).cast("long").alias("o"))
    kind = rows.schema["i"].dataType.simpleString()

    def run_block(held, batches):
        qs, m = held
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, 0))
            ids = b["i"].to_numpy()
            if not len(x):
                continue
            if metric == "cosine":
                s = (m @ x.T) / np.maximum(np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
            else:
                s = 1 / (1 + np.maximum((m**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * m @ x.T, 0))
            s = np.where(np.asarray(qs)[:, None] == ids[None, :], -np.inf, np.round(s, 6))
            if owner:
                groups = b["o"].to_numpy()
                for g in np.unique(groups):
                    own = np.flatnonzero(groups == g)
                    own = own[np.argsort(ids[own], kind="stable")]
                    best = own[s[:, own].argmax(1)]
                    score = s[np.arange(len(qs)), best]
                    keep = np.isfinite(score)
                    yield pd.DataFrame({"query": np.asarray(qs)[keep], "owner": g, "item": ids[best][keep], "score": score[keep]})
                continue
            take = min(k, len(ids))
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :take]
            score = np.take_along_axis(s, order, 1)
            out = pd.DataFrame({"query": np.repeat(qs, take), "item": ids[order.ravel()], "score": score.ravel()})
            yield out[np.isfinite(out["score"])]

    near, numbered = None, q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, many))))
    for i in range(max(1, many)):  # one block of queries at a time is held by the driver and the tasks
        held = numbered.where(F.col("block") == i).orderBy("q").collect()
        if not held and near is not None:
            continue
        matrix = np.array([r["v"] for r in held]) if held else np.empty((0, 0))
        shared = vectors.sparkSession.sparkContext.broadcast(([r["q"] for r in held], matrix))

        def run(batches, shared=shared):
            return run_block(shared.value, batches) if shared.value[0] else iter(())

        part = with_package(rows).mapInPandas(run, f"query {kind}, {'owner long, ' if owner else ''}item {kind}, score double")
        near = part if near is None else near.union(part)
    if owner:
        return collapse_windows(near, "query", "owner", "item", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def collapse_windows(scored: DataFrame, query: str, owner: str, window: str, score: str) -> DataFrame:
    """Score of an owner = its best window; of equal windows the smallest id wins."""
    best = F.min(F.struct((F.lit(0.0) - F.col(score)).alias("low"), F.col(window).alias("w"))).alias("b")
    return scored.groupBy(query, owner).agg(best).select(query, owner, F.col("b.w").alias(window), (F.lit(0.0) - F.col("b.low")).alias(score))


def reciprocal_rank_fusion(
    ranked: DataFrame, query: str, item: str, system: str, k: int = 60, depth: int = 50, keep: int = 50, weights: dict[str, float] | None = None, last_only: tuple[str, float] | None = None
) -> DataFrame:
    """Sum of weight / (k + rank) over systems: ``query``, ``item``, ``score``, ``rank``, ``systems``.

    Each system counts once per item, with its best rank. ``last_only`` = (system, factor) damps items
    that only that system found. Scores of the systems have no influence.
    """
    best = ranked.where(F.col("rank") <= depth).groupBy(query, item, system).agg(F.min("rank").alias("rank"))
    w = F.lit(1.0)
    if weights:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col(system) == name, F.lit(float(x))).otherwise(w)
    fused = best.groupBy(query, item).agg(F.sum(w / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("systems"), F.max(system).alias("__s"))
    if last_only:
        alone = (F.col("systems") == 1) & (F.col("__s") == last_only[0])
        fused = fused.withColumn("score", F.when(alone, F.col("score") * last_only[1]).otherwise(F.col("score")))
    return top_k(fused.drop("__s").where("score > 0"), query, item, "score", keep)
