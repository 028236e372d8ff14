"""Queries on rankings and judgments (group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.operators import metrics as M
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.sql_parts import METRIC_COLUMNS, PANEL, RANKED
from rillmark.plans.text_queries import category_sql
from rillmark.session import table

add = REGISTRY.add
LIST = ["run_id", "query_id", "retriever"]


def ranked(spark, d, depth: int | None = None) -> DataFrame:
    return M.rank_items(table(spark, d, "retrieval_results"), LIST, "chunk_id", "score", depth)


def panel(spark, d) -> DataFrame:
    return M.metric_panel(ranked(spark, d, 10), table(spark, d, "qrels"), LIST)


def _metric_query(name: str, *columns: str) -> None:
    sql = f"WITH {PANEL} SELECT run_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM panel"

    @add(name, sql)
    def query(spark, d):
        return panel(spark, d).select("run_id", *[F.round(c, 6).alias(c) for c in columns])


_metric_query("g01_mrr", "mrr_at_5", "mrr_at_10")
_metric_query("g02_recall", "recall_at_5", "recall_at_10")
_metric_query("g03_precision", "precision_at_5", "precision_at_10")
_metric_query("g04_binary_ndcg", "binary_ndcg_at_10")
_metric_query("g05_graded_ndcg", "graded_ndcg_at_10")
_metric_query("g06_hit_rate", "hit_rate_at_5", "hit_rate_at_10")
_metric_query("g07_complete_evidence", "complete_evidence_recall_at_5", "complete_evidence_recall_at_10")
_metric_query("g08_panel", *METRIC_COLUMNS)

CATEGORY_SQL = "category AS (SELECT query_id, min(" + category_sql("query_text") + ") AS category FROM retrieval_runs WHERE query_text IS NOT NULL GROUP BY query_id)"


def query_categories(spark, d) -> DataFrame:
    runs = table(spark, d, "retrieval_runs").where("query_text is not null")
    return runs.groupBy("query_id").agg(F.min(X.category(F.col("query_text"))).alias("category"))


@add("g09_panel_rollup", f"""
WITH {PANEL}, {CATEGORY_SQL}
SELECT retriever, CASE WHEN grouping(category) = 1 THEN 'all' ELSE coalesce(category, 'unknown') END AS category, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in METRIC_COLUMNS)}
FROM panel LEFT JOIN category USING (query_id) GROUP BY GROUPING SETS ((retriever, category), (retriever))""")
def g09(spark, d):
    return M.summarize(panel(spark, d).join(query_categories(spark, d), "query_id", "left"), "retriever", "category")


@add("g10_run_violations", f"""
WITH {RANKED}
SELECT 'duplicate_result' AS rule, CAST(run_id AS VARCHAR) || '/' || chunk_id AS key FROM retrieval_results GROUP BY run_id, chunk_id HAVING count(*) > 1
UNION ALL SELECT 'missing_run', CAST(run_id AS VARCHAR) FROM (SELECT DISTINCT run_id FROM retrieval_results) r WHERE run_id NOT IN (SELECT run_id FROM retrieval_runs)
UNION ALL SELECT 'bad_score', CAST(result_id AS VARCHAR) FROM retrieval_results WHERE score IS NULL OR isnan(score)
UNION ALL SELECT 'bad_rank', CAST(result_id AS VARCHAR) FROM retrieval_results WHERE result_rank IS NULL OR result_rank < 1
UNION ALL SELECT 'missing_configuration', CAST(run_id AS VARCHAR) FROM (SELECT DISTINCT run_id FROM retrieval_runs WHERE config_snapshot IS NULL)
UNION ALL SELECT 'unknown_chunk', chunk_id FROM (SELECT DISTINCT chunk_id FROM retrieval_results WHERE chunk_id IS NOT NULL) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks_v2 WHERE chunk_id IS NOT NULL)
UNION ALL SELECT 'other_query', CAST(run_id AS VARCHAR) FROM (SELECT DISTINCT r.run_id FROM retrieval_results r JOIN retrieval_runs u ON u.run_id = r.run_id AND (u.query_id <> r.query_id OR u.retriever <> r.retriever))
UNION ALL SELECT 'bad_grade', query_id || '/' || chunk_id FROM qrels WHERE relevance IS NULL OR relevance NOT BETWEEN 0 AND 2
UNION ALL SELECT 'repeated_rank', CAST(run_id AS VARCHAR) || '/' || CAST(result_rank AS VARCHAR) FROM (SELECT DISTINCT run_id, result_rank, chunk_id FROM retrieval_results WHERE result_rank IS NOT NULL) GROUP BY run_id, result_rank HAVING count(*) > 1
UNION ALL SELECT 'empty_run', CAST(run_id AS VARCHAR) FROM (SELECT DISTINCT run_id FROM retrieval_runs) WHERE run_id NOT IN (SELECT run_id FROM item)
UNION ALL SELECT 'unjudged_query', query_id FROM (SELECT DISTINCT query_id FROM retrieval_results) q WHERE query_id NOT IN (SELECT query_id FROM judged)""")
def g10(spark, d):
    res, runs = table(spark, d, "retrieval_results"), table(spark, d, "retrieval_runs")
    judged = M.judgments(table(spark, d, "qrels"))
    doubled = res.groupBy("run_id", "chunk_id").count().where("count > 1")
    chunks = table(spark, d, "chunks_v2").select("chunk_id")
    ranks = res.where("result_rank is not null").select("run_id", "result_rank", "chunk_id").distinct()
    return M.violations(
        {
            "duplicate_result": doubled.select(F.concat(F.col("run_id").cast("string"), F.lit("/"), "chunk_id")),
            "missing_run": res.select("run_id").distinct().join(runs, "run_id", "left_anti"),
            "bad_score": res.where("score is null or isnan(score)").select("result_id"),
            "bad_rank": res.where("result_rank is null or result_rank < 1").select("result_id"),
            "missing_configuration": runs.where("config_snapshot is null").select("run_id").distinct(),
            "unknown_chunk": res.where("chunk_id is not null").select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti"),
            "other_query": res.select("run_id", "query_id", "retriever").distinct().join(runs.select("run_id", F.col("query_id").alias("q"), F.col("retriever").alias("r")).distinct(), "run_id").where("q <> query_id or r <> retriever").select("run_id").distinct(),
            "bad_grade": table(spark, d, "qrels").where("relevance is null or relevance not between 0 and 2").select(F.concat("query_id", F.lit("/"), "chunk_id")),
            "repeated_rank": ranks.groupBy("run_id", "result_rank").count().where("count > 1").select(F.concat(F.col("run_id").cast("string"), F.lit("/"), F.col("result_rank").cast("string"))),
            "empty_run": runs.select("run_id").distinct().join(res.where("score is not null and not isnan(score)"), "run_id", "left_anti"),
            "unjudged_query": res.select("query_id").distinct().join(judged, "query_id", "left_anti"),
        }
    )


@add("g11_coverage", f"""
WITH {CATEGORY_SQL}, u AS (SELECT DISTINCT run_id, retriever, query_id FROM retrieval_runs), s AS (SELECT DISTINCT run_id FROM retrieval_results WHERE score IS NOT NULL AND NOT isnan(score))
SELECT u.retriever, coalesce(category, 'unknown') AS category, count(*) AS runs, count(s.run_id) AS runs_with_results, count(*) - count(s.run_id) AS empty_runs FROM u LEFT JOIN s USING (run_id) LEFT JOIN category USING (query_id) GROUP BY ALL""")
def g11(spark, d):
    kept = table(spark, d, "retrieval_results").where("score is not null and not isnan(score)").select("run_id").distinct().withColumn("kept", F.lit(1))
    runs = table(spark, d, "retrieval_runs").select("run_id", "retriever", "query_id").distinct()
    both = runs.join(kept, "run_id", "left").join(query_categories(spark, d), "query_id", "left")
    n, full = F.count(F.lit(1)), F.count("kept")
    return both.groupBy("retriever", F.coalesce("category", F.lit("unknown")).alias("category")).agg(n.alias("runs"), full.alias("runs_with_results"), (n - full).alias("empty_runs"))


@add("g12_failures", f"""
WITH {PANEL} SELECT retriever, CASE WHEN recall_at_10 = 0 THEN 'no_positive_in_top10' ELSE 'incomplete_multi_evidence_top10' END AS taxonomy, count(*) AS n
FROM panel WHERE complete_evidence_recall_at_10 = 0 GROUP BY ALL""")
def g12(spark, d):
    label = F.when(F.col("recall_at_10") == 0, "no_positive_in_top10").otherwise("incomplete_multi_evidence_top10")
    failed = panel(spark, d).where("complete_evidence_recall_at_10 = 0")
    return failed.groupBy("retriever", label.alias("taxonomy")).agg(F.count(F.lit(1)).alias("n"))


_PLACES = f"""{CATEGORY_SQL}, pl AS (SELECT query_id, retriever, chunk_id, min(rank) AS rank FROM ranked GROUP BY ALL),
gd AS (SELECT query_id, chunk_id FROM judged WHERE grade > 0), qg AS (SELECT DISTINCT query_id FROM gd JOIN (SELECT DISTINCT query_id FROM retrieval_runs) USING (query_id)),
gr AS (SELECT gd.query_id, gd.chunk_id, min(CASE WHEN retriever = 'bm25' THEN rank END) AS b, min(CASE WHEN retriever = 'entity_graph' THEN rank END) AS g, min(CASE WHEN retriever = 'hybrid_rrf' THEN rank END) AS h FROM gd JOIN qg USING (query_id) LEFT JOIN pl ON pl.query_id = gd.query_id AND pl.chunk_id = gd.chunk_id GROUP BY ALL)"""


def _gold_places(spark, d) -> DataFrame:
    """The best rank of every gold chunk of the asked queries under three systems."""
    gold = M.judgments(table(spark, d, "qrels")).where("grade > 0").select("query_id", "chunk_id").join(table(spark, d, "retrieval_runs").select("query_id").distinct(), "query_id", "left_semi")
    lists = ranked(spark, d).groupBy("query_id", "chunk_id", "retriever").agg(F.min("rank").alias("rank"))
    of = lambda name, out: F.min(F.when(F.col("retriever") == name, F.col("rank"))).alias(out)
    return gold.join(lists, ["query_id", "chunk_id"], "left").groupBy("query_id", "chunk_id").agg(of("bm25", "b"), of("entity_graph", "g"), of("hybrid_rrf", "h"))


@add("g12_graph_failures", f"""
WITH {RANKED}, {_PLACES}, sd AS (SELECT DISTINCT query_id FROM pl WHERE retriever = 'entity_graph'),
m AS (SELECT query_id, count(*) AS gold, count(CASE WHEN g <= 5 THEN 1 END) AS in5, count(CASE WHEN g <= 10 THEN 1 END) AS in10, count(CASE WHEN g > 10 THEN 1 END) AS below FROM gr GROUP BY query_id)
SELECT m.query_id, CASE WHEN in10 = gold THEN 'known_gold_below_rank_5' WHEN sd.query_id IS NULL THEN 'no_valid_seed' WHEN in10 > 0 THEN 'incomplete_multi_evidence' WHEN below > 0 THEN 'valid_path_but_distractor_scored_higher' ELSE 'valid_seed_but_disconnected_gold_chunk' END AS taxonomy
FROM m LEFT JOIN sd USING (query_id) WHERE in5 < gold""")
def g12_graph(spark, d):
    """Why the graph's lists miss gold among the first five or ten; a chunk in the list has a path, a query without a list no seed."""
    count_if = lambda c: F.count(F.when(c, 1))
    m = _gold_places(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), count_if(F.col("g") <= 5).alias("in5"), count_if(F.col("g") <= 10).alias("in10"), count_if(F.col("g") > 10).alias("below"))
    seeded = ranked(spark, d).where("retriever = 'entity_graph'").select("query_id").distinct().withColumn("seeded", F.lit(True))
    label = F.when(F.col("in10") == F.col("gold"), "known_gold_below_rank_5").when(F.col("seeded").isNull(), "no_valid_seed").when(F.col("in10") > 0, "incomplete_multi_evidence").when(F.col("below") > 0, "valid_path_but_distractor_scored_higher")
    return m.where("in5 < gold").join(seeded, "query_id", "left").select("query_id", label.otherwise("valid_seed_but_disconnected_gold_chunk").alias("taxonomy"))


@add("g12_hybrid_failures", f"""
WITH {RANKED}, {_PLACES}, sd AS (SELECT DISTINCT query_id FROM pl WHERE retriever = 'entity_graph'), hy AS (SELECT DISTINCT query_id FROM pl WHERE retriever = 'hybrid_rrf'),
m AS (SELECT query_id, count(*) AS gold, count(CASE WHEN h <= 10 THEN 1 END) AS in10, count(CASE WHEN h <= 5 THEN 1 END) AS in5, count(CASE WHEN coalesce(h, 1000000) > 10 AND (b IS NOT NULL OR g IS NOT NULL) THEN 1 END) AS known10,
 bool_or(b <= 10 AND coalesce(h, 1000000) > 10) AS lexical, bool_or(g <= 10 AND coalesce(h, 1000000) > 10) AS graph, bool_or(coalesce(h, 1000000) > 5 AND (b IS NOT NULL OR g IS NOT NULL)) AS below, bool_or(coalesce(h, 1000000) > 5 AND abs(b - g) >= 10) AS apart FROM gr JOIN hy USING (query_id) GROUP BY query_id)
SELECT m.query_id, CASE WHEN sd.query_id IS NULL AND in10 < gold THEN 'no_graph_seed' WHEN in10 > 0 AND in10 < gold AND category IN ('multi_hop', 'synthesis') THEN 'incomplete_multi_evidence' WHEN in10 < gold AND known10 = 0 THEN 'both_components_missed'
 WHEN coalesce(lexical, false) THEN 'bm25_hit_diluted_by_graph_only_competitors' WHEN coalesce(graph, false) THEN 'graph_hit_diluted_by_bm25_only_competitors' WHEN coalesce(apart, false) THEN 'component_disagreement' WHEN coalesce(below, false) THEN 'relevant_chunk_present_but_fused_below_cutoff' ELSE 'unresolved' END AS taxonomy
FROM m LEFT JOIN sd USING (query_id) LEFT JOIN category USING (query_id) WHERE in5 < gold""")
def g12_hybrid(spark, d):
    """Eight causes in order for gold that the fused list misses among the first five or ten."""
    h = F.coalesce("h", F.lit(1_000_000))
    known = F.col("b").isNotNull() | F.col("g").isNotNull()
    count_if = lambda c: F.count(F.when(c, 1))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    fused = ranked(spark, d).where("retriever = 'hybrid_rrf'").select("query_id").distinct()
    m = _gold_places(spark, d).join(fused, "query_id", "left_semi").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gold"), count_if(F.col("h") <= 10).alias("in10"), count_if(F.col("h") <= 5).alias("in5"), count_if((h > 10) & known).alias("known10"),
        any_((F.col("b") <= 10) & (h > 10)).alias("lexical"), any_((F.col("g") <= 10) & (h > 10)).alias("graph"), any_((h > 5) & known).alias("below"), any_((h > 5) & (F.abs(F.col("b") - F.col("g")) >= 10)).alias("apart"),
    )
    seeded = ranked(spark, d).where("retriever = 'entity_graph'").select("query_id").distinct().withColumn("seeded", F.lit(True))
    missed = F.col("in10") < F.col("gold")
    label = (
        F.when(F.col("seeded").isNull() & missed, "no_graph_seed")
        .when((F.col("in10") > 0) & missed & F.col("category").isin("multi_hop", "synthesis"), "incomplete_multi_evidence")
        .when(missed & (F.col("known10") == 0), "both_components_missed")
        .when(F.col("lexical"), "bm25_hit_diluted_by_graph_only_competitors")
        .when(F.col("graph"), "graph_hit_diluted_by_bm25_only_competitors")
        .when(F.col("apart"), "component_disagreement")
        .when(F.col("below"), "relevant_chunk_present_but_fused_below_cutoff")
        .otherwise("unresolved")
    )
    return m.where("in5 < gold").join(seeded, "query_id", "left").join(query_categories(spark, d), "query_id", "left").select("query_id", label.alias("taxonomy"))


@add("g13_worst_queries", f"""
WITH {PANEL}, w AS (SELECT retriever, query_id, round(avg(mrr_at_10), 6) AS mrr, round(avg(recall_at_10), 6) AS recall, round(avg(complete_evidence_recall_at_10), 6) AS complete FROM panel GROUP BY ALL)
SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY retriever ORDER BY mrr, recall, complete, query_id) <= 8""")
def g13(spark, d):
    w = panel(spark, d).groupBy("retriever", "query_id").agg(F.round(F.avg("mrr_at_10"), 6).alias("mrr"), F.round(F.avg("recall_at_10"), 6).alias("recall"), F.round(F.avg("complete_evidence_recall_at_10"), 6).alias("complete"))
    order = Window.partitionBy("retriever").orderBy("mrr", "recall", "complete", "query_id")
    return w.withColumn("place", F.row_number().over(order)).where("place <= 8").drop("place")


@add("g14_metric_deltas", f"""
WITH {PANEL}, p AS (SELECT query_id, retriever, avg(graded_ndcg_at_10) AS v FROM panel GROUP BY ALL)
SELECT b.query_id, b.retriever, round(b.v - a.v, 6) AS delta FROM p a JOIN p b ON a.query_id = b.query_id AND a.retriever = 'bm25' AND b.retriever <> 'bm25' WHERE abs(b.v - a.v) >= 0.01""")
def g14(spark, d):
    p = panel(spark, d).groupBy("query_id", "retriever").agg(F.avg("graded_ndcg_at_10").alias("v"))
    base = p.where("retriever = 'bm25'").select("query_id", F.col("v").alias("base"))
    return p.where("retriever <> 'bm25'").join(base, "query_id").where("abs(v - base) >= 0.01").select("query_id", "retriever", F.round(F.col("v") - F.col("base"), 6).alias("delta"))


@add("g15_reported_ranks", f"""
WITH {RANKED} SELECT r.run_id, count(*) AS results, count(CASE WHEN r.rank = f.result_rank THEN 1 END) AS as_reported
FROM ranked r JOIN (SELECT run_id, chunk_id, min(result_rank) AS result_rank FROM retrieval_results GROUP BY ALL) f USING (run_id, chunk_id) GROUP BY r.run_id""")
def g15(spark, d):
    told = table(spark, d, "retrieval_results").groupBy("run_id", "chunk_id").agg(F.min("result_rank").alias("result_rank"))
    both = ranked(spark, d).join(told, ["run_id", "chunk_id"])
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), F.count(F.when(F.col("rank") == F.col("result_rank"), 1)).alias("as_reported"))


@add("g15_recomputed_metrics", f"""
WITH {RANKED}, told AS (SELECT run_id, query_id, retriever, chunk_id, min(result_rank) AS rank FROM retrieval_results WHERE result_rank >= 1 GROUP BY ALL),
a AS (SELECT run_id, max(1.0 / rank) AS v FROM (SELECT r.run_id, r.rank FROM ranked r JOIN judged j ON j.query_id = r.query_id AND j.chunk_id = r.chunk_id AND grade > 0 WHERE r.rank <= 10) GROUP BY run_id), b AS (SELECT run_id, max(1.0 / rank) AS v FROM (SELECT r.run_id, r.rank FROM told r JOIN judged j ON j.query_id = r.query_id AND j.chunk_id = r.chunk_id AND grade > 0 WHERE r.rank <= 10) GROUP BY run_id),
u AS (SELECT DISTINCT run_id FROM item JOIN judged USING (query_id) WHERE grade > 0)
SELECT u.run_id, round(coalesce(a.v, 0), 6) AS recomputed_mrr, round(coalesce(b.v, 0), 6) AS reported_mrr, abs(coalesce(a.v, 0) - coalesce(b.v, 0)) <= 1e-9 AS agrees FROM u LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id)""")
def g15_metrics(spark, d):
    """The first gold rank of each run by its scores and by the ranks it reported."""
    gold = M.judgments(table(spark, d, "qrels")).where("grade > 0")
    told = table(spark, d, "retrieval_results").where("result_rank >= 1").groupBy("run_id", "query_id", "chunk_id").agg(F.min("result_rank").alias("told"))
    both = ranked(spark, d).select("run_id", "query_id", "chunk_id", "rank").join(told, ["run_id", "query_id", "chunk_id"], "full_outer").join(gold, ["query_id", "chunk_id"], "left")
    first = lambda c: F.coalesce(F.max(F.when(F.col("grade").isNotNull() & (F.col(c) <= 10), F.lit(1.0) / F.col(c))), F.lit(0.0))
    per = both.groupBy("run_id").agg(first("rank").alias("a"), first("told").alias("b"))
    judged = ranked(spark, d).select("run_id", "query_id").distinct().join(gold, "query_id", "left_semi").select("run_id")
    return per.join(judged, "run_id", "left_semi").select("run_id", F.round("a", 6).alias("recomputed_mrr"), F.round("b", 6).alias("reported_mrr"), (F.abs(F.col("a") - F.col("b")) <= 1e-9).alias("agrees"))


@add("g16_qrels_from_gold", """
WITH g AS (SELECT query_id, list(DISTINCT chunk_id) AS gold FROM qrels WHERE relevance > 0 GROUP BY query_id) SELECT query_id, '0' AS iteration_tag, unnest(gold) AS chunk_id, 1 AS relevance FROM g""")
def g16(spark, d):
    gold = table(spark, d, "qrels").where("relevance > 0").groupBy("query_id").agg(F.collect_set("chunk_id").alias("gold"))
    return gold.select("query_id", F.lit("0").alias("iteration_tag"), F.explode("gold").alias("chunk_id"), F.lit(1).alias("relevance"))


@add("g17_recall_ceiling", f"""
WITH {RANKED}, g AS (SELECT query_id, count(*) AS gold FROM judged WHERE grade > 0 GROUP BY query_id),
u AS (SELECT j.query_id, count(DISTINCT j.chunk_id) AS found FROM judged j JOIN ranked r ON r.query_id = j.query_id AND r.chunk_id = j.chunk_id AND r.rank <= 50 WHERE j.grade > 0 GROUP BY ALL)
SELECT g.query_id, g.gold, coalesce(u.found, 0) AS found, round(coalesce(u.found, 0) * 1.0 / g.gold, 6) AS ceiling FROM g LEFT JOIN u USING (query_id)""")
def g17(spark, d):
    judged = M.judgments(table(spark, d, "qrels")).where("grade > 0")
    pool = ranked(spark, d, 50).select("query_id", "chunk_id").distinct()
    found = judged.join(pool, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    out = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold")).join(found, "query_id", "left").fillna(0, ["found"])
    return out.select("query_id", "gold", "found", F.round(F.col("found") / F.col("gold"), 6).alias("ceiling"))


@add("g17_known_and_pooled", f"""
WITH {RANKED}, {CATEGORY_SQL}, k AS (SELECT query_id, count(*) AS gold FROM judged WHERE grade = 2 GROUP BY query_id), p AS (SELECT query_id, count(*) AS gold FROM judged WHERE grade > 0 GROUP BY query_id),
h AS (SELECT run_id, query_id, retriever, count(CASE WHEN grade = 2 THEN 1 END) AS known, count(CASE WHEN grade > 0 THEN 1 END) AS pooled FROM ranked LEFT JOIN judged USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL)
SELECT retriever, count(k.gold) AS known_runs, count(p.gold) AS pooled_runs, round(avg(known * 1.0 / k.gold), 6) AS known_recall, round(avg(pooled * 1.0 / p.gold), 6) AS pooled_recall, round(avg(pooled * 1.0 / p.gold) - avg(known * 1.0 / k.gold), 6) AS difference FROM h LEFT JOIN k USING (query_id) LEFT JOIN p USING (query_id) GROUP BY retriever""")
def g17_panels(spark, d):
    """Recall of the first ten against direct gold (grade 2) and against all that was judged positive, side by side."""
    judged = M.judgments(table(spark, d, "qrels"))
    sizes = judged.groupBy("query_id").agg(F.nullif(F.count(F.when(F.col("grade") == 2, 1)), F.lit(0)).alias("k"), F.nullif(F.count(F.when(F.col("grade") > 0, 1)), F.lit(0)).alias("p"))
    hits = ranked(spark, d, 10).join(judged, ["query_id", "chunk_id"], "left").groupBy("run_id", "query_id", "retriever").agg(F.count(F.when(F.col("grade") == 2, 1)).alias("known"), F.count(F.when(F.col("grade") > 0, 1)).alias("pooled"))
    both = hits.join(sizes, "query_id", "left")
    known, pooled = F.avg(F.col("known") / F.col("k")), F.avg(F.col("pooled") / F.col("p"))
    return both.groupBy("retriever").agg(F.count("k").alias("known_runs"), F.count("p").alias("pooled_runs"), F.round(known, 6).alias("known_recall"), F.round(pooled, 6).alias("pooled_recall"), F.round(pooled - known, 6).alias("difference"))


_RATERS = "r AS (SELECT query_id, chunk_id, min(relevance) AS l, max(relevance) AS r FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL)"


@add("g18_kappa", f"""
WITH {_RATERS}, c AS (SELECT l, r, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT l, sum(n) AS nl FROM c GROUP BY l), b AS (SELECT r, sum(n) AS nr FROM c GROUP BY r),
g AS (SELECT a.l, b.r, coalesce(c.n, 0) * 1.0 / t AS o, nl * nr * 1.0 / (t * t) AS e, t FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN c ON c.l = a.l AND c.r = b.r)
SELECT CAST(max(t) AS BIGINT) AS pairs, round(1 - sum(CASE WHEN l <> r THEN o ELSE 0 END) / sum(CASE WHEN l <> r THEN e ELSE 0 END), 6) AS kappa,
 round(1 - sum(pow((l - r) / 2.0, 2) * o) / sum(pow((l - r) / 2.0, 2) * e), 6) AS quadratic_kappa FROM g""")
def g18(spark, d):
    pairs = table(spark, d, "qrels").where("relevance is not null").groupBy("query_id", "chunk_id").agg(F.min("relevance").alias("l"), F.max("relevance").alias("r"))
    return M.cohen_kappa(pairs, "l", "r").select("pairs", F.round("kappa", 6).alias("kappa"), F.round("quadratic_kappa", 6).alias("quadratic_kappa"))


_POOL = "pool AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE rank <= 10)"


@add("g19_pool", f"""
WITH {RANKED}, {_POOL} SELECT query_id, chunk_id, 'P' || lpad(CAST(row_number() OVER (PARTITION BY query_id ORDER BY sha256('pool:' || query_id || ':' || chunk_id), chunk_id) AS VARCHAR), 4, '0') AS display_id FROM pool""")
def g19(spark, d):
    pool = ranked(spark, d, 10).select("query_id", "chunk_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.sha2(F.concat(F.lit("pool:"), "query_id", F.lit(":"), "chunk_id"), 256), "chunk_id")
    return pool.select("query_id", "chunk_id", F.concat(F.lit("P"), F.lpad(F.row_number().over(order).cast("string"), 4, "0")).alias("display_id"))


@add("g19_residual_pool", f"WITH {RANKED}, {_POOL} SELECT query_id, chunk_id FROM pool ANTI JOIN judged USING (query_id, chunk_id)")
def g19r(spark, d):
    pool = ranked(spark, d, 10).select("query_id", "chunk_id").distinct()
    return pool.join(M.judgments(table(spark, d, "qrels")), ["query_id", "chunk_id"], "left_anti")


@add("g20_adjudicate", """
WITH v AS (SELECT query_id, chunk_id, count(*) AS votes, count(DISTINCT relevance) AS kinds, max(relevance) AS top, median(relevance) AS mid FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL)
SELECT query_id, chunk_id, CASE WHEN kinds = 1 THEN top ELSE CAST(floor(mid + 0.5) AS INT) END AS final_grade, CASE WHEN votes = 1 THEN 'single' WHEN kinds = 1 THEN 'agreed' ELSE 'adjudicated' END AS source FROM v""")
def g20(spark, d):
    v = table(spark, d, "qrels").where("relevance is not null").groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("votes"), F.countDistinct("relevance").alias("kinds"), F.max("relevance").alias("top"), F.median("relevance").alias("mid")
    )
    grade = F.when(F.col("kinds") == 1, F.col("top")).otherwise(F.floor(F.col("mid") + 0.5).cast("int"))
    source = F.when(F.col("votes") == 1, "single").when(F.col("kinds") == 1, "agreed").otherwise("adjudicated")
    return v.select("query_id", "chunk_id", grade.alias("final_grade"), source.alias("source"))


@add("g21_latency", """
SELECT retriever, count(*) AS n, round(avg(total_latency_ms), 6) AS mean_ms, round(median(total_latency_ms), 6) AS median_ms, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_ms,
 round(quantile_disc(total_latency_ms, 0.95), 6) AS p95_nearest_ms, round(stddev_pop(total_latency_ms), 6) AS pstdev_ms FROM (SELECT DISTINCT run_id, retriever, total_latency_ms FROM retrieval_runs WHERE total_latency_ms IS NOT NULL) GROUP BY retriever""")
def g21(spark, d):
    runs = table(spark, d, "retrieval_runs").where("total_latency_ms is not null").select("run_id", "retriever", "total_latency_ms").distinct()
    v = "total_latency_ms"
    return runs.groupBy("retriever").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean_ms"), F.round(F.median(v), 6).alias("median_ms"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95_ms"),
        F.round(F.expr("percentile_disc(0.95) within group (order by total_latency_ms)"), 6).alias("p95_nearest_ms"), F.round(F.stddev_pop(v), 6).alias("pstdev_ms"),
    )


@add("g21_critical_path", """
WITH u AS (SELECT DISTINCT run_id, query_id, retriever, total_latency_ms AS ms FROM retrieval_runs WHERE total_latency_ms IS NOT NULL), p AS (SELECT query_id, avg(CASE WHEN retriever = 'bm25' THEN ms END) AS a, avg(CASE WHEN retriever = 'entity_graph' THEN ms END) AS b, avg(CASE WHEN retriever = 'hybrid_rrf' THEN ms END) AS c FROM u GROUP BY query_id)
SELECT query_id, round(a + b + c, 6) AS component_sum_ms, round(greatest(a, b) + c, 6) AS critical_path_ms FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def g21_path(spark, d):
    """Both component searches one after the other or side by side, then the fusion."""
    runs = table(spark, d, "retrieval_runs").where("total_latency_ms is not null").select("run_id", "query_id", "retriever", "total_latency_ms").distinct()
    of = lambda name, out: F.avg(F.when(F.col("retriever") == name, F.col("total_latency_ms"))).alias(out)
    p = runs.groupBy("query_id").agg(of("bm25", "a"), of("entity_graph", "b"), of("hybrid_rrf", "c")).where("a is not null and b is not null and c is not null")
    return p.select("query_id", F.round(F.col("a") + F.col("b") + F.col("c"), 6).alias("component_sum_ms"), F.round(F.greatest("a", "b") + F.col("c"), 6).alias("critical_path_ms"))


@add("g22_rater_agreement", f"""
WITH {_RATERS} SELECT query_id, count(*) AS pairs, round(avg(CASE WHEN l = r THEN 1.0 ELSE 0.0 END), 6) AS exact_rate FROM r GROUP BY query_id""")
def g22(spark, d):
    pairs = table(spark, d, "qrels").where("relevance is not null").groupBy("query_id", "chunk_id").agg(F.min("relevance").alias("l"), F.max("relevance").alias("r"))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("l") == F.col("r")).cast("double")), 6).alias("exact_rate"))
