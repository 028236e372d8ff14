"""Queries on paired statistics and model selection (group H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.ranking import running_sum
from rillmark.operators import retrieval as R
from rillmark.operators import stats as S
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.metric_queries import CATEGORY_SQL, panel, query_categories
from rillmark.plans.sql_parts import DIFFERENCES, METRIC_COLUMNS, PANEL
from rillmark.session import materialize, table

add = REGISTRY.add


def _per_query(spark, d) -> DataFrame:
    return panel(spark, d).groupBy("query_id", "retriever").agg(F.avg("graded_ndcg_at_10").alias("v"))


def _pair(spark, d, other: str = "dense_flat") -> DataFrame:
    per = _per_query(spark, d).where(F.col("retriever").isin("bm25", other))
    both = per.groupBy("query_id").pivot("retriever", ["bm25", other]).agg(F.first("v"))
    return materialize(both.select("query_id", F.col("bm25").alias("va"), F.col(other).alias("vb"), (F.col("bm25") - F.col(other)).alias("d")).where("d is not null"))


_HEX = "('0x' || substr(md5({key} || '-' || ((s - 1) // {block})), {first}, {digits}))::BIGINT"
_DRAW = _HEX.format(key="query_id", block=8, first="4 * ((s - 1) % 8) + 1", digits=4)
_COUNT = "CASE " + " ".join(f"WHEN x < {bound} THEN {k}" for k, bound in enumerate(S.POISSON)) + f" ELSE {len(S.POISSON)} END"
_SIGN = "(CASE WHEN " + _HEX.format(key="query_id", block=128, first="((s - 1) % 128) // 4 + 1", digits=1) + " & (8 >> ((s - 1) % 4)) = 0 THEN 1.0 ELSE -1.0 END)"


def _means(rows: str, value: str, groups: str = "") -> str:
    """SQL of the resampled means ``m`` of a table with query_id."""
    g = f"{groups}, " if groups else ""
    return f"""means AS (SELECT {g}s, sum({_COUNT} * {value}) / sum({_COUNT}) AS m FROM (SELECT {g}s, {value}, {_DRAW} AS x FROM {rows}, range(1, {S.SAMPLES + 1}) r(s)) GROUP BY {g}s)"""


@add("h01_query_metrics", f"WITH {PANEL} SELECT query_id, retriever, count(*) AS runs, round(avg(graded_ndcg_at_10), 6) AS ndcg, round(avg(mrr_at_10), 6) AS mrr FROM panel GROUP BY ALL")
def h01(spark, d):
    return panel(spark, d).groupBy("query_id", "retriever").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("graded_ndcg_at_10"), 6).alias("ndcg"), F.round(F.avg("mrr_at_10"), 6).alias("mrr"))


@add("h02_paired_bootstrap", f"""
WITH {DIFFERENCES}, {_means('diff', 'd')} SELECT round((SELECT avg(d) FROM diff), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM diff) AS n FROM means""")
def h02(spark, d):
    out = S.bootstrap_interval(_pair(spark, d), [], "query_id", "d")
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@add("h03_bootstrap_mean", f"""
WITH {DIFFERENCES}, {_means('diff', 'va')}
SELECT round((SELECT avg(va) FROM diff), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means""")
def h03(spark, d):
    out = S.bootstrap_interval(_pair(spark, d), [], "query_id", "va")
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@add("h04_sign_flip", f"""
WITH {DIFFERENCES}, m AS (SELECT s, avg({_SIGN} * d) AS m FROM diff, range(1, {S.SAMPLES + 1}) r(s) GROUP BY s)
SELECT round((SELECT avg(d) FROM diff), 6) AS observed, round((sum(CASE WHEN abs(m) >= abs((SELECT avg(d) FROM diff)) - 1e-12 THEN 1 ELSE 0 END) + 1) / {S.SAMPLES + 1}.0, 6) AS p FROM m""")
def h04(spark, d):
    return S.sign_flip(_pair(spark, d), [], "query_id", "d").select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


def _signs_sql(rows: str, groups: str) -> str:
    """Exact one-sided p by adding one difference after the other to the table of sums: units of 1e-4."""
    return f"""
uu AS (SELECT {groups}, CAST(floor(d * 10000 + 0.5) AS BIGINT) AS u FROM {rows}),
zz AS (SELECT {groups}, abs(u) AS size, row_number() OVER (PARTITION BY {groups} ORDER BY abs(u), u) AS i FROM uu WHERE u <> 0),
tt AS (SELECT {groups}, sum(u) AS observed, count(CASE WHEN u <> 0 THEN 1 END) AS nonzero, sum(abs(u)) AS whole FROM uu GROUP BY ALL),
st AS (SELECT {groups}, CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS k, CAST(1 AS DOUBLE) AS p FROM tt
 UNION ALL SELECT {groups}, i, k, sum(p) / 2 FROM (SELECT st.{groups}, st.i + 1 AS i, st.k + x.f * zz.size AS k, st.p FROM st JOIN zz ON st.{groups} = zz.{groups} AND zz.i = st.i + 1, (VALUES (0), (1)) x(f)) GROUP BY ALL),
pv AS (SELECT tt.{groups}, coalesce(sum(CASE WHEN st.k <= (whole - observed) // 2 THEN st.p END), 0) AS p FROM tt JOIN st ON st.{groups} = tt.{groups} AND st.i = tt.nonzero GROUP BY ALL)"""


@add("h05_exact_signs", f"""
WITH RECURSIVE {DIFFERENCES}, own AS (SELECT 'dense_flat' AS system, query_id, round(va, 6) - round(vb, 6) AS d FROM diff), {_signs_sql('own', 'system')}
SELECT (SELECT count(*) FROM own) AS n, nonzero, round((SELECT avg(d) FROM own), 6) AS effect, round(p, 6) AS p FROM pv JOIN tt USING (system)""")
def h05(spark, d):
    """Every sign vector of all nonzero differences counts; SQL adds the differences one by one instead."""
    own = _pair(spark, d).withColumn("d", F.round("va", 6) - F.round("vb", 6))
    return S.exact_signs(own, [], "d").select("n", "nonzero", F.round("effect", 6).alias("effect"), F.round("p", 6).alias("p"))


@add("h06_noninferiority", f"""
WITH {DIFFERENCES}, {_means('diff', 'd')} SELECT round(quantile_cont(m, 0.05), 6) AS bound, quantile_cont(m, 0.05) >= -0.05 AND (SELECT avg(d) FROM diff) >= -0.05 AS noninferior FROM means""")
def h06(spark, d):
    out = S.bootstrap_interval(_pair(spark, d), [], "query_id", "d", low=0.05, high=0.95)
    return out.select(F.round("low", 6).alias("bound"), ((F.col("low") >= -0.05) & (F.col("mean") >= -0.05)).alias("noninferior"))


@add("h07_holm", f"""
WITH {PANEL}, pe AS (SELECT query_id, retriever, avg(graded_ndcg_at_10) AS v FROM panel GROUP BY ALL),
dd AS (SELECT b.retriever AS system, a.query_id, a.v - b.v AS d FROM pe a JOIN pe b ON a.query_id = b.query_id AND a.retriever = 'bm25' AND b.retriever <> 'bm25'),
mm AS (SELECT system, s, avg({_SIGN} * d) AS m FROM dd, range(1, {S.SAMPLES + 1}) r(s) GROUP BY ALL), ob AS (SELECT system, avg(d) AS observed FROM dd GROUP BY system),
pp AS (SELECT system, (sum(CASE WHEN abs(m) >= abs(observed) - 1e-12 THEN 1 ELSE 0 END) + 1) / {S.SAMPLES + 1}.0 AS p FROM mm JOIN ob USING (system) GROUP BY system),
st AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, system) + 1) * p) AS step FROM pp)
SELECT system, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, system ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM st""")
def h07(spark, d):
    per = materialize(_per_query(spark, d))
    base = per.where("retriever = 'bm25'").select("query_id", F.col("v").alias("va"))
    dd = materialize(per.where("retriever <> 'bm25'").join(base, "query_id").select(F.col("retriever").alias("system"), "query_id", (F.col("va") - F.col("v")).alias("d")))
    return S.holm(S.sign_flip(dd, ["system"], "query_id", "d"), "system", "p").select("system", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@add("h08_equivalence", f"""
WITH {DIFFERENCES}, {_means('diff', 'd')}, ci AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means)
SELECT margin, low > -margin AND high < margin AS equivalent FROM ci, (VALUES (CAST(0.03 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) v(margin)""")
def h08(spark, d):
    ci = S.bootstrap_interval(_pair(spark, d), [], "query_id", "d")
    return ci.select(F.explode(F.array(F.lit(0.03), F.lit(0.05))).alias("margin"), "low", "high").select("margin", ((F.col("low") > -F.col("margin")) & (F.col("high") < F.col("margin"))).alias("equivalent"))


#: The directional family: hypothesis, slice, left, right, metric; 12 + 16 + 4 tests.
FAMILY = (
    [("H2", "paraphrase", "dense_flat", "bm25", m) for m in METRIC_COLUMNS]
    + [("H3", c, "entity_graph", r, m) for c in ("entity_relation", "multi_hop") for r in ("bm25", "dense_flat") for m in ("mrr_at_10", "recall_at_10", "graded_ndcg_at_10", "complete_evidence_recall_at_10")]
    + [("H4", "aggregate", "hybrid_rrf", r, "mrr_at_10") for r in ("bm25", "dense_flat", "entity_graph", "prompt_rag")]
)
_FAMILY_SQL = ", ".join(f"({i}, '{h}', '{c}', '{a}', '{b}', '{m}')" for i, (h, c, a, b, m) in enumerate(FAMILY))


@add("h09_directional_family", f"""
WITH RECURSIVE {PANEL}, {CATEGORY_SQL}, fam AS (SELECT * FROM (VALUES {_FAMILY_SQL}) v(test, hypothesis, slice, lhs, rhs, metric)),
pm AS (SELECT query_id, retriever, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRIC_COLUMNS)} FROM panel GROUP BY ALL), lo AS (UNPIVOT pm ON {', '.join(METRIC_COLUMNS)} INTO NAME metric VALUE v),
pr AS (SELECT test, a.query_id, a.v - b.v AS d FROM fam JOIN lo a ON a.retriever = lhs AND a.metric = fam.metric JOIN lo b ON b.retriever = rhs AND b.metric = fam.metric AND b.query_id = a.query_id LEFT JOIN category c ON c.query_id = a.query_id WHERE slice IN ('aggregate', coalesce(c.category, 'unknown'))),
{_signs_sql('pr', 'test')}, {_means('pr', 'd', 'test')},
lw AS (SELECT test, quantile_cont(m, 0.025) AS low FROM means WHERE NOT isnan(m) GROUP BY test), ef AS (SELECT test, count(*) AS n, avg(d) AS effect FROM pr GROUP BY test),
al AS (SELECT fam.test, coalesce(n, 0) AS n, effect, low, coalesce(p, 1.0) AS p FROM fam LEFT JOIN ef USING (test) LEFT JOIN pv USING (test) LEFT JOIN lw USING (test)),
sp AS (SELECT *, least(1.0, (32 - row_number() OVER (ORDER BY round(p, 9), test) + 1) * p) AS step FROM al), ad AS (SELECT *, max(step) OVER (ORDER BY round(p, 9), test ROWS UNBOUNDED PRECEDING) AS adjusted FROM sp)
SELECT hypothesis, slice, lhs || '_minus_' || rhs AS comparison, metric, n, round(effect, 6) AS effect, round(low, 6) AS low, round(p, 6) AS p, round(adjusted, 6) AS adjusted, coalesce(effect > 0 AND low > 0 AND adjusted <= 0.05, false) AS rule_met FROM ad JOIN fam USING (test)""")
def h09(spark, d):
    fam = spark.createDataFrame([(i, *t) for i, t in enumerate(FAMILY)], "test int, hypothesis string, slice string, lhs string, rhs string, metric string")
    per = panel(spark, d).groupBy("query_id", "retriever").agg(*[F.round(F.avg(m), 6).alias(m) for m in METRIC_COLUMNS])
    long = per.unpivot(["query_id", "retriever"], list(METRIC_COLUMNS), "metric", "v").join(query_categories(spark, d), "query_id", "left")
    long = materialize(long.select("query_id", "retriever", "metric", "v", F.coalesce("category", F.lit("unknown")).alias("category")))
    spec = F.broadcast(fam.select("test", "slice", F.col("lhs").alias("retriever"), "rhs", "metric"))
    left = long.join(spec, ["retriever", "metric"]).where("slice in ('aggregate', category)").select("test", "query_id", "rhs", F.col("metric").alias("m"), "v")
    right = long.select("query_id", F.col("retriever").alias("rhs"), F.col("metric").alias("m"), F.col("v").alias("v2"))
    pairs = materialize(left.join(right, ["query_id", "rhs", "m"]).select("test", "query_id", (F.col("v") - F.col("v2")).alias("d")))
    exact, spread = S.exact_signs(pairs, ["test"], "d"), S.bootstrap_interval(pairs, ["test"], "query_id", "d").select("test", "low")
    every = fam.join(exact, "test", "left").join(spread, "test", "left").select(*fam.columns, F.coalesce("n", F.lit(0)).alias("n"), "effect", "low", F.coalesce("p", F.lit(1.0)).alias("p"), F.round(F.coalesce("p", F.lit(1.0)), 9).alias("__p"))
    adjusted = S.holm(every.withColumn("__t", F.col("test")), "__t", "__p")
    met = F.coalesce((F.col("effect") > 0) & (F.col("low") > 0) & (F.col("adjusted") <= 0.05), F.lit(False))
    return adjusted.select("hypothesis", "slice", F.concat("lhs", F.lit("_minus_"), "rhs").alias("comparison"), "metric", "n", *[F.round(c, 6).alias(c) for c in ("effect", "low", "p", "adjusted")], met.alias("rule_met"))


@add("h10_strongest_comparator", f"""
WITH {PANEL}, m AS (SELECT retriever, round(avg(graded_ndcg_at_10), 6) AS v FROM panel GROUP BY retriever)
SELECT retriever, v, row_number() OVER (ORDER BY v DESC, retriever) AS place, round(v - max(v) OVER (), 6) AS behind FROM m""")
def h10(spark, d):
    m = panel(spark, d).groupBy("retriever").agg(F.round(F.avg("graded_ndcg_at_10"), 6).alias("v"))
    whole = Window.partitionBy(F.lit(0))
    return m.select("retriever", "v", F.row_number().over(whole.orderBy(F.desc("v"), "retriever")).alias("place"), F.round(F.col("v") - F.max("v").over(whole), 6).alias("behind"))


@add("h11_nested_selection", f"""
WITH {PANEL}, v AS (SELECT query_id, retriever, avg(graded_ndcg_at_10) AS v FROM panel GROUP BY ALL),
f AS (SELECT query_id, (row_number() OVER (ORDER BY sha256('fold:' || query_id), query_id) - 1) % 5 AS fold FROM (SELECT DISTINCT query_id FROM v)),
tr AS (SELECT k.fold, retriever, round(avg(v), 6) AS v FROM v JOIN f USING (query_id) JOIN (SELECT DISTINCT fold FROM f) k ON k.fold <> f.fold GROUP BY ALL),
pick AS (SELECT fold, retriever FROM tr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY v DESC, retriever) = 1)
SELECT CAST(p.fold AS INT) AS fold, p.retriever, count(*) AS queries, round(avg(v.v), 6) AS held_out FROM pick p JOIN f ON f.fold = p.fold JOIN v ON v.query_id = f.query_id AND v.retriever = p.retriever GROUP BY ALL""")
def h11(spark, d):
    v = materialize(panel(spark, d).groupBy("query_id", "retriever").agg(F.avg("graded_ndcg_at_10").alias("v")))
    hashed = v.select("query_id").distinct().withColumn("sha", F.sha2(F.concat(F.lit("fold:"), "query_id"), 256))
    folds = materialize(running_sum(hashed, ["sha", "query_id"], F.lit(1).cast("long"), "place").select("query_id", ((F.col("place") - 1) % 5).cast("int").alias("fold")))
    # a fold's training mean = all queries but its own, from sums: no query is repeated for each fold
    own = v.join(folds, "query_id").groupBy("fold", "retriever").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("retriever").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    grid = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rest = grid.join(own, ["fold", "retriever"], "left").fillna(0, ["s", "n"]).where("tn > n").select("fold", "retriever", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6).alias("t"))
    best = rest.groupBy("fold").agg(F.min(F.struct((F.lit(0.0) - F.col("t")).alias("low"), "retriever")).alias("b")).select("fold", "b.retriever")
    return best.join(folds, "fold").join(v, ["query_id", "retriever"]).groupBy("fold", "retriever").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("v"), 6).alias("held_out"))


@add("h12_spearman", """
WITH x AS (SELECT score, result_rank FROM retrieval_results WHERE score IS NOT NULL AND NOT isnan(score) AND result_rank IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY result_rank) + (count(*) OVER (PARTITION BY result_rank) - 1) / 2.0 AS ry FROM x)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def h12(spark, d):
    x = table(spark, d, "retrieval_results").where("score is not null and not isnan(score) and result_rank is not null")
    return S.spearman(x, "score", "result_rank").select("n", F.round("rho", 6).alias("rho"))


@add("h13_knn_labels", """
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS item, b.label, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 5), v AS (SELECT query, label, round(sum(1 / (1e-9 + 1 - score)), 4) AS w FROM k GROUP BY ALL)
SELECT query, label AS voted, w FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1""")
def h13(spark, d):
    e = table(spark, d, "embeddings")
    near = R.nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    votes = near.join(e.select(F.col("vec_id").alias("item"), "label"), "item").groupBy("query", "label").agg(F.round(F.sum(F.lit(1.0) / (F.lit(1e-9) + 1 - F.col("score"))), 4).alias("w"))
    best = votes.groupBy("query").agg(F.min(F.struct((F.lit(0.0) - F.col("w")).alias("low"), "label")).alias("b"))
    return best.select("query", F.col("b.label").alias("voted"), (F.lit(0.0) - F.col("b.low")).alias("w"))


@add("h14_system_summary", f"""
WITH {PANEL} SELECT retriever, count(*) AS runs, count(DISTINCT query_id) AS queries, round(avg(recall_at_10), 6) AS mean_recall, round(median(recall_at_10), 6) AS median_recall, round(stddev_pop(recall_at_10), 6) AS pstdev FROM panel GROUP BY retriever""")
def h14(spark, d):
    r = "recall_at_10"
    return panel(spark, d).groupBy("retriever").agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("query_id").alias("queries"), F.round(F.avg(r), 6).alias("mean_recall"), F.round(F.median(r), 6).alias("median_recall"), F.round(F.stddev_pop(r), 6).alias("pstdev")
    )
