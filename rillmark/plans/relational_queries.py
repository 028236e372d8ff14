"""Queries on the relational primitives (group B), over the star schema and the retrieval tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.operators.components import connected_components
from rillmark.functions.ranking import rank_in_groups
from rillmark.plans.catalogue import REGISTRY
from rillmark.session import table

add = REGISTRY.add


def _n():
    return F.count(F.lit(1)).alias("n")


@add("b01_project_struct", "SELECT o_orderkey, o_custkey AS customer, year(o_orderdate) AS order_year, round(o_totalprice + 10, 2) AS gross FROM orders")
def b01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("order_year"), F.round(F.col("o_totalprice") + 10, 2).alias("gross"))


@add("b02_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag <> 'R'")
def b02(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp'1996-01-01' and l_discount between 0.05 and 0.07 and l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")


@add("b03_inner_join", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def b03(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add("b04_left_default", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def b04(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["orders"])


@add("b05_full_outer", "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def b05(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0)


@add("b06_left_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def b06(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left_semi")


@add("b07_left_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b07(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@add("b08_self_join_pairs", "SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS n FROM (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE relevance = 2) a JOIN (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE relevance = 2) b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id GROUP BY ALL")
def b08(spark, d):
    q = table(spark, d, "qrels").where("relevance = 2").select("query_id", "chunk_id").distinct()
    a, b = q.withColumnRenamed("chunk_id", "chunk_a"), q.withColumnRenamed("chunk_id", "chunk_b")
    return a.join(b, "query_id").where("chunk_a < chunk_b").groupBy("chunk_a", "chunk_b").agg(_n())


@add("b12_as_of", """
SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id""")
def b12(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    return table(spark, d, "events").withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")


@add("b13_group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY ALL")
def b13(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        _n(), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount")
    )


@add("b14_distinct_aggregate", "SELECT retriever, count(DISTINCT query_id) AS queries, count(DISTINCT chunk_id) AS chunks FROM retrieval_results GROUP BY retriever")
def b14(spark, d):
    return table(spark, d, "retrieval_results").groupBy("retriever").agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("chunk_id").alias("chunks"))


@add("b15_rollup", "SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def b15(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(_n()).select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_type", F.lit("all")).alias("type"), "n")


@add("b16_cube", "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def b16(spark, d):
    c = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


@add("b17_moments", "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS pstdev FROM events GROUP BY event_type")
def b17(spark, d):
    v = "value"
    return table(spark, d, "events").groupBy("event_type").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_pop(v), 6).alias("pstdev"))


@add("b18_percentile_linear", "SELECT user_id, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY user_id")
def b18(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@add("b19_percentile_nearest", "SELECT user_id, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY user_id")
def b19(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@add("b20_arg_max", "SELECT o_custkey, o_orderkey AS largest_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def b20(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("b"))
    return best.select("o_custkey", F.col("b.o_orderkey").alias("largest_order"))


@add("b21_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5")
def b21(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")


@add("b22_sorted_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS place FROM customer")
def b22(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (-F.col("c_acctbal")).alias("low"))
    return rank_in_groups(c, ["c_mktsegment"], ["low"], "place").select("c_custkey", "place")


@add("b23_limit_total_order", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def b23(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_retailprice").limit(25)


@add("b24_union_first_wins", "SELECT k, min_by(src, pr) AS src FROM (SELECT c_nationkey AS k, 'customer' AS src, 1 AS pr FROM customer UNION ALL SELECT s_nationkey, 'supplier', 2 FROM supplier) GROUP BY k")
def b24(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src"), F.lit(1).alias("pr"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"), F.lit(2).alias("pr"))
    return a.unionByName(b).groupBy("k").agg(F.min_by("src", "pr").alias("src"))


@add("b25_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def b25(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).intersect(li.where("l_discount > 0.05").select("l_partkey"))


@add("b26_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def b26(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey"))


@add("b27_set_equality", "SELECT side, count(*) AS n FROM (SELECT 'only_runs' AS side, run_id FROM (SELECT run_id FROM retrieval_runs EXCEPT SELECT run_id FROM retrieval_results) UNION ALL SELECT 'only_results', run_id FROM (SELECT run_id FROM retrieval_results EXCEPT SELECT run_id FROM retrieval_runs)) GROUP BY side")
def b27(spark, d):
    a, b = table(spark, d, "retrieval_runs").select("run_id"), table(spark, d, "retrieval_results").select("run_id")
    return a.subtract(b).select(F.lit("only_runs").alias("side")).union(b.subtract(a).select(F.lit("only_results"))).groupBy("side").agg(_n())


@add("b28_subset_test", "SELECT o_orderkey, bool_and(l_quantity <= 40) AS all_small FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def b28(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.every(F.col("l_quantity") <= 40).alias("all_small"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey")


@add("b29_unnest", "SELECT ext_row, unnest(extraction_warnings) AS warning FROM extracted_documents")
def b29(spark, d):
    return table(spark, d, "extracted_documents").select("ext_row", F.explode("extraction_warnings").alias("warning"))


@add("b30_nest", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey")
def b30(spark, d):
    line = F.struct("l_linenumber", "l_partkey")
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return nested.select("l_orderkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"))), ",").alias("lines"))


@add("b31_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o FROM lineitem GROUP BY l_returnflag")
def b31(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).withColumnsRenamed({"F": "f", "O": "o"})


@add("b33_lead", "SELECT chunk_row, lead(chunk_row) OVER (PARTITION BY lower(trim(document_id)), corpus_version ORDER BY chunk_index, chunk_row) AS next_chunk FROM chunks_v2")
def b33(spark, d):
    w = Window.partitionBy(F.lower(F.trim("document_id")), "corpus_version").orderBy("chunk_index", "chunk_row")
    return table(spark, d, "chunks_v2").select("chunk_row", F.lead("chunk_row").over(w).alias("next_chunk"))


@add("b34_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 6) AS next_mean FROM events")
def b34(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 3)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("next_mean"))


@add("b35_running_max", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best_so_far FROM orders")
def b35(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("best_so_far"))


@add("b36_first_match", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' WHEN p_size > 40 THEN 'large' ELSE 'usual' END AS kind FROM part")
def b36(spark, d):
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_retailprice") > 1500, "dear").when(F.col("p_size") > 40, "large").otherwise("usual")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@add("b37_sequence_folds", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def b37(spark, d):
    placed = rank_in_groups(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"], "place")
    return placed.select("c_custkey", ((F.col("place") - 1) % 5).cast("int").alias("fold"))


@add("b38_seeded_sample", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42' || c_custkey), c_custkey) <= 20")
def b38(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.md5(F.concat(F.lit("42"), F.col("c_custkey").cast("string"))), "c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 20").select("c_mktsegment", "c_custkey")


@add("b39_hash_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('salt:' || o_orderkey), 1, 8))::BIGINT % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM orders")
def b39(spark, d):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("salt:"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return table(spark, d, "orders").select("o_orderkey", F.when(h % 10 < 8, "train").otherwise("test").alias("split"))


@add("b40_components", """
WITH RECURSIVE p AS (SELECT DISTINCT 'q:' || query_id AS a, 'c:' || chunk_id AS b FROM qrels WHERE relevance = 2), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(n, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n) SELECT n AS node, min(c) AS component FROM r GROUP BY n""")
def b40(spark, d):
    edges = table(spark, d, "qrels").where("relevance = 2").select(F.concat(F.lit("q:"), "query_id").alias("src"), F.concat(F.lit("c:"), "chunk_id").alias("dst"))
    return connected_components(edges)
