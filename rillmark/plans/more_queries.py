"""Further operators of several groups: JSON leaves, edit similarity, section packing, audits and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.functions import records
from rillmark.functions import text as X
from rillmark.operators import dedup
from rillmark.operators import graph as G
from rillmark.operators import retrieval as R
from rillmark.plans.benchmark_queries import QUESTIONS, questions
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.metric_queries import ranked
from rillmark.plans.sql_parts import RANKED
from rillmark.session import materialize, table

add = REGISTRY.add


@add("a14_strict_qrels", """
SELECT query_id, chunk_id, count(*) AS judgments, count(DISTINCT relevance) AS grades FROM qrels GROUP BY ALL HAVING count(*) > 1 OR count(relevance) < count(*)""")
def a14(spark, d):
    q = table(spark, d, "qrels").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("judgments"), F.countDistinct("relevance").alias("grades"), F.count("relevance").alias("known"))
    return q.where("judgments > 1 or known < judgments").drop("known")


@add("b09_band_join", """
SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY""")
def b09(spark, d):
    """Orders meet in their own and the next stretch of 30 days only, so a customer's orders do not all meet."""
    o = table(spark, d, "orders").withColumn("stretch", F.floor(F.datediff("o_orderdate", F.lit("1970-01-01")) / 30))
    a = o.select("o_custkey", F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)).alias("stretch"), F.col("o_orderkey").alias("first_order"), F.col("o_orderdate").alias("d1"))
    b = o.select("o_custkey", "stretch", F.col("o_orderkey").alias("second_order"), F.col("o_orderdate").alias("d2"))
    return a.join(b, ["o_custkey", "stretch"]).where("d2 > d1 and d2 <= d1 + interval 30 days").select("first_order", "second_order")


_ALIASES = r"""al AS (SELECT DISTINCT trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS alias FROM extracted_documents WHERE title IS NOT NULL),
named AS (SELECT alias FROM al WHERE alias <> ''), dn AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)"""


def _aliases(spark, d):
    return table(spark, d, "extracted_documents").where("title is not null").select(X.unicode_norm(F.col("title")).alias("alias")).distinct().where("alias <> ''")


@add("b10_containment_join", f"WITH {_ALIASES} SELECT doc_id, alias FROM dn JOIN named ON contains(t, ' ' || alias || ' ')")
def b10(spark, d):
    hits = G.phrase_occurrences(table(spark, d, "documents"), "doc_id", "text", _aliases(spark, d), "alias")
    return hits.select("doc_id", F.col("phrase").alias("alias")).distinct()


@add("c38_alias_spans")
def c38_spans(spark, d):
    """Every hit of every alias in documents, chunks and raw extracted texts (c38_phrase_occurrences has one phrase)."""
    of = (("documents", "doc_id"), ("chunks_v2", "chunk_row"), ("extracted_documents", "ext_row"))
    texts = [table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("place"), "text") for t, k in of]
    hits = G.phrase_spans(texts[0].unionByName(texts[1]).unionByName(texts[2]), "place", "text", _aliases(spark, d), "alias")
    return hits.select(F.substring_index("place", ":", 1).alias("source"), F.substring_index("place", ":", -1).alias("id"), *[c for c in hits.columns if c != "place"])


@add("b32_positions", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def b32(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("position"))


_LEAVES = r"""
jt AS (SELECT e.ext_row, t.id, t.key, trim(t.atom ->> '$', chr(32) || chr(9) || chr(10) || chr(13)) AS leaf, replace(regexp_replace(regexp_replace(t.fullkey, '^\$\.?', ''), '\[[0-9]+\]', '', 'g'), '"', '') AS path
 FROM (SELECT ext_row, try_cast(text AS JSON) AS j FROM extracted_documents WHERE starts_with(ltrim(text), '{') OR starts_with(ltrim(text), '[')) e, json_tree(e.j) t WHERE t.type = 'VARCHAR'),
jl AS (SELECT *, array_to_string(regexp_extract_all(lower(leaf), '[a-z0-9]+'), ' ') AS norm FROM jt WHERE leaf <> '' AND coalesce(key, '') NOT IN (""" + ", ".join(f"'{k}'" for k in records.SKIPPED_KEYS) + """)),
jf AS (SELECT * FROM jl QUALIFY row_number() OVER (PARTITION BY ext_row, norm ORDER BY id) = 1), lv AS (SELECT ext_row, CAST(row_number() OVER (PARTITION BY ext_row ORDER BY id) - 1 AS INT) AS position, path, leaf FROM jf)"""


@add("c12_json_leaves", f"WITH {_LEAVES} SELECT ext_row, position, path, leaf FROM lv")
def c12(spark, d):
    return records.json_leaves(table(spark, d, "extracted_documents"), "ext_row", "text")


@add("c14_headed_projection", f"""
WITH {_LEAVES}, h AS (SELECT *, array_to_string(list_transform(string_split(replace(string_split(path, '.')[-1], '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || ': ' || leaf AS line FROM lv)
SELECT ext_row, string_agg(line, chr(10) ORDER BY position) AS projection FROM h GROUP BY ext_row""")
def c14(spark, d):
    leaves = records.json_leaves(table(spark, d, "extracted_documents"), "ext_row", "text")
    line = F.concat(F.initcap(F.translate(F.element_at(F.split("path", r"\."), -1), "_", " ")), F.lit(": "), "leaf")
    return leaves.groupBy("ext_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n").alias("projection"))


@add("c15_prose_projection", rf"""
WITH {_LEAVES}, p AS (SELECT ext_row, string_agg(leaf, ' ' ORDER BY position) AS text FROM lv GROUP BY ext_row)
SELECT ext_row, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^[ \t]*#{{1,6}}[ \t]*', '', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '', 'g'), '[*`]+', '', 'g') AS prose,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) >= 80 AS long_enough FROM p""")
def c15(spark, d):
    leaves = records.json_leaves(table(spark, d, "extracted_documents"), "ext_row", "text")
    prose = leaves.groupBy("ext_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "leaf"))), lambda s: s["leaf"]), " ").alias("prose"))
    return prose.select("ext_row", X.markdown_plain(F.col("prose")).alias("prose"), (F.size(X.split_words(F.col("prose"))) >= 80).alias("long_enough"))


@add("c29_json_keys", """
WITH j AS (SELECT ext_row, try_cast(text AS JSON) AS j FROM extracted_documents WHERE starts_with(ltrim(text), '{')) SELECT lower(k) AS json_key, count(*) AS n FROM (SELECT unnest(json_keys(j)) AS k FROM j WHERE j IS NOT NULL) GROUP BY 1""")
def c29(spark, d):
    j = table(spark, d, "extracted_documents").where(F.ltrim("text").startswith("{")).select(F.explode(F.json_object_keys("text")).alias("k"))
    return j.groupBy(F.lower("k").alias("json_key")).agg(F.count(F.lit(1)).alias("n"))


@add("c32_edit_similar_questions")
def c32(spark, d):
    """All pairs of distinct normal forms, judged in pairs of blocks."""
    q = questions(spark, d).select("query_id", X.ascii_norm(F.col("question")).alias("norm")).where("norm <> ''")
    same = q.groupBy("norm").agg(F.min("query_id").alias("query_id"))
    return dedup.edit_pairs(same, "query_id", "norm", 0.88).withColumn("ratio", F.round("ratio", 6))


@add("c36_question_overlap", rf"""
WITH {QUESTIONS}, e AS (SELECT q.query_id, q.chunk_id, min(c.text) AS text FROM qrels q JOIN chunks_v2 c USING (chunk_id) WHERE q.relevance > 0 AND c.text IS NOT NULL GROUP BY ALL),
t AS (SELECT query_id, chunk_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS qt, regexp_extract_all(lower(text), '[a-z0-9]+') AS gt FROM e JOIN qs USING (query_id)),
df AS (SELECT w, count(*) AS df FROM (SELECT chunk_row, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM chunks_v2) GROUP BY w),
u AS (SELECT *, list_filter(list_distinct(qt), lambda w: length(w) > 3) AS qc, list_filter(list_distinct(gt), lambda w: length(w) > 3) AS gc, array_to_string(gt, ' ') AS g FROM t),
r AS (SELECT query_id, chunk_id, count(*) AS rare FROM (SELECT query_id, chunk_id, unnest(list_intersect(qc, gc)) AS w FROM u) JOIN df USING (w) WHERE df <= 5 GROUP BY ALL)
SELECT query_id, chunk_id, CAST(len(list_intersect(qc, gc)) AS INT) AS shared_words, round(len(list_intersect(qc, gc)) * 1.0 / greatest(len(list_distinct(list_concat(qc, gc))), 1), 6) AS jaccard,
 {", ".join(f"CAST(len(list_filter(list_distinct(list_transform(range(1, greatest(len(qt) - {n - 2}, 1)), lambda i: array_to_string(qt[i:i + {n - 1}], ' '))), lambda x: contains(g, x))) AS INT) AS copied_{n}" for n in (4, 3, 2))}, coalesce(rare, 0) AS rare_words
FROM u LEFT JOIN r USING (query_id, chunk_id)""")
def c36(spark, d):
    """Words of over three letters, copied phrases of four to two words, and words found in at most five chunks, that a question shares with its evidence."""
    q = table(spark, d, "qrels").where("relevance > 0").select("query_id", "chunk_id").distinct()
    chunks = table(spark, d, "chunks_v2").where("text is not null")
    c = chunks.groupBy("chunk_id").agg(F.min("text").alias("text"))
    frequent = chunks.select(F.explode(F.array_distinct(X.ascii_tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    t = q.join(c, "chunk_id").join(questions(spark, d), "query_id").select("query_id", "chunk_id", X.ascii_tokens(F.col("question")).alias("qt"), X.ascii_tokens(F.col("text")).alias("gt"))
    long = lambda w: F.length(w) > 3
    u = materialize(t.select("query_id", "chunk_id", "qt", F.filter(F.array_distinct("qt"), long).alias("qc"), F.filter(F.array_distinct("gt"), long).alias("gc"), F.array_join("gt", " ").alias("g")))
    asked = u.select("query_id", "chunk_id", F.explode(F.array_intersect("qc", "gc")).alias("w"))
    rare = asked.join(frequent, "w").where("df <= 5").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("rare_words"))

    def copied(n: int):
        runs = F.expr(f"array_distinct(transform(if(size(qt) >= {n}, sequence(1, size(qt) - {n} + 1), cast(array() as array<int>)), i -> array_join(slice(qt, i, {n}), ' ')))")
        return F.size(F.filter(runs, lambda x: F.contains("g", x))).alias(f"copied_{n}")

    shared = F.size(F.array_intersect("qc", "gc"))
    out = u.select("query_id", "chunk_id", shared.alias("shared_words"), F.round(shared / F.greatest(F.size(F.array_union("qc", "gc")), F.lit(1)), 6).alias("jaccard"), *[copied(n) for n in (4, 3, 2)])
    return out.join(rare, ["query_id", "chunk_id"], "left").withColumn("rare_words", F.coalesce("rare_words", F.lit(0)))


@add("d04_section_packing")
def d04(spark, d):
    return records.pack_sections(table(spark, d, "extracted_documents"), "ext_row", "text", r"^[A-Z][A-Za-z ]{2,40}$")


@add("f06_vector_grid", """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS query, b.vec_id AS item, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS ab, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS aa, list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS bb FROM q a JOIN embeddings b ON a.vec_id <> b.vec_id),
g AS (SELECT 'cosine' AS metric, query, item, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS score FROM s UNION ALL SELECT 'l2', query, item, round(1 / (1 + greatest(aa + bb - 2 * ab, 0)), 6) FROM s)
SELECT metric, query, item, score FROM g QUALIFY row_number() OVER (PARTITION BY metric, query ORDER BY score DESC, item) <= 5""")
def f06(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    parts = [R.nearest_vectors(e, q, "vec_id", "embedding", 5, m).select(F.lit(m).alias("metric"), "query", "item", "score") for m in ("cosine", "l2")]
    return parts[0].unionByName(parts[1])


@add("k15_fusion_trace", f"""
WITH {RANKED}, b AS (SELECT query_id, chunk_id, retriever, min(rank) AS rank FROM ranked WHERE retriever IN ('bm25', 'entity_graph') AND rank <= 50 GROUP BY ALL)
SELECT query_id, count(DISTINCT chunk_id) AS fused, count(*) AS contributions, count(*) - count(DISTINCT chunk_id) AS in_both, count(CASE WHEN rank = 1 THEN 1 END) AS firsts FROM b GROUP BY query_id""")
def k15(spark, d):
    b = ranked(spark, d, 50).where("retriever in ('bm25', 'entity_graph')").groupBy("query_id", "chunk_id", "retriever").agg(F.min("rank").alias("rank"))
    n = F.count(F.lit(1))
    return b.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("fused"), n.alias("contributions"), (n - F.countDistinct("chunk_id")).alias("in_both"), F.count(F.when(F.col("rank") == 1, 1)).alias("firsts"))
