"""Queries on retrieval, graphs and fusion (group F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.operators import entities as E
from rillmark.operators import graph as G
from rillmark.operators import metrics as M
from rillmark.operators import retrieval as R
from rillmark.operators.components import connected_components
from rillmark.plans.benchmark_queries import QUESTIONS, questions
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.metric_queries import LIST, panel, query_categories, ranked
from rillmark.plans.sql_parts import PANEL, RANKED
from rillmark.plans.text_queries import category_sql
from rillmark.session import materialize, table

add = REGISTRY.add

_INDEX = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n, (SELECT sum(dl) FROM dl) * 1.0 / (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), fl AS (SELECT 0.25 * avg(raw) AS floor FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM qa_items) GROUP BY ALL)"""


def _bm25_sql(k1: str, b: str, idf: str = "CASE WHEN raw < 0 THEN floor ELSE raw END") -> str:
    return f"""sc AS (SELECT item_id, tf.doc_id, round(sum(qtf * ({idf}) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
FROM qt JOIN tf USING (term) JOIN dl USING (doc_id) JOIN raw USING (term), st, fl GROUP BY item_id, tf.doc_id)"""


_TOP = "SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"


def _index(spark, d) -> R.Bm25Index:
    return R.Bm25Index(table(spark, d, "documents"), "doc_id", "text")


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "qa_items").select("item_id", "question")


@add("f01_bm25_topk", f"WITH {_INDEX}, {_bm25_sql('1.5', '0.75')} {_TOP}")
def f01(spark, d):
    return _index(spark, d).search(_questions(spark, d), "item_id", "question").withColumnRenamed("doc", "doc_id")


@add("f01_bm25_lucene", f"WITH {_INDEX}, {_bm25_sql('1.5', '0.75', 'ln((n - df + 0.5) / (df + 0.5) + 1)')} {_TOP}")
def f01l(spark, d):
    return _index(spark, d).search(_questions(spark, d), "item_id", "question", idf="lucene").withColumnRenamed("doc", "doc_id")


def _padded(least: str) -> str:
    return f"""SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT q.item_id, d.doc_id, coalesce(sc.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM qt) q CROSS JOIN (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN sc ON sc.item_id = q.item_id AND sc.doc_id = d.doc_id) WHERE score {least}) WHERE rank <= 50"""


@add("f01_bm25_top50", f"WITH {_INDEX}, {_bm25_sql('1.5', '0.75')} {_padded('IS NOT NULL')}")
def f01b(spark, d):
    """The first 50 of all documents: those without a word of the query have score 0 and come by id."""
    return _index(spark, d).search_padded(_questions(spark, d), "item_id", "question", 50).withColumnRenamed("doc", "doc_id")


@add("f01_bm25_nonnegative", f"WITH {_INDEX}, {_bm25_sql('1.5', '0.75')} {_padded('>= 0')}")
def f01a(spark, d):
    """As f01_bm25_top50 without negative scores."""
    return _index(spark, d).search_padded(_questions(spark, d), "item_id", "question", 50, negative=False).withColumnRenamed("doc", "doc_id")


_GRID = [(k1, b) for k1 in (0.9, 1.2, 1.5, 1.8) for b in (0.4, 0.6, 0.75, 0.9)]


@add("f02_bm25_grid", f"""
WITH {_INDEX}, g AS (SELECT * FROM (VALUES (0.9), (1.2), (1.5), (1.8)) a(k1), (VALUES (0.4), (0.6), (0.75), (0.9)) b(b)),
sc AS (SELECT item_id, tf.doc_id, CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, round(sum(qtf * (CASE WHEN raw < 0 THEN floor ELSE raw END) * tf * (CAST(k1 AS DOUBLE) + 1) / (tf + CAST(k1 AS DOUBLE) * (1 - CAST(b AS DOUBLE) + CAST(b AS DOUBLE) * dl / avgdl))), 6) AS score
 FROM qt JOIN tf USING (term) JOIN dl USING (doc_id) JOIN raw USING (term), st, fl, g GROUP BY ALL)
SELECT k1, b, item_id, doc_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY k1, b, item_id ORDER BY score DESC, doc_id) = 1""")
def f02(spark, d):
    scored = _index(spark, d).scores(_questions(spark, d), "item_id", "question", _GRID).withColumn("score", F.round("score", 6))
    best = scored.groupBy("k1", "b", "item_id").agg(F.min(F.struct((F.lit(0.0) - F.col("score")).alias("low"), "doc")).alias("x"))
    return best.select("k1", "b", "item_id", F.col("x.doc").alias("doc_id"), (F.lit(0.0) - F.col("x.low")).alias("score"))


_STOP = X.GENERIC_TERMS


@add("f11_lexical_overlap", rf"""
WITH {_INDEX}, kinds AS (SELECT doc_id, count(*) AS kinds FROM tf GROUP BY doc_id),
sc AS (SELECT item_id, doc_id, round(sum(ln((n + 1.0) / (df + 1)) + 1) / sqrt(max(kinds)), 6) AS score FROM (SELECT DISTINCT item_id, term FROM qt WHERE term NOT IN {_STOP}) q JOIN tf USING (term) JOIN df USING (term) JOIN kinds USING (doc_id), st GROUP BY ALL) {_TOP}""")
def f11(spark, d):
    return _index(spark, d).overlap(_questions(spark, d), "item_id", "question", 10, _STOP).withColumnRenamed("doc", "doc_id")


_VECTORS = "q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"
_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@add("f03_knn_cosine", f"""
WITH {_VECTORS}, s AS (SELECT a.vec_id AS query, b.vec_id AS item, round({_DOT} / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
 FROM q a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10""")
def f03c(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@add("f03_knn_l2", f"""
WITH {_VECTORS}, s AS (SELECT a.vec_id AS query, b.vec_id AS item, round(1 / (1 + list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))), 6) AS score FROM q a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10""")
def f03l(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, "l2")


@add("f04_window_max", f"""
WITH {_VECTORS}, s AS (SELECT a.vec_id AS query, b.label AS owner, b.vec_id AS item, round({_DOT}, 6) AS score FROM q a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query, owner, item, score FROM s QUALIFY row_number() OVER (PARTITION BY query, owner ORDER BY score DESC, item) = 1""")
def f04(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", owner="label")


_MENTIONS = r"""
m0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*')) AS m, generate_subscripts(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*'), 1) AS p FROM documents),
m1 AS (SELECT doc_id, regexp_replace(lower(m), '\s+', ' ', 'g') AS entity, min(p) AS position FROM m0 WHERE length(m) > 3 GROUP BY ALL),
fr AS (SELECT entity, count(*) AS documents FROM m1 GROUP BY entity HAVING count(*) >= 2), mn AS (SELECT m1.*, fr.documents FROM m1 JOIN fr USING (entity)),
nx AS (SELECT entity AS x, lead(entity, 1) OVER w AS y1, lead(entity, 2) OVER w AS y2 FROM mn WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
co AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM (SELECT x, y1 AS y FROM nx UNION ALL SELECT x, y2 FROM nx) WHERE y IS NOT NULL AND x <> y GROUP BY ALL)"""


def _mentions(spark, d) -> DataFrame:
    return materialize(G.entity_mentions(table(spark, d, "documents"), "doc_id", "text"))  # read several times


@add("f07_graph_edges", f"WITH {_MENTIONS} SELECT a, b, weight FROM co")
def f07(spark, d):
    return G.co_occurrences(_mentions(spark, d), "doc_id")


_GENERIC_SQL = "(" + ", ".join(f"'{x}'" for x in X.GENERIC_TERMS) + ")"
_SEEDS = rf"""{_MENTIONS},
qn AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS q FROM qa_items),
sd AS (SELECT item_id, entity, documents FROM qn JOIN fr ON contains(q, ' ' || entity || ' ')),
se AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(entity) DESC, entity) AS r FROM sd WHERE length(entity) >= 3 AND entity NOT IN {_GENERIC_SQL} AND regexp_matches(entity, '[a-z]')),
seeds AS (SELECT item_id, entity, documents FROM se WHERE r <= 5)"""


def _seeds(spark, d, mentions: DataFrame) -> DataFrame:
    entities = mentions.select("entity").distinct()
    hit = G.phrase_occurrences(_questions(spark, d), "item_id", "question", entities, "entity").select("item_id", F.col("phrase").alias("entity")).distinct()
    good = hit.where(G.seed_reason(F.col("entity"), X.GENERIC_TERMS).isNull())
    order = Window.partitionBy("item_id").orderBy(F.desc(F.length("entity")), "entity")
    return good.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r")


@add("f08_seeds", f"WITH {_SEEDS} SELECT item_id, entity FROM seeds")
def f08(spark, d):
    return _seeds(spark, d, _mentions(spark, d))


@add("f12_label_fallback", f"""
WITH {_SEEDS} SELECT item_id, entity, CAST(place AS INT) AS place FROM (SELECT item_id, entity, row_number() OVER (PARTITION BY item_id ORDER BY entity) AS place FROM sd WHERE item_id NOT IN (SELECT item_id FROM seeds)) WHERE place <= 5""")
def f12(spark, d):
    """Questions without an accepted seed take the first five labels they hold, refused ones included."""
    mentions = _mentions(spark, d)
    hit = materialize(G.phrase_occurrences(_questions(spark, d), "item_id", "question", mentions.select("entity").distinct(), "entity").select("item_id", F.col("phrase").alias("entity")).distinct())
    seeded = hit.where(G.seed_reason(F.col("entity"), X.GENERIC_TERMS).isNull()).select("item_id").distinct()
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("entity"))
    return hit.join(seeded, "item_id", "left_anti").withColumn("place", place).where("place <= 5")


_HOPS = """
sides AS (SELECT a AS e, b AS nxt FROM co UNION ALL SELECT b, a FROM co),
hops AS (SELECT item_id, s.entity AS seed, mn.doc_id, 1 AS hop FROM seeds s JOIN mn USING (entity) UNION ALL
 SELECT DISTINCT item_id, s.entity, mn.doc_id, 2 FROM seeds s JOIN sides ON sides.e = s.entity JOIN mn ON mn.entity = sides.nxt),
nearest AS (SELECT item_id, seed, doc_id, min(hop) AS hop FROM hops GROUP BY ALL)"""


def _walk(spark, d):
    mentions = _mentions(spark, d)
    return _seeds(spark, d, mentions), mentions.select("doc_id", "entity"), G.co_occurrences(mentions, "doc_id"), mentions.select("entity", "documents").distinct()


@add("f10_graph_hops", f"WITH {_SEEDS}, {_HOPS}, sc AS (SELECT item_id, doc_id, round(sum(1.0 / (hop + 1)), 6) AS score FROM nearest GROUP BY ALL) {_TOP}")
def f10(spark, d):
    seeds, contains, co, _ = _walk(spark, d)
    return R.top_k(G.hop_ranking(seeds, contains, co, "item_id", "doc_id"), "item_id", "doc_id", "score", 10).drop("seeds")


@add("f09_alias_table", r"""
WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS scheme FROM extracted_documents WHERE title IS NOT NULL),
a AS (SELECT scheme AS alias, scheme FROM t UNION SELECT trim(regexp_replace(regexp_replace(scheme, '\b(?:scheme|programme|program|mission|yojana)\b', ' ', 'g'), ' +', ' ', 'g')), scheme FROM t)
SELECT alias, count(*) AS schemes, min(scheme) AS first_scheme FROM a WHERE length(alias) >= 4 GROUP BY alias""")
def f09(spark, d):
    t = table(spark, d, "extracted_documents").where("title is not null").select(X.unicode_norm(F.col("title")).alias("scheme")).distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace("scheme", r"\b(?:scheme|programme|program|mission|yojana)\b", " "), " +", " "))
    a = t.select("scheme", F.explode(F.array_distinct(F.array("scheme", bare))).alias("alias")).where(F.length("alias") >= 4)
    return a.groupBy("alias").agg(F.count(F.lit(1)).alias("schemes"), F.min("scheme").alias("first_scheme"))


_LAWS = E.LAW
_TYPED = r"""
x AS (SELECT 'document:' || lower(trim(document_id)) AS doc, 'scheme:' || trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS scheme, 'ministry:' || trim(regexp_replace(lower(ministry), '[^\p{L}\p{N}]+', ' ', 'g')) AS ministry,
 'department:' || trim(regexp_replace(lower(department), '[^\p{L}\p{N}]+', ' ', 'g')) AS department FROM extracted_documents),
ct AS (SELECT chunk_id, min('document:' || lower(trim(document_id))) AS doc, min(text) AS text FROM chunks_v2 WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
p0 AS (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*')) AS m, generate_subscripts(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*'), 1) AS p FROM ct),
p1 AS (SELECT chunk_id, regexp_replace(lower(m), '\s+', ' ', 'g') AS entity, min(p) AS position FROM p0 WHERE length(m) > 3 GROUP BY ALL), pf AS (SELECT entity, count(*) AS documents FROM p1 GROUP BY entity HAVING count(*) >= 2), pm AS (SELECT p1.* FROM p1 JOIN pf USING (entity)),
px AS (SELECT entity AS x, lead(entity, 1) OVER w AS y1, lead(entity, 2) OVER w AS y2 FROM pm WINDOW w AS (PARTITION BY chunk_id ORDER BY position)),
pc AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM (SELECT x, y1 AS y FROM px UNION ALL SELECT x, y2 FROM px) WHERE y IS NOT NULL AND x <> y GROUP BY ALL),
typed AS (SELECT src, dst, relation, count(*) AS weight FROM (SELECT doc AS src, scheme AS dst, 'describes_scheme' AS relation FROM x UNION ALL SELECT scheme, ministry, 'administered_by' FROM x UNION ALL SELECT ministry, department, 'managed_by' FROM x
 UNION ALL SELECT 'chunk:' || chunk_id, doc, 'chunk_of' FROM ct UNION ALL SELECT 'chunk:' || chunk_id, 'law:' || trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g')), 'references_law' FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '""" + _LAWS.replace("'", "''") + r"""')) AS l FROM ct)
 UNION ALL SELECT 'chunk:' || chunk_id, 'entity:' || entity, 'mentions' FROM pm) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL UNION ALL SELECT 'entity:' || a, 'entity:' || b, 'co_occurs', weight FROM pc)"""


def _typed(spark, d) -> DataFrame:
    """Typed edges with their weights. Of the relations of such a graph implemented-by and targets have no column here."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    x = table(spark, d, "extracted_documents").select(
        name("document", F.lower(F.trim("document_id"))).alias("doc"), name("scheme", X.unicode_norm(F.col("title"))).alias("scheme"), name("ministry", X.unicode_norm(F.col("ministry"))).alias("ministry"), name("department", X.unicode_norm(F.col("department"))).alias("department")
    )
    chunks = materialize(table(spark, d, "chunks_v2").where("chunk_id is not null").groupBy("chunk_id").agg(F.min(name("document", F.lower(F.trim("document_id")))).alias("doc"), F.min("text").alias("text")))
    mentions = materialize(G.entity_mentions(chunks, "chunk_id", "text"))
    chunk = name("chunk", F.col("chunk_id")).alias("src")
    laws = chunks.select(chunk, F.explode(F.regexp_extract_all("text", F.lit(_LAWS), F.lit(0))).alias("law")).select("src", name("law", X.unicode_norm(F.col("law"))).alias("dst"), F.lit("references_law").alias("relation"))
    edges = [x.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(r).alias("relation")) for a, b, r in (("doc", "scheme", "describes_scheme"), ("scheme", "ministry", "administered_by"), ("ministry", "department", "managed_by"))]
    edges += [chunks.select(chunk, F.col("doc").alias("dst"), F.lit("chunk_of").alias("relation")), laws, mentions.select(chunk, name("entity", F.col("entity")).alias("dst"), F.lit("mentions").alias("relation"))]
    counted = reduce(DataFrame.unionByName, edges).where("src is not null and dst is not null").groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("weight"))
    return counted.unionByName(G.co_occurrences(mentions, "chunk_id").select(name("entity", F.col("a")).alias("src"), name("entity", F.col("b")).alias("dst"), F.lit("co_occurs").alias("relation"), "weight"))


#: Weight of a seed by the type of its node: fixed values.
_TYPE_WEIGHTS = {"scheme": 1.0, "law": 0.9, "ministry": 0.75, "department": 0.75, "entity": 0.6}
_BARE = r"\b(?:scheme|programme|program|mission|yojana)\b"
_TYPED_SEEDS = rf"""
nd AS (SELECT DISTINCT node, split_part(node, ':', 1) AS kind, substr(node, instr(node, ':') + 1) AS label FROM (SELECT src AS node FROM typed UNION ALL SELECT dst FROM typed)),
la AS (SELECT node, kind, label AS alias FROM nd WHERE kind IN ('scheme', 'law', 'ministry', 'department', 'entity') UNION SELECT node, kind, trim(regexp_replace(regexp_replace(label, '{_BARE}', ' ', 'g'), ' +', ' ', 'g')) FROM nd WHERE kind = 'scheme'),
lb AS (SELECT * FROM la WHERE length(alias) >= 4), qn AS (SELECT query_id, ' ' || trim(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS q FROM qs),
sd AS (SELECT DISTINCT query_id, node, CAST(CASE kind {" ".join(f"WHEN '{k}' THEN {w}" for k, w in _TYPE_WEIGHTS.items())} END AS DOUBLE) AS weight FROM qn JOIN lb ON contains(q, ' ' || alias || ' '))"""


def _typed_seeds(spark, d, edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.substring_index("node", ":", 1).alias("kind"), F.expr("substring(node, instr(node, ':') + 1)").alias("label"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("label", _BARE, " "), " +", " "))
    names = nodes.where(F.col("kind").isin(*_TYPE_WEIGHTS)).select("node", "kind", F.explode(F.array_distinct(F.array("label", F.when(F.col("kind") == "scheme", bare).otherwise(F.col("label"))))).alias("alias")).where("length(alias) >= 4")
    names = materialize(names)
    asked = questions(spark, d).select("query_id", X.unicode_norm(F.col("question")).alias("question"))
    hit = G.phrase_occurrences(asked, "query_id", "question", names.select("alias").distinct(), "alias").select("query_id", F.col("phrase").alias("alias")).distinct().join(names, "alias")
    weight = F.lit(None).cast("double")
    for kind, w in _TYPE_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    return hit.select("query_id", "node", weight.alias("weight")).distinct()


@add("f13_typed_graph", f"WITH {_TYPED} SELECT * FROM typed")
def f13(spark, d):
    return _typed(spark, d)


@add("f14_typed_seeds", f"WITH {_TYPED}, {QUESTIONS}, {_TYPED_SEEDS} SELECT query_id, node, weight FROM sd")
def f14(spark, d):
    return _typed_seeds(spark, d, materialize(_typed(spark, d)))


@add("f15_typed_propagation", f"""
WITH {_TYPED}, {QUESTIONS}, {_TYPED_SEEDS}, pairs AS (SELECT src AS f, dst AS t, sum(weight) AS w FROM (SELECT src, dst, weight FROM typed UNION ALL SELECT dst, src, weight FROM typed) GROUP BY ALL),
dg AS (SELECT f AS n, count(*) AS degree FROM pairs GROUP BY f), step AS (SELECT f, t, 0.5 * least(w, 3) / log2(degree + 2) AS k FROM pairs JOIN dg ON dg.n = t),
h0 AS (SELECT DISTINCT node AS seed, node, weight AS score FROM sd), h1 AS (SELECT seed, t AS node, max(score * k) AS score FROM h0 JOIN step ON f = node GROUP BY ALL), h2 AS (SELECT seed, t AS node, max(score * k) AS score FROM h1 JOIN step ON f = node WHERE starts_with(t, 'chunk:') GROUP BY ALL),
best AS (SELECT seed, node, max(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE starts_with(node, 'chunk:') GROUP BY ALL),
sc AS (SELECT query_id, substr(best.node, 7) AS chunk, round(sum(score), 6) AS score FROM sd JOIN best ON best.seed = sd.node GROUP BY ALL)
SELECT query_id, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM sc) WHERE rank <= 10""")
def f15(spark, d):
    """Chunks by the best path of up to two steps from each typed seed of a question, both ways along the edges; a seed is walked once however many questions share it."""
    edges = materialize(_typed(spark, d))
    seeds = materialize(_typed_seeds(spark, d, edges))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("t"), "weight").union(edges.select("dst", "src", "weight"))
    # one shuffle by the target serves the sums and the degrees
    pairs = both.repartition("t").groupBy("node", "t").agg(F.sum("weight").alias("w"))
    step = materialize(pairs.select("node", "t", F.least("w", F.lit(3)).cast("int").alias("w"), F.count(F.lit(1)).over(Window.partitionBy("t")).alias("degree")))
    top = G.two_step_top(step, seeds, "query_id", "chunk:")
    scored = top.select("query_id", F.expr("substring(text, 7)").alias("chunk"), "score")
    return R.top_k(scored, "query_id", "chunk", "score", 10)


_BEST = f"{RANKED}, best AS (SELECT query_id, retriever, chunk_id, min(rank) AS rank FROM ranked GROUP BY ALL)"


def _fused_sql(k: int, weight: str = "1.0", depth: int = 50, keep: int = 10) -> str:
    return f"""fused AS (SELECT query_id, chunk_id, round(sum(({weight}) / ({k} + rank)), 6) AS score, count(*) AS systems FROM best WHERE rank <= {depth} GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused WHERE score > 0) WHERE rank <= {keep})"""


@add("f22_rrf", f"WITH {_BEST}, {_fused_sql(60, keep=50)} SELECT query_id, chunk_id, score, systems, rank FROM top")
def f22(spark, d):
    return R.reciprocal_rank_fusion(ranked(spark, d), "query_id", "chunk_id", "retriever")


@add("f23_rrf_pair", f"""
WITH {_BEST}, two AS (SELECT query_id, chunk_id, min(CASE WHEN retriever = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN retriever = 'entity_graph' THEN rank END) AS graph_rank FROM best WHERE rank <= 50 AND retriever IN ('bm25', 'entity_graph') GROUP BY ALL),
s AS (SELECT *, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + graph_rank), 0), 6) AS score FROM two)
SELECT query_id, chunk_id, bm25_rank, graph_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50""")
def f23(spark, d):
    best = ranked(spark, d).where("rank <= 50").groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    a = best.where("retriever = 'bm25'").select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    b = best.where("retriever = 'entity_graph'").select("query_id", "chunk_id", F.col("rank").alias("graph_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(60) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", part("bm25_rank") + part("graph_rank"))
    return R.top_k(both, "query_id", "chunk_id", "score", 50)


@add("f24_rrf_k", f"""
WITH {_BEST}, s AS (SELECT k, query_id, chunk_id, round(sum(1.0 / (k + rank)), 6) AS score FROM best, (VALUES (30), (60), (100)) v(k) WHERE rank <= 50 GROUP BY ALL)
SELECT CAST(k AS INT) AS k, query_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, chunk_id) <= 10""")
def f24(spark, d):
    best = ranked(spark, d, 50).groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    each = best.select("query_id", "chunk_id", "rank", F.explode(F.array(F.lit(30), F.lit(60), F.lit(100))).alias("k"))
    fused = each.groupBy("k", "query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("k") + F.col("rank"))), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "chunk_id"))
    return fused.withColumn("place", place).where("place <= 10").drop("place")


_WEIGHTS = {"bm25": 1.0, "dense_flat": 0.5, "entity_graph": 0.75}


@add("f25_weighted_rrf", f"""
WITH {_BEST}, w AS (SELECT query_id, chunk_id, sum(CASE retriever WHEN 'bm25' THEN 1.0 WHEN 'dense_flat' THEN 0.5 WHEN 'entity_graph' THEN 0.75 END / (60 + rank)) AS s, count(*) AS systems, max(retriever) AS one
 FROM best WHERE rank <= 50 AND retriever IN ('bm25', 'dense_flat', 'entity_graph') GROUP BY ALL),
x AS (SELECT query_id, chunk_id, systems, round(CASE WHEN systems = 1 AND one = 'entity_graph' THEN s * 0.5 ELSE s END, 6) AS score FROM w)
SELECT query_id, chunk_id, systems, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 10""")
def f25(spark, d):
    lists = ranked(spark, d).where(F.col("retriever").isin(*_WEIGHTS))
    return R.reciprocal_rank_fusion(lists, "query_id", "chunk_id", "retriever", keep=10, weights=_WEIGHTS, last_only=("entity_graph", 0.5))


@add("f25_weight_grid", f"""
WITH {_BEST}, g AS (SELECT CAST(a AS DOUBLE) AS graph_weight, CAST(f AS DOUBLE) AS damping FROM (VALUES (0.25), (0.5), (0.75), (1.0)) x(a), (VALUES (0.25), (0.5), (1.0)) y(f)),
w AS (SELECT graph_weight, damping, query_id, chunk_id, sum(CASE retriever WHEN 'bm25' THEN 1.0 ELSE graph_weight END / (60 + rank)) AS s, count(*) AS systems, max(retriever) AS one FROM best, g WHERE rank <= 50 AND retriever IN ('bm25', 'entity_graph') GROUP BY ALL),
x AS (SELECT graph_weight, damping, query_id, chunk_id, round(CASE WHEN systems = 1 AND one = 'entity_graph' THEN s * damping ELSE s END, 6) AS score FROM w)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY graph_weight, damping, query_id ORDER BY score DESC, chunk_id) <= 10""")
def f25_grid(spark, d):
    """All weights and dampings in one pass over the lists."""
    best = ranked(spark, d, 50).where("retriever in ('bm25', 'entity_graph')").groupBy("query_id", "chunk_id", "retriever").agg(F.min("rank").alias("rank"))
    sides = best.groupBy("query_id", "chunk_id").agg(F.min(F.when(F.col("retriever") == "bm25", F.col("rank"))).alias("b"), F.min(F.when(F.col("retriever") == "entity_graph", F.col("rank"))).alias("g"))
    grid = F.array(*[F.struct(F.lit(w).alias("graph_weight"), F.lit(f).alias("damping")) for w in (0.25, 0.5, 0.75, 1.0) for f in (0.25, 0.5, 1.0)])
    each = sides.select("query_id", "chunk_id", "b", "g", F.explode(grid).alias("x")).select("query_id", "chunk_id", "b", "g", "x.*")
    lexical, graph = F.coalesce(F.lit(1.0) / (F.lit(60) + F.col("b")), F.lit(0.0)), F.coalesce(F.col("graph_weight") / (F.lit(60) + F.col("g")), F.lit(0.0))
    score = F.when(F.col("b").isNull(), graph * F.col("damping")).otherwise(lexical + graph)
    place = F.row_number().over(Window.partitionBy("graph_weight", "damping", "query_id").orderBy(F.desc("score"), "chunk_id"))
    return each.select("graph_weight", "damping", "query_id", "chunk_id", F.round(score, 6).alias("score")).withColumn("place", place).where("place <= 10").drop("place")


@add("f26_fusion_stop_rule", f"""
WITH {PANEL}, m AS (SELECT retriever, avg(graded_ndcg_at_10) AS v FROM panel GROUP BY retriever)
SELECT b.retriever, round(b.v - a.v, 6) AS gain, b.v - a.v >= 0.01 AS adopted FROM m a JOIN m b ON a.retriever = 'bm25' AND b.retriever <> 'bm25'""")
def f26(spark, d):
    m = panel(spark, d).groupBy("retriever").agg(F.avg("graded_ndcg_at_10").alias("v"))
    base = m.where("retriever = 'bm25'").select(F.lit(1).alias("k"), F.col("v").alias("base"))
    gain = F.col("v") - F.col("base")
    return m.where("retriever <> 'bm25'").withColumn("k", F.lit(1)).join(base, "k").select("retriever", F.round(gain, 6).alias("gain"), (gain >= 0.01).alias("adopted"))


@add("f27_rerank_pool", f"""
WITH {_BEST}, lists AS (SELECT retriever AS pool, query_id, chunk_id, rank FROM best WHERE retriever IN ('bm25', 'dense_flat') UNION ALL SELECT 'union', query_id, chunk_id, rank FROM best WHERE retriever IN ('bm25', 'dense_flat')),
pools AS (SELECT DISTINCT pool, CAST(depth AS INT) AS depth, query_id, chunk_id FROM lists, (VALUES (20), (50), (100)) v(depth) WHERE rank <= depth),
s AS (SELECT pool, depth, p.query_id, p.chunk_id, round(coalesce(max(1.0 / b.rank), 0), 6) AS score FROM pools p LEFT JOIN best b ON b.query_id = p.query_id AND b.chunk_id = p.chunk_id AND b.retriever = 'prompt_rag' GROUP BY ALL)
SELECT pool, depth, query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY pool, depth, query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def f27(spark, d):
    """Lexical, dense and joint pools of three depths, ranked again by the recorded scorer."""
    best = materialize(ranked(spark, d).groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank")))
    lists = best.where("retriever in ('bm25', 'dense_flat') and rank <= 100").select(F.explode(F.array("retriever", F.lit("union"))).alias("pool"), "query_id", "chunk_id", "rank")
    pools = lists.groupBy("pool", "query_id", "chunk_id").agg(F.min("rank").alias("rank")).select("*", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))).alias("depth")).where("rank <= depth").drop("rank")
    scorer = best.where("retriever = 'prompt_rag'").select("query_id", "chunk_id", (F.lit(1.0) / F.col("rank")).alias("s"))
    scored = pools.join(scorer, ["query_id", "chunk_id"], "left").select("pool", "depth", "query_id", "chunk_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("pool", "depth", "query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", place).where("rank <= 10")


@add("f29_cost", """
SELECT retriever, count(*) AS calls, CAST(sum(ceil(octet_length(encode(query_text)) / 2.0) + 256) AS BIGINT) AS tokens_in, round((sum(ceil(octet_length(encode(query_text)) / 2.0) + 256) * 1.0 + count(*) * 600 * 5.0) / 1e6, 6) AS maximum_usd
FROM retrieval_runs WHERE query_text IS NOT NULL GROUP BY retriever""")
def f29(spark, d):
    runs = table(spark, d, "retrieval_runs").where("query_text is not null")
    tokens = F.ceil(F.octet_length("query_text") / 2.0) + 256
    return runs.groupBy("retriever").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).cast("long").alias("tokens_in"), F.round((F.sum(tokens) * 1.0 + F.count(F.lit(1)) * 600 * 5.0) / 1e6, 6).alias("maximum_usd"))


_CAT = "category AS (SELECT query_id, min(" + category_sql("query_text") + ") AS category FROM retrieval_runs WHERE query_text IS NOT NULL GROUP BY query_id)"


@add("f30_rule_router", f"""
WITH {PANEL}, {_CAT}, q AS (SELECT query_id, retriever, avg(graded_ndcg_at_10) AS v FROM panel GROUP BY ALL),
cc AS (SELECT coalesce(category, 'unknown') AS category, retriever, round(avg(v), 6) AS v, count(*) AS n FROM q LEFT JOIN category USING (query_id) GROUP BY ALL),
bb AS (SELECT category, max(v) AS best FROM cc GROUP BY category)
SELECT category, min(retriever) AS routed_to, max(best) AS best FROM cc JOIN bb USING (category) WHERE v >= best - 0.01 GROUP BY category""")
def f30(spark, d):
    q = panel(spark, d).groupBy("query_id", "retriever").agg(F.avg("graded_ndcg_at_10").alias("v")).join(query_categories(spark, d), "query_id", "left")
    c = q.groupBy(F.coalesce("category", F.lit("unknown")).alias("category"), "retriever").agg(F.round(F.avg("v"), 6).alias("v"))
    best = c.groupBy("category").agg(F.max("v").alias("best"))
    return c.join(best, "category").where("v >= best - 0.01").groupBy("category").agg(F.min("retriever").alias("routed_to"), F.max("best").alias("best"))


@add("f30_oracle_ceiling", f"""
WITH {PANEL}, q AS (SELECT query_id, retriever, round(avg(graded_ndcg_at_10), 6) AS v FROM panel GROUP BY ALL) SELECT query_id, retriever AS best_system, v FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, retriever) = 1""")
def f30o(spark, d):
    q = panel(spark, d).groupBy("query_id", "retriever").agg(F.round(F.avg("graded_ndcg_at_10"), 6).alias("v"))
    best = q.groupBy("query_id").agg(F.min(F.struct((F.lit(0.0) - F.col("v")).alias("low"), "retriever")).alias("b"))
    return best.select("query_id", F.col("b.retriever").alias("best_system"), (F.lit(0.0) - F.col("b.low")).alias("v"))


@add("f31_union_recall", f"""
WITH {RANKED}, g AS (SELECT query_id, count(*) AS gold FROM judged WHERE grade > 0 GROUP BY query_id),
u AS (SELECT depth, j.query_id, count(DISTINCT j.chunk_id) AS hit FROM judged j JOIN ranked r ON r.query_id = j.query_id AND r.chunk_id = j.chunk_id JOIN (VALUES (10), (25)) v(depth) ON r.rank <= depth WHERE j.grade > 0 AND retriever IN ('bm25', 'dense_flat') GROUP BY ALL)
SELECT CAST(v.depth AS INT) AS depth, round(avg(coalesce(u.hit, 0) * 1.0 / gold), 6) AS recall, count(*) AS queries FROM g CROSS JOIN (VALUES (10), (25)) v(depth) LEFT JOIN u ON u.query_id = g.query_id AND u.depth = v.depth GROUP BY v.depth""")
def f31(spark, d):
    judged = M.judgments(table(spark, d, "qrels")).where("grade > 0")
    pool = ranked(spark, d, 25).where("retriever in ('bm25', 'dense_flat')").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    hit = judged.join(pool, ["query_id", "chunk_id"], "left")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.count(F.when(F.col("rank") <= 10, 1)).alias("h10"), F.count("rank").alias("h25"))
    both = per.select("query_id", F.explode(F.array(F.struct(F.lit(10).alias("depth"), (F.col("h10") / F.col("gold")).alias("r")), F.struct(F.lit(25).alias("depth"), (F.col("h25") / F.col("gold")).alias("r")))).alias("x"))
    return both.groupBy("x.depth").agg(F.round(F.avg("x.r"), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))
