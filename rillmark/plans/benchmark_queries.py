"""Queries on benchmark construction (group J) and on contracts, provenance and answers (group K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.functions.ranking import row_number_in_groups
from rillmark.operators.metrics import violations
from rillmark.operators.pairing import cross_pairs
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.metric_queries import ranked
from rillmark.plans.sql_parts import RANKED
from rillmark.plans.text_queries import category_sql
from rillmark.session import table

add = REGISTRY.add

#: One row per benchmark question: id, text, rule category.
QUESTIONS = "qs AS (SELECT query_id, min(query_text) AS question, " + category_sql("min(query_text)") + " AS category FROM retrieval_runs WHERE query_text IS NOT NULL GROUP BY query_id)"


def questions(spark, d):
    q = table(spark, d, "retrieval_runs").where("query_text is not null").groupBy("query_id").agg(F.min("query_text").alias("question"))
    return q.withColumn("category", X.category(F.col("question")))


def salted(salt: str, key: str):
    """The first 60 bits of the sha256 of salt and key: a reproducible order."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.col(key)), 256), 1, 15), 16, 10).cast("long")


def salted_sql(salt: str, key: str) -> str:
    return f"('0x' || substr(sha256('{salt}:' || {key}), 1, 15))::BIGINT"


@add("j01_template_questions", r"""
WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS scheme, trim(regexp_replace(lower(ministry), '[^\p{L}\p{N}]+', ' ', 'g')) AS ministry FROM extracted_documents WHERE title IS NOT NULL AND ministry IS NOT NULL),
q AS (SELECT 'Which ministry runs ' || scheme || '?' AS question, ministry AS answer FROM t UNION ALL SELECT 'Which scheme is run by ' || ministry || '?', scheme FROM t)
SELECT question, min(answer) AS answer, count(DISTINCT answer) AS answers, CASE WHEN count(DISTINCT answer) = 1 THEN 'accepted' ELSE 'ambiguous' END AS decision FROM q GROUP BY question""")
def j01(spark, d):
    t = table(spark, d, "extracted_documents").where("title is not null and ministry is not null").select(X.unicode_norm(F.col("title")).alias("scheme"), X.unicode_norm(F.col("ministry")).alias("ministry")).distinct()
    ask = F.array(
        F.struct(F.concat(F.lit("Which ministry runs "), "scheme", F.lit("?")).alias("question"), F.col("ministry").alias("answer")),
        F.struct(F.concat(F.lit("Which scheme is run by "), "ministry", F.lit("?")).alias("question"), F.col("scheme").alias("answer")),
    )
    q = t.select(F.explode(ask).alias("x")).select("x.question", "x.answer")
    n = F.countDistinct("answer")
    return q.groupBy("question").agg(F.min("answer").alias("answer"), n.alias("answers"), F.when(n == 1, "accepted").otherwise("ambiguous").alias("decision"))


@add("j02_bridge_candidates", r"""
WITH s AS (SELECT DISTINCT lower(trim(scheme_id)) AS scheme, trim(regexp_replace(lower(department), '[^\p{L}\p{N}]+', ' ', 'g')) AS bridge FROM extracted_documents WHERE scheme_id IS NOT NULL AND department IS NOT NULL),
m AS (SELECT scheme, count(DISTINCT bridge) AS bridges FROM s GROUP BY scheme)
SELECT s.bridge, count(*) AS schemes, min(s.scheme) AS first_scheme, max(s.scheme) AS last_scheme, CAST(sum(CASE WHEN bridges > 1 THEN 1 ELSE 0 END) AS BIGINT) AS connecting FROM s JOIN m USING (scheme) GROUP BY s.bridge HAVING count(*) > 1""")
def j02(spark, d):
    s = table(spark, d, "extracted_documents").where("scheme_id is not null and department is not null").select(F.lower(F.trim("scheme_id")).alias("scheme"), X.unicode_norm(F.col("department")).alias("bridge")).distinct()
    m = s.groupBy("scheme").agg(F.count(F.lit(1)).alias("bridges"))
    out = s.join(m, "scheme").groupBy("bridge").agg(F.count(F.lit(1)).alias("schemes"), F.min("scheme").alias("first_scheme"), F.max("scheme").alias("last_scheme"), F.sum((F.col("bridges") > 1).cast("long")).alias("connecting"))
    return out.where("schemes > 1")


_RELATION = (("funding", r"\b(grant|fund|outlay|rs|rupees|owe)"), ("eligibility", r"\b(qualif|eligib|only|listed)"), ("procedure", r"\b(register|apply|file|returns|hears)"))


@add("j03_relation_type", f"WITH {QUESTIONS} SELECT query_id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in _RELATION) + " ELSE 'other' END AS relation FROM qs")
def j03(spark, d):
    out = F.lit("other")
    for name, pattern in _RELATION[::-1]:
        out = F.when(F.lower("question").rlike(pattern), name).otherwise(out)
    return questions(spark, d).select("query_id", out.alias("relation"))


_EVIDENCE = """ev AS (SELECT q.query_id, q.chunk_id, max(q.relevance) AS grade, min(c.text) AS text, min(lower(trim(c.document_id))) AS doc FROM qrels q JOIN chunks_v2 c USING (chunk_id) WHERE q.relevance > 0 AND c.text IS NOT NULL GROUP BY ALL)"""


def _evidence(spark, d):
    q = table(spark, d, "qrels").where("relevance > 0").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("grade"))
    c = table(spark, d, "chunks_v2").where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min(F.lower(F.trim("document_id"))).alias("doc"))
    return q.join(c, "chunk_id")


@add("j04_answer_support", r"""
WITH d AS (SELECT lower(trim(document_id)) AS doc, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS e FROM extracted_documents WHERE text IS NOT NULL AND document_id IS NOT NULL),
c AS (SELECT chunk_row, lower(trim(document_id)) AS doc, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS a FROM chunks_v2 WHERE text IS NOT NULL AND document_id IS NOT NULL),
t AS (SELECT chunk_row, contains(e, a) AS verbatim, len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(e, ' ')))) * 1.0 / len(list_distinct(string_split(a, ' '))) AS coverage FROM c JOIN d USING (doc) WHERE a <> '')
SELECT chunk_row, bool_or(verbatim) AS verbatim, round(max(coverage), 6) AS coverage, bool_or(verbatim) OR max(coverage) >= 0.85 AS supported FROM t GROUP BY chunk_row""")
def j04(spark, d):
    """Whether the document a passage is said to come from supports it: verbatim or by its words; the best delivery of the document counts."""
    doc = F.lower(F.trim("document_id")).alias("doc")
    e = table(spark, d, "extracted_documents").where("text is not null and document_id is not null").select(doc, X.ascii_norm(F.col("text")).alias("e")).distinct()
    c = table(spark, d, "chunks_v2").where("text is not null and document_id is not null").select("chunk_row", doc, X.ascii_norm(F.col("text")).alias("a")).where("a <> ''")
    words = lambda x: F.array_distinct(F.split(x, " "))
    t = c.join(e, "doc").select("chunk_row", F.contains("e", "a").alias("verbatim"), (F.size(F.array_intersect(words("a"), words("e"))) / F.size(words("a"))).alias("coverage"))
    return t.groupBy("chunk_row").agg(F.bool_or("verbatim").alias("verbatim"), F.round(F.max("coverage"), 6).alias("coverage"), (F.bool_or("verbatim") | (F.max("coverage") >= 0.85)).alias("supported"))


@add("j05_stratified_split", f"""
WITH {QUESTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {salted_sql('split', 'query_id')}) AS r, count(*) OVER (PARTITION BY category) AS n FROM qs)
SELECT query_id, category, CASE WHEN r <= ceil(0.6 * n) THEN 'dev' ELSE 'test' END AS split, CAST((r - 1) % 5 AS INT) AS fold FROM n""")
def j05(spark, d):
    q = questions(spark, d).select("query_id", "category")
    placed = row_number_in_groups(q, ["category"], salted("split", "query_id"), "r", salt_bits=10)
    sized = placed.join(q.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category")
    return sized.select("query_id", "category", F.when(F.col("r") <= F.ceil(F.lit(0.6) * F.col("n")), "dev").otherwise("test").alias("split"), ((F.col("r") - 1) % 5).cast("int").alias("fold"))


@add("j06_question_contract", rf"""
WITH {QUESTIONS}
SELECT 'short_question' AS rule, query_id AS key FROM qs WHERE len(regexp_split_to_array(trim(question), '\s+')) < 6
UNION ALL SELECT 'unknown_category', query_id FROM qs WHERE category = 'unknown'
UNION ALL SELECT 'no_judgment', query_id FROM qs WHERE query_id NOT IN (SELECT query_id FROM qrels)
UNION ALL SELECT 'repeated_question', array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' ') FROM qs GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'reused_evidence', chunk_id FROM (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE relevance > 0) GROUP BY chunk_id HAVING count(*) > 2""")
def j06(spark, d):
    q, judged = questions(spark, d), table(spark, d, "qrels")
    return violations(
        {
            "short_question": q.where(F.size(F.split(F.trim("question"), r"\s+")) < 6).select("query_id"),
            "unknown_category": q.where("category = 'unknown'").select("query_id"),
            "no_judgment": q.join(judged, "query_id", "left_anti").select("query_id"),
            "repeated_question": q.groupBy(X.ascii_norm(F.col("question")).alias("k")).count().where("count > 1"),
            "reused_evidence": judged.where("relevance > 0").select("query_id", "chunk_id").distinct().groupBy("chunk_id").count().where("count > 2"),
        }
    )


@add("j07_grade_two_evidence", f"""
WITH {_EVIDENCE}, d2 AS (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE relevance = 2)
SELECT d2.query_id, d2.chunk_id, CASE WHEN ev.chunk_id IS NULL THEN 'unresolved' WHEN ev.grade <> 2 THEN 'conflicting' ELSE 'resolved' END AS state FROM d2 LEFT JOIN ev USING (query_id, chunk_id)""")
def j07(spark, d):
    direct = table(spark, d, "qrels").where("relevance = 2").select("query_id", "chunk_id").distinct()
    found = direct.join(_evidence(spark, d), ["query_id", "chunk_id"], "left")
    return found.select("query_id", "chunk_id", F.when(F.col("grade").isNull(), "unresolved").when(F.col("grade") != 2, "conflicting").otherwise("resolved").alias("state"))


@add("j08_graph_path", f"""
WITH {_EVIDENCE} SELECT query_id, count(*) AS gold, count(DISTINCT doc) AS documents, count(*) >= 2 AND count(DISTINCT doc) >= 2 AS two_documents FROM ev GROUP BY query_id""")
def j08(spark, d):
    n, docs = F.count(F.lit(1)), F.countDistinct("doc")
    return _evidence(spark, d).groupBy("query_id").agg(n.alias("gold"), docs.alias("documents"), ((n >= 2) & (docs >= 2)).alias("two_documents"))


@add("j09_synthesis_rounds")
def j09_rounds(spark, d):
    """Every question that can be is paired, across categories and with disjoint documents of its positive judgments."""
    docs = table(spark, d, "chunks_v2").select("chunk_id", F.lower(F.trim("document_id")).alias("doc")).where("doc is not null").distinct()
    gold = table(spark, d, "qrels").where("relevance > 0").select("query_id", "chunk_id").distinct().join(docs, "chunk_id").groupBy("query_id").agg(F.collect_set("doc").alias("docs"))
    pairs = cross_pairs(questions(spark, d).join(gold, "query_id", "left"), "query_id", "category", "docs")
    h = {c: salted("pair", c) for c in "ab"}
    first = (h["a"] < h["b"]) | ((h["a"] == h["b"]) & (F.col("a") < F.col("b")))
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("query_a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("query_b"))


@add("j10_audit_sheet", f"""
WITH {QUESTIONS} SELECT query_id, category FROM qs QUALIFY row_number() OVER (PARTITION BY category ORDER BY {salted_sql('audit', 'query_id')}) <= ceil(0.1 * count(*) OVER (PARTITION BY category))""")
def j10(spark, d):
    q = questions(spark, d).select("query_id", "category")
    placed = row_number_in_groups(q, ["category"], salted("audit", "query_id"), "r", salt_bits=10)
    sized = placed.join(q.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category")
    return sized.where(F.col("r") <= F.ceil(F.lit(0.1) * F.col("n"))).select("query_id", "category")


@add("j11_regeneration_gate", f"WITH {QUESTIONS} SELECT category, count(*) AS questions, count(DISTINCT question) AS distinct_questions, count(*) >= 20 AS enough FROM qs GROUP BY category")
def j11(spark, d):
    g = questions(spark, d).groupBy("category")
    return g.agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("question").alias("distinct_questions"), (F.count(F.lit(1)) >= 20).alias("enough"))


@add("j12_stratified_sample", f"WITH {QUESTIONS} SELECT category, query_id FROM qs QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('42' || query_id), query_id) <= 5")
def j12(spark, d):
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit("42"), "query_id")), "query_id"))
    return questions(spark, d).withColumn("r", place).where("r <= 5").select("category", "query_id")


@add("j13_gold_resolution", """
SELECT q.query_id, q.chunk_id, max(q.relevance) AS relevance, max(CASE WHEN c.chunk_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS resolves FROM qrels q LEFT JOIN (SELECT DISTINCT chunk_id FROM chunks_v2) c USING (chunk_id) WHERE q.relevance > 0 GROUP BY ALL""")
def j13(spark, d):
    known = table(spark, d, "chunks_v2").select("chunk_id").distinct().withColumn("known", F.lit(True))
    q = table(spark, d, "qrels").where("relevance > 0").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    return q.join(known, "chunk_id", "left").select("query_id", "chunk_id", "relevance", F.col("known").isNotNull().alias("resolves"))


@add("j14_trace_pick", f"""
WITH {RANKED}, {QUESTIONS}, c AS (SELECT retriever, coalesce(category, 'unknown') AS category, min({{'h': sha256('trace:' || r.query_id), 'q': r.query_id}}) AS b FROM (SELECT DISTINCT retriever, query_id FROM ranked) r LEFT JOIN qs USING (query_id) GROUP BY ALL),
l AS (SELECT list({{'s': retriever, 'h': b.h, 'q': b.q, 'c': category}} ORDER BY retriever, b.h, b.q) AS all_ FROM c),
f AS (SELECT list_reduce(all_, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s = x.s OR y.c = x.c)) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(s VARCHAR, h VARCHAR, q VARCHAR, c VARCHAR)[])) AS t FROM l)
SELECT x.s AS retriever, x.q AS query_id, x.c AS category FROM (SELECT unnest(t) AS x FROM f)""")
def j14(spark, d):
    """One query for each system in the order of its name, by hash, of a category no system before it has; systems times categories rows are looked at."""
    lists = ranked(spark, d).select("retriever", "query_id").distinct().join(questions(spark, d).select("query_id", "category"), "query_id", "left")
    best = lists.groupBy("retriever", F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.min(F.struct(F.sha2(F.concat(F.lit("trace:"), "query_id"), 256).alias("h"), "query_id")).alias("b"))
    ordered = best.agg(F.array_sort(F.collect_list(F.struct("retriever", "b.h", "b.query_id", "category"))).alias("all"))
    picked = F.aggregate(
        "all", F.expr("cast(array() as array<struct<retriever:string,h:string,query_id:string,category:string>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["retriever"] == x["retriever"]) | (y["category"] == x["category"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ordered.select(F.inline(picked)).drop("h")


@add("j15_publication_gate", """
WITH j AS (SELECT query_id, count(DISTINCT chunk_id) AS judged, count(DISTINCT CASE WHEN relevance > 0 THEN chunk_id END) AS gold FROM qrels GROUP BY query_id)
SELECT CASE WHEN gold = 0 THEN 'no_gold' WHEN judged < 2 THEN 'too_few_judgments' ELSE 'publishable' END AS gate, count(*) AS queries FROM j GROUP BY 1""")
def j15(spark, d):
    j = table(spark, d, "qrels").groupBy("query_id").agg(F.countDistinct("chunk_id").alias("judged"), F.countDistinct(F.when(F.col("relevance") > 0, F.col("chunk_id"))).alias("gold"))
    gate = F.when(F.col("gold") == 0, "no_gold").when(F.col("judged") < 2, "too_few_judgments").otherwise("publishable")
    return j.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("queries"))


@add("k01_field_rules", r"""
SELECT 'required_text' AS rule, CAST(chunk_row AS VARCHAR) AS key FROM chunks_v2 WHERE text IS NULL OR trim(text) = '' OR regexp_matches(text, '(?i)^\s*(todo|tbd|placeholder)\b')
UNION ALL SELECT 'schema_version', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE schema_version IS NULL OR schema_version <> '2.0'
UNION ALL SELECT 'sha256_form', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE NOT regexp_full_match(text_sha256, '[0-9a-f]{64}')
UNION ALL SELECT 'sha256_of_text', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE text IS NOT NULL AND sha256(text) <> text_sha256""")
def k01(spark, d):
    c = table(spark, d, "chunks_v2")
    return violations(
        {
            "required_text": c.where(F.col("text").isNull() | (F.trim("text") == "") | F.col("text").rlike(r"(?i)^\s*(todo|tbd|placeholder)\b")).select("chunk_row"),
            "schema_version": c.where("schema_version is null or schema_version <> '2.0'").select("chunk_row"),
            "sha256_form": c.where("not text_sha256 rlike '^[0-9a-f]{64}$'").select("chunk_row"),
            "sha256_of_text": c.where("text is not null and sha2(text, 256) <> text_sha256").select("chunk_row"),
        }
    )


@add("k02_invariants", """
SELECT 'word_count_range' AS rule, CAST(chunk_row AS VARCHAR) AS key FROM chunks_v2 WHERE word_count <> end_word - start_word OR word_count NOT BETWEEN 1 AND 300
UNION ALL SELECT 'overlap_range', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE previous_overlap IS NULL OR previous_overlap NOT BETWEEN 0 AND 60
UNION ALL SELECT 'char_span', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE start_char < 0 OR end_char <= start_char
UNION ALL SELECT 'multi_hop_evidence', CAST(item_id AS VARCHAR) FROM qa_items WHERE category = 'multi_hop' AND len(supporting_evidence_quotes) < 2
UNION ALL SELECT 'pages', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE pages_extracted > page_count""")
def k02(spark, d):
    c, q, e = table(spark, d, "chunks_v2"), table(spark, d, "qa_items"), table(spark, d, "extracted_documents")
    return violations(
        {
            "word_count_range": c.where("word_count <> end_word - start_word or word_count not between 1 and 300").select("chunk_row"),
            "overlap_range": c.where("previous_overlap is null or previous_overlap not between 0 and 60").select("chunk_row"),
            "char_span": c.where("start_char < 0 or end_char <= start_char").select("chunk_row"),
            "multi_hop_evidence": q.where("category = 'multi_hop' and size(supporting_evidence_quotes) < 2").select("item_id"),
            "pages": e.where("pages_extracted > page_count").select("ext_row"),
        }
    )


@add("k03_lineage", """
SELECT 'unknown_parent' AS rule, chunk_id AS key FROM (SELECT DISTINCT chunk_id, source_sha256 FROM chunks_v2) WHERE source_sha256 NOT IN (SELECT source_sha256 FROM extracted_documents WHERE source_sha256 IS NOT NULL)
UNION ALL SELECT 'unknown_run', CAST(run_id AS VARCHAR) FROM (SELECT DISTINCT run_id FROM retrieval_results) WHERE run_id NOT IN (SELECT run_id FROM retrieval_runs)""")
def k03(spark, d):
    c, e = table(spark, d, "chunks_v2"), table(spark, d, "extracted_documents")
    res, runs = table(spark, d, "retrieval_results"), table(spark, d, "retrieval_runs")
    return violations(
        {
            "unknown_parent": c.where("source_sha256 is not null").select("chunk_id", "source_sha256").distinct().join(e, "source_sha256", "left_anti").select("chunk_id"),
            "unknown_run": res.select("run_id").distinct().join(runs, "run_id", "left_anti"),
        }
    )


@add("k04_fingerprint", """
SELECT corpus_version, count(*) AS chunks, CAST(sum(('0x' || substr(md5(chunk_id || '|' || coalesce(text_sha256, '')), 1, 12))::BIGINT) AS DECIMAL(38,0))::VARCHAR AS fingerprint FROM chunks_v2 GROUP BY corpus_version""")
def k04(spark, d):
    """An order-free fingerprint: row hashes are summed, so no list of a whole corpus is built."""
    h = F.conv(F.substring(F.md5(F.concat("chunk_id", F.lit("|"), F.coalesce("text_sha256", F.lit("")))), 1, 12), 16, 10).cast("decimal(38,0)")
    return table(spark, d, "chunks_v2").groupBy("corpus_version").agg(F.count(F.lit(1)).alias("chunks"), F.sum(h).cast("string").alias("fingerprint"))


@add("k05_configuration_hash", """
SELECT cfg AS config_hash, count(*) AS runs, count(DISTINCT retriever) AS retrievers FROM (SELECT retriever, sha256(array_to_string(list_transform(list_sort(map_keys(config_snapshot)), lambda k: k || '=' || config_snapshot[k]), '|')) AS cfg FROM retrieval_runs WHERE config_snapshot IS NOT NULL) GROUP BY cfg""")
def k05(spark, d):
    runs = table(spark, d, "retrieval_runs").where("config_snapshot is not null")
    keys = F.array_sort(F.map_keys("config_snapshot"))
    cfg = F.sha2(F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("config_snapshot")[k])), "|"), 256)
    return runs.groupBy(cfg.alias("config_hash")).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("retriever").alias("retrievers"))


_MANIFEST = "SELECT lower(trim(document_id)) || '#' || chunk_index AS path, min(text_sha256) AS sha FROM chunks_v2 WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL AND corpus_version {} GROUP BY 1"


@add("k06_manifest_diff", f"""
WITH o AS ({_MANIFEST.format("= 'pilot-v2'")}), n AS ({_MANIFEST.format("> 'pilot-v2'")})
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN o.sha IS DISTINCT FROM n.sha THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def k06(spark, d):
    """The manifest of one release of the chunks against that of the later ones."""
    c = table(spark, d, "chunks_v2").where("document_id is not null and chunk_index is not null").withColumn("path", F.concat(F.lower(F.trim("document_id")), F.lit("#"), F.col("chunk_index").cast("string")))
    o = c.where("corpus_version = 'pilot-v2'").groupBy("path").agg(F.min("text_sha256").alias("old"), F.lit(True).alias("in_old"))
    n = c.where("corpus_version > 'pilot-v2'").groupBy("path").agg(F.min("text_sha256").alias("new"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "missing").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


@add("k07_release_gate", """
SELECT retriever, count(DISTINCT run_id) AS runs, count(DISTINCT query_id) AS queries, count(DISTINCT query_id) = (SELECT count(DISTINCT query_id) FROM retrieval_runs) AS covers_all FROM retrieval_runs GROUP BY retriever""")
def k07(spark, d):
    runs = table(spark, d, "retrieval_runs")
    total = runs.agg(F.countDistinct("query_id")).first()[0]
    return runs.groupBy("retriever").agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("query_id").alias("queries"), (F.countDistinct("query_id") == total).alias("covers_all"))


@add("k08_context", f"""
WITH {RANKED}, c AS (SELECT chunk_id, min(text) AS text FROM chunks_v2 WHERE text IS NOT NULL GROUP BY chunk_id), e AS (SELECT depth, run_id, rank, 'E' || lpad(CAST(rank AS VARCHAR), 2, '0') AS id, chunk_id, coalesce(text, '') AS text FROM ranked LEFT JOIN c USING (chunk_id), (VALUES (3), (5), (10)) v(depth) WHERE rank <= depth)
SELECT CAST(depth AS INT) AS depth, run_id, count(*) AS evidence, string_agg(id || '=' || chunk_id, ';' ORDER BY rank) AS id_map, md5(string_agg(id || '|' || md5(text), ';' ORDER BY rank)) AS context_md5 FROM e GROUP BY ALL""")
def k08(spark, d):
    """The first 3, 5 and 10 results of each run as numbered evidence with their texts (as a digest), and the map from numbers to chunks."""
    texts = table(spark, d, "chunks_v2").where("text is not null").groupBy("chunk_id").agg(F.md5(F.min("text")).alias("digest"))
    top = ranked(spark, d, 10).join(texts, "chunk_id", "left").select("run_id", "rank", "chunk_id", F.concat(F.lit("E"), F.lpad(F.col("rank").cast("string"), 2, "0")).alias("id"), F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))
    each = top.select("*", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("depth")).where("rank <= depth")
    lists = each.groupBy("depth", "run_id").agg(F.count(F.lit(1)).alias("evidence"), F.array_sort(F.collect_list(F.struct("rank", "id", "chunk_id", "digest"))).alias("e"))
    named = F.array_join(F.transform("e", lambda x: F.concat(x["id"], F.lit("="), x["chunk_id"])), ";")
    held = F.md5(F.array_join(F.transform("e", lambda x: F.concat(x["id"], F.lit("|"), x["digest"])), ";"))
    return lists.select("depth", "run_id", "evidence", named.alias("id_map"), held.alias("context_md5"))


@add("k09_panel_completeness", """
WITH s AS (SELECT DISTINCT retriever FROM retrieval_runs), q AS (SELECT DISTINCT query_id FROM retrieval_runs), h AS (SELECT DISTINCT query_id, retriever FROM retrieval_runs)
SELECT q.query_id, count(h.retriever) AS present, (SELECT count(*) FROM s) - count(h.retriever) AS missing FROM q LEFT JOIN h USING (query_id) GROUP BY q.query_id""")
def k09(spark, d):
    runs = table(spark, d, "retrieval_runs")
    systems = runs.agg(F.countDistinct("retriever")).first()[0]
    return runs.groupBy("query_id").agg(F.countDistinct("retriever").alias("present")).withColumn("missing", F.lit(systems) - F.col("present"))


@add("k11_dependency_gate", "SELECT chunk_id, count(DISTINCT text_sha256) AS hashes FROM chunks_v2 GROUP BY chunk_id HAVING count(DISTINCT text_sha256) > 1")
def k11(spark, d):
    return table(spark, d, "chunks_v2").groupBy("chunk_id").agg(F.countDistinct("text_sha256").alias("hashes")).where("hashes > 1")


@add("k13_blinding", f"WITH {QUESTIONS} SELECT query_id, 'P8G' || lpad(CAST(row_number() OVER (ORDER BY {salted_sql('blind', 'query_id')}) AS VARCHAR), 9, '0') AS display_id FROM qs")
def k13(spark, d):
    placed = row_number_in_groups(questions(spark, d).select("query_id"), [], salted("blind", "query_id"), "r", salt_bits=10)
    return placed.select("query_id", F.concat(F.lit("P8G"), F.lpad(F.col("r").cast("string"), 9, "0")).alias("display_id"))


@add("k16_review_completeness", """
WITH l AS (SELECT query_id, chunk_id, min(relevance) AS first FROM qrels GROUP BY ALL), r AS (SELECT query_id, chunk_id, max(relevance) AS last FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL)
SELECT l.query_id, l.chunk_id, CASE WHEN r.last IS NULL THEN 'unjudged' WHEN l.first IS DISTINCT FROM r.last THEN 'changed' ELSE 'unchanged' END AS state FROM l LEFT JOIN r USING (query_id, chunk_id)""")
def k16(spark, d):
    q = table(spark, d, "qrels").groupBy("query_id", "chunk_id").agg(F.min("relevance").alias("first"), F.max("relevance").alias("last"))
    return q.select("query_id", "chunk_id", F.when(F.col("last").isNull(), "unjudged").when(~F.col("first").eqNullSafe(F.col("last")), "changed").otherwise("unchanged").alias("state"))
