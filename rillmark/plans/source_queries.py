"""Queries on sources and sinks (group A) and on streams (group I). Sinks are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.operators import metrics as M
from rillmark.operators.retrieval import Bm25Index
from rillmark.plans.catalogue import REGISTRY
from rillmark.plans.metric_queries import panel, ranked
from rillmark.plans.sql_parts import PANEL, RANKED
from rillmark.session import scratch, table
from rillmark.sources import files
from rillmark.streaming import pipelines

add = REGISTRY.add


@add("a01_document_ids", "SELECT ext_row, 'doc_' || left(sha256(text), 12) AS doc_id, octet_length(encode(text)) AS byte_size FROM extracted_documents WHERE text IS NOT NULL")
def a01(spark, d):
    t = table(spark, d, "extracted_documents").where("text is not null")
    return t.select("ext_row", F.concat(F.lit("doc_"), F.left(F.sha2("text", 256), F.lit(12))).alias("doc_id"), F.octet_length("text").cast("long").alias("byte_size"))


@add("a07_json_fields", r"""
WITH j AS (SELECT ext_row, text AS t FROM extracted_documents WHERE starts_with(ltrim(text), '{') AND json_valid(text))
SELECT ext_row, json_extract_string(t, '$.scheme_title') AS scheme_title, json_extract_string(t, '$.ministry') AS ministry FROM j""")
def a07(spark, d):
    j = table(spark, d, "extracted_documents").where(F.ltrim("text").startswith("{")).withColumn("v", F.expr("try_parse_json(text)")).where("v is not null")
    return j.select("ext_row", F.expr("try_variant_get(v, '$.scheme_title', 'string')").alias("scheme_title"), F.expr("try_variant_get(v, '$.ministry', 'string')").alias("ministry"))


@add("a08_jsonl", "SELECT chunk_row, chunk_id, text FROM chunks_v2")
def a08(spark, d):
    path = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, d, "chunks_v2").select("chunk_row", "chunk_id", "text"), path)
    return files.read_jsonl(spark, path, "chunk_row long, chunk_id string, text string", strict=True)


@add("a11_canonical_json", """
WITH j AS (SELECT query_id, chunk_id, max(relevance) AS r FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL) SELECT query_id, chunk_id, '{"chunk_id":"' || chunk_id || '","query_id":"' || query_id || '","relevance":' || r || '}' AS canonical FROM j""")
def a11(spark, d):
    q = table(spark, d, "qrels").where("relevance is not null").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    return q.select("query_id", "chunk_id", files.canonical_json(["query_id", "chunk_id", "relevance"]).alias("canonical"))


@add("a12_unique_sink", "SELECT query_id, chunk_id, max(relevance) AS grade FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL")
def a12(spark, d):
    path = scratch(spark, "unique")
    files.write_unique(M.judgments(table(spark, d, "qrels")).withColumn("key", F.concat_ws("/", "query_id", "chunk_id")), "key", path)
    return spark.read.parquet(path).select("query_id", "chunk_id", "grade")


@add("a13_qrels_file", "SELECT query_id, iteration_tag, chunk_id, relevance FROM qrels WHERE relevance IS NOT NULL")
def a13(spark, d):
    path = scratch(spark, "qrels")
    files.write_qrels(table(spark, d, "qrels"), path)
    return files.read_qrels(spark, path)


@add("a15_run_file", f"WITH {RANKED} SELECT run_id, query_id, retriever, chunk_id, score, rank FROM ranked")
def a15(spark, d):
    path = scratch(spark, "runs")
    files.write_runs(ranked(spark, d), path)
    return files.read_runs(spark, path)


@add("a16_metric_csv", f"WITH {PANEL} SELECT run_id, round(graded_ndcg_at_10, 4) AS graded_ndcg_at_10, round(recall_at_10, 4) AS recall_at_10 FROM panel")
def a16(spark, d):
    path = scratch(spark, "metrics")
    files.write_metrics_csv(panel(spark, d).select("run_id", "graded_ndcg_at_10", "recall_at_10"), path)
    return spark.read.option("header", "true").schema("run_id long, graded_ndcg_at_10 double, recall_at_10 double").csv(path)


@add("a19_manifest_profile", r"""
SELECT lower(trim(scheme_id)) AS scheme, count(*) AS documents, count(DISTINCT text_sha256) AS texts, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda s: s <> ''))) AS BIGINT) AS words, max(ingested_at) AS latest FROM extracted_documents GROUP BY 1""")
def a19(spark, d):
    e = table(spark, d, "extracted_documents")
    return e.groupBy(F.lower(F.trim("scheme_id")).alias("scheme")).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("text_sha256").alias("texts"), F.sum(F.size(X.split_words(F.col("text")))).alias("words"), F.max("ingested_at").alias("latest")
    )


@add("a20_source_chunk_counts", """
WITH c AS (SELECT lower(trim(document_id)) AS doc, count(*) AS chunks FROM chunks_v2 GROUP BY 1) SELECT DISTINCT lower(trim(e.document_id)) AS doc, coalesce(c.chunks, 0) AS chunks FROM extracted_documents e LEFT JOIN c ON c.doc = lower(trim(e.document_id))""")
def a20(spark, d):
    c = table(spark, d, "chunks_v2").groupBy(F.lower(F.trim("document_id")).alias("doc")).agg(F.count(F.lit(1)).alias("chunks"))
    e = table(spark, d, "extracted_documents").select(F.lower(F.trim("document_id")).alias("doc")).distinct()
    return e.join(c, "doc", "left").fillna(0, ["chunks"])


@add("a21_index_tables", r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL) SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term""")
def a21(spark, d):
    return Bm25Index(table(spark, d, "documents"), "doc_id", "text").terms.select("term", "df")


@add("i01_tumbling_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def i01(spark, d):
    """Windows of the stream, those still open at its end in their last state."""
    stream = pipelines.read_stream(spark, f"{d}/events.parquet", table(spark, d, "events")).select("ts", "event_type", "value")
    counted = pipelines.run_updates(pipelines.tumbling_counts(stream), ["window_start", "event_type"])
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("i02_first_arrivals", "SELECT sha256(text) AS text_sha, count(*) > 0 AS arrived FROM documents WHERE text IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1")
def i02(spark, d):
    docs = table(spark, d, "documents")
    stream = pipelines.read_stream(spark, f"{d}/documents.parquet", docs).where("ingested_at is not null")
    return pipelines.run_to_table(pipelines.first_arrivals(stream, "ingested_at", "text").select("text_sha", F.lit(True).alias("arrived")))


@add("i03_sessions", """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def i03(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")
