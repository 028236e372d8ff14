"""Queries of the problems on free text of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.llm import leakage, pii
from rillmark.llm.queries import add
from rillmark.session import table


def _texts():
    return F.concat(F.array("question", "reference_answer"), F.coalesce("supporting_evidence_quotes", F.array().cast("array<string>")))


def _passages(spark, sf_dir):
    items = table(spark, sf_dir, "qa_items").where("split_name = 'test'")
    return items.select("item_id", F.explode(_texts()).alias("passage"))


@add("p6_found", r"""
WITH i AS (SELECT item_id, unnest(list_concat([question, reference_answer], coalesce(supporting_evidence_quotes, []))) AS t FROM qa_items WHERE split_name = 'test'),
iw AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM i WHERE t IS NOT NULL),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' '))) AS g FROM iw WHERE len(w) >= 12),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' '))) AS g FROM dw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""")
def p6_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return leakage.leaked_items(docs, "doc_id", "text", _passages(spark, sf_dir), "item_id", "passage")


@add("p6_spans", r"""
WITH i AS (SELECT item_id, list_concat([question, reference_answer], coalesce(supporting_evidence_quotes, [])) AS ts FROM qa_items WHERE split_name = 'test'),
ip AS (SELECT item_id, CAST(n - 1 AS INT) AS passage_number, ts[n] AS t FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS n FROM i)),
iw AS (SELECT item_id, passage_number, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM ip WHERE t IS NOT NULL),
ig AS (SELECT item_id, passage_number, j - 1 AS q, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS j FROM iw WHERE len(w) >= 12)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, j - 1 AS p, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS j FROM dw WHERE len(w) >= 12)),
h AS (SELECT doc_id, item_id, passage_number, p - q AS shift, p, p - row_number() OVER (PARTITION BY doc_id, item_id, passage_number, p - q ORDER BY p) AS island FROM dg JOIN ig USING (g))
SELECT doc_id, item_id, passage_number, CAST(min(p) AS INT) AS start_word, CAST(min(p) - any_value(shift) AS INT) AS passage_word, CAST(count(*) + 11 AS INT) AS words FROM h GROUP BY doc_id, item_id, passage_number, shift, island""")
def p6_spans(spark, sf_dir):
    """Where the leaked runs stand in the document and in the passage, and how long they are."""
    items = table(spark, sf_dir, "qa_items").where("split_name = 'test'").select("item_id", _texts().alias("texts"))
    passages = items.select("item_id", F.posexplode("texts").alias("passage_number", "passage"))
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), "doc_id", "text", passages, "item_id", "passage_number", "passage")


@add("p8_found")
def p8_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, "doc_id", "text", table(spark, sf_dir, "known_names"))
    return found.select("doc_id", "pii_type", "pii_text").distinct()


@add("p8_redacted")
def p8_redacted(spark, sf_dir):
    return pii.redact_personal_data(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "known_names"))
