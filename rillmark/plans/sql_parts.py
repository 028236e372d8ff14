"""SQL building blocks that several oracles share."""

RANKED = """
item AS (SELECT run_id, query_id, retriever, chunk_id, max(score) AS score FROM retrieval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, chunk_id) AS rank FROM item),
judged AS (SELECT query_id, chunk_id, max(relevance) AS grade FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL)"""

PANEL = RANKED + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS place FROM judged WHERE grade > 0),
ideal AS (SELECT query_id, count(*) AS gold, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS ib, sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS ig FROM placed GROUP BY query_id),
h AS (SELECT r.run_id, r.query_id, r.retriever, r.rank, j.grade FROM ranked r LEFT JOIN judged j ON r.query_id = j.query_id AND r.chunk_id = j.chunk_id AND j.grade > 0 WHERE r.rank <= 10),
c AS (SELECT run_id, query_id, retriever, coalesce(1.0 / min(CASE WHEN grade IS NOT NULL AND rank <= 5 THEN rank END), 0) AS mrr_at_5, coalesce(1.0 / min(CASE WHEN grade IS NOT NULL THEN rank END), 0) AS mrr_at_10,
 CAST(count(CASE WHEN rank <= 5 THEN grade END) AS DOUBLE) AS h5, CAST(count(grade) AS DOUBLE) AS h10,
 coalesce(sum(CASE WHEN grade IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS db, coalesce(sum(grade / log2(rank + 1)), 0) AS dg FROM h GROUP BY ALL),
panel AS (SELECT run_id, query_id, retriever, gold, mrr_at_5, mrr_at_10, h5 / gold AS recall_at_5, h10 / gold AS recall_at_10, CAST(CAST(h5 > 0 AS INT) AS DOUBLE) AS hit_rate_at_5, CAST(CAST(h10 > 0 AS INT) AS DOUBLE) AS hit_rate_at_10,
 h5 / 5 AS precision_at_5, h10 / 10 AS precision_at_10, db / ib AS binary_ndcg_at_10, dg / ig AS graded_ndcg_at_10, CAST(CAST(h5 = gold AS INT) AS DOUBLE) AS complete_evidence_recall_at_5, CAST(CAST(h10 = gold AS INT) AS DOUBLE) AS complete_evidence_recall_at_10
 FROM c JOIN ideal USING (query_id))"""

METRIC_COLUMNS = (
    "mrr_at_5", "mrr_at_10", "recall_at_5", "recall_at_10", "hit_rate_at_5", "hit_rate_at_10", "precision_at_5", "precision_at_10",
    "binary_ndcg_at_10", "graded_ndcg_at_10", "complete_evidence_recall_at_5", "complete_evidence_recall_at_10",
)

#: Mean nDCG of each query under each of two systems, and the difference.
DIFFERENCES = PANEL + """,
per AS (SELECT query_id, retriever, avg(graded_ndcg_at_10) AS v, avg(recall_at_10) AS rc FROM panel GROUP BY ALL),
diff AS (SELECT a.query_id, a.v - b.v AS d, a.v AS va, b.v AS vb, row_number() OVER (ORDER BY a.query_id) - 1 AS i, count(*) OVER () AS n FROM per a JOIN per b USING (query_id) WHERE a.retriever = 'bm25' AND b.retriever = 'dense_flat')"""
