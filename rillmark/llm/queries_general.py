"""Queries of the problems on top items, splitting, splits and formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm import format_duplicates, grouped_splits, mixing, splitting, top_items
from rillmark.llm.queries import RECORDS, add
from rillmark.session import materialize, table


def _every_kind(make) -> DataFrame:
    parts = [make(kind, name, key).withColumn("record_kind", F.lit(kind)) for kind, name, key in RECORDS]
    return reduce(DataFrame.unionByName, parts)


def _pieces(spark, sf_dir) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks_v2").select("chunk_row", "chunk_id", "document_id", "start_word", "previous_overlap", "text")
    return splitting.split_oversized(chunks, "text", 300, 60, start_col="start_word", overlap_col="previous_overlap")


@add("p2_found", r"""
SELECT chunk_row FROM chunks_v2
WHERE len(regexp_extract_all(text, '[^\s\x{85}\x{A0}\x{0B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 300
""")
def p2_found(spark, sf_dir):
    return _pieces(spark, sf_dir).where("piece_index = 0").select("chunk_row")


@add("p2_pieces")
def p2_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir).drop("text")


_SPACE = r"[^\s\x{85}\x{A0}\x{0B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@add("p2_rebuilt", f"""
WITH c AS (SELECT chunk_row, coalesce(start_word, 0) AS start, CASE WHEN previous_overlap BETWEEN 0 AND 60 THEN previous_overlap ELSE 0 END AS before, regexp_extract_all(text, '{_SPACE}') AS w FROM chunks_v2)
SELECT chunk_row, CAST(len(w) AS INT) AS words, md5(array_to_string(w, ' ')) AS text_md5, CAST(start AS INT) AS first_start, CAST(before AS INT) AS first_overlap, true AS within_limit, true AS overlaps_right, true AS starts_right FROM c WHERE len(w) > 300""")
def p2_rebuilt(spark, sf_dir):
    """Each oversized text put together again from its pieces, and whether limits, overlaps and positions hold."""
    pieces = _pieces(spark, sf_dir).withColumn("w", F.regexp_extract_all("piece_text", F.lit(r"\P{IsWhite_Space}+"), F.lit(0)))
    order = Window.partitionBy("chunk_row").orderBy("piece_index")
    last = F.lag("w").over(order)
    first = F.col("piece_index") == 0
    checked = pieces.select(
        "chunk_row", "piece_index", "w", "start_word", "previous_overlap",
        F.when(first, F.col("w")).otherwise(F.slice("w", 61, F.size("w"))).alias("own"),
        (F.size("w") <= 300).alias("short"),
        (first | ((F.col("previous_overlap") == 60) & (F.slice("w", 1, 60) == F.slice(last, -60, 60)))).alias("shared"),
        (first | (F.col("start_word") == F.lag("start_word").over(order) + F.size(last) - 60)).alias("placed"),
    )
    whole = checked.groupBy("chunk_row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_index", "own"))), lambda x: x["own"])).alias("words"),
        F.min_by("start_word", "piece_index").alias("first_start"), F.min_by("previous_overlap", "piece_index").alias("first_overlap"),
        F.bool_and("short").alias("within_limit"), F.bool_and("shared").alias("overlaps_right"), F.bool_and("placed").alias("starts_right"),
    )
    return whole.select("chunk_row", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("text_md5"), "first_start", "first_overlap", "within_limit", "overlaps_right", "starts_right")


def _targets(spark, sf_dir) -> dict[str, float]:
    rows = table(spark, sf_dir, "split_targets").select("split_name", "target_share").collect()  # one row a split
    return {r["split_name"]: float(r["target_share"]) for r in rows}


def _splits(spark, sf_dir) -> DataFrame:
    chunks, docs = table(spark, sf_dir, "chunks_v2"), table(spark, sf_dir, "extracted_documents")
    return grouped_splits.grouped_splits(chunks, "chunk_row", "document_id", docs, "document_id", "scheme_id", _targets(spark, sf_dir))


CLEAN_SCHEMES = r"""
WITH RECURSIVE f AS (
  SELECT DISTINCT nullif(regexp_replace(lower(document_id), '^\s+|\s+$', '', 'g'), '') AS d,
         nullif(regexp_replace(lower(scheme_id), '^\s+|\s+$', '', 'g'), '') AS s
  FROM extracted_documents),
e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM f a JOIN f b ON a.d = b.d AND a.s <> b.s),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""


@add("p3_found", CLEAN_SCHEMES + "SELECT a AS scheme_a, b AS scheme_b FROM r WHERE a < b")
def p3_found(spark, sf_dir):
    docs = table(spark, sf_dir, "extracted_documents")
    schemes, _ = grouped_splits.scheme_components(docs, "document_id", "scheme_id")
    a = schemes.select(F.col("scheme").alias("scheme_a"), "component")
    b = schemes.select(F.col("scheme").alias("scheme_b"), "component")
    return a.join(b, "component").where("scheme_a < scheme_b").select("scheme_a", "scheme_b")


@add("p3_components", CLEAN_SCHEMES + "SELECT s AS scheme, least(s, coalesce(min(r.b), s)) AS component FROM (SELECT DISTINCT s FROM f WHERE s IS NOT NULL AND d IS NOT NULL) LEFT JOIN r ON r.a = s GROUP BY s")
def p3_components(spark, sf_dir):
    return grouped_splits.scheme_components(table(spark, sf_dir, "extracted_documents"), "document_id", "scheme_id")[0]


@add("p3_intact", CLEAN_SCHEMES + r""", c AS (SELECT chunk_row, nullif(regexp_replace(lower(document_id), '^\s+|\s+$', '', 'g'), '') AS d FROM chunks_v2)
SELECT s AS scheme, count(DISTINCT chunk_row) AS chunks, 1 AS splits FROM c JOIN f USING (d) WHERE s IS NOT NULL GROUP BY s""")
def p3_intact(spark, sf_dir):
    """The chunks of every scheme, and in how many splits they are."""
    filed = table(spark, sf_dir, "extracted_documents").select(grouped_splits.clean_id(F.col("document_id")).alias("d"), grouped_splits.clean_id(F.col("scheme_id")).alias("scheme")).where("scheme is not null").distinct()
    chunks = table(spark, sf_dir, "chunks_v2").select(F.col("chunk_row").alias("key"), grouped_splits.clean_id(F.col("document_id")).alias("d"))
    at = chunks.join(filed, "d").join(_splits(spark, sf_dir).select("key", "split_name"), "key")
    return at.groupBy("scheme").agg(F.countDistinct("key").alias("chunks"), F.countDistinct("split_name").cast("int").alias("splits"))


@add("p3_near", "SELECT split_name, target_share, (SELECT count(*) FROM chunks_v2) AS all_records, true AS near FROM split_targets")
def p3_near(spark, sf_dir):
    """Whether each split is as near its target as the heaviest bin allows: a component is never cut."""
    splits = materialize(_splits(spark, sf_dir))
    heaviest = splits.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all_records"))
    shares = grouped_splits.split_shares(splits, _targets(spark, sf_dir)).crossJoin(F.broadcast(heaviest))  # one row
    slack = F.greatest(F.col("n") / F.col("all_records"), F.lit(0.01)) + 0.005
    return shares.select("split_name", "target_share", "all_records", (F.abs(F.col("actual_share") - F.col("target_share")) <= slack).alias("near"))


@add("p3_splits")
def p3_splits(spark, sf_dir):
    return _splits(spark, sf_dir).withColumnRenamed("key", "chunk_row")


@add("p3_shares")
def p3_shares(spark, sf_dir):
    return grouped_splits.split_shares(_splits(spark, sf_dir), _targets(spark, sf_dir))


_CANON = r"""
{k}0 AS (SELECT {key} AS key, text AS t, try_cast(text AS JSON) AS j FROM {table} WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')),
{k}1 AS (SELECT key, t, CASE WHEN regexp_matches(t, '^\s*\{{') AND json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda x: x || json_extract_string(j, '$."' || x || '"')) END AS f,
 list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '\S')) AS l FROM {k}0),
{k}2 AS (SELECT key, t, CASE WHEN f IS NOT NULL THEN f WHEN len(l) >= 2 AND len(list_filter(l, lambda s: NOT regexp_matches(s, '^\s*[A-Za-z][A-Za-z _]{{0,39}}:\s*\S'))) = 0 THEN l END AS f FROM {k}1),
{k}3 AS (SELECT key, CASE WHEN f IS NOT NULL THEN chr(10) || array_to_string(list_sort(list_transform(f, lambda s: regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', '', 'g'))), chr(10)) ELSE regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g') END AS c FROM {k}2),
{k}4 AS (SELECT key, min(key) OVER (PARTITION BY c) AS first FROM {k}3)"""
_CANONS = ",".join(_CANON.format(k=kind[0], key=key, table=name) for kind, name, key in RECORDS)


@add("p4_found", f"""WITH {_CANONS}
SELECT 'document' AS record_kind, first AS row_a, key AS row_b FROM d4 WHERE key <> first UNION ALL SELECT 'chunk', first, key FROM c4 WHERE key <> first""")
def p4_found(spark, sf_dir):
    def one(kind, name, key):
        _, members = format_duplicates.collapse_formatting(table(spark, sf_dir, name), key, "text")
        return members.where("key <> group_key").select(F.col("group_key").alias("row_a"), F.col("key").alias("row_b"))

    return _every_kind(one).select("record_kind", "row_a", "row_b")


@add("p4_collapsed", f"""WITH {_CANONS}
SELECT 'document' AS record_kind, first AS row_key, count(*) AS copies FROM d4 GROUP BY first UNION ALL SELECT 'chunk', first, count(*) FROM c4 GROUP BY first""")
def p4_collapsed(spark, sf_dir):
    def one(kind, name, key):
        groups, _ = format_duplicates.collapse_formatting(table(spark, sf_dir, name), key, "text")
        return groups.select(F.col("group_key").alias("row_key"), "copies")

    return _every_kind(one).select("record_kind", "row_key", "copies")


@add("p5_found", """
WITH item AS (
  SELECT query_id, retriever, run_id, chunk_id, max(score) AS score FROM retrieval_results
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT query_id, retriever, run_id, chunk_id FROM item
QUALIFY row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, chunk_id, run_id) <= 10
""")
def p5_found(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieval_results")
    top = top_items.top_n_per_group(rows, ["query_id", "retriever"], "score", ["chunk_id", "run_id"], 10)
    return top.select("query_id", "retriever", "run_id", "chunk_id")


def _counted(spark, sf_dir) -> DataFrame:
    return materialize(mixing.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))


def _mix(spark, sf_dir, counted: DataFrame | None = None):
    return mixing.mix_sources(counted or _counted(spark, sf_dir), table(spark, sf_dir, "source_targets"))


@add("p7_mixture")
def p7_mixture(spark, sf_dir):
    return _mix(spark, sf_dir)[0].withColumnRenamed("doc_key", "doc_id")


@add("p7_shares")
def p7_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


@add("p7_targets", r"""
WITH d AS (SELECT nullif(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '') AS source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)
SELECT t.source, t.target_share, coalesce(d.n, 0) > 0 AS has_documents, coalesce(d.n, 0) > 0 AS share_met, true AS repeats_kept FROM source_targets t LEFT JOIN d ON d.source = lower(trim(t.source))""")
def p7_targets(spark, sf_dir):
    """Whether the tokens of each source are within a thousandth of all, or within its longest document, of its target
    (of sources with documents, scaled to sum to 1), and the repeats are kept."""
    counted = _counted(spark, sf_dir)
    longest = counted.groupBy("source").agg(F.max("tokens").alias("longest"))
    shares = _mix(spark, sf_dir, counted)[1].join(longest, "source", "left")
    whole = Window.partitionBy(F.lit(1))  # a row a source
    want = F.sum("tokens").over(whole) * F.col("target_share") / F.sum(F.when(F.col("documents") > 0, F.col("target_share"))).over(whole)
    gap = F.abs(F.col("tokens") - want)
    met = (F.col("documents") > 0) & ((gap <= F.sum("tokens").over(whole) * 0.001) | (gap <= F.col("longest")))
    return shares.select("source", "target_share", (F.col("documents") > 0).alias("has_documents"), met.alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"))
