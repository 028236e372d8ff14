"""Queries on chunking (group D), duplicates and corpus quality (group E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.functions.ranking import running_sum
from rillmark.operators import chunking, dedup
from rillmark.operators.metrics import violations
from rillmark.plans.benchmark_queries import QUESTIONS, questions
from rillmark.plans.catalogue import REGISTRY
from rillmark.session import materialize, table

add = REGISTRY.add

_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS w FROM documents WHERE text IS NOT NULL), ww AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0)"


def _fixed_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{_WORDS}, i AS (SELECT doc_id, w, n, unnest(range(0, greatest(CAST(ceil((n - {size}) * 1.0 / {step}) AS BIGINT), 0) + 1)) AS k FROM ww),
p AS (SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(k * {step} AS INT) AS start_word, CAST(least(k * {step} + {size}, n) AS INT) AS end_word, w FROM i)"""


def _fixed(name: str, size: int, overlap: int) -> None:
    sql = f"""WITH {_fixed_sql(size, overlap)} SELECT doc_id, chunk_index, start_word, end_word, CASE WHEN chunk_index = 0 THEN 0 ELSE least({overlap}, end_word - start_word) END AS previous_overlap,
 md5(array_to_string(w[start_word + 1:end_word], ' ')) AS text_md5 FROM p"""

    @add(name, sql)
    def query(spark, d):
        out = chunking.word_windows(table(spark, d, "documents"), "doc_id", "text", size, overlap)
        return out.withColumn("text_md5", F.md5("chunk_text")).drop("chunk_text")


_fixed("d02_windows_fixed", 300, 60)
_fixed("d03_windows_token", 254, 32)


def _sliding_sql(size: int, overlap: int) -> str:
    return f"""{_WORDS}, i AS (SELECT doc_id, w, n, unnest(range(0, n, {size - overlap})) AS s FROM ww),
e AS (SELECT doc_id, w, n, s, s + {size} AS plain, list_position(list_transform(w[s + {size}:s + {size} + 19], lambda x: regexp_matches(x, '[.!?]$')), true) AS ahead FROM i),
f AS (SELECT doc_id, s, least(CASE WHEN plain < n AND ahead > 0 AND plain + ahead - 1 < n THEN plain + ahead - 1 ELSE plain END, n) AS e, w FROM e),
g AS (SELECT doc_id, s, e, array_to_string(w[s + 1:e], ' ') AS t FROM f),
sliding AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, CAST(s AS INT) AS start_word, CAST(e AS INT) AS end_word, md5(t) AS text_md5 FROM g WHERE length(t) >= 50)"""


@add("d01_windows_sentence", f"WITH {_sliding_sql(512, 64)} SELECT * FROM sliding")
def d01(spark, d):
    out = chunking.sentence_windows(table(spark, d, "documents"), "doc_id", "text")
    return out.withColumn("text_md5", F.md5("chunk_text")).drop("chunk_text")


_HEAD_SQL = r"""(length(line) BETWEEN 3 AND 100 AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda s: s <> '')) <= 12 AND NOT regexp_matches(line, '[.;:,]$')
 AND ((upper(line) = line AND regexp_matches(line, '[A-Z]')) OR regexp_matches(line, '^\d+(\.\d+)*[.)]?\s+\S')
 OR (regexp_matches(line, '^(?:[A-Z][\p{L}\p{N}''-]*|(?:of|and|the|for|in|to|on|a|an))(?:\s+(?:[A-Z][\p{L}\p{N}''-]*|of|and|the|for|in|to|on|a|an))*$') AND regexp_matches(line, '^[A-Z]'))))"""


@add("d05_windows_section", rf"""
WITH w AS (SELECT ext_row AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS w FROM extracted_documents WHERE text IS NOT NULL), ww AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
i AS (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil((n - 450) * 1.0 / 390) AS BIGINT), 0) + 1)) AS k FROM ww),
p AS (SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(k * 390 AS INT) AS start_word, CAST(least(k * 390 + 450, n) AS INT) AS end_word FROM i),
l AS (SELECT ext_row AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM extracted_documents WHERE text IS NOT NULL),
q AS (SELECT *, coalesce(sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda s: s <> ''))) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word FROM l),
h AS (SELECT * FROM q WHERE {_HEAD_SQL})
SELECT p.doc_id AS ext_row, chunk_index, start_word, end_word, trim(arg_max(line, at_word * 1000000 + no)) AS heading FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.at_word <= p.start_word GROUP BY ALL""")
def d05(spark, d):
    return chunking.section_windows(table(spark, d, "extracted_documents"), "ext_row", "text", X.heading_like(F.col("line")))


@add("d07_window_grid", f"""
WITH {_WORDS}, g AS (SELECT * FROM (VALUES (256), (512), (1024)) a(size), (VALUES (0), (64), (128)) b(overlap))
SELECT CAST(size AS INT) AS size, CAST(overlap AS INT) AS overlap, CAST(sum(greatest(CAST(ceil((n - size) * 1.0 / (size - overlap)) AS BIGINT), 0) + 1) AS BIGINT) AS windows FROM ww, g GROUP BY ALL""")
def d07(spark, d):
    """Windows follow from the words of a text, which are counted once for the whole grid."""
    n = table(spark, d, "documents").select(F.size(X.split_words(F.col("text"))).alias("n")).where("n > 0")
    grid = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap")) for size in (256, 512, 1024) for overlap in (0, 64, 128)])
    windows = F.greatest(F.ceil((F.col("n") - F.col("size")) / (F.col("size") - F.col("overlap"))), F.lit(0)) + 1
    return n.select("n", F.explode(grid).alias("g")).select("n", "g.*").groupBy("size", "overlap").agg(F.sum(windows).alias("windows"))


@add("d06_crosswalk", f"""
WITH {QUESTIONS}, t AS (SELECT chunk_id, min(lower(trim(document_id))) AS doc, min(corpus_version) AS v, list_distinct(regexp_extract_all(lower(min(text)), '[a-z0-9]+')) AS w FROM chunks_v2 WHERE text IS NOT NULL AND document_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
g AS (SELECT DISTINCT q.query_id, q.chunk_id AS old_chunk, t.doc, t.w AS ow, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS aw FROM qrels q JOIN t USING (chunk_id) JOIN qs USING (query_id) WHERE q.relevance > 0),
x AS (SELECT query_id, old_chunk, t.chunk_id AS new_chunk, round(len(list_intersect(aw, t.w)) * 1.0 / greatest(len(aw), 1), 6) AS answer, round(len(list_intersect(ow, t.w)) * 1.0 / greatest(least(len(ow), len(t.w)), 1), 6) AS containment FROM g JOIN t ON t.doc = g.doc AND t.chunk_id <> old_chunk),
y AS (SELECT *, round(0.8 * answer + 0.2 * containment, 6) AS score FROM x)
SELECT query_id, old_chunk, new_chunk, answer, containment, score FROM y QUALIFY row_number() OVER (PARTITION BY query_id, old_chunk ORDER BY score DESC, answer DESC, containment DESC, new_chunk DESC) = 1""")
def d06(spark, d):
    """For each piece of gold evidence the other chunk of its document that covers the question and the old text best; no answers are at hand for these questions."""
    chunks = table(spark, d, "chunks_v2").where("text is not null and document_id is not null and chunk_id is not null").groupBy("chunk_id").agg(F.min(F.lower(F.trim("document_id"))).alias("doc"), F.min("text").alias("text"))
    t = materialize(chunks.select("chunk_id", "doc", F.array_distinct(X.ascii_tokens(F.col("text"))).alias("w")))
    asked = questions(spark, d).select("query_id", F.array_distinct(X.ascii_tokens(F.col("question"))).alias("aw"))
    gold = table(spark, d, "qrels").where("relevance > 0").select("query_id", F.col("chunk_id").alias("old_chunk")).distinct().join(t.select(F.col("chunk_id").alias("old_chunk"), "doc", F.col("w").alias("ow")), "old_chunk").join(asked, "query_id")
    x = gold.join(t.select(F.col("chunk_id").alias("new_chunk"), "doc", "w"), "doc").where("old_chunk <> new_chunk")
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    answer = F.round(F.size(F.array_intersect("aw", "w")) / at_least_one(F.size("aw")), 6)
    inside = F.round(F.size(F.array_intersect("ow", "w")) / at_least_one(F.least(F.size("ow"), F.size("w"))), 6)
    x = x.select("query_id", "old_chunk", "new_chunk", answer.alias("answer"), inside.alias("containment")).withColumn("score", F.round(0.8 * F.col("answer") + 0.2 * F.col("containment"), 6))
    best = x.groupBy("query_id", "old_chunk").agg(F.max(F.struct("score", "answer", "containment", "new_chunk")).alias("b"))
    return best.select("query_id", "old_chunk", "b.new_chunk", "b.answer", "b.containment", "b.score")


_SHINGLE_SQL = """tok AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table} WHERE text IS NOT NULL),
sh AS (SELECT k, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM tok)"""


@add("e01_shingles", f"WITH {_SHINGLE_SQL.format(key='doc_id', table='documents')} SELECT k AS doc_id, CAST(len(s) AS INT) AS shingles, md5(array_to_string(list_sort(s), '|')) AS shingles_md5 FROM sh")
def e01(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", dedup.shingles(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("shingles_md5"))


@add("e02_jaccard_of_versions", f"""
WITH {_SHINGLE_SQL.format(key='chunk_row', table='chunks_v2')}, v AS (SELECT c.chunk_row, c.chunk_id, sh.s FROM chunks_v2 c JOIN sh ON sh.k = c.chunk_row)
SELECT a.chunk_row AS row_a, b.chunk_row AS row_b, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard
FROM v a JOIN v b ON a.chunk_id = b.chunk_id AND a.chunk_row < b.chunk_row""")
def e02(spark, d):
    v = table(spark, d, "chunks_v2").where("text is not null").select("chunk_id", "chunk_row", dedup.shingles(F.col("text")).alias("s"))
    a = v.select("chunk_id", F.col("chunk_row").alias("row_a"), F.col("s").alias("sa"))
    b = v.select("chunk_id", F.col("chunk_row").alias("row_b"), F.col("s").alias("sb"))
    both, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return a.join(b, "chunk_id").where("row_a < row_b").select("row_a", "row_b", F.round(F.when(total == 0, 1.0).otherwise(both / (total - both)), 6).alias("jaccard"))


_NORM = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')"


@add("e03_dedup_exact", f"""
WITH n AS (SELECT ext_row, source_sha256, sha256({_NORM}) AS sha, length(text) AS len FROM extracted_documents WHERE text IS NOT NULL),
a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source_sha256 ORDER BY len DESC, ext_row) = 1)
SELECT ext_row FROM a QUALIFY row_number() OVER (PARTITION BY sha ORDER BY len DESC, ext_row) = 1""")
def e03(spark, d):
    docs = table(spark, d, "extracted_documents").where("text is not null")
    n = docs.select("ext_row", "source_sha256", F.sha2(X.ascii_norm(F.col("text")), 256).alias("sha"), F.length("text").alias("len"))
    order = [F.desc("len"), F.asc("ext_row")]
    return dedup.first_of(dedup.first_of(n, ["source_sha256"], order), ["sha"], order).select("ext_row")


_PAIR_SQL = _SHINGLE_SQL + """, e AS (SELECT k, len(s) AS n, unnest(s) AS h FROM sh), c AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.k < b.k GROUP BY ALL),
pairs AS (SELECT a, b, shared * 1.0 / (na + nb - shared) AS jaccard FROM c)"""


@add("e03_dedup_near", f"""
WITH RECURSIVE {_PAIR_SQL.format(key='doc_id', table='documents')}, p AS (SELECT a, b FROM pairs WHERE jaccard >= 0.95),
nodes AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT a AS n FROM p UNION SELECT b FROM p)),
step(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
 SELECT s.i + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = n.n AND list_contains(s.kept, p.a)) THEN s.kept ELSE list_append(s.kept, n.n) END FROM step s JOIN nodes n ON n.i = s.i + 1),
k AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM step ORDER BY i DESC LIMIT 1))
SELECT p.b AS rejected, min(p.a) AS retained FROM p JOIN k ON k.n = p.a WHERE p.b NOT IN (SELECT n FROM k) GROUP BY p.b""")
def e03_near(spark, d):
    pairs = dedup.shingle_pairs(table(spark, d, "documents"), "doc_id", "text", 0.95)
    return dedup.greedy_keep(pairs).select(F.col("b").alias("rejected"), "retained")


_RANKED_SOURCES = """r0 AS (SELECT doc_id, text, sha256(text) AS raw, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS norm, row_number() OVER (ORDER BY coalesce(lower(trim(source)), 'unknown') = 'legacy_scans', published_at DESC NULLS LAST, length(text) DESC, doc_id) AS place FROM documents WHERE text IS NOT NULL)"""


@add("e03_dedup_cascade", f"""
WITH RECURSIVE {_RANKED_SOURCES}, r1 AS (SELECT *, min(place) OVER (PARTITION BY raw) AS first_raw FROM r0), k1 AS (SELECT * FROM r1 WHERE place = first_raw), r2 AS (SELECT *, min(place) OVER (PARTITION BY norm) AS first_norm FROM k1), k2 AS (SELECT * FROM r2 WHERE place = first_norm),
{_SHINGLE_SQL.format(key='place', table='k2')}, e AS (SELECT k, len(s) AS n, unnest(s) AS h FROM sh), c AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.k < b.k GROUP BY ALL), p AS (SELECT a, b FROM c WHERE shared * 1.0 / (na + nb - shared) >= 0.95),
nodes AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT a AS n FROM p UNION SELECT b FROM p)),
step(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT s.i + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = n.n AND list_contains(s.kept, p.a)) THEN s.kept ELSE list_append(s.kept, n.n) END FROM step s JOIN nodes n ON n.i = s.i + 1),
k AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM step ORDER BY i DESC LIMIT 1)), near AS (SELECT p.b AS rejected, min(p.a) AS retained FROM p JOIN k ON k.n = p.a WHERE p.b NOT IN (SELECT n FROM k) GROUP BY p.b),
report AS (SELECT place AS rejected, first_raw AS retained, 'raw_sha256' AS method FROM r1 WHERE place <> first_raw UNION ALL SELECT place, first_norm, 'normalized_sha256' FROM r2 WHERE place <> first_norm UNION ALL SELECT rejected, retained, 'shingle_jaccard' FROM near)
SELECT a.doc_id AS rejected, b.doc_id AS retained, method FROM report JOIN r0 a ON a.place = rejected JOIN r0 b ON b.place = retained""")
def e03_cascade(spark, d):
    """Documents in the order of their source's rank, date, length and id; each is refused by the first kept one of equal bytes, equal words or a similarity of 0.95."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "published_at", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"))
    keyed = docs.select("doc_id", "text", (F.col("source") == "legacy_scans").alias("last"), (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(-(2**62)).cast("long"))).alias("newest"), (-F.length("text")).alias("longest"))
    places = running_sum(keyed.drop("text"), ["last", "newest", "longest", "doc_id"], F.lit(1).cast("long"), "place").select("doc_id", "place")
    return dedup.cascade(docs.select("doc_id", "text").join(places, "doc_id"), "doc_id", "place", "text", 0.95)


@add("e04_duplicate_groups", f"""
SELECT sha256({_NORM}) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def e04(spark, d):
    docs = table(spark, d, "documents").where("text is not null").groupBy(F.sha2(X.ascii_norm(F.col("text")), 256).alias("sha"))
    return docs.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@add("e05_near_pairs", f"WITH {_PAIR_SQL.format(key='doc_id', table='documents')} SELECT a AS doc_a, b AS doc_b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.85")
def e05(spark, d):
    pairs = dedup.shingle_pairs(table(spark, d, "documents"), "doc_id", "text", 0.85)
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))


@add("e06_catalog_violations", r"""
SELECT 'document_id_form' AS rule, CAST(ext_row AS VARCHAR) AS key FROM extracted_documents WHERE document_id IS NULL OR NOT regexp_full_match(document_id, '[a-z]+-[0-9]{8}')
UNION ALL SELECT 'missing_scheme', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE scheme_id IS NULL OR trim(scheme_id) = ''
UNION ALL SELECT 'duplicate_document_id', document_id FROM extracted_documents GROUP BY document_id HAVING count(*) > 1
UNION ALL SELECT 'bad_hash', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE NOT regexp_full_match(text_sha256, '[0-9a-f]{64}')
UNION ALL SELECT 'missing_title', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE title IS NULL OR trim(title) = ''
UNION ALL SELECT 'missing_ministry', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE ministry IS NULL OR trim(ministry) = ''
UNION ALL SELECT 'missing_date', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE extracted_at IS NULL
UNION ALL SELECT 'late_date', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE extracted_at > ingested_at
UNION ALL SELECT 'pages', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE page_count < 1 OR pages_extracted + empty_page_count > page_count
UNION ALL SELECT 'hash_of_text', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE text IS NOT NULL AND sha256(text) <> text_sha256
UNION ALL SELECT 'status', CAST(ext_row AS VARCHAR) FROM extracted_documents WHERE extraction_status NOT IN ('complete', 'partial') OR extraction_status IS NULL""")
def e06(spark, d):
    docs = table(spark, d, "extracted_documents")
    return violations(
        {
            "document_id_form": docs.where("document_id is null or not document_id rlike '^[a-z]+-[0-9]{8}$'").select("ext_row"),
            "missing_scheme": docs.where("scheme_id is null or trim(scheme_id) = ''").select("ext_row"),
            "duplicate_document_id": docs.groupBy("document_id").count().where("count > 1"),
            "bad_hash": docs.where("not text_sha256 rlike '^[0-9a-f]{64}$'").select("ext_row"),
            "missing_title": docs.where("title is null or trim(title) = ''").select("ext_row"),
            "missing_ministry": docs.where("ministry is null or trim(ministry) = ''").select("ext_row"),
            "missing_date": docs.where("extracted_at is null").select("ext_row"),
            "late_date": docs.where("extracted_at > ingested_at").select("ext_row"),
            "pages": docs.where("page_count < 1 or pages_extracted + empty_page_count > page_count").select("ext_row"),
            "hash_of_text": docs.where("text is not null and sha2(text, 256) <> text_sha256").select("ext_row"),
            "status": docs.where("extraction_status is null or extraction_status not in ('complete', 'partial')").select("ext_row"),
        }
    )


@add("e07_corpus_violations", r"""
SELECT 'empty_text' AS rule, CAST(chunk_row AS VARCHAR) AS key FROM chunks_v2 WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 'word_count', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE text IS NOT NULL AND word_count <> len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> ''))
UNION ALL SELECT 'orphan_chunk', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM extracted_documents WHERE document_id IS NOT NULL)
UNION ALL SELECT 'too_long', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE word_count > 300 OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) > 300
UNION ALL SELECT 'missing_metadata', CAST(chunk_row AS VARCHAR) FROM chunks_v2 WHERE source_id IS NULL OR corpus_version IS NULL OR chunker_version IS NULL
UNION ALL SELECT 'repeated_text', text_sha256 FROM chunks_v2 WHERE text_sha256 IS NOT NULL GROUP BY text_sha256 HAVING count(DISTINCT chunk_id) > 1
UNION ALL SELECT 'document_without_chunks', document_id FROM (SELECT DISTINCT document_id FROM extracted_documents WHERE document_id IS NOT NULL) WHERE document_id NOT IN (SELECT document_id FROM chunks_v2 WHERE document_id IS NOT NULL)
UNION ALL SELECT 'duplicate_chunk_id', chunk_id FROM chunks_v2 GROUP BY chunk_id HAVING count(*) > 1""")
def e07(spark, d):
    chunks, docs = table(spark, d, "chunks_v2"), table(spark, d, "extracted_documents")
    return violations(
        {
            "empty_text": chunks.where("text is null or trim(text) = ''").select("chunk_row"),
            "word_count": chunks.where(F.col("text").isNotNull() & (F.col("word_count") != F.size(X.split_words(F.col("text"))))).select("chunk_row"),
            "orphan_chunk": chunks.join(docs, "document_id", "left_anti").select("chunk_row"),
            "too_long": chunks.where((F.col("word_count") > 300) | (F.size(X.split_words(F.col("text"))) > 300)).select("chunk_row"),
            "missing_metadata": chunks.where("source_id is null or corpus_version is null or chunker_version is null").select("chunk_row"),
            "repeated_text": chunks.where("text_sha256 is not null").groupBy("text_sha256").agg(F.countDistinct("chunk_id").alias("n")).where("n > 1"),
            "document_without_chunks": docs.where("document_id is not null").select("document_id").distinct().join(chunks, "document_id", "left_anti"),
            "duplicate_chunk_id": chunks.groupBy("chunk_id").count().where("count > 1"),
        }
    )


@add("e08_clean_projection", r"""
SELECT ext_row FROM extracted_documents WHERE regexp_matches(text, '(?i)"(?:children|answer_md|process_md|schemeId|_id)"\s*:|\b(?:answer_md|process_md|benefits_md|documentsRequired_md)\b|</?[a-z][^>]*>|&(?:amp|lt|gt|quot|#\d+);')""")
def e08(spark, d):
    leaks = X.leak_counts(F.col("text"))
    return table(spark, d, "extracted_documents").where(sum(leaks.values(), F.lit(0)) > 0).select("ext_row")


@add("e09_corpus_statistics", r"""
WITH w AS (SELECT coalesce(lower(trim(source)), 'unknown') AS source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda s: s <> '')) AS n, text, doc_kind, published_at, n_chars FROM documents)
SELECT source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS words, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS pstdev, count(DISTINCT lang) AS langs,
 count(DISTINCT text) AS distinct_texts, CAST(count(text) AS BIGINT) AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars, min(length(text)) AS least_chars, max(length(text)) AS most_chars, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.95), 6) AS p95,
 count(DISTINCT doc_kind) AS kinds, count(doc_kind) AS with_kind, count(published_at) AS dated, min(published_at) AS first_date, max(published_at) AS last_date, count(CASE WHEN n = 0 THEN 1 END) AS empty, count(CASE WHEN n < 40 THEN 1 END) AS short,
 count(CASE WHEN lang = 'en' THEN 1 END) AS english, count(CASE WHEN length(text) <> n_chars THEN 1 END) AS wrong_lengths, CAST(sum(len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS sentence_ends, CAST(sum(len(regexp_extract_all(text, '\d+'))) AS BIGINT) AS numbers, count(CASE WHEN contains(text, chr(10)) THEN 1 END) AS with_lines FROM w GROUP BY source""")
def e09(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), "lang", F.size(X.split_words(F.col("text"))).cast("long").alias("n"), "text", "doc_kind", "published_at", "n_chars")
    count_if = lambda c: F.count(F.when(c, 1))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("median"),
        F.round(F.stddev_pop("n"), 6).alias("pstdev"), F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("distinct_texts"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"), F.min(F.length("text")).alias("least_chars"), F.max(F.length("text")).alias("most_chars"),
        F.round(F.percentile("n", F.lit(0.05)), 6).alias("p05"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.countDistinct("doc_kind").alias("kinds"), F.count("doc_kind").alias("with_kind"), F.count("published_at").alias("dated"),
        F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"), count_if(F.col("n") == 0).alias("empty"), count_if(F.col("n") < 40).alias("short"), count_if(F.col("lang") == "en").alias("english"), count_if(F.length("text") != F.col("n_chars")).alias("wrong_lengths"),
        F.sum(F.regexp_count("text", F.lit("[.!?]+"))).alias("sentence_ends"), F.sum(F.regexp_count("text", F.lit(r"\d+"))).alias("numbers"), count_if(F.contains("text", F.lit("\n"))).alias("with_lines"),
    )


@add("e10_release_audit", r"""
SELECT ext_row, contains(text, title) AS title_in_text, regexp_matches(text, '\b(?:19|20)\d{2}\b') AS time_sensitive,
 CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) < 200 THEN 'short' WHEN len(regexp_split_to_array(trim(text), '\s+')) > 600 THEN 'long' ELSE 'usual' END AS text_length FROM extracted_documents WHERE text IS NOT NULL""")
def e10(spark, d):
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return table(spark, d, "extracted_documents").where("text is not null").select(
        "ext_row",
        F.contains(F.col("text"), F.col("title")).alias("title_in_text"),
        F.col("text").rlike(r"\b(?:19|20)\d{2}\b").alias("time_sensitive"),
        F.when(n < 200, "short").when(n > 600, "long").otherwise("usual").alias("text_length"),
    )
