"""Queries on text normalisation and text features (group C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.plans.catalogue import REGISTRY
from rillmark.session import table

add = REGISTRY.add


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


CLEAN = r"""regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), chr(10)),
 lambda s: NOT regexp_matches(s, '^\s*page\s+\d+\s*(of\s+\d+)?\s*$|^\s*\d+\s*$|^\s*(table of contents|contents)\s*$|^\s*www\.\S+\s*$|^\s*©.*$|^\s*all rights reserved.*$', 'i')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g')"""


@add("c01_clean_text", f"SELECT doc_id, md5({CLEAN}) AS cleaned_md5 FROM documents WHERE text IS NOT NULL")
def c01(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned_md5"))


@add("c02_boilerplate_lines", r"""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\s*page\s+\d+\s*(of\s+\d+)?\s*$|^\s*\d+\s*$|^\s*(table of contents|contents)\s*$|^\s*www\.\S+\s*$|^\s*©.*$|^\s*all rights reserved.*$', 'i'))) AS INT) AS dropped_lines,
 CAST(len(string_split(text, chr(10))) AS INT) AS all_lines FROM documents WHERE text IS NOT NULL""")
def c02(spark, d):
    lines = F.split(F.col("text"), "\n")
    return _docs(spark, d).select("doc_id", F.size(F.filter(lines, lambda s: s.rlike(X.BOILERPLATE))).alias("dropped_lines"), F.size(lines).alias("all_lines"))


@add("c03_ascii_norm", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm FROM documents WHERE text IS NOT NULL")
def c03(spark, d):
    return _docs(spark, d).select("doc_id", X.ascii_norm(F.col("text")).alias("norm"))


@add("c04_unicode_norm", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL")
def c04(spark, d):
    return _docs(spark, d).select("doc_id", X.unicode_norm(F.col("text")).alias("norm"))


@add("c05_organization_key", r"""
SELECT trim(regexp_replace(lower(replace(ministry, '&', ' and ')), '[^\p{L}\p{N}]+', ' ', 'g')) AS org_key, count(*) AS n, count(DISTINCT ministry) AS spellings
FROM extracted_documents WHERE ministry IS NOT NULL GROUP BY 1""")
def c05(spark, d):
    docs = table(spark, d, "extracted_documents").where("ministry is not null")
    return docs.groupBy(X.organization_key(F.col("ministry")).alias("org_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ministry").alias("spellings"))


@add("c06_punctuation_tokens", r"""
SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+')) AS tok FROM documents) WHERE tok <> '' GROUP BY tok""")
def c06(spark, d):
    return _docs(spark, d).select(F.explode(X.punctuation_free_tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@add("c07_word_tokens", r"""
SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM documents) GROUP BY tok""")
def c07(spark, d):
    return _docs(spark, d).select(F.explode(X.word_tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@add("c08_leak_counts", r"""
SELECT ext_row, CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)"(?:children|answer_md|process_md|schemeId|_id)"\s*:')) AS INT) AS json_field,
 CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:answer_md|process_md|benefits_md|documentsRequired_md)\b')) AS INT) AS markdown_copy_field,
 CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)</?[a-z][^>]*>')) AS INT) AS html_tag,
 CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)&(?:amp|lt|gt|quot|#\d+);')) AS INT) AS escaped_markup FROM extracted_documents""")
def c08(spark, d):
    return table(spark, d, "extracted_documents").select("ext_row", *[c.alias(k) for k, c in X.leak_counts(F.col("text")).items()])


_URLS = r"SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s)>]+')) AS url FROM documents"


def _urls(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"https?://[^\s)>]+"), F.lit(0))).alias("url"))


@add("c09_canonical_url", rf"""
SELECT doc_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
 regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/+$', '') || regexp_extract(url, '(\?[^#]*)', 1) AS canonical, count(*) AS n
FROM ({_URLS}) GROUP BY ALL""")
def c09(spark, d):
    return _urls(spark, d).groupBy("doc_id", X.canonical_url(F.col("url")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@add("c10_authoritative_host", rf"""
SELECT host, count(*) AS n, CAST(sum(CASE WHEN starts_with(lower(url), 'https://') AND (host LIKE '%.gov.in' OR host LIKE '%.nic.in' OR host IN ('mygov.in', 'www.mygov.in')) THEN 1 ELSE 0 END) AS BIGINT) AS authoritative
FROM (SELECT url, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host FROM ({_URLS})) GROUP BY host""")
def c10(spark, d):
    host = F.lower(F.regexp_extract("url", r"://([^/:?#]*)", 1)).alias("host")
    return _urls(spark, d).groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(X.authoritative_host(F.col("url")).cast("long")).alias("authoritative"))


def _unescape_sql() -> str:
    t = "text"
    for _ in range(3):
        for entity, sign in X.ENTITIES:
            quoted = sign.replace("'", "''")
            t = f"replace({t}, '{entity}', '{quoted}')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace(replace({t}, '\\n', chr(10)), '[ \\t\\x{{A0}}]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, ' ?\\n ?', chr(10), 'g'), '\\A[\\s|-]+|[\\s|-]+\\z', '', 'g')"


@add("c11_unescape_strip", f"SELECT ext_row, md5({_unescape_sql()}) AS plain_md5 FROM extracted_documents WHERE text IS NOT NULL")
def c11(spark, d):
    return table(spark, d, "extracted_documents").where("text is not null").select("ext_row", F.md5(X.unescape_strip(F.col("text"))).alias("plain_md5"))


@add("c13_unique_paragraphs", r"""
WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\A\s+|\s+\z', '', 'g') AS para, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, para, array_to_string(regexp_extract_all(lower(para), '[a-z0-9]+'), ' ') AS key FROM p), f AS (SELECT * FROM k WHERE length(key) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS position, para AS paragraph FROM f""")
def c13(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.unique_paragraphs(F.col("text"))).alias("position", "paragraph"))


@add("c16_markdown_plain", r"""
SELECT ext_row, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'),
 '(?m)^[ \t]*#{1,6}[ \t]*', '', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '', 'g'), '[*`]+', '', 'g')) AS plain_md5 FROM extracted_documents WHERE text IS NOT NULL""")
def c16(spark, d):
    return table(spark, d, "extracted_documents").where("text is not null").select("ext_row", F.md5(X.markdown_plain(F.col("text"))).alias("plain_md5"))


_RATIO = r"(CASE WHEN length(regexp_replace(text, '[^\p{L}]+', '', 'g')) > 0 THEN CAST(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[^\p{L}]+', '', 'g')) ELSE 0.0 END)"


@add("c17_ascii_ratio", f"SELECT doc_id, round({_RATIO}, 6) AS ratio FROM documents WHERE text IS NOT NULL")
def c17(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.ascii_letter_ratio(F.col("text")), 6).alias("ratio"))


@add("c18_extraction_gate", f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 500000 THEN 'too_long'
 WHEN regexp_matches(lower(left(text, 100000)), '404 not found|access denied|service unavailable') THEN 'error_page' WHEN {_RATIO} < 0.6 THEN 'not_english' ELSE 'accepted' END AS reason FROM documents) GROUP BY reason""")
def c18(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce(X.extraction_gate(F.col("text")), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _tags_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{t}' END" for t, w in X.DOMAIN_KEYWORDS.items())
    return f"coalesce(nullif(concat_ws(',', {cases}), ''), 'general')"


@add("c19_enrich", rf"""
SELECT chunk_row, CAST(n AS INT) AS words, round(n / (200.0 / 60.0), 2) AS reading_time_s, {_tags_sql()} AS domain_tags, regexp_matches(text, '\d') AS has_numbers,
 CAST(len(regexp_extract_all(text, '[.!?]+')) AS INT) AS sentence_count
FROM (SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) AS DOUBLE) AS n FROM chunks_v2 WHERE text IS NOT NULL)""")
def c19(spark, d):
    words = F.size(X.split_words(F.col("text")))
    return table(spark, d, "chunks_v2").where("text is not null").select(
        "chunk_row", words.alias("words"), X.reading_time(words).alias("reading_time_s"), X.domain_tags(F.col("text")).alias("domain_tags"), F.col("text").rlike(r"\d").alias("has_numbers"), F.regexp_count(F.col("text"), F.lit("[.!?]+")).alias("sentence_count")
    )


_SENTENCES = r"""sn AS (SELECT doc_id, regexp_replace(q, '\A[ :;"''-]+|[ :;"''-]+\z', '', 'g') AS sentence, pos FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '\A\s+|\s+\z', '', 'g') AS q FROM (
 SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)) WHERE NOT regexp_matches(s, '""" + X.ARTIFACTS + """')) WHERE length(q) BETWEEN 30 AND 500)"""


@add("c20_sentences", f"WITH {_SENTENCES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS position, sentence FROM sn")
def c20(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence"))


@add("c21_usable_answer", rf"""
WITH {_SENTENCES}, l AS (SELECT doc_id, sentence, regexp_replace(lower(sentence), '\A\s+|\s+\z', '', 'g') AS low FROM sn)
SELECT doc_id, count(*) AS sentences, CAST(sum(CASE WHEN NOT contains(sentence, '?') AND NOT regexp_matches(low, '^(?:true|false|https?://|central\s+ministry|ministry\s+of|department\s+of)\b') AND len(regexp_extract_all(sentence, '\b[a-z]{{3,}}\b')) >= 5
 AND NOT regexp_matches(low, '\b(?:the|a|an|to|of|in|on|for|prescribed)\W*$') THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM l GROUP BY doc_id""")
def c21(spark, d):
    each = _docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(X.usable_answer(F.col("sentence")).cast("long")).alias("usable"))


@add("c23_initials", r"""
SELECT ministry, array_to_string(list_transform(list_filter(regexp_split_to_array(ministry, '\s+'), lambda s: s <> ''), lambda w: left(w, 1)), '') AS initials, count(*) AS n
FROM extracted_documents WHERE ministry IS NOT NULL GROUP BY ALL""")
def c23(spark, d):
    docs = table(spark, d, "extracted_documents").where("ministry is not null")
    return docs.groupBy("ministry", X.initials(F.col("ministry")).alias("initials")).agg(F.count(F.lit(1)).alias("n"))


@add("c23_acronym_match", r"""
WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS phrase, title FROM extracted_documents WHERE title IS NOT NULL),
i AS (SELECT phrase, title, string_split(phrase, ' ') AS w, array_to_string(list_transform(string_split(phrase, ' '), lambda x: left(x, 1)), '') AS ini FROM t),
k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(query_text, '\b[A-Z]{2,}\b'))) AS short FROM retrieval_runs), s AS (SELECT DISTINCT ini AS short FROM i UNION SELECT short FROM k),
m AS (SELECT short, regexp_replace(short, 's+$', '') AS bare FROM s)
SELECT i.title, m.short, (ini = short OR rtrim(ini, 's') = short OR ini || 's' = short) AS exact, true AS matches FROM i JOIN m ON len(w) >= 2 AND bare <> '' AND left(ini, 1) = left(bare, 1) AND length(short) >= 2 AND regexp_matches(ini, array_to_string(string_split(bare, ''), '.*'))""")
def c23_match(spark, d):
    """Which short forms (initials of the titles, capitals in the questions) stand for which title: initials, with or without an s, or letters of them in order."""
    t = table(spark, d, "extracted_documents").where("title is not null").select("title", X.unicode_norm(F.col("title")).alias("phrase")).distinct()
    i = t.select("title", F.split("phrase", " ").alias("w")).select("title", "w", F.array_join(F.transform("w", lambda x: F.left(x, F.lit(1))), "").alias("ini"))
    asked = table(spark, d, "retrieval_runs").select(F.explode(F.regexp_extract_all("query_text", F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))).alias("x")).select(F.lower("x").alias("short"))
    m = i.select(F.col("ini").alias("short")).union(asked).distinct().withColumn("bare", F.regexp_replace("short", "s+$", "")).where("bare <> '' and length(short) >= 2")
    pattern = F.array_join(F.filter(F.split("bare", ""), lambda x: x != ""), ".*")
    both = i.where("size(w) >= 2").withColumn("head", F.left("ini", F.lit(1))).join(m.withColumn("head", F.left("bare", F.lit(1))), "head").where(F.regexp_like("ini", pattern))
    exact = (F.col("ini") == F.col("short")) | (F.regexp_replace("ini", "s+$", "") == F.col("short")) | (F.concat("ini", F.lit("s")) == F.col("short"))
    return both.select("title", "short", exact.alias("exact"), F.lit(True).alias("matches"))


_ACRONYM = r"([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){1,10})\s*\(([A-Z][A-Z0-9-]{1,9})\)"


@add("c24_acronym_pairs", rf"""
SELECT regexp_extract(m, '{_ACRONYM}', 1) AS expansion, regexp_extract(m, '{_ACRONYM}', 2) AS acronym, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{_ACRONYM}')) AS m FROM documents) GROUP BY ALL""")
def c24(spark, d):
    m = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(_ACRONYM), F.lit(0))).alias("m"))
    return m.groupBy(F.regexp_extract("m", _ACRONYM, 1).alias("expansion"), F.regexp_extract("m", _ACRONYM, 2).alias("acronym")).agg(F.count(F.lit(1)).alias("n"))


_LAW = r"(?:[A-Z][A-Za-z]+\s+)+(?:Act|Rules|Policy|Order|Guidelines)(?:,?\s+\d{4})?"


@add("c25_law_phrases", rf"SELECT m AS phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_LAW}')) AS m FROM documents) GROUP BY m")
def c25(spark, d):
    return _docs(spark, d).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(_LAW), F.lit(0))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@add("c26_excerpt", r"""
WITH p AS (SELECT ext_row, title, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\A\s+|\s+\z', '', 'g') AS t FROM extracted_documents WHERE text IS NOT NULL AND length(title) > 0)
SELECT ext_row, substr(t, greatest(1, instr(lower(t), lower(title)) - 73), 220) AS excerpt FROM p""")
def c26(spark, d):
    """The surroundings of each document's own title in its text."""
    docs = table(spark, d, "extracted_documents").where("text is not null")
    return docs.select("ext_row", X.excerpt(F.col("text"), F.col("title")).alias("excerpt")).where("excerpt is not null")


_CAP_SQL = r"list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*'), lambda s: length(s) > 3), lambda s: lower(s)))"


@add("c27_capitalized_phrases", f"SELECT phrase, count(*) AS documents FROM (SELECT unnest({_CAP_SQL}) AS phrase FROM documents) GROUP BY phrase")
def c27(spark, d):
    return _docs(spark, d).select(F.explode(X.capitalized_phrases(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("documents"))


def category_sql(question: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({question}, '{p}') THEN '{n}'" for n, p in X.CATEGORY_RULES) + " ELSE 'unknown' END"


@add("c30_query_category", f"SELECT run_id, ingested_at, {category_sql('query_text')} AS category FROM retrieval_runs WHERE query_text IS NOT NULL")
def c30(spark, d):
    runs = table(spark, d, "retrieval_runs").where("query_text is not null")
    return runs.select("run_id", "ingested_at", X.category(F.col("query_text")).alias("category"))


@add("c31_router_features", rf"""
SELECT run_id, ingested_at, {category_sql('query_text')} AS category, regexp_matches(query_text, '\b[A-Z]{{2,}}\b') AS has_acronym,
 CASE WHEN n <= 8 THEN 'short' WHEN n <= 15 THEN 'medium' ELSE 'long' END AS length_bucket
FROM (SELECT *, len(list_filter(regexp_split_to_array(query_text, '\s+'), lambda s: s <> '')) AS n FROM retrieval_runs WHERE query_text IS NOT NULL)""")
def c31(spark, d):
    n = F.size(X.split_words(F.col("query_text")))
    bucket = F.when(n <= 8, "short").when(n <= 15, "medium").otherwise("long")
    runs = table(spark, d, "retrieval_runs").where("query_text is not null")
    return runs.select("run_id", "ingested_at", X.category(F.col("query_text")).alias("category"), F.col("query_text").rlike(r"\b[A-Z]{2,}\b").alias("has_acronym"), bucket.alias("length_bucket"))


@add("c33_scheme_aliases", r"""
WITH t AS (SELECT DISTINCT title, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS scheme FROM extracted_documents WHERE title IS NOT NULL),
a AS (SELECT scheme, scheme AS alias FROM t UNION SELECT scheme, b FROM (SELECT scheme, trim(regexp_replace(regexp_replace(scheme, '\b(?:scheme|programme|program|mission|yojana)\b', ' ', 'g'), ' +', ' ', 'g')) AS b FROM t) WHERE length(b) >= 4
 UNION SELECT scheme, lower(unnest(regexp_extract_all(title, '\(([A-Z][A-Z0-9-]{1,9})\)', 1))) FROM t
 UNION SELECT scheme, i FROM (SELECT scheme, array_to_string(list_transform(list_filter(string_split(scheme, ' '), lambda w: w NOT IN ('of', 'the', 'and', 'for')), lambda w: left(w, 1)), '') AS i FROM t) WHERE length(i) BETWEEN 2 AND 10)
SELECT scheme, alias FROM a WHERE length(alias) >= 2""")
def c33(spark, d):
    """Full title, title without its kind, acronym in brackets, initials without small words."""
    t = table(spark, d, "extracted_documents").where("title is not null").select("title", X.unicode_norm(F.col("title")).alias("scheme")).distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace("scheme", r"\b(?:scheme|programme|program|mission|yojana)\b", " "), " +", " "))
    initials = F.array_join(F.transform(F.filter(F.split("scheme", " "), lambda w: ~w.isin("of", "the", "and", "for")), lambda w: F.left(w, F.lit(1))), "")
    short = F.transform(F.regexp_extract_all("title", F.lit(r"\(([A-Z][A-Z0-9-]{1,9})\)"), F.lit(1)), F.lower)
    own = F.array(F.col("scheme"), F.when(F.length(bare) >= 4, bare), F.when(F.length(initials).between(2, 10), initials))
    return t.select("scheme", F.explode(F.array_union(own, short)).alias("alias")).where(F.length("alias") >= 2).distinct()


_CONTROL = r"[\p{Cf}\p{Co}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@add("c34_noise_flags", rf"""
WITH n AS (SELECT chunk_row, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm, text FROM chunks_v2 WHERE text IS NOT NULL)
SELECT chunk_row, len(regexp_split_to_array(trim(text), '\s+')) < 40 AS is_short,
 CAST(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS DOUBLE) / greatest(length(text), 1) < 0.55 AS low_alpha, CAST(length(regexp_replace(text, '{_CONTROL}', '', 'g')) AS DOUBLE) / greatest(length(text), 1) < 0.98 AS unprintable,
 count(*) OVER (PARTITION BY left(norm, 240)) >= 3 AS repeated_prefix FROM n""")
def c34(spark, d):
    n = table(spark, d, "chunks_v2").where("text is not null").select("chunk_row", F.left(X.ascii_norm(F.col("text")), F.lit(240)).alias("prefix"), "text")
    often = n.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"))  # counted before the join: a prefix may be very frequent
    share = lambda pattern: F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.length("text"), F.lit(1))
    flags = n.select("chunk_row", "prefix", (F.size(F.split(F.trim("text"), r"\s+")) < 40).alias("is_short"), (share(r"[^\p{L}]+") < 0.55).alias("low_alpha"), (share(_CONTROL) < 0.98).alias("unprintable"))
    return flags.join(often, "prefix").select("chunk_row", "is_short", "low_alpha", "unprintable", (F.col("rows") >= 3).alias("repeated_prefix"))


@add("c35_headings", r"""
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM extracted_documents)
WHERE length(line) BETWEEN 3 AND 100 AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda s: s <> '')) <= 12 AND NOT regexp_matches(line, '[.;:,]$')
 AND ((upper(line) = line AND regexp_matches(line, '[A-Z]')) OR regexp_matches(line, '^\d+(\.\d+)*[.)]?\s+\S')
 OR (regexp_matches(line, '^(?:[A-Z][\p{L}\p{N}''-]*|(?:of|and|the|for|in|to|on|a|an))(?:\s+(?:[A-Z][\p{L}\p{N}''-]*|of|and|the|for|in|to|on|a|an))*$') AND regexp_matches(line, '^[A-Z]')))
GROUP BY line""")
def c35(spark, d):
    lines = table(spark, d, "extracted_documents").where("text is not null").select(F.explode(F.split(F.col("text"), "\n")).alias("line"))
    return lines.where(X.heading_like(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@add("c37_hashes", """
SELECT ext_row, sha256(text) AS sha256_text, md5(text) AS md5_text, sha256(text) = text_sha256 AS hash_matches, 'doc_' || left(sha256(text), 12) AS short_id FROM extracted_documents WHERE text IS NOT NULL""")
def c37(spark, d):
    sha = F.sha2("text", 256)
    docs = table(spark, d, "extracted_documents").where("text is not null")
    return docs.select("ext_row", sha.alias("sha256_text"), F.md5("text").alias("md5_text"), (sha == F.col("text_sha256")).alias("hash_matches"), F.concat(F.lit("doc_"), F.left(sha, F.lit(12))).alias("short_id"))


@add("c38_phrase_occurrences", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM t)
SELECT doc_id, CAST(pos AS INT) AS token_start, CAST(pos + 2 AS INT) AS token_end FROM w WHERE tok = 'gram' AND nxt = 'sabha'""")
def c38(spark, d):
    toks = _docs(spark, d).select("doc_id", X.word_tokens(F.col("text")).alias("toks"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("toks") - 1, F.lit(1))), lambda i: (F.try_element_at("toks", i) == "gram") & (F.try_element_at("toks", i + 1) == "sabha"))
    return toks.select("doc_id", F.explode(at).alias("token_start")).select("doc_id", "token_start", (F.col("token_start") + 2).alias("token_end"))
