"""Queries on the entity graph (F16 to F21): registry, organisations, aliases, resolver, graph and ranking, each from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import text as X
from rillmark.operators import entities as E
from rillmark.operators import graph as G
from rillmark.operators import retrieval as R
from rillmark.plans.catalogue import REGISTRY
from rillmark.session import materialize, table

add = REGISTRY.add


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(E.TYPES)) + " END"
_REGISTRY = rf"""
dc AS (SELECT nullif(trim(lower(document_id)), '') AS doc, title, ministry, department, text FROM extracted_documents),
dd AS (SELECT * FROM dc WHERE doc IS NOT NULL),
pp AS (SELECT doc, unnest(regexp_extract_all(text, {_quoted(E.PAREN_PAIR)}, 1)) AS long, unnest(regexp_extract_all(text, {_quoted(E.PAREN_PAIR)}, 2)) AS short FROM dd),
pq AS (SELECT *, regexp_replace(regexp_replace(lower(short), '[^\p{{L}}\p{{N}}]', '', 'g'), 's+$', '') AS letters, string_split({_norm('long')}, ' ') AS ws FROM pp),
tk AS (SELECT DISTINCT doc, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+')) AS token FROM dd),
ca AS (SELECT 'scheme' AS kind, regexp_replace(title, {_quoted(E.PAREN_TITLE)}, '') AS label, nullif({_norm("regexp_extract(title, " + _quoted(E.PAREN_TITLE) + ")")}, '') AS alias, doc, true AS trusted, false AS audit FROM dd
 UNION ALL SELECT 'ministry', ministry, NULL, doc, true, false FROM dd UNION ALL SELECT 'department', department, NULL, doc, true, false FROM dd
 UNION ALL SELECT 'law_or_policy', unnest(regexp_extract_all(text, {_quoted(E.LAW)})), NULL, doc, false, false FROM dd
 UNION ALL SELECT 'controlled_acronym', long, {_norm('short')}, doc, false, false FROM pq WHERE len(ws) >= 2 AND letters <> '' AND regexp_matches(array_to_string(list_transform(ws, lambda w: left(w, 1)), ''), array_to_string(string_split(letters, ''), '.*'))
 UNION ALL SELECT 'controlled_acronym', token, NULL, doc, false, true FROM tk WHERE regexp_matches(token, '^[A-Z][A-Z0-9-]{{1,14}}$')),
cn AS (SELECT *, {_norm('label')} AS norm FROM (SELECT kind, trim(regexp_replace(label, '\s+', ' ', 'g')) AS label, alias, doc, trusted, audit FROM ca WHERE label IS NOT NULL) WHERE {_norm('label')} <> ''),
gr AS (SELECT kind, norm, first(label ORDER BY length(label), lower(label), label) AS label, bool_or(trusted) AS trusted, bool_and(audit) AS audit FROM cn GROUP BY ALL),
ju AS (SELECT *, CASE WHEN norm IN {_list(X.GENERIC_TERMS)} THEN 'generic_entity' WHEN regexp_matches(norm, '^[ivxlcdm]+$') THEN 'roman_numeral' WHEN length(norm) = 1 THEN 'single_character' WHEN audit THEN 'unpaired_uppercase_token'
 WHEN (string_split(norm, ' ')[1] IN {_list(E.STOPWORDS)} OR string_split(norm, ' ')[-1] IN {_list(E.STOPWORDS)}) AND NOT trusted THEN 'stopword_boundary' END AS r1 FROM gr),
jv AS (SELECT kind, norm, label, coalesce(r1, CASE WHEN {_PRIORITY} > (SELECT min({_PRIORITY.replace('kind', 'o.kind')}) FROM ju o WHERE o.norm = ju.norm AND o.r1 IS NULL) THEN 'normalization_collision' END) AS r2 FROM ju),
ap AS (SELECT DISTINCT cn.kind, cn.norm, cn.alias FROM cn JOIN jv ON jv.kind = cn.kind AND jv.norm = cn.norm AND r2 IS NULL WHERE alias <> '' AND alias <> cn.norm),
aq AS (SELECT * FROM ap QUALIFY {_PRIORITY} = min({_PRIORITY}) OVER (PARTITION BY alias)), ar AS (SELECT * FROM aq QUALIFY count(*) OVER (PARTITION BY alias) = 1),
nm AS (SELECT kind, norm, norm AS alias FROM jv WHERE r2 IS NULL UNION ALL SELECT * FROM ar),
tx AS (SELECT doc, ' ' || {_norm('text')} || ' ' AS t FROM dd WHERE text IS NOT NULL),
fq AS (SELECT kind, norm, count(DISTINCT doc) AS df FROM (SELECT kind, norm, doc FROM nm JOIN tx ON contains(t, ' ' || alias || ' ') UNION ALL SELECT cn.kind, cn.norm, doc FROM cn JOIN jv ON jv.kind = cn.kind AND jv.norm = cn.norm AND r2 IS NULL WHERE trusted) GROUP BY ALL),
en AS (SELECT jv.kind, jv.norm, label, coalesce(df, 0) AS document_frequency, coalesce(r2, CASE WHEN coalesce(df, 0) = 0 THEN 'no_corpus_occurrence' END) AS reason FROM jv LEFT JOIN fq ON fq.kind = jv.kind AND fq.norm = jv.norm),
na AS (SELECT nm.* FROM nm JOIN en ON en.kind = nm.kind AND en.norm = nm.norm AND reason IS NULL)"""

_CHUNKS = "ck AS (SELECT chunk_id AS chunk, min(nullif(trim(lower(document_id)), '')) AS doc, min(text) AS text FROM chunks_v2 WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"


def _documents(spark, d) -> DataFrame:
    docs = table(spark, d, "extracted_documents")
    return docs.select(F.nullif(F.trim(F.lower("document_id")), F.lit("")).alias("doc"), "title", "ministry", "department", "text").where("doc is not null")


def _chunks(spark, d) -> DataFrame:
    """One text for each chunk id: the smallest, where deliveries differ."""
    chunks = table(spark, d, "chunks_v2").where("chunk_id is not null")
    return chunks.groupBy(F.col("chunk_id").alias("chunk")).agg(F.min(F.nullif(F.trim(F.lower("document_id")), F.lit(""))).alias("doc"), F.min("text").alias("text"))


@add("f16_entity_registry", f"WITH {_REGISTRY} SELECT kind, norm, label, document_frequency, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM en")
def f16(spark, d):
    return E.registry(_documents(spark, d))[0]


@add("f17_organization_groups", rf"""
WITH RECURSIVE {_REGISTRY},
lb AS (SELECT DISTINCT kind, {_norm('label')} AS norm, {_norm("replace(label, '&', ' and ')")} AS key FROM (SELECT 'ministry' AS kind, ministry AS label FROM dd UNION ALL SELECT 'department', department FROM dd) WHERE label IS NOT NULL),
ke AS (SELECT lb.kind || ':' || lb.norm AS e, key, lb.kind, lb.norm FROM lb JOIN en ON en.kind = lb.kind AND en.norm = lb.norm AND reason IS NULL), ed AS (SELECT DISTINCT a.e AS a, b.e AS b FROM ke a JOIN ke b USING (key)),
rc(a, b) AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b), co AS (SELECT a, min(b) AS component FROM rc GROUP BY a)
SELECT DISTINCT ke.kind, ke.norm, component, CASE WHEN bool_or(ke.kind = 'ministry') OVER (PARTITION BY component) THEN 'ministry' ELSE 'department' END AS merged_kind FROM co JOIN ke ON ke.e = co.a""")
def f17(spark, d):
    docs = _documents(spark, d)
    return E.organisation_groups(docs, E.registry(docs)[0])


@add("f18_alias_evidence", rf"""
WITH {_REGISTRY}, {_CHUNKS}, sc AS (SELECT norm FROM na WHERE kind = 'scheme' AND alias = norm),
pr AS (SELECT trim(regexp_replace(regexp_replace(norm, '{E.SCHEME_WORDS}', ' ', 'g'), ' +', ' ', 'g')) AS alias, norm FROM sc), ps AS (SELECT * FROM pr WHERE length(alias) >= 4 AND alias <> norm),
ow AS (SELECT alias, count(DISTINCT owner) AS owners FROM (SELECT alias, norm AS owner FROM ps UNION ALL SELECT alias, norm FROM na WHERE alias IN (SELECT alias FROM ps)) GROUP BY alias),
ct AS (SELECT chunk, doc, ' ' || {_norm('text')} || ' ' AS t FROM ck WHERE text IS NOT NULL), al AS (SELECT DISTINCT alias FROM ps),
ht AS (SELECT alias, chunk, doc, (length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' ' || replace(alias, ' ', '  ') || ' ', ''))) // (length(replace(alias, ' ', '  ')) + 2) AS n FROM al JOIN ct ON contains(t, ' ' || alias || ' ')),
tl AS (SELECT alias, sum(n) AS occurrences, count(*) AS chunks FROM ht GROUP BY alias), td AS (SELECT DISTINCT doc, {_norm("regexp_replace(title, " + _quoted(E.PAREN_TITLE) + ", '')")} AS norm FROM dd WHERE title IS NOT NULL),
on_ AS (SELECT ps.alias, ps.norm, sum(n) AS own FROM ht JOIN td USING (doc) JOIN ps ON ps.alias = ht.alias AND ps.norm = td.norm GROUP BY ALL)
SELECT ps.alias, ps.norm, CAST(coalesce(occurrences, 0) AS BIGINT) AS occurrences, coalesce(chunks, 0) AS chunks, CAST(coalesce(own, 0) AS BIGINT) AS own, CASE WHEN owners > 1 THEN 'ambiguous' WHEN coalesce(own, 0) = 0 THEN 'no_corpus_evidence' ELSE 'accepted' END AS decision
FROM ps JOIN ow USING (alias) LEFT JOIN tl USING (alias) LEFT JOIN on_ ON on_.alias = ps.alias AND on_.norm = ps.norm""")
def f18(spark, d):
    docs = _documents(spark, d)
    return E.alias_evidence(docs, _chunks(spark, d), E.registry(docs)[1])


_RESOLVED = rf"""qw AS (SELECT query_id, string_split({_norm('question')}, ' ') AS w FROM qs), ls AS (SELECT *, CAST(len(string_split(alias, ' ')) AS INT) AS size FROM na),
rn AS (SELECT query_id, s.size, CAST(i - 1 AS INT) AS p, array_to_string(w[i:i + s.size - 1], ' ') AS run FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM qw), (SELECT DISTINCT size FROM ls) s WHERE i + s.size - 1 <= len(w)),
hh AS (SELECT DISTINCT query_id, {{'low': -ls.size, 'phrase': alias, 'pr': {_PRIORITY}, 'e': kind || ':' || norm, 'p': p}} AS h FROM rn JOIN ls ON alias = run AND ls.size = rn.size),
fo AS (SELECT query_id, list_reduce(list(h ORDER BY h), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.e = x.e OR (y.p < x.p - x.low AND x.p < y.p - y.low))) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(low INT, phrase VARCHAR, pr INT, e VARCHAR, p INT)[])) AS taken FROM hh GROUP BY query_id),
rs AS (SELECT query_id, x.e AS e, split_part(x.e, ':', 1) AS kind, substr(x.e, instr(x.e, ':') + 1) AS norm, x.phrase AS alias, x.p AS "at", -x.low AS size FROM (SELECT query_id, unnest(taken) AS x FROM fo))"""


#: The questions name no entity of the documents, so passages are asked instead: all of them for the resolver, every hundredth for the ranking.
_ASKED = "qs AS (SELECT chunk_row AS query_id, text AS question FROM chunks_v2 WHERE text IS NOT NULL{})"


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "chunks_v2").where("text is not null").select(F.col("chunk_row").alias("query_id"), F.col("text").alias("question"))


@add("f19_longest_match", f'WITH {_REGISTRY}, {_ASKED.format("")}, {_RESOLVED} SELECT query_id, kind, norm, alias, "at", size FROM rs')
def f19(spark, d):
    return E.resolve(_asked(spark, d), "query_id", "question", E.registry(_documents(spark, d))[1])


_GRAPH = rf"""{_CHUNKS}, ct AS (SELECT chunk, doc, ' ' || {_norm('text')} || ' ' AS t FROM ck WHERE text IS NOT NULL),
an AS (SELECT doc, min(chunk) AS chunk FROM ck WHERE doc IS NOT NULL GROUP BY doc),
mn AS (SELECT kind || ':' || norm AS e, chunk, bool_or(exact) AS exact, bool_or(trusted) AS trusted FROM (SELECT kind, norm, chunk, true AS exact, false AS trusted FROM na JOIN ct ON contains(t, ' ' || alias || ' ')
 UNION ALL SELECT cn.kind, cn.norm, an.chunk, false, true FROM cn JOIN an USING (doc) JOIN en ON en.kind = cn.kind AND en.norm = cn.norm AND reason IS NULL WHERE cn.trusted) GROUP BY ALL),
cm AS (SELECT a.e AS a, b.e AS b, count(*) AS support FROM mn a JOIN mn b ON a.chunk = b.chunk AND a.e < b.e GROUP BY ALL)"""


@add("f20_graph_audit", f"""
WITH {_REGISTRY}, {_GRAPH}, dg AS (SELECT e, count(*) AS neighbours, sum(support) AS support FROM (SELECT a AS e, support FROM cm UNION ALL SELECT b, support FROM cm) GROUP BY e)
SELECT mn.e AS entity, count(*) AS mentions, count(CASE WHEN exact THEN 1 END) AS exact_mentions, count(CASE WHEN trusted THEN 1 END) AS trusted_links, coalesce(max(neighbours), 0) AS neighbours, CAST(coalesce(max(support), 0) AS BIGINT) AS support, count(*) + coalesce(max(neighbours), 0) AS degree FROM mn LEFT JOIN dg ON dg.e = mn.e GROUP BY mn.e""")
def f20(spark, d):
    docs = _documents(spark, d)
    found = materialize(E.mentions(docs, _chunks(spark, d), E.registry(docs)[1]))
    pairs = E.co_mentions(found)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("entity"), "support").groupBy("entity").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("support").alias("support"))
    own = found.groupBy(F.concat("kind", F.lit(":"), "norm").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.sum(F.col("exact").cast("long")).alias("exact_mentions"), F.sum(F.col("trusted").cast("long")).alias("trusted_links"))
    return own.join(sides, "entity", "left").fillna(0, ["neighbours", "support"]).withColumn("degree", F.col("mentions") + F.col("neighbours"))


@add("f20_graph_edges", f"WITH {_REGISTRY}, {_GRAPH} SELECT 'MENTIONED_IN' AS edge, e AS a, chunk AS b, 1 AS support FROM mn UNION ALL SELECT 'CO_OCCURS_WITH', a, b, support FROM cm")
def f20e(spark, d):
    docs = _documents(spark, d)
    found = materialize(E.mentions(docs, _chunks(spark, d), E.registry(docs)[1]))
    mention = found.select(F.lit("MENTIONED_IN").alias("edge"), F.concat("kind", F.lit(":"), "norm").alias("a"), F.col("chunk").alias("b"), F.lit(1).cast("long").alias("support"))
    return mention.union(E.co_mentions(found).select(F.lit("CO_OCCURS_WITH").alias("edge"), "a", "b", "support"))


@add("f21_graph_weighted", f"""
WITH {_REGISTRY}, {_ASKED.format(" AND chunk_row % 100 = 0")}, {_RESOLVED}, {_GRAPH}, sd AS (SELECT query_id, e, document_frequency AS df FROM rs JOIN en ON en.kind = rs.kind AND en.norm = rs.norm), sides AS (SELECT a AS e, b AS nxt FROM cm UNION ALL SELECT b, a FROM cm),
hops AS (SELECT DISTINCT query_id, sd.e, df, chunk, 1 AS hop FROM sd JOIN mn ON mn.e = sd.e UNION ALL SELECT DISTINCT query_id, sd.e, df, mn.chunk, 2 FROM sd JOIN sides ON sides.e = sd.e JOIN mn ON mn.e = sides.nxt),
near AS (SELECT query_id, e, df, chunk, min(hop) AS hop FROM hops GROUP BY ALL),
sc AS (SELECT query_id, chunk, round(sum((ln(((SELECT count(*) FROM ck) + 1.0) / (df + 1)) + 1) * pow(0.5, hop)), 6) AS score, count(*) AS seeds FROM near GROUP BY ALL)
SELECT query_id, chunk, seeds, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM sc) WHERE rank <= 10""")
def f21(spark, d):
    docs, chunks = _documents(spark, d), materialize(_chunks(spark, d))
    entities, names = E.registry(docs)
    entity = F.concat("kind", F.lit(":"), "norm").alias("entity")
    found = materialize(E.mentions(docs, chunks, names))
    seeds = materialize(E.resolve(_asked(spark, d).where("query_id % 100 = 0"), "query_id", "question", names).select("query_id", entity))
    frequency = entities.where("status = 'accepted'").select(entity, F.col("document_frequency").alias("documents"))
    ranked = G.weighted_hop_top(seeds, found.select("chunk", entity), materialize(E.co_mentions(found)), frequency, chunks.count(), "query_id", "chunk")
    return R.top_k(ranked, "query_id", "chunk", "score", 10)
