"""Queries of the problem on near-duplicates. Keys of both tables are made distinct by their last bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import near_duplicates
from rillmark.llm.queries import RECORDS, add
from rillmark.session import table


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts = [table(spark, sf_dir, name).select((F.col(key) * 2 + bit).alias("id"), F.lit(kind).alias("record_kind"), "text") for bit, (kind, name, key) in enumerate(RECORDS)]
    return near_duplicates.similar_classes(parts[0].unionByName(parts[1]), "id", "record_kind", "text")


def _kind(c: str):
    return F.when(F.col(c) % 2 == 0, RECORDS[0][0]).otherwise(RECORDS[1][0]).alias("record_kind")


def _row(c: str):
    return F.shiftright(c, 1).alias(c)


_SIDE = r"""
{k}t AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL),
{k}s AS (SELECT k, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM {k}t WHERE len(w) > 0),
{k}e AS (SELECT k, len(s) AS n, unnest(s) AS g FROM {k}s),
{k}p AS (SELECT a.k AS row_a, b.k AS row_b, a.n AS na, b.n AS nb, count(*) AS shared FROM {k}e a JOIN {k}e b ON a.g = b.g AND a.k < b.k GROUP BY ALL)"""
_PAIRS = ",".join(_SIDE.format(k=kind[0], key=key, table=name) for kind, name, key in RECORDS)


@add("p1_found", f"""WITH {_PAIRS}
SELECT 'document' AS record_kind, row_a, row_b FROM dp WHERE 5 * shared >= 4 * (na + nb - shared)
UNION ALL SELECT 'chunk', row_a, row_b FROM cp WHERE 5 * shared >= 4 * (na + nb - shared)""")
def p1_found(spark, sf_dir):
    pairs = near_duplicates.similar_pairs(*_linked(spark, sf_dir))
    return pairs.select(_kind("row_a"), _row("row_a"), _row("row_b"))


_GROUP = r"""
{k}c AS (SELECT k, min(k) OVER (PARTITION BY array_to_string(w, ' ')) AS rep, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS copies FROM {k}t WHERE len(w) > 0),
{k}l AS (SELECT row_a AS a, row_b AS b FROM {k}p JOIN {k}c x ON x.k = row_a AND x.rep = row_a JOIN {k}c y ON y.k = row_b AND y.rep = row_b WHERE 5 * shared >= 4 * (na + nb - shared)),
{k}b AS (SELECT a, b FROM {k}l UNION ALL SELECT b, a FROM {k}l),
{k}r(a, b) AS (SELECT a, b FROM {k}b UNION SELECT {k}r.a, {k}b.b FROM {k}r JOIN {k}b ON {k}b.a = {k}r.b),
{k}g AS (SELECT c.k AS key, c.rep, c.copies, coalesce((SELECT count(*) FROM {k}b WHERE a = c.rep), 0) AS links, least(c.rep, coalesce((SELECT min(b) FROM {k}r WHERE a = c.rep), c.rep)) AS group_key FROM {k}c c)"""
_GROUPS = ",".join(_GROUP.format(k=kind[0]) for kind, _, _ in RECORDS)


@add("p1_groups", f"WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT 'document' AS record_kind, * FROM dg UNION ALL SELECT 'chunk', * FROM cg")
def p1_groups(spark, sf_dir):
    rows = near_duplicates.similarity_groups(*_linked(spark, sf_dir))
    return rows.select(_kind("key"), _row("key"), _row("rep"), "copies", "links", _row("group_key"))
