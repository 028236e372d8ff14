"""Entity registry, organisations, aliases, alias resolution and the graph of entities and chunks, as one chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import GENERIC_TERMS, organization_key, strip, unicode_norm
from rillmark.operators.components import connected_components
from rillmark.operators.graph import longest_matches, phrase_occurrences
from rillmark.session import materialize

# Types in the order in which they win a label, words that may not begin or end one, phrase patterns.
TYPES = ("scheme", "ministry", "department", "law_or_policy", "controlled_acronym")
ORGANISATIONS = ("ministry", "department")
STOPWORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
PAREN_TITLE = r"\s*\([A-Z][A-Za-z0-9 -]{1,20}\)$"
PAREN_PAIR = r"([A-Z][A-Za-z0-9&’'/-]*(?:\s+(?:[A-Z][A-Za-z0-9&’'/-]*|of|and|the|for)){1,10})\s*\(([A-Z][A-Za-z0-9-]{1,14})\)"
LAW = r"[A-Z][A-Za-z0-9’'-]*(?:\s+(?:[A-Z][A-Za-z0-9’'-]*|of|and|the|for)){1,8}\s+(?:Act|Policy)(?:\s*,?\s*\d{4})?"
SCHEME_WORDS = r"\b(?:scheme|programme|program|mission|yojana)\b"


def priority(kind: str = "kind") -> Column:
    """Place of a type in ``TYPES``."""
    return F.array_position(F.array(*map(F.lit, TYPES)), F.col(kind))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def _acronym(long: Column, short: Column) -> Column:
    """Do the letters of ``short`` stand in the initials of ``long`` in order?"""
    words = F.split(unicode_norm(long), " ")
    initials = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    letters = F.regexp_replace(F.regexp_replace(F.lower(short), r"[^\p{L}\p{N}]", ""), "s+$", "")
    pattern = F.array_join(F.filter(F.split(letters, ""), lambda x: x != ""), ".*")
    return (F.size(words) >= 2) & (F.length(letters) > 0) & F.regexp_like(initials, pattern)


def candidates(documents: DataFrame) -> DataFrame:
    """``kind``, ``label``, ``norm``, ``alias`` (normalised, or null), ``doc``, ``trusted`` (from metadata), ``audit`` (a bare upper-case token).

    ``documents`` has doc, title, ministry, department, text; nulls give no candidate.
    """
    def fields(kind: str, label: Column, alias: Column, rows: DataFrame, trusted: bool, audit: bool = False) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), squeeze(label).alias("label"), alias.cast("string").alias("alias"), "doc", F.lit(trusted).alias("trusted"), F.lit(audit).alias("audit"))

    none = F.lit(None)
    title = F.col("title")
    short = F.nullif(unicode_norm(F.regexp_extract("title", PAREN_TITLE, 0)), F.lit(""))
    pairs = documents.select("doc", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(PAREN_PAIR), F.lit(1)).alias("long"), F.regexp_extract_all("text", F.lit(PAREN_PAIR), F.lit(2)).alias("short"))).alias("p")).select("doc", "p.*")
    laws = documents.select("doc", F.explode(F.regexp_extract_all("text", F.lit(LAW), F.lit(0))).alias("law"))
    tokens = documents.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))).alias("token")).where(F.col("token").rlike("^[A-Z][A-Z0-9-]{1,14}$"))
    parts = [
        fields("scheme", F.regexp_replace(title, PAREN_TITLE, ""), short, documents, True),
        fields("ministry", F.col("ministry"), none, documents, True),
        fields("department", F.col("department"), none, documents, True),
        fields("law_or_policy", F.col("law"), none, laws, False),
        fields("controlled_acronym", F.col("long"), unicode_norm(F.col("short")), pairs.where(_acronym(F.col("long"), F.col("short"))), False),
        fields("controlled_acronym", F.col("token"), none, tokens, False, True),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("norm", unicode_norm(F.col("label"))).where("norm <> ''")


def registry(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All entities with their decision, and the aliases of the accepted ones.

    Returns ``entities`` (``kind``, ``norm``, ``label``, ``document_frequency``, ``status``, ``reason``) and ``names`` (``kind``,
    ``norm``, ``alias``: the normal form itself and every unambiguous alias). Candidates of one type and
    normal form are one entity; refusals in order: generic_entity, roman_numeral, single_character,
    unpaired_uppercase_token, stopword_boundary, normalization_collision (a type before it has the label),
    no_corpus_occurrence. An alias of several entities stays with the one of the first type, or with none.
    The document frequency counts documents that hold a name of the entity as whole words or name it in
    their metadata.
    """
    found = materialize(candidates(documents))
    words = F.split("norm", " ")
    bounded = words[0].isin(*STOPWORDS) | F.element_at(words, -1).isin(*STOPWORDS)
    reason = (
        F.when(F.col("norm").isin(*GENERIC_TERMS), "generic_entity")
        .when(F.col("norm").rlike("^[ivxlcdm]+$"), "roman_numeral")
        .when(F.length("norm") == 1, "single_character")
        .when(F.col("audit"), "unpaired_uppercase_token")
        .when(bounded & ~F.col("trusted"), "stopword_boundary")
    )
    grouped = found.groupBy("kind", "norm").agg(F.min(F.struct(F.length("label").alias("n"), F.lower("label").alias("low"), "label")).getField("label").alias("label"), F.bool_or("trusted").alias("trusted"), F.bool_and("audit").alias("audit"))
    judged = materialize(grouped.withColumn("reason", reason))
    first = judged.where("reason is null").groupBy("norm").agg(F.min(priority()).alias("first"))
    judged = judged.join(first, "norm", "left").withColumn("reason", F.coalesce("reason", F.when(priority() > F.col("first"), "normalization_collision"))).drop("first", "audit")
    open_ = judged.where("reason is null").select("kind", "norm")
    aliases = found.where("alias <> '' and alias <> norm").select("kind", "norm", "alias").distinct().join(open_, ["kind", "norm"], "left_semi")
    owners = aliases.groupBy("alias").agg(F.min(priority()).alias("first"))
    kept = aliases.join(owners, "alias").where(priority() == F.col("first"))
    single = kept.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("alias")
    names = materialize(open_.withColumn("alias", F.col("norm")).unionByName(kept.join(single, "alias", "left_semi").select("kind", "norm", "alias")))
    texts = documents.select("doc", unicode_norm(F.col("text")).alias("text"))
    held = phrase_occurrences(texts, "doc", "text", names, "alias").select("doc", F.col("phrase").alias("alias")).distinct().join(names, "alias").select("kind", "norm", "doc")
    linked = found.where("trusted").select("kind", "norm", "doc").join(open_, ["kind", "norm"], "left_semi")
    frequency = held.union(linked).distinct().groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("document_frequency"))
    out = judged.join(frequency, ["kind", "norm"], "left").withColumn("document_frequency", F.coalesce("document_frequency", F.lit(0)))
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("document_frequency") == 0, "no_corpus_occurrence")))
    out = materialize(out.select("kind", "norm", "label", "document_frequency", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason"))
    return out, names.join(out.where("status = 'accepted'").select("kind", "norm"), ["kind", "norm"], "left_semi")


def organisation_groups(documents: DataFrame, entities: DataFrame, equivalences: DataFrame | None = None) -> DataFrame:
    """Accepted organisations that share a key (``&`` read as ``and``) or an approved equivalence, through chains: ``kind``,
    ``norm``, ``component`` (smallest ``kind:norm``) and ``merged_kind``, the first type in it.

    ``equivalences`` has ``key_a`` and ``key_b``, organisation keys that mean the same.
    """
    keep = entities.where(F.col("kind").isin(*ORGANISATIONS) & (F.col("status") == "accepted")).select("kind", "norm")
    labels = reduce(DataFrame.union, [documents.select(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ORGANISATIONS]).where("label is not null").distinct()
    keyed = labels.select("kind", unicode_norm(F.col("label")).alias("norm"), organization_key(F.col("label")).alias("key")).distinct().join(keep, ["kind", "norm"], "left_semi")
    node = F.concat("kind", F.lit(":"), "norm")
    edges = keyed.select(node.alias("src"), F.concat(F.lit("~"), "key").alias("dst"))
    if equivalences is not None:
        edges = edges.union(equivalences.select(F.concat(F.lit("~"), "key_a"), F.concat(F.lit("~"), "key_b")))
    joined = connected_components(edges)
    of = keep.join(joined, node == F.col("node")).select("kind", "norm", "component")
    strongest = of.groupBy("component").agg(F.element_at(F.array(*map(F.lit, TYPES)), F.min(priority()).cast("int")).alias("merged_kind"))
    return of.join(strongest, "component").select("kind", "norm", "component", "merged_kind")


def alias_evidence(documents: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Shorter names of schemes (without words such as yojana) judged by the chunks: ``alias``, ``norm``, ``occurrences``, ``chunks``, ``own``
    (occurrences in chunks of the scheme's documents), ``decision``.

    Decisions: ambiguous (several schemes, or a name of another entity), no_corpus_evidence (in no chunk of
    the scheme's own documents), accepted. ``chunks`` has chunk, doc and text; ``documents`` doc and title.
    """
    schemes = names.where("kind = 'scheme' and alias = norm").select("norm")
    bare = F.trim(F.regexp_replace(F.regexp_replace("norm", SCHEME_WORDS, " "), " +", " "))
    proposed = schemes.select(bare.alias("alias"), "norm").where((F.length("alias") >= 4) & (F.col("alias") != F.col("norm")))
    owned = names.select(F.col("alias"), F.col("norm").alias("owner"))
    owners = proposed.select("alias", F.col("norm").alias("owner")).union(owned.join(proposed.select("alias").distinct(), "alias", "left_semi")).distinct().groupBy("alias").agg(F.count(F.lit(1)).alias("owners"))
    texts = chunks.select("chunk", unicode_norm(F.col("text")).alias("text"))
    hits = phrase_occurrences(texts, "chunk", "text", proposed.select("alias").distinct(), "alias").groupBy("chunk", F.col("phrase").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    hits = materialize(hits.join(chunks.select("chunk", "doc"), "chunk"))
    total = hits.groupBy("alias").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("chunks"))
    titled = documents.where("title is not null").select("doc", unicode_norm(F.regexp_replace("title", PAREN_TITLE, "")).alias("norm")).distinct()
    own = hits.join(titled, "doc").join(proposed, ["alias", "norm"]).groupBy("alias", "norm").agg(F.sum("n").alias("own"))
    out = proposed.join(owners, "alias").join(total, "alias", "left").join(own, ["alias", "norm"], "left").fillna(0, ["occurrences", "chunks", "own"])
    decision = F.when(F.col("owners") > 1, "ambiguous").when(F.col("own") == 0, "no_corpus_evidence").otherwise("accepted")
    return out.select("alias", "norm", "occurrences", "chunks", "own", decision.alias("decision"))


def resolve(queries: DataFrame, query: str, text: str, names: DataFrame) -> DataFrame:
    """Names in each query, longest first, none overlapping, one for each entity: ``query``, ``kind``, ``norm``, ``alias``, ``at``, ``size``."""
    texts = queries.select(query, unicode_norm(F.col(text)).alias("text"))
    hits = phrase_occurrences(texts, query, "text", names.select("alias").distinct(), "alias").join(names.withColumnRenamed("alias", "phrase"), "phrase")
    hits = hits.withColumn("entity", F.concat("kind", F.lit(":"), "norm"))
    chosen = longest_matches(hits, query, "entity", priority())
    return chosen.select(query, F.substring_index("entity", ":", 1).alias("kind"), F.expr("substring(entity, instr(entity, ':') + 1)").alias("norm"), F.col("phrase").alias("alias"), "at", "size")


def mentions(documents: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``kind``, ``norm``, ``chunk``, ``exact``, ``trusted``: chunks that hold a name of the entity as whole words, and the first chunk
    (by id) of each document whose metadata names it."""
    texts = chunks.select("chunk", unicode_norm(F.col("text")).alias("text"))
    exact = phrase_occurrences(texts, "chunk", "text", names.select("alias").distinct(), "alias").select("chunk", F.col("phrase").alias("alias")).distinct().join(names, "alias").select("kind", "norm", "chunk", F.lit(True).alias("exact"), F.lit(False).alias("trusted"))
    anchors = chunks.groupBy("doc").agg(F.min("chunk").alias("chunk"))
    named = candidates(documents.withColumn("text", F.lit(None).cast("string"))).where("trusted").select("kind", "norm", "doc").distinct().join(names.select("kind", "norm").distinct(), ["kind", "norm"], "left_semi")
    linked = named.join(anchors, "doc").select("kind", "norm", "chunk", F.lit(False).alias("exact"), F.lit(True).alias("trusted"))
    return exact.union(linked).groupBy("kind", "norm", "chunk").agg(F.bool_or("exact").alias("exact"), F.bool_or("trusted").alias("trusted"))


def co_mentions(found: DataFrame) -> DataFrame:
    """Pairs of entities ``a`` < ``b`` (``kind:norm``) that a chunk mentions, with the number of such chunks.

    The entities of one chunk are bounded by its text; pairs are counted in each task before the shuffle.
    """
    per = found.groupBy("chunk").agg(F.sort_array(F.collect_set(F.concat("kind", F.lit(":"), "norm"))).alias("e"))
    left = per.select("e", F.posexplode("e").alias("i", "a"))
    pairs = left.select("a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))
