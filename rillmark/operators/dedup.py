"""Exact and near duplicates of documents, corpus rules and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.edits import near_texts
from rillmark.functions.ranking import running_sum
from rillmark.functions.text import ascii_tokens, let
from rillmark.session import materialize, shuffle_partitions, with_package


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` ASCII words; a shorter text is one run, an empty one has none."""
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        many = F.when(F.size(w) >= size, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
        return F.coalesce(many, F.when(F.size(w) > 0, F.array(F.array_join(w, " "))), none)

    return F.array_distinct(let(F.coalesce(ascii_tokens(text), none), runs))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """64-bit hashes of the distinct shingles of a text; the same sets as ``shingles`` without building their strings."""
    none = F.array().cast("array<bigint>")

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        many = F.when(F.size(w) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(size)))))
        return F.coalesce(many, F.when(F.size(w) > 0, F.array(F.xxhash64(w))), none)

    tokens = F.coalesce(ascii_tokens(text), F.array().cast("array<string>"))
    return F.array_distinct(let(F.transform(tokens, lambda t: F.xxhash64(t)), runs))


def shingle_pairs(df: DataFrame, key: str, text: str, threshold: float, size: int = 5) -> DataFrame:
    """All pairs ``a`` < ``b`` of rows with a Jaccard similarity of shingles of at least ``threshold``; exact.

    Prefix filter: with shingles in one order (rare ones first), two sets of similarity t share one of
    the first ``n - ceil(t * n) + 1``; only those are joined, with the length ratio in the join. The
    shared shingles are then counted on whole sets. Frequent shingles sort last and are hardly ever
    joined, so no bucket grows with the corpus. Null and empty texts have no pairs.
    """
    sets = materialize(df.select(F.col(key).alias("k"), shingle_hashes(F.col(text), size).alias("s"))).where(F.size("s") > 0)
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("h"))
    # shingles of one text only can join nothing; they sort first, so the others' places follow from counts
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("k").orderBy("df", "h")
    shared = each.join(common, "h").withColumn("nth", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("k")))
    placed = shared.withColumn("place", F.col("n") - F.col("shared") + F.col("nth"))
    lead = materialize(placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)).select("k", "n", "h"))
    a = lead.select("h", F.col("k").alias("a"), F.col("n").alias("na"))
    b = lead.select("h", F.col("k").alias("b"), F.col("n").alias("nb"))
    alike = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9)
    pairs = a.join(b, "h").where(alike).select("a", "b").distinct()
    with_a = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    full = with_a.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    scored = full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)


#: Characters of a block of texts at most, each text with so many besides its own; a smaller table is cut into so many blocks.
BLOCK_CHARACTERS, TEXT_CHARACTERS, BLOCKS = 1 << 20, 32, 24


def edit_pairs(df: DataFrame, key: str, text: str, threshold: float, block_characters: int = BLOCK_CHARACTERS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs ``a`` < ``b`` of rows with an edit ratio of at least ``threshold``, with their ``ratio``; exact.

    Texts are cut into blocks in the order of their length, and each two blocks whose lengths allow the ratio are
    one task's work: products of matrices bound the characters that two texts have in common, and the pairs that
    pass are matched, many at once. So no pair is a row before it is judged, however many texts share their
    wording. The work is still quadratic in the texts of like length. Null and empty texts have no pairs.
    """
    texts = df.select(F.col(key).alias("k"), F.length(text).alias("n"), F.col(text).alias("t")).where("k is not null and n > 0")
    placed = materialize(running_sum(texts, ["n", "k"], (F.col("n") + TEXT_CHARACTERS).cast("long"), "upto"))
    size = min(block_characters, max(1, -(-(placed.agg(F.max("upto")).first()[0] or 0) // blocks)))
    placed = placed.withColumn("block", F.floor((F.col("upto") - 1) / F.lit(size)))
    spans = materialize(placed.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    x, y = spans.select(F.col("block").alias("x"), "high"), spans.select(F.col("block").alias("y"), "low")
    meet = x.join(y, F.expr(f"x <= y and low * {threshold!r} <= high * (2 - {threshold!r}) + 1e-6")).select("x", "y")
    first = placed.join(meet, F.col("block") == F.col("x")).select("x", "y", F.lit(0).alias("side"), "k", "t")
    second = placed.join(meet.where("x < y"), F.col("block") == F.col("y")).select("x", "y", F.lit(1).alias("side"), "k", "t")
    both = first.unionByName(second)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        yield from near_texts(rows["k"].to_numpy(), rows["t"].tolist(), rows["side"].to_numpy(), threshold)

    kind = both.schema["k"].dataType.simpleString()
    spread = with_package(both.repartition(4 * shuffle_partitions(both), "x", "y"))
    return spread.groupBy("x", "y").applyInPandas(near, f"a {kind}, b {kind}, ratio double")


def edit_candidates(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """The pairs of ``edit_pairs`` with their texts ``ta`` and ``tb``."""
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    with_a = edit_pairs(df, key, text, threshold).join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
    return with_a.join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order; rows with a null key are all kept."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in by))
    first = known.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
    return first.unionByName(df.where(" or ".join(f"`{c}` is null" for c in by)))


#: So many pairs are settled in the driver at most; more are settled in rounds on the executors.
LOCAL_PAIRS = 20_000


def greedy_keep(pairs: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Rejected nodes of a greedy first-wins pass over ``pairs`` (``a`` comes before ``b``): ``b``, ``retained``.

    A node is rejected by the first kept node it pairs with; a rejected node rejects none. Each round
    settles the nodes all of whose predecessors are settled, until no pair is left: the smallest node of
    those left is settled in any case. Once at most ``local_pairs`` are left, as along a chain, which
    takes a round for every two nodes, they are settled in their order in the driver.
    """
    first = materialize(pairs.select("a", "b").where("a < b").distinct())
    left, out = first, None
    while True:
        few = left.limit(local_pairs + 1).collect()
        if len(few) <= local_pairs:
            break
        kept = left.select(F.col("a").alias("k")).distinct().join(left.select(F.col("b").alias("k")), "k", "left_anti")
        hit = materialize(left.join(kept, F.col("a") == F.col("k"), "left_semi").select("b").distinct())
        out = hit if out is None else out.union(hit)
        gone = hit.select(F.col("b").alias("g"))
        left = left.join(kept, F.col("a") == F.col("k"), "left_anti")
        left = materialize(left.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti"))
    rejected = set()
    for a, b in sorted(few, key=lambda p: (p["b"], p["a"])):  # all pairs of a as the later node come before
        if a not in rejected:
            rejected.add(b)
    rest = first.sparkSession.createDataFrame([(b,) for b in sorted(rejected)], first.select("b").schema)
    out = materialize(rest if out is None else out.union(rest))
    of_kept = first.join(out.select(F.col("b").alias("g")), F.col("a") == F.col("g"), "left_anti")
    return of_kept.join(out, "b", "left_semi").groupBy("b").agg(F.min("a").alias("retained"))


def cascade(df: DataFrame, key: str, place: str, text: str, threshold: float) -> DataFrame:
    """Refused rows of a first-wins pass in the order of ``place`` (unique): ``rejected``, ``retained`` (keys) and ``method``.

    A row is refused by the first row of equal bytes, then by the first kept one of equal words, then by the
    first kept one with a similarity of at least ``threshold``. Minima are aggregated before each join, so
    a group of copies never meets in one task. Rows with a null text are left out.
    """
    rows = materialize(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(text).alias("text"), F.sha2(text, 256).alias("raw"), F.sha2(F.array_join(ascii_tokens(F.col(text)), " "), 256).alias("norm")))
    reports, left = [], rows
    for sha, method in (("raw", "raw_sha256"), ("norm", "normalized_sha256")):
        first = left.groupBy(sha).agg(F.min("place").alias("first"))
        joined = left.join(first, sha)
        reports.append(joined.where("place <> first").select(F.col("place").alias("b"), F.col("first").alias("a"), F.lit(method).alias("method")))
        left = materialize(joined.where("place = first").drop("first"))
    near = greedy_keep(shingle_pairs(left, "place", "text", threshold)).select("b", F.col("retained").alias("a"), F.lit("shingle_jaccard").alias("method"))
    report = reports[0].union(reports[1]).union(near)
    of = rows.select("key", "place")
    named = report.join(of.select(F.col("key").alias("rejected"), F.col("place").alias("b")), "b").join(of.select(F.col("key").alias("retained"), F.col("place").alias("a")), "a")
    return named.select("rejected", "retained", "method")
