"""Evaluation passages inside a training corpus, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.words import WordHashes, grams
from rillmark.session import materialize, with_package

#: Most bits of the filter of test fingerprints that goes to every task (32 MB); 16 bits each as long as they suffice.
MOST_BITS = 1 << 28


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of every window of ``window`` hashes (of all, if fewer)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    m = n - window + 1
    best, at = hashes[:m].copy(), np.arange(m)
    for i in range(1, window):
        nearer = hashes[i : i + m] <= best
        best = np.where(nearer, hashes[i : i + m], best)
        at = np.where(nearer, np.arange(i, i + m), at)
    return np.unique(at)


def fingerprint_filter(prints: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the column ``fingerprint`` with two probes, its words put together by the tasks."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * count).bit_length()))
    probes = prints.select("fingerprint").distinct().select(F.explode(F.expr(f"array(fingerprint & {bits - 1}L, shiftrightunsigned(fingerprint, 32) & {bits - 1}L)")).alias("p"))
    masks = probes.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("mask"))
    words = np.zeros(bits // 64, dtype=np.int64)
    for r in masks.toLocalIterator():  # at most bits / 64 rows
        words[r["word"]] = r["mask"]
    return words.view(np.uint64)


def _may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low, one = np.uint64(len(words) * 64 - 1), np.uint64(1)
    out = np.ones(len(hashes), dtype=bool)
    for p in (hashes & low, (hashes >> np.uint64(32)) & low):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & one).astype(bool)
    return out


def fingerprints(df: DataFrame, key_cols: list[str], text_col: str, span: int, gram: int, only: np.ndarray | None = None) -> DataFrame:
    """Winnowed fingerprints of each text, with their place ``at`` (words before) and the word hashes around them.

    Any run of ``span`` words holds a whole window of ``span - gram + 1`` runs of ``gram`` words, so two
    texts that share the run share a selected fingerprint. ``before`` and ``after`` are the hashes of the
    ``span - gram`` words on either side (before: nearest first), enough to see whether the run reaches
    ``span`` words, and to meet the next fingerprint of a longer one. Fingerprints that the filter ``only``
    does not hold are left out. Texts of fewer than ``span`` words, null and empty texts have none.
    """
    reach = span - gram
    rows = df.select(*key_cols, F.col(text_col).alias("__text"))
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key_cols)
    known = only if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_of = WordHashes()
        for b in batches:
            at, places, prints, before, after, middle = [], [], [], [], [], []
            for i, text in enumerate(b["__text"]):
                h = hash_of.of(text)
                if len(h) < span:
                    continue
                g = grams(h, gram)
                where = winnow(g, reach + 1)
                if known is not None and len(where):
                    where = where[_may_hold(known.value, g[where])]
                for p in where:
                    at.append(i)
                    places.append(p)
                    prints.append(g[p].astype(np.int64))
                    before.append(h[max(0, p - reach) : p][::-1].astype(np.int64))
                    middle.append(h[p : p + gram].astype(np.int64))
                    after.append(h[p + gram : p + gram + reach].astype(np.int64))
            out = b[key_cols].iloc[at].reset_index(drop=True)
            around = {c: pd.Series(v, dtype=object) for c, v in (("before", before), ("middle", middle), ("after", after))}
            yield out.assign(at=np.array(places, dtype=np.int32), fingerprint=np.array(prints, dtype=np.int64), **around)

    return with_package(rows).mapInPandas(run, f"{keys}, at int, fingerprint long, before array<long>, middle array<long>, after array<long>")


def _alike(a: Column, b: Column) -> Column:
    """Length of the longest common beginning of two short arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(first == 0, F.size(a)).otherwise(first - 1)


_AROUND = ["fingerprint", "before", "middle", "after"]


def _hits(corpus: DataFrame, doc_col: str, text_col: str, passages: DataFrame, keys: list[str], passage_col: str, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Places of the corpus that agree with a surrounding of a test fingerprint: ``__doc``, ``at``, ``place``, ``left``, ``right``
    (words that agree on either side); and the members of each surrounding: ``place``, ``keys``, ``item_at``.

    Equal surroundings of test passages are one row, so a quote that many items share is compared once. The
    scan of the corpus drops what the filter of test fingerprints does not hold, whatever their number;
    only the rest is joined, with the join that Spark chooses by the size of the written table.
    """
    test = materialize(fingerprints(passages, keys, passage_col, span, gram))
    places = materialize(test.select(*_AROUND).distinct().withColumn("place", F.monotonically_increasing_id()))
    members = test.join(places, _AROUND).select("place", *keys, F.col("at").alias("item_at"))
    train = fingerprints(corpus.withColumnRenamed(doc_col, "__doc").select("__doc", text_col), ["__doc"], text_col, span, gram, fingerprint_filter(places, places.count()))
    t = places.select("place", *[F.col(c).alias(f"__{c}") for c in _AROUND])
    near = train.join(t, (F.col("fingerprint") == F.col("__fingerprint")) & (F.col("middle") == F.col("__middle")))
    return near.select("__doc", "at", "place", _alike(F.col("before"), F.col("__before")).alias("left"), _alike(F.col("after"), F.col("__after")).alias("right")), members


def leaked_items(corpus: DataFrame, doc_col: str, text_col: str, passages: DataFrame, item_col: str, passage_col: str, span: int = 12, gram: int = 6) -> DataFrame:
    """Every ``(doc, item)`` such that ``span`` consecutive words of a passage of the item stand in the text.

    Words are runs of letters or digits in lower case. Fingerprints of both sides are joined and each hit
    is extended over the neighbouring words to ``span``; as each shared run of that length has a common
    fingerprint, none is missed. Null and short texts never leak; repeated rows give one row; an empty side
    gives an empty result; other columns are ignored.
    """
    renamed = passages.select(F.col(item_col).alias("__item"), F.col(passage_col).alias("__passage"))
    hits, members = _hits(corpus, doc_col, text_col, renamed, ["__item"], "__passage", span, gram)
    found = hits.where(F.col("left") + gram + F.col("right") >= span).select("__doc", "place").distinct()
    return found.join(members, "place").select(F.col("__doc").alias(doc_col), F.col("__item").alias(item_col)).distinct()


def leaked_spans(corpus: DataFrame, doc_col: str, text_col: str, passages: DataFrame, item_col: str, number_col: str, passage_col: str, span: int = 12, gram: int = 6) -> DataFrame:
    """The longest shared runs of at least ``span`` words: ``doc_col``, ``item_col``, ``number_col`` (which passage of the
    item), ``start_word`` (from 0, in the text), ``passage_word`` (from 0, in the passage) and ``words``.

    The agreeing surroundings of hits that lie on one shift between text and passage are joined where they
    meet: neighbouring fingerprints of a shared run are no further apart than the surroundings reach, so
    the joined run is the whole shared run. Keys of the corpus must be unique.
    """
    renamed = passages.select(F.col(item_col).alias("__item"), F.col(number_col).alias("__number"), F.col(passage_col).alias("__passage"))
    hits, members = _hits(corpus, doc_col, text_col, renamed, ["__item", "__number"], "__passage", span, gram)
    run = hits.join(members, "place").select("__doc", "__item", "__number", (F.col("at") - F.col("item_at")).alias("shift"), (F.col("at") - F.col("left")).alias("first"), (F.col("at") + gram + F.col("right")).alias("last")).distinct()
    line = Window.partitionBy("__doc", "__item", "__number", "shift").orderBy("first", "last")
    reached = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumn("part", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int")).withColumn("part", F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = run.groupBy("__doc", "__item", "__number", "shift", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("last") - F.col("first") >= span)
    return whole.select(
        F.col("__doc").alias(doc_col), F.col("__item").alias(item_col), F.col("__number").alias(number_col), F.col("first").alias("start_word"), (F.col("first") - F.col("shift")).alias("passage_word"), (F.col("last") - F.col("first")).alias("words")
    )
