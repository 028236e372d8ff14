"""Near-duplicate texts: banded MinHash candidates, sifted by odd sketches, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.words import WordHashes, grams, mix, words
from rillmark.operators.components import connected_components
from rillmark.session import materialize, with_package


@dataclass(frozen=True)
class Sketching:
    """Parameters. A pair of similarity ``s`` shares no band with probability ``(1 - s**rows)**bands``
    (4e-7 at 0.8 with the defaults), and less for any closer pair."""

    similarity: float = 0.8
    shingle: int = 5
    bands: int = 28
    rows: int = 4
    bits: int = 256
    deviations: float = 5.2

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_differing_bits(self) -> int:
        """Popcount of two sketches' XOR that a pair at ``similarity`` exceeds with about 1e-7.

        Each differing MinHash sample flips two bits; ``d`` flips leave bits/2 * (1 - exp(-2d/bits)) set.
        """
        n, k, s = self.bits, self.samples, self.similarity
        flips = 2 * k * (1 - s)
        mean = n / 2 * (1 - math.exp(-2 * flips / n))
        by_samples = 2 * math.exp(-2 * flips / n) * math.sqrt(k * s * (1 - s))
        by_places = math.sqrt(max(n / 4 * (1 - math.exp(-4 * flips / n)), 1.0))
        return min(n, math.ceil(mean + self.deviations * math.hypot(by_samples, by_places)))


def signatures(df: DataFrame, key_col: str, scope_col: str, text_col: str, p: Sketching) -> DataFrame:
    """``key``, ``class`` (of equal word sequences within a scope), ``bands`` and odd ``sketch`` of each text with a word."""
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.col(scope_col).alias("scope"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    rng = np.random.default_rng(7)
    times = (rng.integers(0, 1 << 31, p.samples, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, p.samples, dtype=np.uint64).astype(np.uint32)
    salt = mix(np.arange(1, p.samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_of = WordHashes()
        for b in batches:
            least = np.empty((len(b), p.samples), dtype=np.uint32)
            classes, keep = [], np.zeros(len(b), dtype=bool)
            scopes = np.array([xxhash.xxh3_64_intdigest(s or "") for s in b["scope"]], dtype=np.uint64)
            for i, text in enumerate(b["text"]):
                h = hash_of.of(text)
                if not len(h):
                    continue
                keep[i] = True
                classes.append(xxhash.xxh3_128_digest(h.tobytes() + scopes[i].tobytes()))
                g = grams(h, min(p.shingle, len(h))).astype(np.uint32)
                for j in range(0, p.samples, 16):  # small blocks stay in the CPU's cache
                    least[i, j : j + 16] = ((g[None, :] ^ flip[j : j + 16, None]) * times[j : j + 16, None]).min(axis=1)
            least, scopes = least[keep].astype(np.uint64), scopes[keep]
            n = len(least)
            sampled = mix(least + salt)
            band = np.zeros((n, p.bands), dtype=np.uint64)
            for r in range(p.rows):
                band = mix(band + sampled[:, r :: p.rows]) + np.uint64(1)
            band = mix(band + scopes[:, None])
            parity = np.zeros((n, p.bits), dtype=np.uint8)
            np.add.at(parity, (np.arange(n)[:, None], (sampled >> np.uint64(17)) % np.uint64(p.bits)), 1)
            sketch = np.packbits(parity & 1, axis=1).view(np.int64)
            yield pd.DataFrame({"key": b["key"][keep].to_numpy(), "class": classes, "bands": list(band.view(np.int64)), "sketch": list(sketch)})

    return with_package(rows).mapInPandas(run, "key long, class binary, bands array<long>, sketch array<long>")


def _differing(a: Column, b: Column, longs: int) -> Column:
    total = F.lit(0)
    for i in range(longs):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


#: Most candidate keys that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def similar_classes(df: DataFrame, key_col: str, scope_col: str, text_col: str, p: Sketching = Sketching()) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts, and every row's class.

    Returns ``links`` (``a`` < ``b``, ``similarity``) between the representatives (smallest key) of
    different classes in one scope whose shingle sets have a Jaccard similarity of at least
    ``p.similarity``, and ``members`` (``key``, ``rep``) with every text that has a word. Rows of one
    word sequence are collapsed before banding, so copies never meet in a bucket. Within a bucket only
    pairs whose odd sketches are close are emitted; these are compared on their whole shingle sets.
    A text of fewer words than a shingle is one shingle. Null texts and texts without a word have no
    class. Keys must be unique BIGINTs; other columns are ignored; an empty table gives empty results.
    """
    signed = materialize(signatures(df, key_col, scope_col, text_col, p))
    reps = materialize(signed.groupBy("class").agg(F.min("key").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    members = signed.select("key", "class").join(reps.select("class", "rep"), "class").select("key", "rep")
    buckets = reps.select("rep", "sketch", F.explode("bands").alias("bucket"))
    a = buckets.select("bucket", F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    b = buckets.select("bucket", F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    near = (F.col("a") < F.col("b")) & (_differing(F.col("sketch_a"), F.col("sketch_b"), p.bits // 64) <= p.most_differing_bits)
    pairs = materialize(a.join(b, "bucket").where(near).select("a", "b").distinct())
    keys = materialize(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
    few = keys.count() <= BROADCAST_KEYS
    texts = df.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(F.broadcast(keys) if few else keys, "k", "left_semi")
    texts = materialize(texts)
    with_b = pairs.join(texts.select(F.col("k").alias("b"), F.col("t").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("k").alias("a"), F.col("t").alias("text_a")), "a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, frozenset()
        for batch in batches:
            sims = []
            for x, tx, ty in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if x != last:
                    last, of_last = x, shingle_set(tx, p.shingle)
                other = shingle_set(ty, p.shingle)
                both = len(of_last & other)
                sims.append(both / (len(of_last) + len(other) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": sims})

    found = with_package(with_both).mapInPandas(verify, "a long, b long, similarity double")
    # both / union >= s in whole numbers would be exact; the smallest slack covers the division
    return materialize(found.where(F.col("similarity") >= p.similarity - 1e-12)), members


def shingle_set(text: str, size: int) -> frozenset:
    """The distinct runs of ``size`` words (of all words, if there are fewer)."""
    w = words(text)
    k = min(size, len(w))
    return frozenset(zip(*(w[i:] for i in range(k))))


def similar_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows ``row_a`` < ``row_b``: of linked classes, and of equal texts within a class."""
    a = members.select(F.col("rep").alias("a"), F.col("key").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("key").alias("y"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("row_a"), F.col("y").alias("row_b"))
    return across.union(within)


def similarity_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per text: ``key``, its exact class ``rep``, ``copies`` of it, its ``links`` to other classes, and the
    ``group_key`` of everything linked to it directly or through a chain."""
    ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group_key"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    known = copies.join(ends, "rep", "left").join(groups, "rep", "left")
    return members.join(known, "rep").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_key", "rep").alias("group_key"))
