"""Mixtures of sources at target token shares, with capped repeats."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.ranking import row_number_in_groups
from rillmark.session import materialize, with_file, with_package

#: Where the public vocabulary files lie, unless a path is given.
TOKENIZER = os.environ.get("RILLMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Words, numbers, signs and blanks, as the public vocabulary was built: a fixed value.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, key_col: str, source_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """``doc_key``, ``source`` (lower case, no surrounding blanks), ``tokens`` of every row.

    The vocabulary file ``path`` lies where the driver runs and is sent to the tasks. Null and empty texts have 0 tokens; a null source stays null.
    """
    source = F.regexp_replace(F.lower(source_col), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    rows = df.select(F.col(key_col).alias("doc_key"), source.alias("source"), F.col(text_col).alias("text"))

    name = with_file(rows, path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            tokens = [len(encode(t)) if t else 0 for t in b.pop("text")]
            yield b.assign(tokens=np.array(tokens, dtype="int64"))

    key_type = rows.schema["doc_key"].dataType.simpleString()
    return with_package(rows).mapInPandas(count, f"doc_key {key_type}, source string, tokens long")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_limit: int = 1 << 16) -> np.ndarray:
    """How many documents of each token length to take so that the tokens come nearest to ``budget`` from below.

    First the even share of every length is taken, then documents one length at a time while more than
    ``dp_limit`` tokens are missing, and the remaining budget is filled by a bounded-knapsack table over
    the documents left: reachable sums as bits, with the counts of each length in powers of two.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = (counts.astype(object) * budget // total).astype("int64") if budget > 0 else np.zeros_like(counts)
    left = int(budget - (lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= dp_limit:
            break
        more = int(min(counts[i] - take[i], (left - dp_limit) // lengths[i] + 1, left // lengths[i]))
        take[i] += max(0, more)
        left -= max(0, more) * int(lengths[i])
    parts = []
    for i in np.flatnonzero((counts > take) & (lengths <= left)):
        spare, k = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while spare > 0:
            use = min(k, spare)
            parts.append((int(i), use))
            spare -= use
            k *= 2
    mask = (1 << (left + 1)) - 1
    reach, history = 1, []
    for i, use in parts:
        history.append(reach)
        reach |= (reach << (use * int(lengths[i]))) & mask
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for (i, use), had in zip(reversed(parts[: len(history)]), reversed(history)):
        if not had >> at & 1:
            take[i] += use
            at -= use * int(lengths[i])
    return take


def mix_sources(
    counted: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 42,
    dp_limit: int = 1 << 16,
) -> tuple[DataFrame, DataFrame]:
    """Draw a mixture; returns ``mixture`` (``doc_key``, ``source``, ``tokens``, ``repeats``) and ``shares``.

    ``counted`` comes from ``count_tokens``; ``targets`` has source, target_share and max_repeats (few
    rows). The targets of listed sources without tokens cannot be met: they are reported with 0 and
    the other shares are scaled up. Without ``total_tokens`` the mixture is the largest in which every
    source can hold its share within its repeats; with it, a source too small gives what it has. Of each
    source as many whole passes are taken as fit, and ``fit_lengths`` fills the rest on the counts by
    token length; which documents of a length go in is settled by a seeded hash. Unlisted and null
    sources and documents without tokens are not used. Repeated targets for one source are refused.
    """
    spark = counted.sparkSession
    want = targets.select(
        F.regexp_replace(F.lower("source"), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")
    ).toPandas()  # one row a source, given by hand
    if want["source"].duplicated().any():
        raise ValueError("a source has two targets")
    usable = counted.where("tokens > 0").join(F.broadcast(spark.createDataFrame(want[["source"]], "source string")), "source", "left_semi")
    lengths = materialize(usable.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")))
    have = {r["source"]: r["t"] for r in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("t")).collect()}
    live = want[want["source"].isin(list(have)) & (want["target_share"] > 0) & (want["max_repeats"] > 0)]
    whole = float(live["target_share"].sum())
    share = dict(zip(live["source"], live["target_share"] / whole if whole else live["target_share"]))
    repeats = dict(zip(live["source"], live["max_repeats"]))
    if total_tokens is None:
        total_tokens = int(min((have[s] * repeats[s] / share[s] for s in share), default=0))
    plan = []
    for s in share:
        budget = min(int(round(share[s] * total_tokens)), int(have[s] * repeats[s]))
        plan.append((s, budget // have[s], budget % have[s]))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, passes long, rest long"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens", ignore_index=True)
        take = fit_lengths(pdf["tokens"].to_numpy(), pdf["docs"].to_numpy(), int(pdf["rest"].iloc[0]), dp_limit)
        return pdf.assign(take=take)[["source", "tokens", "passes", "take"]]

    chosen = materialize(with_package(lengths).join(plan_df, "source").groupBy("source").applyInPandas(fit, "source string, tokens long, passes long, take long"))
    drawn = row_number_in_groups(usable.select("doc_key", "source", "tokens"), ["source", "tokens"], F.xxhash64(F.lit(seed), F.col("doc_key")), "draw")
    mixture = (
        drawn.join(chosen, ["source", "tokens"])
        .select("doc_key", "source", "tokens", (F.col("passes") + (F.col("draw") <= F.col("take")).cast("long")).alias("repeats"))
        .where("repeats > 0")
    )
    used = lengths.join(chosen, ["source", "tokens"]).groupBy("source").agg(
        F.sum(F.when(F.col("passes") > 0, F.col("docs")).otherwise(F.col("take"))).alias("documents"),
        F.sum(F.col("tokens") * (F.col("docs") * F.col("passes") + F.col("take"))).alias("tokens"),
        F.max(F.col("passes") + (F.col("take") > 0).cast("long")).alias("most_repeats"),
    )
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    shares = (
        spark.createDataFrame(want, "source string, target_share double, max_repeats long")
        .join(used, "source", "left")
        .fillna(0, ["documents", "tokens", "most_repeats"])
        .withColumn("actual_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0))
    )
    return mixture, shares
