"""Word windows over texts, built from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import split_words


def word_windows(df: DataFrame, key: str, text: str, size: int = 300, overlap: int = 60) -> DataFrame:
    """Fixed windows: ``key``, ``chunk_index``, ``start_word``, ``end_word``, ``previous_overlap``, ``chunk_text``.

    A window begins every ``size - overlap`` words and the last one is the first to reach the end. Null
    texts and texts without words give no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    words = df.select(key, split_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    last = F.greatest(F.ceil((n - size) / F.lit(float(step))).cast("int"), F.lit(0))
    at = words.select(key, "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.size("words"))
    out = at.select(key, "chunk_index", start.alias("start_word"), end.alias("end_word"), "words")
    return out.select(
        key,
        "chunk_index",
        "start_word",
        "end_word",
        F.when(F.col("chunk_index") == 0, 0).otherwise(F.least(F.lit(overlap), F.col("end_word") - F.col("start_word"))).alias("previous_overlap"),
        F.array_join(F.slice("words", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " ").alias("chunk_text"),
    )


def sentence_windows(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, reach: int = 20, least_chars: int = 50) -> DataFrame:
    """Sliding windows whose end moves on to the next sentence start within ``reach`` words.

    Windows begin every ``size - overlap`` words up to the end of the text; those under ``least_chars``
    characters are dropped and do not count in ``chunk_index``.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    words = df.select(key, split_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    at = words.select(key, "words", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).alias("start_word"))
    plain = F.col("start_word") + size
    # word i (from 0) starts a sentence if the word before it ends one; ends are looked for in a short slice
    near = F.slice("words", plain, F.lit(reach))
    ahead = F.array_position(F.transform(near, lambda w: w.rlike("[.!?]$")), True)
    moved = F.when((plain < n) & (ahead > 0) & (plain + ahead - 1 < n), plain + ahead - 1).otherwise(plain)
    out = at.withColumn("end_word", F.least(moved.cast("int"), n))
    out = out.withColumn("chunk_text", F.array_join(F.slice("words", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " "))
    kept = out.where(F.length("chunk_text") >= least_chars)
    index = F.row_number().over(Window.partitionBy(key).orderBy("start_word")) - 1
    return kept.select(key, index.alias("chunk_index"), "start_word", "end_word", "chunk_text")


def section_windows(df: DataFrame, key: str, text: str, is_heading: Column, size: int = 450, overlap: int = 60) -> DataFrame:
    """Fixed windows with the heading active where they start (the last heading line at or before the start).

    ``is_heading`` is a condition on the column ``line``. Lines keep their order; windows before any
    heading have none.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("at_word", F.coalesce(F.sum(F.size(split_words(F.col("line")))).over(before), F.lit(0)))
    heads = placed.where(is_heading).select(F.col(key).alias("__key"), "at_word", "line_no", F.trim("line").alias("heading"))
    windows = word_windows(df, key, text, size, overlap)
    active = windows.join(heads, (F.col(key) == F.col("__key")) & (F.col("at_word") <= F.col("start_word")), "left")
    return active.groupBy(key, "chunk_index", "start_word", "end_word").agg(F.max_by("heading", F.struct("at_word", "line_no")).alias("heading"))
