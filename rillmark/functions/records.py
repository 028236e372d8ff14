"""Small Arrow helpers for what Spark expressions cannot do: recursive JSON leaves, edit similarity, section packing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.session import with_package

#: Keys whose values are no human text: a fixed list.
SKIPPED_KEYS = ("_id", "id", "schemeId", "slug", "url", "type", "children")


def _leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in SKIPPED_KEYS or isinstance(v, (dict, list)):
                yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, path)
    elif isinstance(value, str) and value.strip():
        yield path, value.strip()


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``position``, ``path``, ``leaf``: the human text of JSON texts in order, repeats left out; other texts give none."""
    rows = df.where(F.ltrim(text).startswith("{") | F.ltrim(text).startswith("[")).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                try:
                    found = list(_leaves(json.loads(t), ""))
                except (ValueError, RecursionError):
                    continue
                seen: set[str] = set()
                for path, leaf in found:
                    norm = " ".join(re.findall("[a-z0-9]+", leaf.lower()))
                    if norm not in seen:
                        seen.add(norm)
                        out.append((k, len(seen) - 1, path, leaf))
            yield pd.DataFrame(out, columns=["k", "position", "path", "leaf"])

    kind = rows.schema["k"].dataType.simpleString()
    return with_package(rows).mapInPandas(run, f"k {kind}, position int, path string, leaf string").withColumnRenamed("k", key)


def edit_similarity(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of two text columns; null if either is null."""

    with_package(pairs)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])

    return pairs.withColumn(out, ratio(left, right))


def pack_sections(df: DataFrame, key: str, text: str, heading: str, size: int = 450) -> DataFrame:
    """Paragraphs packed under their heading: ``key``, ``chunk_index``, ``heading``, ``chunk_text``.

    ``heading`` is a regular expression for heading lines. A chunk ends at a heading or where the next
    paragraph would exceed ``size`` words; a paragraph over the size is a chunk of its own. One text at a time.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    pattern = re.compile(heading)

    def pack(t: str) -> list[tuple[str | None, str]]:
        out, head, lines, n = [], None, [], 0
        for line in [*t.split("\n"), None]:
            if line is not None and not line.strip():
                continue
            words = 0 if line is None else len(line.split())
            new_head = line is not None and pattern.search(line)
            if lines and (line is None or new_head or n + words > size):
                out.append((head, "\n".join(lines)))
                lines, n = [], 0
            if new_head:
                head = line.strip()
            elif line is not None:
                lines.append(line.strip())
                n += words
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, h, c) for k, t in zip(b["k"], b["t"]) for i, (h, c) in enumerate(pack(t))]
            yield pd.DataFrame(out, columns=["k", "chunk_index", "heading", "chunk_text"])

    kind = rows.schema["k"].dataType.simpleString()
    return with_package(rows).mapInPandas(run, f"k {kind}, chunk_index int, heading string, chunk_text string").withColumnRenamed("k", key)
