"""Records that are the same but for white space, case, punctuation or field order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.session import free_name, materialize, with_package

#: A line of a serialised record: label, colon, value.
FIELD_LINE = r"\A\p{IsWhite_Space}*[A-Za-z][A-Za-z _]{0,39}:(?s:.*)\P{IsWhite_Space}(?s:.*)\z"


def bare(text: Column) -> Column:
    """Letters and digits of a text in lower case, all else dropped."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical_lines(text: Column) -> Column:
    """Canonical text of ``Label: value`` lines, or null where the text is not of that form."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda s: s.rlike(r"\P{IsWhite_Space}"))
    is_record = (F.size(lines) >= 2) & F.forall(lines, lambda s: s.rlike(FIELD_LINE))
    return F.when(is_record, record_text(F.transform(lines, bare)))


def record_text(fields: Column) -> Column:
    """One text for a collection of bare fields whatever their order; line breaks part them."""
    return F.concat(F.lit("\n"), F.array_join(F.array_sort(fields), "\n"))


def _values(value: object) -> str:
    if isinstance(value, dict):
        return "".join(sorted(f"{k}{_values(v)}" for k, v in value.items()))
    if isinstance(value, list):
        return "".join(map(_values, value))
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _json_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fields = []
        for text in b["text"]:
            try:
                found = json.loads(text, object_pairs_hook=_Pairs, parse_float=str, parse_int=str)
            except (ValueError, RecursionError):
                found = None
            fields.append([f"{k}{_values(_plain(v))}" for k, v in found] if isinstance(found, _Pairs) else None)
        yield pd.DataFrame({"raw_key": b["raw_key"], "fields": fields})


class _Pairs(list):
    """The members of a JSON object, repeated labels included."""


def _plain(value: object) -> object:
    if isinstance(value, _Pairs):
        return {k: _plain(v) for k, v in value}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def collapse_formatting(df: DataFrame, key_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Groups of rows with the same canonical text, and every row's group.

    Returns ``groups`` (``group_key``: smallest key of the group, ``copies``, ``canonical_text``) and
    ``members`` (``key``, ``group_key``), which together lose no row. Byte-identical texts are first
    collapsed with their counts; only the distinct survivors are canonicalised and grouped again on
    the whole canonical text, summing the counts. Null texts and texts without a letter or digit
    belong to no group. A record's fields are compared as a collection (a repeated field counts as
    often as it stands), so a record never equals prose. Keys must be unique; other columns are ignored.
    """
    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    raw = rows.groupBy("text").agg(F.min("key").alias("raw_key"), F.count(F.lit(1)).alias("copies"))
    is_json = F.col("text").rlike(r"\A\p{IsWhite_Space}*\{(?s:.*)\}\p{IsWhite_Space}*\z")
    plain = F.coalesce(canonical_lines(F.col("text")), bare(F.col("text")))
    raw = materialize(raw.select("raw_key", "copies", F.sha2("text", 256).alias("digest"), F.when(is_json, F.col("text")).alias("text"), F.when(~is_json, plain).alias("canonical_text")))
    parsed = with_package(raw).where("text is not null").select("raw_key", "text").mapInPandas(_json_fields, "raw_key {}, fields array<string>".format(raw.schema["raw_key"].dataType.simpleString()))
    json_text = F.when(F.col("fields").isNotNull(), record_text(F.transform("fields", bare)))
    objects = raw.where("text is not null").join(parsed, "raw_key").select("raw_key", "copies", "digest", F.coalesce(json_text, canonical_lines(F.col("text")), bare(F.col("text"))).alias("canonical_text"))
    canon = raw.where("text is null").select("raw_key", "copies", "digest", "canonical_text").unionByName(objects)
    groups = materialize(
        canon.groupBy("canonical_text").agg(F.min("raw_key").alias("group_key"), F.sum("copies").alias("copies"))
    )
    group_of = canon.select(F.sha2("canonical_text", 256).alias("c"), "digest").join(groups.select(F.sha2("canonical_text", 256).alias("c"), "group_key"), "c").select("digest", "group_key")
    members = rows.select("key", F.sha2("text", 256).alias("digest")).join(group_of, "digest").select("key", "group_key")
    return groups, members


def collapsed_records(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` per group (the one of smallest key) with ``copies``; see collapse_formatting."""
    groups, _ = collapse_formatting(df, key_col, text_col)
    copies = free_name(df, "copies")[0]
    return df.join(groups.select(F.col("group_key").alias("__k"), F.col("copies").alias(copies)), F.col(key_col) == F.col("__k")).drop("__k")
