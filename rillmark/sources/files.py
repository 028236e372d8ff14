"""Readers and writers: raw files, JSON lines, judgments, runs and metric tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.text import strip
from rillmark.session import with_package

#: Parts of a page that hold no text: a fixed list.
HIDDEN_TAGS = ("script", "style", "nav", "footer", "header")


def title_of(path: Column) -> Column:
    """Title from a file name: stem, dashes and underscores as blanks, in title case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " ")))


def html_text(html: Column) -> Column:
    """Visible text of a page, one line per element; hidden parts dropped."""
    t = html
    for tag in HIDDEN_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<title\b.*?</title\s*>", " "), r"<[^>]+>", "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def _docx(content: bytes) -> str:
    """Non-blank paragraphs of a word-processor file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(x for x in lines if x.strip())


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder tree, and the files that could not be read.

    Returns ``documents`` (doc_id from the hash of the bytes, source_path, source_type, title, raw_text,
    byte_size, sha256) and ``rejected`` (source_path, reason). Text, markdown, HTML, JSON and JSON lines are
    decoded by Spark; word-processor files by a small reader in Arrow batches; PDF is refused, as no reader
    is at hand. A bad file never fails the job.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    base = raw.select(F.col("path").alias("source_path"), ext.alias("source_type"), "content", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, reasons = [], []
            for c in b["content"]:
                try:
                    texts.append(_docx(bytes(c)))
                    reasons.append(None)
                except Exception as error:  # a reject row, not a failure
                    texts.append(None)
                    reasons.append(type(error).__name__)
            yield b.drop(columns="content").assign(raw_text=texts, reason=reasons)

    plain = base.where(F.col("source_type").isin("txt", "md", "html", "htm", "json", "jsonl"))
    decoded = F.decode(F.col("content"), "UTF-8")
    text = F.when(F.col("source_type").isin("html", "htm"), html_text(decoded)).otherwise(decoded)
    plain = plain.select("source_path", "source_type", "byte_size", "sha256", text.alias("raw_text"), F.lit(None).cast("string").alias("reason"))
    word = base.where("source_type = 'docx'").select("source_path", "source_type", "byte_size", "sha256", "content")
    word = with_package(word).mapInPandas(parse, "source_path string, source_type string, byte_size long, sha256 string, raw_text string, reason string")
    other = base.where(~F.col("source_type").isin("txt", "md", "html", "htm", "json", "jsonl", "docx")).select("source_path", "source_type", "byte_size", "sha256", F.lit(None).cast("string").alias("raw_text"), F.lit("unsupported").alias("reason"))
    everything = plain.unionByName(word).unionByName(other)
    documents = everything.where("reason is null").select(
        F.concat(F.lit("doc_"), F.left("sha256", F.lit(12))).alias("doc_id"), "source_path", "source_type", title_of(F.col("source_path")).alias("title"), "raw_text", "byte_size", "sha256"
    )
    return documents, everything.where("reason is not null").select("source_path", "reason")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a given schema; strict reading fails on a malformed line and on an empty file."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if strict and df.isEmpty():
        raise ValueError("no record")
    return df


def write_unique(df: DataFrame, key: str, path: str) -> None:
    """Parquet sorted by key within ranges; a repeated key is refused before anything is written."""
    repeated = df.groupBy(key).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"repeated keys: {[r[0] for r in repeated]}")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


QRELS = "query_id string, iteration_tag string, chunk_id string, relevance string"


def write_qrels(df: DataFrame, path: str) -> None:
    """Tab-separated judgments in the four-column form."""
    df.select("query_id", F.coalesce("iteration_tag", F.lit("0")).alias("iteration_tag"), "chunk_id", "relevance").write.mode("errorifexists").option("sep", "\t").csv(path)


def read_qrels(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Four-column judgments. Bad rows are skipped; strict reading refuses them, and repeated pairs."""
    raw = spark.read.schema(QRELS).option("sep", "\t").csv(path).where("query_id is not null and query_id <> 'query_id'")
    ok = F.col("relevance").rlike(r"^\s*-?\d+\s*$") & F.col("chunk_id").isNotNull()
    if strict:
        if not raw.where(~F.coalesce(ok, F.lit(False))).isEmpty():
            raise ValueError("a judgment is malformed")
        if not raw.groupBy("query_id", "chunk_id").count().where("count > 1").isEmpty():
            raise ValueError("a pair is judged twice")
    return raw.where(ok).withColumn("relevance", F.trim("relevance").cast("int"))


def write_runs(ranked: DataFrame, path: str, depth: int | None = None, block: int = 1000) -> None:
    """JSON objects of a ranked list with its results nested in rank order, all of them unless ``depth`` is given.

    A list of more than ``block`` results is written as several objects, so that no row grows without bound.
    """
    kept = ranked if depth is None else ranked.where(F.col("rank") <= depth)
    part = F.floor((F.col("rank") - 1) / F.lit(block)).alias("part")
    item = F.struct("rank", "chunk_id", "score")
    lists = kept.groupBy("run_id", "query_id", "retriever", part).agg(F.array_sort(F.collect_list(item)).alias("results"))
    lists.write.mode("errorifexists").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Flat ranked rows of a nested run file."""
    schema = "run_id long, query_id string, retriever string, results array<struct<rank:int,chunk_id:string,score:double>>"
    return spark.read.schema(schema).json(path).select("run_id", "query_id", "retriever", F.explode("results").alias("r")).select("run_id", "query_id", "retriever", "r.chunk_id", "r.score", "r.rank")


def write_metrics_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header, doubles rounded to ``digits``."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("errorifexists").option("header", "true").csv(path)


def canonical_json(columns: list[str]) -> Column:
    """A row's columns as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))
