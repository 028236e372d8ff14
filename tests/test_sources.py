"""Round trips and refusals of the readers and writers; the registry's contract."""

import glob
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillmark.session import scratch, shared_folder
from rillmark.sources import files
from rillmark.streaming import pipelines


def test_read_files(spark, tmp_path):
    (tmp_path / "a_note-one.txt").write_text("plain text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.html").write_text("<html><title>T</title><script>x()</script><p>Seen</p><nav>menu</nav></html>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "ok.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    docs, bad = files.read_files(spark, str(tmp_path))
    got = {r["source_path"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert got["a_note-one.txt"]["title"] == "A Note One" and got["a_note-one.txt"]["doc_id"].startswith("doc_")
    assert got["p.html"]["raw_text"] == "Seen" and got["ok.docx"]["raw_text"] == "One"
    assert {r["source_path"].rsplit("/", 1)[1] for r in bad.collect()} == {"bad.docx", "x.pdf"}


def test_jsonl_and_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "k long, t string", strict=True).collect())) == [(1, "a"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k long", strict=True).collect()
    with pytest.raises(ValueError):
        files.write_unique(df.union(df), "k", str(tmp_path / "u"))


def test_qrels(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query_id\t0\tchunk_id\trelevance\nq1\t0\tc1\t2\nq1\t0\tc2\tx\nq1\t0\tc1\t1\n")
    assert files.read_qrels(spark, str(tmp_path / "q.tsv")).count() == 2
    with pytest.raises(ValueError):
        files.read_qrels(spark, str(tmp_path / "q.tsv"), strict=True)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "graded_ndcg_at_10" in out.columns


class _Cluster:
    """Stands for a session whose master is not local."""

    class sparkContext:
        master = "spark://somewhere:7077"

    class conf:
        folder = None

        @classmethod
        def get(cls, name, default):
            return cls.folder or default


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    with pytest.raises(ValueError):
        shared_folder(_Cluster)
    _Cluster.conf.folder = "/shared"
    assert shared_folder(_Cluster) == "/shared" and shared_folder(spark)


def test_streams_read_a_file_or_a_folder(spark):
    base = scratch(spark, "arrivals")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "n long, k string")
    rows.coalesce(1).write.parquet(f"{base}/all.parquet")
    (file,) = glob.glob(f"{base}/all.parquet/*.parquet")
    for path in (f"{base}/all.parquet", file):
        stream = pipelines.read_stream(spark, path, rows).groupBy("k").agg(F.sum("n").alias("n"))
        assert sorted(map(tuple, pipelines.run_updates(stream, ["k"]).collect())) == [("a", 1), ("b", 5)]
