"""Session helpers shared by all operators: inputs, shared folder, materialised tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of this machine; on a cluster, whose executors
    would each write to their own disk, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-rillmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_shipped: set[str] = set()


def with_package(df: DataFrame) -> DataFrame:
    """``df``, after this package has been sent to the executors once, so that Python in tasks can import it
    wherever the driver was started."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="spark-rillmark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        sc.addPyFile(str(packed))
        _shipped.add(sc.applicationId)
    return df


def with_file(df: DataFrame, path: str) -> str:
    """The name under which tasks find the local file ``path`` with ``SparkFiles.get``, after it was sent to them once."""
    sc = df.sparkSession.sparkContext
    if f"{sc.applicationId}:{path}" not in _shipped:
        sc.addFile(path)
        _shipped.add(f"{sc.applicationId}:{path}")
    return os.path.basename(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/rillmark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, in compressed columns; a lost executor loses nothing.
    The tables are removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(_remove)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, for a repartition whose rows multiply afterwards: adaptive execution
    would merge its small partitions and leave the work to one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def local_session(cores: str | None = None) -> SparkSession:
    """A session for tests and the bench."""
    master = f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName("rillmark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
