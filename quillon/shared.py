"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    own = getattr(shared_dir, "own", None)
    if own is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = shared_dir.own = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, own, True)
    return own


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _MADE:
        atexit.register(release, spark)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


TASK_BYTES = 128 << 20  # of a shuffle for each task


def tasks_for(spark: SparkSession, size: float) -> int:
    """Partitions for a shuffle of about `size` bytes: the session's number, or more where tasks would get over TASK_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK_BYTES))


_MADE: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all tables written so far, for long sessions: to be called when no result that reads them is needed any more. Happens by itself at the end."""
    while _MADE:
        _remove(spark, _MADE.pop())


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_sent", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/quillon.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._quillon_sent = True


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def bounded(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows (narrow) rows, which is counted; else df as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
