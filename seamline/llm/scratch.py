"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of this application's own folder under ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, for local sessions only: on a cluster
    executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _ROOTS:
        return _ROOTS[key]
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seamline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{base.rstrip('/')}/rdd")
    _ROOTS[key] = f"{base.rstrip('/')}/seamline-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, _ROOTS[key])
    return _ROOTS[key]


def _forget(spark: SparkSession, uri: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, uri)
    elif uri.startswith("file:"):
        import shutil

        shutil.rmtree(local_path(uri), ignore_errors=True)


#: rows of texts in an Arrow batch, at most: both sides of each running task hold a few batches
BATCH_ROWS = 1000


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to Arrow batches of ``BATCH_ROWS`` at most. Spark's default is ten times as
    many, made for rows of a few numbers; it would hold tens of megabytes of texts several times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def local_path(uri: str) -> str:
    return "/" + uri.split(":", 1)[1].lstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and keeps its size known."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    remove(df.sparkSession, df._stored_at)


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI; works for shared mounts and object stores alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write chunks to ``uri`` by way of another name, so that a lost task leaves no half file. Callers put a name of
    their own attempt in ``uri``."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(temp) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(temp, path)
    return n
