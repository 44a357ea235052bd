"""Tables that are computed once and kept in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths in the shared folder that this process has asked for and not deleted.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a fresh local one only where that is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="contagraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: computed once, short lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of materialised tables that nothing is going to read any more; other frames and None are passed over."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this process has left in the shared folder, when no result that reads it is needed any more."""
    for path in list(_MADE):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.discard(path)


def copy_parts(spark: SparkSession, folder: str, to: str, head: str = "") -> None:
    """Make one file of head and the part files of a folder, in order, and delete the folder; bytes are copied as they are.

    to is a path of the driver's machine, or a URI that Hadoop can write; the file appears when it is whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    paths = [x.getPath() for x in fs.listStatus(where)]
    parts = sorted((p for p in paths if p.getName().startswith("part-")), key=lambda p: int(p.getName().split("-")[1].split(".")[0]))
    target = jvm.org.apache.hadoop.fs.Path(to if "://" in to else "file://" + os.path.abspath(to))
    into = target.getFileSystem(conf)
    into = into.getRawFileSystem() if into.getScheme() == "file" else into  # without a file of checksums beside it
    begun = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.part")
    out = into.create(begun, True)
    try:
        out.write(bytearray(head.encode()))
        for p in parts:
            given = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
            given.close()
    finally:
        out.close()
    if into.exists(target):
        into.delete(target, False)
    into.rename(begun, target)
    fs.delete(where, True)
