"""Shared scratch tables used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session that leaves the setting unset gets a folder of
    its own; on a cluster a machine-local folder would be lost with its host.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pulsegrid-")
    return _local_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Needed where one plan reads the same range partitioning twice: the row to
    partition mapping must be the same in both reads, and survive lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pulsegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/pulsegrid-" in folder:
            fs, path = file_system(spark, folder)
            fs.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and ``path`` as its own path object."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish_once(df: DataFrame, path: str) -> bool:
    """Write ``df`` as the folder ``path`` unless it is there; of several writers at a time one succeeds.

    The folder is written under a hidden name and renamed. Where the name has been taken meanwhile, a file system refuses or
    puts the hidden folder inside, where readers do not see it and it is deleted.
    """
    spark = df.sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        return False
    name = f"_new-{uuid.uuid4().hex}"
    hidden = target.getParent().suffix(f"/{name}")
    df.write.parquet(hidden.toString())
    fs.rename(hidden, target)
    inside = target.suffix(f"/{name}")
    lost = fs.exists(hidden) or fs.exists(inside)
    for left in (hidden, inside):
        fs.delete(left, True)
    return not lost


def drop_batches(spark: SparkSession, path: str, before: int) -> int:
    """Delete the folders ``batch=N`` below ``path`` with ``N < before``; returns how many."""
    fs, top = file_system(spark, path)
    if not fs.exists(top):
        return 0
    old = [s.getPath() for s in fs.listStatus(top) if _batch_number(s.getPath().getName()) < before]
    return sum(bool(fs.delete(p, True)) for p in old)


def _batch_number(name: str) -> float:
    number = name.removeprefix("batch=")
    return int(number) if number != name and number.isdigit() else float("inf")
