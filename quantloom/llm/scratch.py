"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_notes = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a local one that is set now, on local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root; ``release`` removes it."""
    path = f"{shared_root(spark)}/quantloom/{uuid.uuid4().hex}/{name}"
    _WRITTEN.append(path)
    for paths in getattr(_notes, "open", []):
        paths.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here and later plans know the size on disk.

    Spark removes the shuffle files of a plan once the driver has collected its handles as garbage, so a collection is
    asked for here; what a finished step has shuffled then does not stay on disk while the next one runs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def written() -> list[str]:
    """Paths made so far, oldest first."""
    return list(_WRITTEN)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that this thread makes inside the block."""
    paths: list[str] = []
    _notes.open = [*getattr(_notes, "open", []), paths]
    try:
        yield paths
    finally:
        _notes.open = [x for x in _notes.open if x is not paths]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables. Call only once every result built on them has been written elsewhere."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name.rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)
