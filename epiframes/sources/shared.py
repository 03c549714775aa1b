"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the innermost ``owned`` block of this thread, and else of the thread itself.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)
_THREADS = threading.local()


def _mine() -> list[str]:
    own = _OWNER.get()
    if own is None:
        own = _THREADS.__dict__.setdefault("folders", [])
    return own


def shared_dir(spark: SparkSession, name: str = "data") -> str:
    """A new folder under the cluster's spark.checkpoint.dir; where that is unset, a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    folders = _mine()
    folders.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return folders[-1]


def _delete(spark: SparkSession, folders: list[str]) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path
    while folders:
        path = place(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Folders made inside belong to the block and are deleted at its end; those of other blocks and threads stay."""
    folders: list[str] = []
    token = _OWNER.set(folders)
    try:
        yield
    finally:
        _OWNER.reset(token)
        _delete(spark, folders)


def made() -> int:
    """How many folders there are: a mark for ``release``."""
    return len(_mine())


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders that this thread has made since a mark, once no table that reads them is needed."""
    folders = _mine()
    late = folders[since:]
    del folders[since:]
    _delete(spark, late)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
