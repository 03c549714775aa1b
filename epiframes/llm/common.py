"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written  # noqa: F401  (the operators take it from here)

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows of a few longs that may be broadcast: some 50 MB in an executor.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Only the named columns of a table: others never reach a plan and cannot clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a written table, if it has at most ``BROADCAST_ROWS`` rows; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What this Python worker keeps from task to task: what was made, by the module of its operator and a name.
_KEPT: dict[tuple[str, Hashable], object] = {}


def kept(module: str, name: Hashable, make: Callable[[], object]):
    """Look-up tables and caches that a Python worker makes once for one operator's tasks."""
    if (module, name) not in _KEPT:
        _KEPT[module, name] = make()
    return _KEPT[module, name]


def keep_only(module: str) -> None:
    """At a task's start: workers serve many stages, and what other operators keep would fill the executor."""
    others = [k for k in _KEPT if k[0] != module]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with one dict of columns for each batch of output."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        keep_only(fn.__module__)
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
