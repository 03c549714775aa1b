"""Exact distinct counts of several columns in one pass, by bitmaps over positions.

Each value has a position: days and whole numbers have one of their own, other values that of a sorted dictionary.
A group keeps one bitmap of 4 KB for each column and range of 32,768 positions, set by each row and merged by "or",
before and after the exchange alike; no row is repeated for each column, and no value is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(value as ``column``, ``_pos`` from 1) of the distinct values, nulls left out, in order."""
    from ..operators.frames import order_index

    return order_index(rows.select(column).distinct(), column).select(column, F.col("low").alias("_pos"))


def with_positions(rows: DataFrame, columns: list[str], words: DataFrame | None = None) -> DataFrame:
    """``_p_<column>``, a position from 1, for each column; ``words`` are the rows that dictionaries are made of, if not these."""
    kinds = dict(rows.dtypes)
    for c in columns:
        if kinds[c] == "date":
            rows = rows.withColumn(f"_p_{c}", F.datediff(c, F.lit("0001-01-01").cast("date")).cast("long") + 1)
        elif kinds[c] in _WHOLE:
            # negative numbers and zero between the positive ones
            rows = rows.withColumn(f"_p_{c}", F.when(F.col(c) > 0, F.col(c).cast("long") * 2).otherwise(1 - F.col(c).cast("long") * 2))
        else:
            rows = rows.join(dictionary(rows if words is None else words, c).withColumnRenamed("_pos", f"_p_{c}"), c, "left")
    return rows


def bitmaps(placed: DataFrame, keys: list[str], columns: list[str], *others: Column) -> DataFrame:
    """Per keys and ranges of positions: ``_b_<column>`` (range), ``_m_<column>`` (bitmap) and other aggregates."""
    ranges = [F.bitmap_bucket_number(f"_p_{c}").alias(f"_b_{c}") for c in columns]
    maps = [F.bitmap_construct_agg(F.bitmap_bit_position(f"_p_{c}")).alias(f"_m_{c}") for c in columns]
    return placed.groupBy(*keys, *ranges).agg(*maps, *others)


def counted(maps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct counts ``<column>`` per keys from bitmaps that may belong to finer keys."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_b_{c}").alias("_b"), F.col(f"_m_{c}").alias("_m")) for i, c in enumerate(columns)]))
    merged = maps.select(*keys, each).groupBy(*keys, "_c", "_b").agg(F.bitmap_count(F.bitmap_or_agg("_m")).alias("_n"))
    return merged.groupBy(*keys).agg(*[F.sum(F.when(F.col("_c") == i, F.col("_n")).otherwise(0)).alias(f"n_{c}") for i, c in enumerate(columns)])


def distinct_counts(rows: DataFrame, keys: list[str], columns: list[str], **others: Column) -> DataFrame:
    """``n_<column>`` for each column, exact, nulls not counted, beside sums or counts given as ``name=(first, merge)``.

    ``others`` maps a name to a pair of aggregates: over the rows, and over the partial results called ``_o_<name>``.
    """
    placed = with_positions(rows, columns)
    partial = bitmaps(placed, keys, columns, *[a.alias(f"_o_{k}") for k, (a, _) in others.items()])
    counts = counted(partial, keys, columns)
    if not others:
        return counts
    merged = partial.groupBy(*keys).agg(*[b.alias(k) for k, (_, b) in others.items()])
    return merged.join(counts, keys) if keys else merged.crossJoin(counts)
