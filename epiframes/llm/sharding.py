"""Sharding along a Hilbert curve: rows close in several metadata dimensions share a shard.

Dimensions are quantised to ``2**bits`` levels (numbers by their rank among approximate quantiles, strings
by a hash), the curve index is computed in native expressions, rows are range-partitioned by (index, tie
columns), and the global rank follows from the partitions' counts.  Runs of equally many rows become
shards, so each file covers a small box of the dimensions and scans can prune on any of them.  Only
metadata travels: the text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .quality import let


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Curve index of integer coordinates in [0, 2**bits): axes to transposed form, then interleaved."""
    names = [f"x{i}" for i in range(len(axes))]
    pack = lambda x: F.struct(*[x[k].alias(k) for k in names])
    levels = [1 << b for b in range(bits - 1, 0, -1)]

    def turn(s: Column, q: int, k: str) -> Column:
        """Reflect or swap the low bits of axis k and the first axis, as bit q of axis k says."""
        low, has = F.lit(q - 1), s[k].bitwiseAND(F.lit(q)) != 0
        swap = s["x0"].bitwiseXOR(s[k]).bitwiseAND(low)
        x = {m: s[m] for m in names} | {"x0": F.when(has, s["x0"].bitwiseXOR(low)).otherwise(s["x0"].bitwiseXOR(swap))}
        if k != "x0":
            x[k] = F.when(has, s[k]).otherwise(s[k].bitwiseXOR(swap))
        return pack(x)

    def gray(s: Column) -> Column:
        x = [s["x0"]]
        for k in names[1:]:
            x.append(s[k].bitwiseXOR(x[-1]))
        flip = F.lit(0)
        for q in levels:
            flip = flip.bitwiseXOR(F.when(x[-1].bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        return let(flip, lambda t: pack({k: a.bitwiseXOR(t) for k, a in zip(names, x, strict=True)}))

    def weave(s: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for k in names:
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(s[k], b).bitwiseAND(F.lit(1)).cast("long"))
        return out

    state = F.struct(*[a.cast("int").alias(k) for a, k in zip(axes, names, strict=True)])
    for q in levels:
        for k in names:
            state = let(state, lambda s, q=q, k=k: turn(s, q, k))
    return let(let(state, gray), weave)


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Each dimension as a level below ``2**bits``; nulls share the lowest level."""
    top = 1 << bits
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    cuts = {}
    if numbers:
        at = [i / top for i in range(1, top)]
        row = df.agg(*[F.percentile_approx(F.col(d), at, 10_000).alias(d) for d in numbers]).head()
        cuts = {d: sorted(set(row[d] or [])) for d in numbers}
    out = []
    for d in dims:
        if d in cuts:
            level = _level(F.col(d), cuts[d])
        else:
            level = F.pmod(F.xxhash64(d), F.lit(top))
        out.append(F.coalesce(F.when(F.col(d).isNotNull(), level), F.lit(0)).cast("int"))
    return out


def _level(x: Column, cuts: list) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c <= x)) if cuts else F.lit(0)


def hilbert_shards(rows: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = 5) -> DataFrame:
    """Add ``curve`` (index), ``shard`` and ``slot`` (gapless in the shard) to rows of metadata.

    Shards are runs of the order (curve, ties); their row counts differ by one at most.  Rows equal in all
    of these are interchangeable; nulls sort first; repeated rows have slots of their own; an empty table
    gives an empty result.  All columns of ``rows`` stay but ``curve``, ``shard``, ``slot``, ``run`` and ``rank``,
    which are replaced.
    """
    n_parts = partitions(rows.sparkSession)
    order = ["curve", *ties]
    base = written(rows)
    keyed = base.withColumn("curve", hilbert_index(quantised(base, dims, bits), bits))
    placed = written(keyed.repartitionByRange(n_parts, *order).withColumn("run", F.spark_partition_id()))
    counts = {r.run: r["n"] for r in placed.groupBy("run").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for run in range(n_parts):
        before.append(total)
        total += counts.get(run, 0)
    rank = F.lit(before)[F.col("run")] + F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1
    ranked = placed.withColumn("rank", rank.cast("long"))
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long")).drop("run", "rank")


def write_shards(rows: DataFrame, path: str, files: int | None = None) -> None:
    """One folder per shard, rows in slot order.  Each of about ``files`` files (as many as shuffle partitions, if
    not given) is a run of the curve within a shard, so its dimensions span little and scans skip it by its statistics."""
    n = files or partitions(rows.sparkSession)
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
