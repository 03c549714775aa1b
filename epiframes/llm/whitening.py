"""Embedding whitening with a weighted multiplicity covariance.

Identical quantised vectors are grouped first; each distinct vector enters the covariance once, with its count
or one as its weight, is whitened once, and is joined back to the rows that hold it.  Sums are exact integers;
each partition centres its block of vectors and multiplies it with itself, and only the d x d sums of the
blocks reach the driver, where d is the vectors' dimension.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, written

#: Largest magnitude whose products and sums are surely exact in 64-bit integers.
SAFE = 1 << 62


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) as long for each entry; beyond the range of long it stays at the range's end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _keys(x: Column) -> list[Column]:
    """A 128-bit name of a quantised vector."""
    return [F.xxhash64(F.lit(salt), x).alias(k) for k, salt in (("k1", 0x5EED), ("k2", 0xC0DE))]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _weights(batch: pa.RecordBatch, weight: str) -> np.ndarray:
    n = batch.column("count").to_numpy(zero_copy_only=False)
    return n if weight == "count" else np.ones(len(n), dtype=np.int64)


def _exact(values: np.ndarray, bound: float) -> np.ndarray:
    """As Python integers where 64 bits might not do."""
    return values if bound < SAFE else values.astype(object)


def _sums(distinct: DataFrame, weight: str) -> tuple[int, list[int]]:
    """Sum of the weights and of each dimension, exact."""

    def part(batches):
        n, total = 0, 0
        for batch in batches:
            x, w = matrix(batch.column("x")), _weights(batch, weight)
            bound = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())
            n += int(w.sum())
            total = total + (_exact(x, bound) * _exact(w, bound)[:, None]).sum(axis=0).astype(object)
        if n:
            rows = [(-1, Decimal(n)), *((i, Decimal(int(s))) for i, s in enumerate(total))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.decimal128(38, 0))], names=["dim", "s"])

    got = distinct.select("x", "count").mapInArrow(part, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    sums = {r.dim: int(r.s) for r in got}
    return sums.pop(-1, 0), [sums[i] for i in sorted(sums)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums: exact integers (Python's where 64 bits might not do), and the same over n as doubles."""
    bound = float(np.abs(x.astype(float)).max(initial=0)) * n + max((abs(float(s)) for s in sums), default=0.0)
    y = _exact(x, bound) * n - np.array(sums, dtype=object if bound >= SAFE else np.int64)
    return y, (y / n).astype(np.float64)


def _covariance(distinct: DataFrame, weight: str, n: int, sums: list[int]) -> np.ndarray:
    """Sum over all blocks of the weighted centred products, over n."""
    d = len(sums)

    def part(batches):
        total = np.zeros((d, d))
        for batch in batches:
            _, c = deviations(matrix(batch.column("x")), n, sums)
            total += (c * _weights(batch, weight)[:, None]).T @ c
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = distinct.select("x", "count").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in got:
        out[r.i, r.j] = r.v / n
    return (out + out.T) / 2


def square_sums(y: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, exact; None where it does not fit a long."""
    if float((y.astype(float) ** 2).sum(axis=1).max(initial=0)) < SAFE:
        return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(e) ** 2 for e in row) for row in y)]


def whiten(rows: DataFrame, key: str, vector: str = "embedding", components: int = 4, weight: str = "one", scale: int = 256) -> DataFrame:
    """Leading whitened components of each row's vector: ``key``, component, n, deviation, whitened, explained, identity_error.

    ``weight`` is "one" (each distinct vector counts once) or "count" (as often as it occurs); n is the sum of the weights.

    Rows whose vector is null or holds null, NaN or infinite entries go; of the rest, rows whose vector has not
    the most frequent length (of equally frequent ones the longest) go as well, and empty vectors have no component.
    Equal vectors get equal results, repeated rows and keys stay, null keys stay null; other columns are ignored;
    an empty table gives none.  A component without variance has null ``whitened`` and ``explained`` 0 (null if no
    dimension varies), and stays out of ``identity_error``.  Entries that no long holds stay at its range's end; a
    deviation that no long holds is null.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    x = quantised(F.col(vector), scale)
    kept = rows.select(F.col(key), F.col(vector)).where(usable(F.col(vector))).select(F.col(key), x.alias("x"))
    distinct = written(kept.groupBy("x").count())
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    d = lengths[0].d if lengths else 0
    distinct = distinct.where(F.size("x") == d)
    k = min(components, d)
    schema = "k1 long, k2 long, deviation long, w array<double>"
    if k:
        n, sums = _sums(distinct, weight)
        v = _covariance(distinct, weight, n, sums)
        values, vectors = np.linalg.eigh(v)
        e, axes = values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy()
        trace = float(np.trace(v))
        live = e > trace * d * np.finfo(float).eps
    else:
        n, sums, e, axes, trace, live = 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, np.zeros(0, dtype=bool)
    roots = np.sqrt(np.where(live, e, 1.0))

    def project(batch):
        y, c = deviations(matrix(batch.column("x")), n, sums)
        w = c @ axes / roots
        rows_ = [[float(a) if ok else None for a, ok in zip(r, live, strict=True)] for r in w]
        yield {"k1": batch.column("k1"), "k2": batch.column("k2"), "deviation": square_sums(y), "w": rows_}

    if not k:
        whitened = spark.createDataFrame([], schema)
    else:
        whitened = written(map_batches(distinct.select("x", *_keys(F.col("x"))), project, schema))
    error = _identity_error(distinct, whitened, weight, n, np.flatnonzero(live).tolist())
    shares = F.array(*[F.lit(float(a / trace) if ok else 0.0 if trace > 0 else None).cast("double") for a, ok in zip(e, live, strict=True)]).cast("array<double>")
    back = kept.select(key, *_keys(F.col("x"))).join(whitened, ["k1", "k2"])
    out = back.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(key, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _identity_error(distinct: DataFrame, whitened: DataFrame, weight: str, n: int, live: list[int]) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over components that vary."""
    if not live:
        return None
    w = whitened
    if weight == "count":
        w = whitened.join(distinct.select(*_keys(F.col("x")), "count"), ["k1", "k2"])
    times = F.col("count") if weight == "count" else F.lit(1)
    means = w.agg(*[F.sum(times * F.col("w")[i]).alias(f"m{i}") for i in live]).head()
    mean = {i: means[f"m{i}"] / n for i in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    got = w.agg(*[F.sum(times * (F.col("w")[i] - mean[i]) * (F.col("w")[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).head()
    return max(abs(got[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)
