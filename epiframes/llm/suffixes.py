"""Removal of byte strings that earlier documents hold, by range-partitioned suffix sorting.

A byte goes if a string of ``SPAN`` bytes over it also starts in a document with a smaller key.  Sorting
the suffixes of every byte would move each byte fifty times, so suffixes are handled in families: each
window of SPAN bytes has one anchor, the leftmost of its k-grams with the least hash, and equal windows have
equal anchors at equal offsets.  A family (an anchor with the run of windows that it stands for) is the
suffix at the anchor plus the few bytes before it.

1. Documents are packed into compressed blocks, written once.
2. Blocks send fingerprints of their anchors; those that occur in one document only come back to nobody:
   their suffixes cannot repeat and are never sent.
3. The other suffixes go, once per block and content, to the bucket that sampled splitters give for
   their leading bytes.  The splitters compare whole anchors, so suffixes that could match never
   straddle a boundary.  Buckets sort by multikey quicksort (eight bytes a symbol, only ties go on to the
   next) and compare neighbours: first whole families, then the single windows of families that differ.
   A bucket is held as it was sent, packed, and sorted a bounded part at a time.
   Anchors with many different families in the sample (a common line with different text around it)
   are hot: their single windows, once per block and document, are dealt by a hash of the window's
   bytes, so that equal windows meet and one anchor is spread over all buckets.
4. Removed runs return to their blocks, which cut the documents.

Within a block only the least document of equal families travels, so a string in a third of all
documents costs one record per block.

What differs from plain suffix sorting: not every suffix is sorted, as step 2 leaves out those that cannot
repeat (else each byte would be sent fifty times); splitters are whole anchors, so there is nothing to compare
across boundaries; and the local sort takes the multikey scheme (a symbol at a time, only ties go on) with
numpy's own sort of each symbol instead of three-way partitions.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, partitions, text_or_empty, written

SPAN, K = 50, 24
SIDE = SPAN - K  # most bytes before an anchor in its window, and after its k-gram
WIDE = SPAN + SIDE  # bytes of a family: SIDE before the anchor, SPAN from it on
#: Symbols of a family: anchor and bytes after it, then the bytes before it and the offsets.
ANCHOR_FIRST = [*range(SIDE, WIDE - 8, 8), WIDE - 8, *range(0, SIDE - 8, 8), SIDE - 8, WIDE - 6]
#: Bytes of a block, and those whose anchors are looked for at a time.
BLOCK_BYTES, SEGMENT = 4 << 20, 1 << 16
SAMPLE_BLOCKS, SAMPLE_EACH = 500, 200
#: An anchor is hot from this share of a bucket on, and from so many different families in the sample.
HOT_PART, HOT_LEAST = 4, 8
#: Families whose windows are compared at a time.
STEP = 20_000
#: Families and windows that a task sorts at a time, and bytes of packed ones that it holds in memory.
PART, WINDOWS, HELD = 500_000, 600_000, 16 << 20
#: Bytes of packed families that a block sends at a time.
BATCH = 2 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)
_PRINT = np.uint64((1 << 40) - 1)


def _zip(x: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


class Block:
    """Documents of one block: keys, which keys are null, and the texts one behind the other."""

    def __init__(self, keys: np.ndarray, null: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        self.keys, self.null, self.size, self.data = keys, null, size, data
        self.end = np.cumsum(size)
        self.start = self.end - size

    def packed(self) -> bytes:
        return _zip(np.int64(len(self.keys)).tobytes() + self.keys.tobytes() + self.null.tobytes() + self.size.tobytes() + self.data.tobytes(), 7)

    @classmethod
    def of(cls, payload: bytes) -> Block:
        raw = _unzip(payload)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, bool, n, 8 + 8 * n), np.frombuffer(raw, np.int64, n, 8 + 9 * n), np.frombuffer(raw, np.uint8, offset=8 + 17 * n))

    def families(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors: fingerprint, position, first and last window start that they stand for."""
        out: list[tuple[np.ndarray, ...]] = []
        ok = np.ones(len(self.data), bool)
        for a, b, null in zip(self.start.tolist(), self.end.tolist(), self.null.tolist(), strict=True):
            ok[a if null else max(a, b - SPAN + 1) : b] = False
        for a in range(0, len(self.data), SEGMENT):
            use = np.flatnonzero(ok[a : a + SEGMENT])
            if len(use):
                out.append(_anchors(self.data[a : a + SEGMENT + SPAN - 1], use, a))
        if not out:
            return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(data: np.ndarray, use: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    h = _BYTE[data]
    h = h[:-1] * _A[0] + h[1:]
    h = h[:-2] * _A[1] + h[2:]
    h8 = h[:-4] * _A[2] + h[4:]
    h = h8[:-8] * _A[3] + h8[8:]
    h = h[: len(h8) - 16] * _A[4] + h8[16:]
    h ^= h >> np.uint64(29)
    h *= _A[0]
    at = np.arange(len(h), dtype=np.uint64)
    v = (h & ~_LOW) | at
    m = np.minimum(v[:-1], v[1:])
    m = np.minimum(m[:-2], m[2:])
    m = np.minimum(m[:-4], m[4:])
    m = np.minimum(m[:-8], m[8:])
    rest = SPAN - K + 1 - 16
    m = np.minimum(m[:-rest], m[rest:])
    best = m[use]
    where = (best & _LOW).astype(np.int64)
    new = np.ones(len(use), bool)
    new[1:] = (where[1:] != where[:-1]) | (use[1:] != use[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(use)) - 1
    return _even(best[first] >> np.uint64(24)), where[first] + base, use[first] + base, use[last] + base


def _even(x: np.ndarray) -> np.ndarray:
    """A permutation of 40-bit numbers: anchors are least hashes, so most are small and would meet in the first buckets."""
    x = x * _A[1] & _PRINT
    x ^= x >> np.uint64(20)
    return x * _A[2] & _PRINT


class Symbols:
    """Rows of bytes as columns of big-endian eight-byte symbols, each made when it is asked for; they may overlap, ``at`` has their places."""

    def __init__(self, rows: np.ndarray, at: list[int] | None = None) -> None:
        self.rows = np.ascontiguousarray(rows)
        self.at = at or [*range(0, rows.shape[1] - 8, 8), rows.shape[1] - 8]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, j: int) -> np.ndarray:
        return np.ndarray(len(self.rows), ">u8", self.rows, self.at[j], self.rows.strides[:1]).astype(np.uint64)


def multikey(cols: list[np.ndarray] | Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over rows of symbols: the order, and where a row differs from the one before."""
    first = cols[0]
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    del first
    for j in range(1, len(cols)):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        value = cols[j][order[at]]
        mixed = np.zeros(int(group[-1]) + 1, bool)  # the others, copies mostly, stay as they are
        mixed[group[1:][(value[1:] != value[:-1]) & (group[1:] == group[:-1])]] = True
        mine = np.flatnonzero(mixed[group])
        at, value, group = at[mine], value[mine], group[mine]
        inner = np.lexsort((value, group))
        order[at] = order[at[inner]]
        value = value[inner]
        split = np.flatnonzero((value[1:] != value[:-1]) & (group[1:] == group[:-1])) + 1
        new[at[split]] = True
    return order, new


def _leads(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Group number of each row, in row order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _family_rows(b: Block, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bytes around each anchor as far as its windows reach, then the two offsets."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), b.data, np.zeros(SPAN, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDE)
    far, near = pos - first, pos - last
    j = np.arange(WIDE)
    out = np.empty((len(pos), WIDE + 2), np.uint8)
    for i in range(0, len(pos), STEP):
        a = slice(i, i + STEP)
        out[a, :WIDE] = np.where((j >= (SIDE - far[a])[:, None]) & (j < (SIDE - near[a] + SPAN)[:, None]), rows[pos[a]], 0)
    out[:, WIDE], out[:, WIDE + 1] = far, near
    return out


def pack_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    def pack(batches):
        task, n = TaskContext.get().partitionId(), 0
        keys: list = []
        texts: list[bytes] = []
        held = 0

        def done():
            b = Block(np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys]), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([b.packed()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t.encode("utf-8", "surrogatepass")
                if held and held + len(t) > BLOCK_BYTES:
                    yield done()
                    keys, texts, held, n = [], [], 0, n + 1
                keys.append(k)
                texts.append(t)
                held += len(t)
        if keys:
            yield done()

    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    return written(rows.mapInArrow(pack, "block long, payload binary"), codec="none")


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _sorted_pack(x: np.ndarray) -> bytes:
    return _zip(np.diff(x, prepend=np.uint64(0)).tobytes())


def _sorted_unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unzip(x), np.uint64))


def _listed(fp: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, whether several documents of the block hold them, and their cuts into n buckets."""
    order = np.lexsort((key, fp))
    fp, key = fp[order], key[order]
    new = np.ones(len(fp), bool)
    new[1:] = fp[1:] != fp[:-1]
    at = np.flatnonzero(new)
    several = key[at] != key[np.append(at[1:], len(fp)) - 1] if len(at) else np.empty(0, bool)
    fp = fp[at]
    where = ((fp * np.uint64(n)) >> np.uint64(40)).astype(np.int64)
    return fp, several, np.searchsorted(where, np.arange(n + 1))


def _wanted(fp: np.ndarray, key: np.ndarray, n: int, hits: list) -> np.ndarray:
    """Sorted fingerprints that two documents hold: the block's own and those that the buckets confirmed."""
    fp, several, cut = _listed(fp, key, n)
    keep = several.copy()
    for bucket, bits in hits:
        once = cut[bucket] + np.flatnonzero(~several[cut[bucket] : cut[bucket + 1]])
        keep[once] = np.unpackbits(np.frombuffer(_unzip(bits), np.uint8), count=len(once)).astype(bool)
    return fp[keep]


def shared_anchors(blocks: DataFrame, n: int) -> DataFrame:
    """For each block and bucket, which of the fingerprints that it listed once other blocks list too, as bits."""

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block.of(payload.as_buffer())
                fp, _, first, _ = b.families()
                doc = np.searchsorted(b.start, first, "right") - 1
                fp, several, cut = _listed(fp, b.keys[doc], n)
                out: list[list] = [[], [], [], []]
                for i in range(n):
                    mine, many = fp[cut[i] : cut[i + 1]], several[cut[i] : cut[i + 1]]
                    if len(mine):
                        for col, x in zip(out, (i, block, _sorted_pack(mine[~many]), _sorted_pack(mine[many])), strict=True):
                            col.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["bucket", "block", "one", "many"])

    def match(batches):
        fps, owner, flag, names = [], [], [], []
        for batch in batches:
            for bucket, block, one, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                for x, many_here in ((one, False), (many, True)):
                    got = _sorted_unpack(x.as_buffer())
                    fps.append(got)
                    owner.append(np.full(len(got), len(names), np.int32))
                    flag.append(np.full(len(got), many_here))
                names.append((bucket, block))
        if not fps:
            return
        fp, own, many = np.concatenate(fps), np.concatenate(owner), np.concatenate(flag)
        del fps, owner, flag
        order = np.argsort(fp, kind="stable")
        fp, own, many = fp[order], own[order], many[order]
        twin = np.zeros(len(fp), bool)
        twin[1:] = fp[1:] == fp[:-1]
        twin[:-1] |= twin[1:]
        twin = twin[~many]
        own, rank = own[~many], np.argsort(np.argsort(own[~many], kind="stable"), kind="stable")
        answer = np.empty(len(twin), bool)
        answer[rank] = twin
        cut = np.searchsorted(np.sort(own), np.arange(len(names) + 1))
        for i, (bucket, block) in enumerate(names):
            mine = answer[cut[i] : cut[i + 1]]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_zip(np.packbits(mine).tobytes())], pa.binary())], names=["block", "bucket", "hits"])

    sent = blocks.mapInArrow(send, "bucket int, block long, one binary, many binary")
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(match, "block long, bucket int, hits binary")


def splitters(blocks: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that cut a bounded sample of all others into n equal parts, and the hot anchors (at most HOT_PART * n)."""
    total = blocks.count()

    def some(batch):
        out, fresh = [], []
        for payload in batch.column(0):
            b = Block.of(payload.as_buffer())
            _, pos, first, last = b.families()
            at = np.arange(0, len(pos), max(1, len(pos) // SAMPLE_EACH))[:SAMPLE_EACH]
            if len(at):
                rows = _family_rows(b, pos[at], first[at], last[at])
                out += [x.tobytes() for x in rows[:, SIDE : SIDE + K]]
                new = np.zeros(len(at), bool)
                new[np.unique(np.ascontiguousarray(rows).view(f"V{WIDE + 2}").ravel(), return_index=True)[1]] = True
                fresh += new.tolist()
        yield {"lead": out, "fresh": fresh}

    share = min(1.0, SAMPLE_BLOCKS / max(total, 1))
    few = blocks.select("payload") if share == 1.0 else blocks.sample(share, seed=7).select("payload")
    got = map_batches(few, some, "lead binary, fresh boolean").collect()
    leads = np.array([bytes(r.lead) for r in got], f"S{K}")
    different, weight = np.unique(leads[np.array([r.fresh for r in got], bool)], return_counts=True)
    hot = different[(weight >= HOT_LEAST) & (weight * HOT_PART * n >= len(leads))]
    leads = np.sort(leads[~np.isin(leads, hot)])
    return np.unique(leads[[len(leads) * i // n for i in range(1, n)]]) if len(leads) else leads, hot


def _planes(x: np.ndarray) -> bytes:
    """Longs byte plane by byte plane: equal high bytes lie together."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(x: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def _runs_row(kind_rows: list, block: int, first: np.ndarray, last: np.ndarray) -> None:
    kind_rows.append((block, _zip(_planes(first) + _planes(last - first))))


def removed_runs(blocks: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """Rows (block, runs): first starts of removed windows in the block, and how many more follow."""
    cuts, hot = splitters(blocks, n)
    ranges = len(cuts) + 1

    def send(batches):
        for batch in batches:
            for block, payload, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                b = Block.of(payload.as_buffer())
                fp, pos, first, last = b.families()
                doc = np.searchsorted(b.start, first, "right") - 1
                wanted = _wanted(fp, b.keys[doc], n, [(x["bucket"], x["hits"]) for x in lists or []])
                if not len(wanted):
                    continue
                hit = wanted[np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)] == fp
                pos, first, last, doc = pos[hit], first[hit], last[hit], doc[hit]
                rows = _family_rows(b, pos, first, last)
                order, new = multikey(Symbols(rows))
                group = _leads(order, new)
                least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, b.keys[doc])
                later = b.keys[doc] > least[group]
                out: list = []
                if later.any():
                    _runs_row(out, block, first[later], last[later])
                    yield _sent([(_home(block, n), 1, *out[0])])
                keep = order[~later[order]]
                lead = _lead(rows[keep, SIDE : SIDE + K])
                if len(hot):
                    many = hot[np.minimum(np.searchsorted(hot, lead), len(hot) - 1)] == lead
                    mine = keep[many][np.argsort(lead[many], kind="stable")]
                    for i in range(0, len(mine), STEP):
                        part = mine[i : i + STEP]
                        yield from _hot_windows(rows[part], first[part], b.keys[doc[part]], block, n)
                    keep, lead = keep[~many], lead[~many]
                where = np.searchsorted(cuts, lead, "right") if len(cuts) else np.zeros(len(keep), np.int64)
                by = np.lexsort((lead, where))
                keep, where = keep[by], where[by]
                edge = np.searchsorted(where, np.arange(ranges + 1))
                sent, held = [], 0
                for i in range(ranges):
                    mine = keep[edge[i] : edge[i + 1]]
                    if len(mine):
                        sent.append((i, 0, block, _packed(_turned(rows[mine], SIDE), first[mine], b.keys[doc[mine]])))
                        held += len(sent[-1][3])
                    if held > BATCH:
                        yield _sent(sent)
                        sent, held = [], 0
                if sent:
                    yield _sent(sent)

    def match(batches):
        families, windows = Held(WIDE + 2), Held(SPAN)
        for batch in batches:
            for kind, block, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload.as_py()], pa.binary())], names=["block", "runs"])
                else:
                    (windows if kind == 2 else families).add(block, payload.as_buffer())
        for parts in _family_parts(families):
            yield from _bucket_runs(parts)
        families.file.close()
        for parts in _window_parts(windows, n):
            yield from _equal_windows(parts)
        windows.file.close()

    joined = blocks.join(shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "hits")).alias("lists")), "block", "left")
    sent = joined.mapInArrow(send, "bucket int, kind byte, block long, payload binary")
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(match, "block long, runs binary")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "block", "payload"])


def _home(block: int, n: int) -> int:
    """A bucket for rows that only pass through."""
    return (block + (block >> 32)) % n


def _turned(rows: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of families last: they travel anchor first, so that sorted rows share their beginnings."""
    return np.concatenate([rows[:, n:WIDE], rows[:, :n], rows[:, WIDE:]], axis=1)


def _packed(rows: np.ndarray, place: np.ndarray, key: np.ndarray) -> bytes:
    return _zip(np.int64(len(rows)).tobytes() + rows.tobytes() + _planes(place) + _planes(key))


def _lead(rows: np.ndarray) -> np.ndarray:
    """The first bytes of rows, as strings of the anchors' length."""
    return np.ascontiguousarray(rows[:, :K]).view(f"S{K}").ravel()


class Held:
    """Rows of one bucket as they were sent: packed, and beyond ``HELD`` bytes in a file without a name."""

    def __init__(self, width: int) -> None:
        self.width, self.many = width, 0
        self.names: list[tuple[int, int]] = []
        self.file = tempfile.SpooledTemporaryFile(HELD, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)

    def add(self, block: int, payload: pa.Buffer) -> None:
        self.many += (zstandard.frame_content_size(payload) - 8) // (self.width + 16)
        self.names.append((block, self.file.write(payload)))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Block, rows, first starts and keys."""
        self.file.seek(0)
        for block, size in self.names:
            raw = _unzip(self.file.read(size))
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            at = 8 + m * self.width
            yield block, np.frombuffer(raw, np.uint8, m * self.width, 8).reshape(m, self.width), _from_planes(raw, m, at), _from_planes(raw, m, at + 8 * m)


def _family_parts(held: Held) -> Iterator[list[tuple]]:
    """The families of a bucket in ranges of whole anchors, of about ``PART`` families at most."""
    times, seen = -(-held.many // PART), 0
    cuts: list[np.ndarray] = []
    if times > 1:
        for _, rows, *_ in held:
            cuts.append(_lead(rows[-seen % 64 :: 64]))
            seen += len(rows)
        some = np.sort(np.concatenate(cuts))
        cuts = list(np.unique(some[[len(some) * i // times for i in range(1, times)]]))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True) if held.many else ():
        parts = []
        for block, rows, first, key in held:
            lead = _lead(rows) if cuts else rows
            mine = slice(0 if low is None else np.searchsorted(lead, low), len(rows) if high is None else np.searchsorted(lead, high))
            if mine.start < mine.stop:
                parts.append((block, _turned(rows[mine], SPAN), first[mine], key[mine]))
        if parts:
            yield parts


def _window_parts(held: Held, n: int) -> Iterator[list[tuple]]:
    """The windows of a bucket of n, dealt by their hash again to parts of about ``WINDOWS``."""
    times = -(-held.many // WINDOWS)
    for i in range(times):
        parts = []
        for block, rows, place, key in held:
            if times > 1:
                mine = np.flatnonzero(_window_hash(Symbols(rows)) // np.uint64(n) % np.uint64(times) == i)
                rows, place, key = rows[mine], place[mine], key[mine]
            if len(rows):
                parts.append((block, rows, place, key))
        if parts:
            yield parts


def _returned(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "runs"])


def _expanded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The single windows of families: whose, offset before the anchor, and starts after the family's first."""
    far, near = rows[:, WIDE].astype(np.int64), rows[:, WIDE + 1].astype(np.int64)
    many = far - near + 1
    who = _runs(many)
    after = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    return who, far[who] - after, after


def _window_hash(cols: Symbols) -> np.ndarray:
    h = np.zeros(len(cols.rows), np.uint64)
    for j in range(len(cols)):
        h = (h ^ cols[j]) * _A[0]
        h ^= h >> np.uint64(29)
    return h


def _hot_windows(rows: np.ndarray, first: np.ndarray, key: np.ndarray, block: int, n: int) -> Iterator[pa.RecordBatch]:
    """Windows of hot families, to buckets by a hash of their bytes; those that an earlier document of the block holds go at once."""
    who, offset, after = _expanded(rows)
    windows = np.lib.stride_tricks.sliding_window_view(rows[:, :WIDE], SPAN, axis=1)[who, SIDE - offset]
    cols = Symbols(windows)
    place, key, where = first[who] + after, key[who], (_window_hash(cols) % np.uint64(n)).astype(np.int64)
    order, new = multikey(cols)
    same = _leads(order, new)
    low = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, same, key)
    later = key > low[same]
    sent: list = []
    if later.any():
        out: list = []
        _runs_row(out, block, place[later], place[later])
        sent.append((_home(block, n), 1, *out[0]))
    keep = order[~later[order]]
    keep = keep[np.argsort(where[keep], kind="stable")]
    edge = np.searchsorted(where[keep], np.arange(n + 1))
    for i in range(n):
        mine = keep[edge[i] : edge[i + 1]]
        if len(mine):
            sent.append((i, 2, block, _packed(windows[mine], place[mine], key[mine])))
    yield _sent(sent)


def _equal_windows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Give back the windows of hot anchors that an earlier document holds."""
    names = [(p[0], len(p[2])) for p in parts]
    windows, place, key = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
    parts.clear()
    order, new = multikey(Symbols(windows))
    same = _leads(order, new)
    low = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, same, key)
    later, at = key > low[same], 0
    out: list = []
    for block, many in names:
        gone = place[at : at + many][later[at : at + many]]
        at += many
        if len(gone):
            _runs_row(out, block, gone, gone)
    yield from _returned(out)


def _bucket_runs(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket's families, compare neighbours, and give back what goes."""
    names = [p[0] for p in parts]
    own = _runs(np.array([len(p[2]) for p in parts]))
    rows = np.concatenate([p[1] for p in parts])
    first, key = (np.concatenate([p[j] for p in parts]) for j in (2, 3))
    last = first + rows[:, WIDE] - rows[:, WIDE + 1].astype(np.int64)
    parts.clear()
    order, new = multikey(Symbols(rows, ANCHOR_FIRST))
    group = _leads(order, new)
    least = np.full(int(group[order[-1]]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, key)
    later = key > least[group]
    gone = [(np.flatnonzero(later), first[later], last[later])]
    # one family of each content, from its least document; those that share an anchor with others are compared window by window
    heads = order[new]
    anchor = np.ascontiguousarray(rows[heads, SIDE : SIDE + K]).view(f"V{K}").ravel()
    fresh = np.ones(len(heads), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    number = np.cumsum(fresh) - 1
    several = np.bincount(number)[number] > 1
    heads, number = heads[several], number[several]
    if len(heads):
        members = np.flatnonzero(~later)
        members = members[np.argsort(group[members], kind="stable")]
        edges = [0]
        while edges[-1] < len(heads):
            e = min(len(heads), edges[-1] + STEP)
            while e < len(heads) and number[e] == number[e - 1]:
                e += 1
            edges.append(e)
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            times = -(-(e - a) // STEP)
            for i in range(times):
                gone += _window_runs(rows, heads[a:e], group, least, members, first, i, times)
    at = np.concatenate([g[0] for g in gone])
    lo, hi = np.concatenate([g[1] for g in gone]), np.concatenate([g[2] for g in gone])
    by = np.argsort(own[at], kind="stable")
    at, lo, hi = at[by], lo[by], hi[by]
    edge = np.searchsorted(own[at], np.arange(len(names) + 1))
    out: list = []
    for i, block in enumerate(names):
        mine = slice(edge[i], edge[i + 1])
        if edge[i] < edge[i + 1]:
            _runs_row(out, block, lo[mine], hi[mine])
    yield from _returned(out)


def _window_runs(rows, heads, group, least, members, first, part, parts) -> list[tuple]:
    """Windows of the heads that an earlier document holds, for all members of their families; of several parts, those with one rest of the hash."""
    view = np.lib.stride_tricks.sliding_window_view(rows[:, :WIDE], SPAN, axis=1)
    found: list[list] = [[], [], []]
    for i in range(0, len(heads), STEP):
        who, offset, after = _expanded(rows[heads[i : i + STEP]])
        if parts > 1:
            mine = _window_hash(Symbols(view[heads[i + who], SIDE - offset])) % np.uint64(parts) == part
            who, offset, after = who[mine], offset[mine], after[mine]
        for col, x in zip(found, (who + i, offset, after), strict=True):
            col.append(x)
    who, offset, after = (np.concatenate(x) for x in found)
    if not len(who):
        return []
    order, new = multikey(Symbols(view[heads[who], SIDE - offset]))
    same = _leads(order, new)
    owner = least[group[heads]][who]
    low = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, same, owner)
    out = np.flatnonzero(owner > low[same])
    if not len(out):
        return []
    # spread to every member: same document, same content, other place
    family = group[heads][who[out]]
    a, b = np.searchsorted(group[members], family, "left"), np.searchsorted(group[members], family, "right")
    times = b - a
    pick = members[np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
    place = first[pick] + np.repeat(after[out], times)
    return [(pick, place, place)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``full`` also ``kept`` (bytes).

    Null and empty texts have no bytes; rows with a null key keep all bytes and remove nothing from
    others; rows that repeat a key are not earlier than each other.  Very long texts are whole documents of
    their block.  An empty table gives none; other columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BLOCK_BYTES)
    n = partitions(spark)
    blocks = pack_blocks(docs, key, text)
    shared = shared_anchors(blocks, n)
    runs = removed_runs(blocks, shared, n).groupBy("block").agg(F.collect_list("runs").alias("lists"))

    def cut(batches):
        for batch in batches:
            for payload, lists in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield _cut(Block.of(payload.as_buffer()), lists or [], full)

    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if full else "")
    return blocks.join(runs, "block", "left").select("payload", "lists").mapInArrow(cut, schema).withColumnRenamed("key", key)


def _counted(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _cut(b: Block, lists: list[bytes], full: bool) -> pa.RecordBatch:
    change = np.zeros(len(b.data) + 1, np.int32)
    for x in lists:
        raw = _unzip(x)
        n = len(raw) // 16
        first, more = _from_planes(raw, n, 0), _from_planes(raw, n, 8 * n)
        np.add.at(change, first, 1)
        np.add.at(change, first + more + SPAN, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    del change
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[b.start[b.start < len(gone)]] |= gone[b.start[b.start < len(gone)]]
    total, starts = _counted(gone), _counted(begins)
    digests, kept = [], []
    for a, e in zip(b.start.tolist(), b.end.tolist(), strict=True):
        left = b.data[a:e][~gone[a:e]].tobytes()
        digests.append(hashlib.sha256(left).hexdigest())
        if full:
            kept.append(left)
    cols = [pa.array(b.keys, mask=b.null), pa.array(b.size), pa.array(total[b.end] - total[b.start], pa.int64()), pa.array(starts[b.end] - starts[b.start], pa.int64()), pa.array(digests)]
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if full else []), names=names + ["kept"] * full)
