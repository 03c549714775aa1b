"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document's set holds the hashes of its distinct word n-grams; equal sets form a class, and only classes
are compared.  Classes are banded by size.  For a band, no two linked sets differ in more than U elements,
so after hashing the universe into segments some segments must agree: ``m0`` segments are indexed as
whole subsets (cost one difference each to break) and ``m1`` with their one-deletion neighbourhoods (cost
two), with m0 + 2 m1 = U + 1 + d + e.  The spare d lets every set leave out its d least telling whole subsets
(empty and tiny ones, the heavy lists) in an order that depends on the subset alone: of the at least
d + e + 1 units that agree, the e + 1 most telling ones are kept by both sides.  ``allocate`` picks m0, m1
and d by estimated cost from the band's measured size; e is ``EXTRA`` where the band has room for it.

Sets that share a signature are tied in stars: within a task first, so that a hot signature sends one
row per task, then across tasks.  Star pairs are verified on the real sets and components follow.  A signature
is open while its three or more sets are in several components; an open one is tied once more, to its
likeliest hub.  What is then still open is never paired within the signature.  A set with at most e open
signatures in a band is done: of the e + 1 that it shares with any linked set one is closed.  The other sets
meet by the prefix rule: with elements in order of their frequency among those sets, linked sets share one
of the few rarest elements of both, at positions that leave room for the overlap.  In a cluster of near
copies those are the copies' own changes, so copies that do not link hardly ever meet.  No link is lost.
Hashes have 64 bits: with N different n-grams or sets the chance of any clash is about N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, broadcast_if_small, keep_only, map_batches, partitions, text_or_empty, written
from .components import components

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Further units that linked sets share, in bands that allow four differences for each.
EXTRA = 2
#: A signature's low bits name its band.
BAND_BITS = 6
#: Signatures that a task holds before it passes them on: some 60 bytes each while they are sorted and dealt.
FLUSH = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one n-gram, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    acc = h[:n]
    for k in range(1, width):
        acc = mix(acc) + h[k : k + n]
    return np.unique(mix(acc))


def class_of(s: np.ndarray) -> int | None:
    return _signed(xxh64_intdigest(s.tobytes())) if len(s) else None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Plan(NamedTuple):
    low: int
    high: int
    budget: int  # U: most differences of linked sets
    whole: int  # m0
    delete: int  # m1
    spare: int  # d
    extra: int  # e: signatures beyond one that linked sets surely share


def band_bounds(most: int, ratio: float = 1.4) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= most:
        nxt = max(low + 1, int(np.ceil(low * ratio)))
        out.append((low, nxt - 1))
        low = nxt
    return out


def differences(high: int, num: int, den: int) -> int:
    """Most elements in which a set of at most ``high`` and a larger linked one differ (Jaccard >= num / den)."""
    return (den - num) * (high + high * den // num) // (den + num)


def allocate(low: int, high: int, n: int, num: int, den: int, chance: float = 0.01, pair_cost: float = 4.0) -> Plan:
    """The cheapest (m0, m1, d): signatures sent for n sets, plus chance pairs to look at.

    ``chance`` is how often elements of unrelated sets in one place are equal.
    """
    u = differences(high, num, den)
    e = min(EXTRA, u // 4)
    size = (low + high) / 2
    best = None
    for d in sorted({0, 1, (u + 7) // 8, (u + 3) // 4}):
        for m1 in sorted({0, (u + 1) // 4, (u + 1) // 2, (u + 2) // 2}):
            m0 = u + 1 + d + e - 2 * m1
            if m0 < 0 or (m0 == 0 and d > 1) or (m0 and d >= m0) or m0 + m1 < 1:
                continue
            t = size / (m0 + m1)
            keep = m0 - d
            # an empty subset, or one that a deletion empties, agrees with all others like it
            empty_whole = max(0.0, m0 * np.exp(-t) - d / 2) / max(m0, 1)
            empty_delete = np.exp(-t) * (1 + t)
            chance_pairs = n * n / 2 * ((keep + m1) * chance**t + m0 * empty_whole**2 + m1 * empty_delete**2)
            cost = n * (keep + m1 * (1 + t)) + pair_cost * chance_pairs
            if best is None or cost < best[0]:
                best = (cost, Plan(low, high, u, m0, m1, min(d, m0), e // 2 if m1 else e))
    return best[1]


def signatures(s: np.ndarray, k: int, plan: Plan) -> np.ndarray:
    """Signatures of one set under the plan of band k."""
    m = plan.whole + plan.delete
    salted = mix(s + np.uint64((k + 1) * int(_M2) & 0xFFFFFFFFFFFFFFFF))
    seg = ((salted >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    value = mix(s ^ _M1)
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], value[order]
    count = np.bincount(seg, minlength=m)
    total = np.zeros(m, np.uint64)
    first = np.cumsum(count) - count
    full = count > 0
    total[full] = np.add.reduceat(value, first[full])
    name = np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32)
    out = []
    if plan.whole:
        keep = np.lexsort((np.arange(plan.whole), total[: plan.whole], count[: plan.whole]))[plan.spare :]
        out.append(mix(total[keep] + mix(name[keep])))
    if plan.delete:
        out.append(mix(total[plan.whole :] + mix(name[plan.whole :])))
        inner = seg >= plan.whole
        out.append(mix(total[seg[inner]] - value[inner] + mix(name[seg[inner]])))
    low = np.uint64((1 << BAND_BITS) - 1)
    return np.concatenate(out) & ~low | np.uint64(k) & low


def bitmap(s: np.ndarray) -> list[int]:
    """Parities of the set's counts in 256 cells, as four longs: two sets differ in at least as many elements as their bitmaps in bits."""
    odd = np.bincount((mix(s ^ _M2) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _bands_for(size: int, plans: list[Plan], num: int, den: int) -> Iterator[int]:
    """Own band and lower ones whose largest set a set of this size can still link with."""
    for k in range(len(plans) - 1, -1, -1):
        p = plans[k]
        if p.low <= size and (size <= p.high or size * num <= p.high * den):
            yield k
        elif p.high < size and size * num > p.high * den:
            break


def _stars(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted signatures with their least class, and (signature, least, other) for the rest."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
    other = ~new & (cls != cls[lead])
    other[1:] &= (cls[1:] != cls[:-1]) | (sig[1:] != sig[:-1])
    return sig[new], cls[new], sig[other], np.stack([cls[lead][other], cls[other]]) if other.any() else np.empty((2, 0), np.int64)


_OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])


def _send(n: int, kind: int, where: np.ndarray, record: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records (rows of longs) in one binary per bucket."""
    order = np.argsort(where, kind="stable")
    where, record = where[order], np.ascontiguousarray(record[order])
    cut = np.searchsorted(where, np.arange(n + 1))
    used = [b for b in range(n) if cut[b] < cut[b + 1]]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int8()), pa.array([record[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary())], schema=_OUT)


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def tied(docs: DataFrame, plans: list[Plan], width: int, num: int, den: int) -> DataFrame:
    """Star edges (sig, a, b) between classes that share a signature."""
    n = partitions(docs.sparkSession)

    def emit(batches):
        keep_only(__name__)
        sigs: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[int] = set()
        held = 0

        def flush():
            sig, cls = np.concatenate(sigs), np.repeat(np.array(owners, np.int64), [len(s) for s in sigs])
            sigs.clear()
            owners.clear()
            seen.clear()
            sig, cls, osig, pair = _stars(sig, cls)
            yield from _send(n, 0, _bucket(sig, n), np.stack([sig.view(np.int64), cls], 1))
            if len(osig):
                yield from _send(n, 1, _bucket(mix(pair[1].view(np.uint64)), n), np.stack([osig.view(np.int64), pair[0], pair[1]], 1))

        for batch in batches:
            for t in batch.column(0).to_pylist():
                s = shingles(t, width)
                c = class_of(s)
                if c is None or c in seen:
                    continue
                seen.add(c)
                for k in _bands_for(len(s), plans, num, den):
                    if plans[k].budget:
                        sigs.append(signatures(s, k, plans[k]))
                        owners.append(c)
                        held += len(sigs[-1])
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def gather(batches):
        keep_only(__name__)
        heads: list[np.ndarray] = []
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(payload.as_buffer(), np.int64).reshape(-1, 3 if kind else 2)
                if kind:
                    yield from _edges(data[:, 0], data[:, 1], data[:, 2])
                else:
                    heads.append(data)
        if heads:
            data = np.concatenate(heads)
            _, _, sig, pair = _stars(np.ascontiguousarray(data[:, 0]).view(np.uint64), np.ascontiguousarray(data[:, 1]))
            yield from _edges(sig.view(np.int64), pair[0], pair[1])

    sent = docs.select(text_or_empty().alias("t")).mapInArrow(emit, "bucket int, kind byte, payload binary")
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(gather, "sig long, a long, b long")


def _edges(sig, a, b, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(sig), rows):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + rows])) for x in (sig, a, b)], names=["sig", "a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity, by exact intersection.  One set moves for each pair."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))

    def check(batch):
        out = [[], []]
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both):
                out[0].append(a)
                out[1].append(b)
        yield {"a": out[0], "b": out[1]}

    return map_batches(right.join(broadcast_if_small(pairs), "b").join(left, "a").select("a", "b", "sa", "sb"), check, "a long, b long")


def _open(members: DataFrame, roots: DataFrame, extra: list[int], least: int) -> DataFrame:
    """(sig, class, root) of open signatures, for the sets that have more of them in a band than it can spare.

    Signatures of fewer than ``least`` sets are left out: two sets under one signature, among all sets, are a star
    of their own and have been verified; two that are left of a larger group have not.
    """
    placed = members.join(roots.withColumnRenamed("vertex", "class"), "class", "left").select("sig", "class", F.coalesce("root", "class").alias("root"))
    spread = placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where(F.expr("x <> y") & (F.col("m") >= least)).select("sig")
    found = placed.join(spread, "sig").withColumn("band", F.col("sig").bitwiseAND((1 << BAND_BITS) - 1).cast("int"))
    enough = found.groupBy("class", "band").agg(F.count("*").alias("k")).where(F.col("k") > F.get(F.lit(extra), F.col("band")))
    return written(found.join(enough.select("class", "band"), ["class", "band"]).select("sig", "class", "root"))


def _met_in_prefix(crowd: DataFrame, sets: DataFrame, may_link, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different roots that share an element early enough in both sets' order by frequency.

    ``crowd``: class, root, n and bitmap words.  Elements that one set alone holds come first in its order and
    meet nothing; a set of n elements can link only over its first n - ceil(n num / den) + 1.
    """

    def cut(batch):
        each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        yield {"class": np.repeat(batch.column(0).to_numpy(), [len(x) for x in each]), "token": np.concatenate(each)}

    own = sets.join(broadcast_if_small(crowd.select("class")), "class")
    tokens = map_batches(own.select("class", "set"), cut, "class long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    by_class = Window.partitionBy("class")
    ranked = tokens.join(shared, "token").withColumn("rank", F.row_number().over(by_class.orderBy("f", "token"))).withColumn("k", F.count("*").over(by_class))
    at = (F.col("n") - F.col("k") + F.col("rank") - 1).alias("at")
    prefix = ranked.join(broadcast_if_small(crowd), "class").select("token", "class", "root", "n", "b0", "b1", "b2", "b3", at).where((F.col("n") - F.col("at")) * den >= F.col("n") * num)
    prefix = written(prefix)
    spread = prefix.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    prefix = prefix.join(spread, "token")
    a, b = (prefix.select("token", *[F.col(c).alias(f"{s}_{c}") for c in prefix.columns if c != "token"]) for s in "ab")
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) * (den + num) >= (F.col("a_n") + F.col("b_n")) * num
    met = a.join(b, "token").where((F.col("a_root") < F.col("b_root")) & room & may_link)
    return met.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", rows_too: bool = False) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` (least key reachable over links, itself included).

    Null, empty and wordless texts have no set and link with nothing; rows with a null key get a null
    component and link with nothing; equal texts, whatever their number, are one class; very long texts are
    sets like others, in bands of their own.  Repeated rows and ties get equal results.  An empty table gives
    none; other columns of ``docs`` are left out.  With ``rows_too`` also ``text_hash``
    (xxhash64 of the text) and ``first``: whether the row has the least (key, text_hash) of its component.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))

    def described(batch):
        sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
        bits = list(zip(*[bitmap(s) for s in sets], strict=True)) or [[]] * 4
        yield {"key": batch.column(0), "th": batch.column(2), "n": [len(s) for s in sets], "class": [class_of(s) for s in sets]} | {f"b{i}": bits[i] for i in range(4)}

    known = written(map_batches(rows.select("key", "text", F.xxhash64("text").alias("th")), described, "key long, th long, n long, class long, b0 long, b1 long, b2 long, b3 long"))
    rows = rows.where("key is not null")
    marks = ["n", "b0", "b1", "b2", "b3"]
    classes = known.where("class is not null and key is not null").groupBy("class").agg(F.min(F.struct("key", "th")).alias("rep"), *[F.min(c).alias(c) for c in marks])
    classes = written(classes)
    most = classes.agg(F.max("n")).head()[0] or 0
    bounds = band_bounds(most)
    lows = [b[0] for b in bounds]
    band = F.size(F.filter(F.lit(lows or [1]), lambda x: x <= F.col("n")))
    counts = {r.band: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}
    plans = [allocate(lo, hi, counts.get(k + 1, 0) + 1, num, den) for k, (lo, hi) in enumerate(bounds)]
    extra = [min([p.extra for p in plans[k :: 1 << BAND_BITS]] or [0]) for k in range(1 << BAND_BITS)]

    edges = written(tied(rows, plans, width, num, den))

    def marked(df: DataFrame, c: str) -> DataFrame:
        return df.join(classes.select(F.col("class").alias(c), *[F.col(m).alias(f"{c}_{m}") for m in marks]), c)

    both = F.col("a_n") + F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in marks[1:]), F.lit(0))
    may_link = (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num) & (apart * (den + num) <= both * (den - num))

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps allow a link, once each."""
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return marked(marked(once, "a"), "b").where(may_link).select("a", "b")

    def sets_of(batch):
        sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
        have = [s for s in sets if len(s)]
        yield {"class": [class_of(s) for s in have], "set": [s.tobytes() for s in have]}

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()

    def sets_for(wanted: DataFrame, have: DataFrame | None) -> DataFrame:
        """Sets of the wanted classes, from the texts of one document each; those at hand stay."""
        if have is not None:
            wanted = wanted.join(have.select("class"), "class", "left_anti")
        keys = written(wanted.join(classes.select("class", "rep.key", "rep.th"), "class"))
        n = keys.count()
        if have is not None and not n:
            return have
        texts = rows.withColumn("th", F.xxhash64("text")).join(broadcast_if_small(keys.select("key", "th")), ["key", "th"], "left_semi").select("text")
        got = written(map_batches(texts, sets_of, "class long, set binary"), codec="none")
        if got.count() > n:  # repeated rows
            got = written(got.dropDuplicates(["class"]), codec="none")
        return got if have is None else have.unionByName(got)

    star = written(close(edges))
    members = edges.select("sig", F.col("a").alias("class")).union(edges.select("sig", F.col("b").alias("class"))).distinct()
    sets = sets_for(ends(star), None)
    links = written(verified(star, sets, num, den))
    roots = components(links)
    left = _open(members, roots, extra, least=3)
    # in a cluster around one text most sets link with that text only: the set that shares most is the hub
    size = left.groupBy("sig").agg(F.count("*").alias("m"))
    weight = left.join(size, "sig").groupBy("class").agg(F.sum("m").alias("w"))
    hub = left.join(weight, "class").groupBy("sig").agg(F.max_by(F.struct("class", "root"), F.struct("w", "class")).alias("h"))
    spokes = left.join(hub, "sig").where("root <> h.root").select(F.col("h.class").alias("a"), F.col("class").alias("b"))
    new = written(close(spokes).join(star, ["a", "b"], "left_anti"))
    sets = sets_for(ends(new), sets)
    found = written(verified(new, sets, num, den))
    if found.head(1):
        links = links.union(found)
        roots = components(links)
        left = _open(left.select("sig", "class"), roots, extra, least=2)
    crowd = written(left.select("class", "root").distinct().join(classes.select("class", *marks), "class"))
    sets = sets_for(crowd.select("class"), sets)
    met = _met_in_prefix(crowd, sets, may_link, num, den)
    crossing = written(met.join(star.union(new), ["a", "b"], "left_anti"))
    more = written(verified(crossing, sets, num, den))
    if more.head(1):
        roots = components(links.union(more))
    roots = written(roots)
    linked = roots.join(classes.select(F.col("class").alias("vertex"), "rep"), "vertex")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    of_class = classes.join(linked.join(least, "root").select(F.col("vertex").alias("class"), "least"), "class", "left").select("class", F.coalesce("least", "rep").alias("least"))
    out = known.join(of_class, "class", "left")
    alone = F.when(F.col("key").isNotNull(), F.coalesce("least.key", "key"))
    more_columns = [F.col("th").alias("text_hash"), F.coalesce((F.col("key") == F.col("least.key")) & (F.col("th") == F.col("least.th")), F.lit(True)).alias("first")] if rows_too else []
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"), *more_columns)
