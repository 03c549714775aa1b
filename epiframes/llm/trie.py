"""Prefix trie of conversations by vertical bitmaps, shard by shard, merged over the cluster.

Texts never leave their scan: a turn is a 128-bit digest of (role, text) and a word count.  Conversations lie
in ranges of their ids; a task cuts its range into shards of a bounded number of conversations and turns.
In a shard each (position, turn) has a bitset of the shard's conversations, and each length a bitset of those
that end there.  A depth-first walk takes the parent's bitset, splits the ended ones off, and intersects what
is left with the posting of its lowest conversation's next turn: each intersection gives one child.

Nodes of different shards are equal when their prefixes are; a prefix is named by the exclusive or of two
64-bit hashes of (position, turn digest), 128 bits in all.  A node that very many conversations share comes
with one row for each shard, so nothing hot is gathered.  Sums over subtrees need no rounds over the levels:
every node is counted where its smallest member lies, whose shard holds the whole path above it, so each
shard sums in preorder and the sums of equal nodes are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, written

#: Conversations and turns of a shard: bound a bitset and what a task holds.  Longer conversations are cut.
SHARD_CONVS, SHARD_TURNS = 2048, 40_000
WORD = r"[^\x20\x09-\x0D]+"
#: Turns that a rebuilt conversation takes over at most, and conversations that share a leader.
MOST_HEAD, GROUP = 3, 20

_LOCAL = "shard long, pos int, size int, up int, ghost boolean, a long, b long, pa long, pb long, depth long, words long, local_n long, conv_id long, local_ends long, piece string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """One slim row a turn: conv_id, turn, role, digest (16 bytes), words.  Null roles and texts are empty; rows without a conv_id belong to no conversation and go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def own_turns(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: rows (conv_id, at, digest, words), with one at -1 for the start of each."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    rows = turns.repartitionByRange(partitions(turns.sparkSession), "conv_id").withColumn("p", F.row_number().over(order) - 1)
    return _unfolded(rows, F.array(_element(F.col("p"), F.struct("digest", "words"))))


def rebuilt_turns(turns: DataFrame, most_head: int = MOST_HEAD, group: int = GROUP) -> DataFrame:
    """Conversation c with the first h turns of its leader c - c % group in place of its own, h = crc32(c) % (most_head + 1).

    One exchange: a leader and its followers lie together, and the leader's first turns reach them by a window.
    """
    conv, head = F.col("conv_id"), Window.partitionBy("lead")
    order = Window.partitionBy("lead", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    rows = turns.withColumn("lead", conv - conv % group).repartitionByRange(partitions(turns.sparkSession), "lead")
    rows = rows.withColumn("p", F.row_number().over(order) - 1).withColumn("h", F.crc32(conv.cast("string").cast("binary")) % (most_head + 1))
    first = [F.max(F.when((conv == F.col("lead")) & (F.col("p") == k), F.struct("digest", "words"))).over(head) for k in range(most_head)]
    rows = rows.withColumns({f"head{k}": x for k, x in enumerate(first)})
    heads = F.filter(F.array(*[_element(F.lit(k), F.when(F.col("h") > k, F.col(f"head{k}"))) for k in range(most_head)]), lambda x: x["digest"].isNotNull())
    taken = F.when(F.col("p") == 0, heads).otherwise(F.array().cast(heads_type()))
    own = F.when(F.col("p") >= F.col("h"), F.array(_element(F.col("p"), F.struct("digest", "words")))).otherwise(F.array().cast(heads_type()))
    return _unfolded(rows, F.concat(taken, own), "lead")


def heads_type() -> str:
    return "array<struct<at:int,digest:binary,words:bigint>>"


def _element(at: Column, turn: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), turn["digest"].alias("digest"), turn["words"].alias("words"))


def _unfolded(rows: DataFrame, elements: Column, *keep: str) -> DataFrame:
    start = F.when(F.col("p") == 0, F.array(_element(F.lit(-1), F.struct(F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))))).otherwise(F.array().cast(heads_type()))
    return rows.select("conv_id", *keep, F.inline(F.concat(start, elements)))


def prefixes(rows: DataFrame) -> DataFrame:
    """Depth, prefix name (a, b), word count and end flag of each (conversation, depth); depth 0 is the root."""
    by = [c for c in ("lead", "conv_id") if c in rows.columns]
    order = Window.partitionBy(*by).orderBy("at")
    numbered = rows.withColumn("depth", (F.row_number().over(order) - 1).cast("long")).withColumn("ends", F.lead("at").over(order).isNull())
    name = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(salt), "depth", "digest")).otherwise(F.lit(0).cast("long")) for salt in (0x5EED, 0xC0DE)]
    return numbered.select(*by, "depth", "ends", "words", "digest", F.bit_xor(name[0]).over(order).alias("a"), F.bit_xor(name[1]).over(order).alias("b"))


class Shard:
    """Conversations of one shard, by columns; ``cut`` if the first goes on from the shard before."""

    def __init__(self) -> None:
        self.convs: list[int] = []
        self.first: list[int] = []  # row of each conversation's start
        self.rows: list[tuple] = []  # (depth, ends, words, digest, a, b)

    def add(self, conv: int, row: tuple) -> None:
        if not self.convs or self.convs[-1] != conv:
            self.convs.append(conv)
            self.first.append(len(self.rows))
        self.rows.append(row)

    def full(self, conv: int) -> bool:
        return len(self.rows) >= SHARD_TURNS or len(self.convs) >= SHARD_CONVS and conv != self.convs[-1]

    def nodes(self) -> dict[str, list]:
        """The shard's trie in preorder: see ``_LOCAL``."""
        rows, first = self.rows, self.first
        last = [*first[1:], len(rows)]
        starts = [rows[f][0] for f in first]
        postings: dict[tuple, int] = {}
        ended: dict[int, int] = {}
        roots = 0
        for i, (f, g) in enumerate(zip(first, last, strict=True)):
            bit = 1 << i
            if starts[i]:
                continue  # goes on from another shard: a chain of its own
            roots |= bit
            for r in rows[f + 1 : g]:
                k = r[0], r[3]
                postings[k] = postings.get(k, 0) | bit
            if rows[g - 1][1]:
                d = rows[g - 1][0]
                ended[d] = ended.get(d, 0) | bit
        out: dict[str, list] = {k: [] for k in ("pos", "up", "ghost", "a", "b", "pa", "pb", "depth", "words", "local_n", "conv_id", "local_ends", "piece")}
        columns = list(out.values())[1:]

        def emit(i: int, r: tuple, up: int, ghost: bool, n: int, ends: str | None, n_ends: int) -> int:
            at = len(out["pos"])
            out["pos"].append(at)
            pa_, pb = (out["a"][up], out["b"][up]) if up >= 0 else (None, None)
            for c, v in zip(columns, (up, ghost, r[4], r[5], pa_, pb, r[0], r[2], n, self.convs[i], n_ends, ends), strict=True):
                c.append(v)
            return at

        def chain(i: int, k: int, up: int) -> None:
            """What only conversation i goes through, from its row k on."""
            for r in rows[k : last[i]]:
                up = emit(i, r, up, False, 1, str(self.convs[i]) if r[1] else None, int(r[1]))

        for i, f in enumerate(first):
            if starts[i]:
                chain(i, f + 1, emit(i, rows[f], -1, True, 0, None, 0))
        stack = [(roots, 0, -1)] if roots else []
        while stack:
            members, depth, up = stack.pop()
            low = (members & -members).bit_length() - 1
            if members.bit_count() == 1:
                chain(low, first[low] + depth, up)
                continue
            done = members & ended.get(depth, 0)
            ids = ",".join(str(self.convs[i]) for i in bits(done)) if done else None
            at = emit(low, rows[first[low] + depth], up, False, members.bit_count(), ids, done.bit_count())
            rest, children = members ^ done, []
            while rest:
                i = (rest & -rest).bit_length() - 1
                k = first[i] + depth + 1
                if k >= last[i]:  # the shard was cut here; the rest of this conversation lies in the next one
                    rest ^= 1 << i
                    continue
                child = rest & postings[depth + 1, rows[k][3]]
                children.append((child, depth + 1, at))
                rest ^= child
            stack += reversed(children)
        size = [1] * len(out["pos"])
        for at in range(len(size) - 1, -1, -1):
            if out["up"][at] >= 0:
                size[out["up"][at]] += size[at]
        return out | {"size": size}


def bits(x: int) -> Iterator[int]:
    """Positions of the set bits, ascending."""
    for at, byte in enumerate(x.to_bytes((x.bit_length() + 7) // 8, "little")):
        while byte:
            low = byte & -byte
            yield at * 8 + low.bit_length() - 1
            byte ^= low


def local_tries(rows: DataFrame) -> DataFrame:
    """The tries of all shards; rows lie in ranges of conv_id.  A shard is named by its task and its number there."""
    bounded_batches(rows.sparkSession)
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_LOCAL))

    def run(batches):
        task, number, shard = TaskContext.get().partitionId(), 0, Shard()

        def flush():
            got = shard.nodes()
            n = len(got["pos"])
            got["shard"] = [(task << 32) + number] * n
            yield from pa.Table.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow).to_batches(max_chunksize=10_000)

        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            fields = zip(*[batch.column(k).to_pylist() for k in ("depth", "ends", "words", "digest", "a", "b")], strict=True)
            for conv, row in zip(convs, fields, strict=True):
                if shard.rows and shard.full(conv):
                    yield from flush()
                    before, number, fresh = shard, number + 1, Shard()
                    if conv == before.convs[-1]:
                        fresh.add(conv, (before.rows[-1][0], False, *before.rows[-1][2:]))
                    shard = fresh
                shard.add(conv, row)
        if shard.rows:
            yield from flush()

    by = [c for c in ("lead", "conv_id", "depth") if c in rows.columns]
    return rows.sortWithinPartitions(*by).select("conv_id", "depth", "ends", "words", "digest", "a", "b").mapInArrow(run, _LOCAL)


_SUMS = "a long, b long, shard long, ghost boolean, conv_id long, depth long, owner boolean, n long, kids long, parent long, leaves long, saved long"


def _summed(shard: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of one shard, in preorder; ``leaf`` and ``gain`` are what each row adds."""
    x = shard.sort_values("pos", kind="stable")
    at, size, up = (x[k].to_numpy() for k in ("pos", "size", "up"))
    out = x[["a", "b", "shard", "ghost", "conv_id", "depth", "owner", "n", "kids"]].copy()
    for name, part in (("leaves", "leaf"), ("saved", "gain")):
        run = np.concatenate([[0], np.cumsum(x[part].to_numpy(dtype=np.int64))])
        out[name] = run[at + size] - run[at]
    holders = x["holder"].to_numpy(dtype=np.int64)
    out["parent"] = pd.array(np.where(up >= 0, holders[up], 0), dtype="Int64")
    out.loc[up < 0, "parent"] = pd.NA
    return out


def _streamed_ends(pieces: DataFrame) -> DataFrame:
    """SHA-256 of end lists that several shards hold parts of: one pass in the order of the ids, one part in memory at a time."""

    def run(batches):
        key, sha = None, None
        for batch in batches:
            done = {"a": [], "b": [], "ends_sha": []}
            for a, b, piece in zip(*[batch.column(k).to_pylist() for k in ("a", "b", "piece")], strict=True):
                if key != (a, b):
                    if key:
                        done["a"].append(key[0]), done["b"].append(key[1]), done["ends_sha"].append(sha.hexdigest())
                    key, sha = (a, b), hashlib.sha256()
                    sha.update(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pydict(done, schema)
        if key:
            yield pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "ends_sha": [sha.hexdigest()]}, schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha", pa.string())])
    ordered = pieces.repartition(partitions(pieces.sparkSession), "a", "b").sortWithinPartitions("a", "b", "conv_id")
    return ordered.select("a", "b", "piece").mapInArrow(run, "a long, b long, ends_sha string")


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row per trie node, named by its smallest member and its depth.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as the
    contract of the trie query has them; ``rebuild`` mixes each conversation with its leader first.

    Turns are ordered by turn (nulls first), then role, then digest, so ties and repeated rows have one order;
    rows without a conv_id go; null roles and texts are empty; other columns are ignored; an empty table has no
    conversation and so no root.  A conversation of more than ``SHARD_TURNS`` turns goes through several
    shards: its sums are carried back by a second pass over the shards that it leaves.
    """
    turns = written(turns_of(conversations))
    rows = prefixes(rebuilt_turns(turns) if rebuild else own_turns(turns))
    local = written(local_tries(rows))
    same = Window.partitionBy("a", "b")
    merged = local.withColumns({"n": F.sum("local_n").over(same), "holder": F.min("conv_id").over(same), "parts": F.count("piece").over(same)})
    merged = written(merged.withColumn("owner", (F.col("conv_id") == F.col("holder")) & ~F.col("ghost")))
    kids = merged.where("owner AND pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    known = merged.drop("piece").join(kids, ["a", "b"], "left").fillna(0, ["kids"])
    added = known.withColumns({"leaf": (F.col("owner") & (F.col("kids") == 0)).cast("long"), "gain": F.when(F.col("owner"), (F.col("n") - 1) * F.col("words")).otherwise(0)})
    sums = written(added.groupBy("shard").applyInPandas(_summed, _SUMS))
    ghosts = sums.where("ghost")
    if ghosts.head(1):
        sums = sums.union(_carried(added, ghosts))
    own = lambda c: F.max(F.when(F.col("owner"), F.col(c)))
    nodes = sums.where("NOT ghost").groupBy("a", "b").agg(own("conv_id").alias("conv_id"), own("depth").alias("depth"), own("parent").alias("parent_conv_id"), own("n").alias("n_convs"), own("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    listed = merged.where("piece IS NOT NULL").select("a", "b", "conv_id", "piece", "parts")
    ends = listed.where("parts = 1").select("a", "b", F.sha2("piece", 256).alias("ends_sha")).union(_streamed_ends(listed.where("parts > 1")))
    got = nodes.join(ends, ["a", "b"], "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _carried(added: DataFrame, ghosts: DataFrame) -> DataFrame:
    """Sums of the later parts of long conversations, for the nodes above the cuts.

    ``ghosts`` are the cut nodes as the later shards hold them, with the sums of one part each; this part and the
    ones after it count for the node where the cut was made, which lies in the shard before, and for what is above it there.
    """
    later = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    cuts = ghosts.select((F.col("shard") - 1).alias("shard"), "a", "b", F.sum("leaves").over(later).alias("leaf"), F.sum("saved").over(later).alias("gain"))
    places = added.drop("leaf", "gain")
    at = written(places.where("NOT ghost").join(cuts, ["shard", "a", "b"]).select("shard", "pos", "leaf", "gain"))
    shards = places.join(at.select("shard").distinct(), "shard", "left_semi")
    again = shards.join(at, ["shard", "pos"], "left").fillna(0, ["leaf", "gain"])
    return again.groupBy("shard").applyInPandas(_summed, _SUMS).withColumn("owner", F.lit(False)).where("NOT ghost")
