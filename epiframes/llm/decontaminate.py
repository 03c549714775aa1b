"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are lower-cased runs of ASCII letters, digits and all non-ASCII characters.  The automaton is built
over the items' words; each document streams its words through it, tracking the longest suffix that is a
factor of some item.  Where that length reaches the window, the window's words are hit.  Only stretches
of words that the items know, and that are long enough to hold a window, enter the automaton.

Up to ``BLOCK_WORDS`` words of items are one automaton that every worker holds, and the documents are read once.
With more, the items lie in blocks of at most so many words (an item longer than a block is cut into pieces that
overlap by a window less one word, which have the same windows), and the documents are read three times, however
many blocks there are: once for their anchors, once to send the texts that share an anchor with a block to
that block, once for the verdict.  An anchor is the hash of the least of the short word runs in a window, so equal
windows have equal anchors and a document has few of them.  A block's task builds its automaton and streams the
texts sent to it; blocks that many documents meet are dealt to several tasks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep_only, kept, map_batches, partitions, text_or_empty, written

BLOCK_WORDS = 100_000
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(i if i in _WORD or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemAutomaton:
    """States of the minimal automaton of all factors of all items, with the windows that end in them."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[tuple[int, int, str]] = []  # state of a prefix, its length, item
        self.least = window
        for name, words in items:
            last = 0
            for n, w in enumerate(words, 1):
                last = self._add(last, self.vocab.setdefault(w, len(self.vocab)))
                if n >= window or n == len(words):
                    ends.append((last, min(n, window), name))
            if words:
                self.least = min(self.least, len(words))
        self.windows: dict[int, dict[int, set[str]]] = defaultdict(dict)
        for state, n, name in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.windows[state].setdefault(n, set()).add(name)
        self.chain: dict[int, list[tuple[int, frozenset[str]]]] = {}

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def ending(self, state: int) -> list[tuple[int, frozenset[str]]]:
        """Windows among the suffixes of a state's words: (length, items), longest first."""
        if state not in self.chain:
            found, s = [], state
            while s > 0:
                found += [(n, frozenset(who)) for n, who in self.windows.get(s, {}).items()]
                s = self.link[s]
            self.chain[state] = sorted(found, key=lambda x: -x[0])
        return self.chain[state]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit runs [start, end) of words, and the items whose windows occur."""
        ids = list(map(self.vocab.get, words))
        runs: list[tuple[int, int]] = []
        who: set[str] = set()
        if len(ids) < self.least:
            return runs, who
        ids.append(None)
        start = 0
        while True:
            try:
                stop = ids.index(None, start)
            except ValueError:
                break
            if stop - start >= self.least:
                self._stream(ids, start, stop, runs, who)
            start = stop + 1
        return runs, who

    def _stream(self, ids: list[int], start: int, stop: int, runs: list[tuple[int, int]], who: set[str]) -> None:
        edges, link, length, least = self.next, self.link, self.length, self.least
        state = n = 0
        for i in range(start, stop):
            c = ids[i]
            while state and c not in edges[state]:
                state = link[state]
                n = length[state]
            if c in edges[state]:
                state, n = edges[state][c], n + 1
            if n >= least:
                for size, names in self.ending(state):
                    if size <= n:
                        who |= names
                        a = i + 1 - size
                        while runs and runs[-1][1] >= a:
                            a = min(a, runs.pop()[0])
                        runs.append((a, i + 1))


def item_pieces(items: DataFrame, item_id: str, text: str, limit: int, window: int) -> DataFrame:
    """Rows (chunk, n, item, words), written: items with words, cut where longer than ``limit`` words.

    Each task deals its pieces to chunks of at most ``limit`` words.
    """

    def deal(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                step = limit if len(words) <= limit else limit - window + 1
                for i in range(0, len(words) if len(words) <= limit else len(words) - window + 1, step):
                    piece = words[i : i + limit]
                    if size + len(piece) > limit:
                        chunk, size = chunk + 1, 0
                    size += len(piece)
                    for col, x in zip(out, (chunk, len(piece), name or "", b" ".join(piece)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["chunk", "n", "item", "words"])

    if limit < window:
        raise ValueError("a block must hold a window")
    rows = items.select(F.col(item_id).cast("string").alias("i"), text_or_empty(text).alias("t"))
    return written(rows.mapInArrow(deal, "chunk long, n long, item string, words binary"))


def item_blocks(pieces: DataFrame, limit: int) -> list[list[int]]:
    """Chunks, by their sizes only, put together to blocks of at most ``limit`` words; one empty block if there are none."""
    blocks: list[list[int]] = [[]]
    size = 0
    for r in pieces.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy("chunk").collect():
        if blocks[-1] and size + r.n > limit:
            blocks.append([])
            size = 0
        blocks[-1].append(r.chunk)
        size += r.n
    return blocks


def _block(pieces: DataFrame, chunks: list[int]) -> tuple:
    """What is broadcast for one block: a mark of its own, and its items' words."""
    rows = pieces.where(F.col("chunk").isin(chunks)).select("item", "words").collect() if chunks else []
    return uuid.uuid4().hex, [(r.item, bytes(r.words).split()) for r in rows]


def decontaminate(docs: DataFrame, items: DataFrame, key: list[str], window: int = 13, text: str = "text", item_id: str = "item_id", coverage: int = 20, cut: bool = False) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``items`` (sorted), ``runs`` of hit words, ``contaminated``.

    ``contaminated``: some word is hit and hit words times ``coverage`` reach the words.  With ``cut``, also
    ``clean_text``: the text without its hit runs (from a run's first word to its last).  Null and empty
    texts have no words; items without words have no window; an empty item table hits nothing; a null
    item id counts as an empty string; repeated items count once.  Repeated rows and null keys are judged like
    others; very long texts are streamed whole; an empty table gives none; columns that are not named in ``key``
    are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = item_pieces(items, item_id, text, BLOCK_WORDS, window)
    blocks = item_blocks(pieces, BLOCK_WORDS)
    keys = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key)
    schema = keys + ", n_words long, n_hit long, items array<string>, runs array<int>, contaminated boolean" + (", clean_text string" if cut else "")
    texts = docs.select(*key, text_or_empty(text).alias("_text"))
    if len(blocks) > 1:
        return _judged_by_blocks(texts, pieces, blocks, key, keys, schema, window, coverage, cut)
    n_key, block = len(key), spark.sparkContext.broadcast(_block(pieces, blocks[0]))

    def judged(batch):
        automaton = _automaton(block, window)
        out = {k: batch.column(i) for i, k in enumerate(key)}
        rows = []
        for t in batch.column(n_key).to_pylist():
            words = words_of(t)
            runs, who = automaton.match(words)
            rows.append(_verdict(len(words), runs, who, coverage) + ([without(t, runs)] if cut else []))
        yield out | _columns(rows, cut)

    return map_batches(texts, judged, schema)


def _verdict(n_words: int, runs: list[tuple[int, int]], who: Iterable[str], coverage: int) -> list:
    hit = sum(b - a for a, b in runs)
    return [n_words, hit, sorted(who), [x for r in runs for x in r], hit > 0 and coverage * hit >= n_words]


def _columns(rows: list[list], cut: bool) -> dict[str, list]:
    names = ("n_words", "n_hit", "items", "runs", "contaminated", "clean_text")[: 5 + cut]
    return {name: [r[i] for r in rows] for i, name in enumerate(names)}


#: Words of the runs that anchors are chosen from; and texts that one task of a block gets, about.
RUN, TEXTS_EACH = 5, 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words: equal runs have equal hashes, in any text."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _ODD + h[j : len(h) - k + 1 + j]
    out ^= out >> np.uint64(29)
    return out * _ODD


def anchors(words: list[bytes], k: int) -> np.ndarray:
    """For windows of k words the least hash of the runs inside each; of short windows the hash of the window itself."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    if k <= RUN:
        return np.unique(run_hashes(words, k))
    runs = run_hashes(words, RUN)
    return np.unique(np.lib.stride_tricks.sliding_window_view(runs, k - RUN + 1).min(axis=1))


def _anchored(rows: DataFrame, keep: str, sizes, window: int) -> DataFrame:
    """Rows (what is kept, size, anchor); the words are the last column.  ``sizes`` gives a row's window sizes."""

    def run(batch):
        n = batch.num_columns - 1
        at, out = [], {"_k": [], "_anchor": []}
        for i, t in enumerate(batch.column(n).to_pylist()):
            words = words_of(t) if isinstance(t, str) else bytes(t).split()
            for k in sizes(len(words)):
                got = anchors(words, k).view(np.int64)
                at += [i] * len(got)
                out["_k"] += [k] * len(got)
                out["_anchor"] += got.tolist()
        yield {name: batch.column(j).take(pa.array(at, pa.int32())) for j, name in enumerate(batch.schema.names[:n])} | out

    return map_batches(rows, run, keep + ", _k int, _anchor long")


def _judged_by_blocks(texts: DataFrame, pieces: DataFrame, blocks: list[list[int]], key: list[str], keys: str, schema: str, window: int, coverage: int, cut: bool) -> DataFrame:
    """Texts meet the blocks that they share an anchor with; hits are kept by key and digest of the text, as keys may be null or repeated."""
    spark, n_key = texts.sparkSession, len(key)
    digested = texts.withColumn("_digest", F.sha2("_text", 256)).select(*key, "_digest", "_text")
    named = spark.createDataFrame([(c, i) for i, chunks in enumerate(blocks) for c in chunks], "chunk long, _block int")
    filed = written(pieces.join(named, "chunk").select("_block", "item", "words"))
    theirs = written(_anchored(filed.select("_block", "words"), "_block int", lambda n: (min(n, window),), window).distinct())
    lengths = sorted(r._k for r in theirs.select("_k").distinct().collect())
    ours = _anchored(digested, keys + ", _digest string", lambda n: lengths, window)
    met = written(ours.join(theirs, ["_k", "_anchor"]).select(*key, "_digest", "_block").distinct())
    # blocks that many texts meet go to several tasks
    deals = [(r._block, int(1 + r.n // TEXTS_EACH)) for r in met.groupBy("_block").agg(F.count("*").alias("n")).collect()]
    deal = F.broadcast(spark.createDataFrame(deals, "_block int, _deals int"))  # one row a block
    sent = _same(digested.alias("l"), met.join(deal, "_block").alias("r"), key, "inner")
    sent = sent.select(*[F.col(f"l.`{k}`") for k in key], "l._digest", "l._text", "r._block", F.pmod(F.xxhash64("l._digest"), F.col("r._deals")).cast("int").alias("_part"), F.lit(1).alias("_kind"))
    held = filed.join(deal, "_block").select("_block", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_part"), "item", "words", F.lit(0).alias("_kind"))
    both = sent.unionByName(held, allowMissingColumns=True).repartition(partitions(spark), "_block", "_part").sortWithinPartitions("_block", "_part", "_kind")
    found = keys + ", _digest string, _runs array<int>, _items array<string>"
    hits = written(_streamed_blocks(both.select(*key, "_digest", "_text", "_block", "_part", "_kind", "item", "words"), found, key, window))
    hits = hits.groupBy(*key, "_digest").agg(F.flatten(F.collect_set("_runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))

    def counted(batch):
        kept = {k: batch.column(i) for i, k in enumerate([*key, "_digest", "_text"])}
        kept["_n"] = [len(words_of(t)) for t in kept["_text"].to_pylist()]
        yield kept

    def judged(batch):
        out = {k: batch.column(i) for i, k in enumerate(key)}
        rows = []
        for n, flat, who, *t in zip(*[c.to_pylist() for c in batch.columns[n_key:]], strict=True):
            runs = merged(list(zip(flat[::2], flat[1::2], strict=True))) if flat else []
            rows.append(_verdict(n, runs, who or (), coverage) + ([without(t[0], runs)] if cut else []))
        yield out | _columns(rows, cut)

    left = map_batches(digested, counted, keys + ", _digest string" + (", _text string" if cut else "") + ", _n long").alias("l")
    joined = _same(left, hits.alias("r"), key, "left")
    return map_batches(joined.select(*[F.col(f"l.`{k}`") for k in key], "l._n", "r._runs", "r._items", *(["l._text"] if cut else [])), judged, schema)


def _same(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """Joined by key, null or not, and digest; the sides are called l and r."""
    same = F.col("l._digest") == F.col("r._digest")
    for k in key:
        same &= F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    return left.join(right, same, how)


def _streamed_blocks(rows: DataFrame, found: str, key: list[str], window: int) -> DataFrame:
    """Sorted rows of blocks: a block's items come first and make its automaton, its texts follow."""
    n_key = len(key)

    def run_all(batches):
        keep_only(__name__)
        at, items, automaton = None, [], None
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_block", "_part", "_kind", "item", "words", "_text")]
            took, runs_of, items_of = [], [], []
            for i, (block, part, kind, item, words, text) in enumerate(zip(*cols, strict=True)):
                if (block, part) != at:
                    at, items, automaton = (block, part), [], None
                if kind == 0:
                    items.append((item, bytes(words).split()))
                    continue
                automaton = automaton or ItemAutomaton(items, window)
                runs, who = automaton.match(words_of(text))
                if runs:
                    took.append(i)
                    runs_of.append([x for r in runs for x in r])
                    items_of.append(sorted(who))
            index = pa.array(took, pa.int32())
            kept = [batch.column(i).take(index) for i in range(n_key + 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(runs_of, pa.list_(pa.int32())), pa.array(items_of, pa.list_(pa.string()))], names=[*batch.schema.names[: n_key + 1], "_runs", "_items"])

    return rows.mapInArrow(run_all, found)


def _automaton(block, window: int) -> ItemAutomaton:
    """Built once per Python worker and block; a worker holds one."""
    mark, items = block.value
    held = kept(__name__, "automaton", dict)
    if (mark, window) not in held:
        held.clear()
        held[mark, window] = ItemAutomaton(items, window)
    return held[mark, window]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the characters from each run's first word to its last."""
    if not runs:
        return text
    import re

    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]
