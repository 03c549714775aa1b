"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank over the whole corpus, so the commonest take one byte.  A block
holds the documents' keys and lengths, then one control byte for every four ids (two bits each: bytes of
that id less one), then the data bytes.  Blocks are rows of Parquet files, which brings Spark's commit
protocol, retries and any file system; the files follow ascending document order.  Decoding looks control
bytes up in a table of byte counts and gathers all ids of a block at once.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_symbols
from .chunks import grouped, slices
from .common import bounded_batches, kept, map_batches, partitions, text_or_empty

MAGIC, VERSION = b"EFTK", 2
_HEAD = struct.Struct("<4sIqqqI")  # magic, version, documents, those of them with a null key (they come first), ids, crc32 of what follows
#: Bytes of ids that are counted at once.
COUNT_BYTES = 1 << 20
#: Characters that are encoded at once.
GROUP_CHARS = 2 << 20
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 19
#: Pieces that are encoded as one text.
JOINED = 1 << 12
#: Pieces of a worker's table, and the bytes of the longest ones in it: bound its memory and never change results.
TABLE_ENTRIES, KEPT_BYTES = 500_000, 256
#: Letters in every version of Unicode since long: where they end, and where they begin after a single line break, a
#: pre-token ends, whatever follows.  So does one of ASCII signs before a line break.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-ҁ"
_LETTER = re.compile(f"[{LETTERS}]")
#: Bytes of each of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_block(keys: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, nulls: int = 0) -> bytes:
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    four[: len(code)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    body = keys.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + control.tobytes() + data.tobytes()
    return _HEAD.pack(MAGIC, VERSION, len(keys), nulls, len(ranks), zlib.crc32(body)) + body


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys, sizes and ranks of a block, and how many keys at its start are null."""
    magic, version, n_docs, nulls, n_ids, crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc:
        raise ValueError("not a block of token ids, or a damaged one")
    keys, sizes = np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, "<u4", n_docs, 8 * n_docs)
    control = np.frombuffer(body, np.uint8, -(-n_ids // 4), 12 * n_docs)
    data = np.frombuffer(body, np.uint8, offset=12 * n_docs + len(control))
    size = LENGTHS[control].ravel()[:n_ids].astype(np.int64)
    at = np.cumsum(size) - size
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return keys, sizes, ranks, nulls


def _flags() -> np.ndarray:
    """Of each byte, in bits: an ASCII letter, a sign that ends letters, a sign that ends before a line break, visible ASCII."""
    found = [re.compile(x) for x in ("[A-Za-z]", r"[!-@\[-`{-~\n]", r"[!-/:-@\[-`{-~]", "[!-~]")]
    return np.array([sum(1 << k for k, x in enumerate(found) if c < 128 and x.match(chr(c))) for c in range(256)], np.uint8)


FLAGS = _flags()
#: Letters of two bytes, by code point.
TWO_BYTES = np.array([bool(_LETTER.match(chr(c))) for c in range(1 << 11)])
#: White space in UTF-8 beyond ASCII, by its two or three bytes; U+180E was white space once.
WHITE = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])


def flagged(data: np.ndarray) -> np.ndarray:
    """The flags of UTF-8 bytes; both bytes of a longer letter are letters."""
    flags = FLAGS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xD2))
    lead = lead[TWO_BYTES[(data[lead] & 31).astype(np.int32) << 6 | data[lead + 1] & 63]]
    flags[lead] = flags[lead + 1] = 1
    return flags


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, which lie one behind the other as UTF-8, and the last one's end.

    No pre-token crosses a cut: before a space with no white space behind it, where letters end, where ASCII signs end
    before a line break, and after a single line break before a letter.  ``ends``: of all texts.
    """
    flags = flagged(data)
    line = data == 10
    cut = np.zeros(len(data) + 1, bool)
    inner = cut[1:-1]
    inner |= (flags[:-1] & flags[1:] >> 1 & 1).view(bool)
    inner |= (flags[:-1] & 4).astype(bool) & line[1:]
    cut[2:-1] |= (flags[:-2] & 8).astype(bool) & line[1:-1] & (flags[2:] & 1).view(bool)
    space = data == 32
    space[ends - 1] = False  # what follows is another text
    space = np.flatnonzero(space)
    after = data[space + 1]
    some = np.flatnonzero((after == 0xC2) | (after >= 0xE1) & (after <= 0xE3))
    at = space[some] + 1
    code = data[at].astype(np.int32) << 8 | data[at + 1]
    code = np.where(after[some] == 0xC2, code, code << 8 | data[np.minimum(at + 2, len(data) - 1)])
    good = (after > 32) & (after != 127)
    good[some] = ~np.isin(code, WHITE)
    cut[space[good]] = True
    cut[0] = True
    cut[ends] = True
    return np.flatnonzero(cut).astype(np.int32)


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ids one behind the other."""
    at = np.repeat(start - starts(size), size)
    at += np.arange(len(at))
    return ids[at]


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Encoder:
    """The library's ids of pieces between cuts no token crosses, kept in a bounded table.

    Texts are cut as bytes, and each distinct piece of a group is looked up once; only pieces that the table does not
    have go to the library, many at a time.  Cuts hold for byte-level BPE as such; with any other set-up whole texts
    are encoded.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores out
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.kind = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.lib.to_str())
        way = spec["pre_tokenizer"] or {}
        self.by_pieces = way.get("type") == "ByteLevel" and way.get("use_regex") and not way.get("add_prefix_space") and not (spec["normalizer"] or spec["truncation"] or spec["padding"])
        self.by_pieces = self.by_pieces and not any(" " in t for t in self.special)
        model = spec["model"]
        self.by_pieces = self.by_pieces and model["type"] == "BPE"
        symbols = byte_symbols()
        space = symbols[32]
        self.spaced = np.zeros(self.lib.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.lib.get_vocab().items() if t.startswith(space)]] = True
        if self.by_pieces:
            self.words = self.words_only(model)
            self.symbol = np.array([ord(c) for c in symbols], "<u4")
        # the table: pieces, how many ids each has, the ids, and the group that saw the piece last
        self.entries = entries
        self.known, self.size, self.ids, self.seen, self.group = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64), 0

    def words_only(self, model: dict):
        """The library on words in symbols, one pre-token each: it has nothing to match, and keeps nothing, as each comes once."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        same = {k: v for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if (v := model.get(k)) is not None}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        out = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **same))
        out.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return out

    def each(self, texts: list[str], lib=None) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in (lib or self.lib).encode_batch_fast(texts, add_special_tokens=False)]

    def fill(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has.

        Words and pieces with a space before them are encoded as one text, which the tokens that begin with a space cut again.
        """
        offsets, data = _raw(new)
        first = offsets[:-1]
        other = (flagged(data) & 1) == 0
        spaced = data[first] == 32
        other[first[spaced]] = np.diff(offsets)[spaced] == 1
        word = ~np.logical_or.reduceat(other, first)
        rest = np.flatnonzero(~word)
        texts = dict(zip(rest.tolist(), new.take(pa.array(rest)).to_pylist(), strict=True))
        joined = np.array([i for i, p in texts.items() if len(p) > 1 and p[0] == " " and " " not in p[1:]], np.int64)
        single = [i for i, p in texts.items() if not (len(p) > 1 and p[0] == " " and " " not in p[1:])]
        order, size, ids = [], [], []
        for some, encoded in ((np.flatnonzero(word & spaced), self.symbols_of), (joined, self.text_of)):
            for at in range(0, len(some), JOINED):
                part = some[at : at + JOINED]
                got = np.array(encoded(new.take(pa.array(part))), self.kind)
                begin = np.flatnonzero(self.spaced[got])
                if len(begin) != len(part):  # some cut is none
                    single += part.tolist()
                    continue
                order.append(part)
                size.append(np.diff(begin, append=len(got)))
                ids.append(got)
        heads = np.flatnonzero(word & ~spaced)
        for some, found in ((heads, self.each(self.in_symbols(new.take(pa.array(heads)), " ").split(" ")[1:], self.words)), (single, self.each(new.take(pa.array(single, pa.int64())).to_pylist()))):
            order.append(np.array(some, np.int64))
            size.append(np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize)
            ids.append(np.frombuffer(b"".join(found), self.kind))
        order, size, ids = np.concatenate(order), np.concatenate(size), np.concatenate(ids)
        back = np.argsort(order)
        return gathered(ids, starts(size)[back], size[back]), size[back]

    def in_symbols(self, words: pa.Array, before: str) -> str:
        offsets, data = _raw(words)
        return np.insert(self.symbol[data], offsets[:-1], ord(before)).tobytes().decode("utf-32-le")

    def text_of(self, part: pa.Array) -> list[int]:
        return self.lib.encode_batch_fast(["".join(part.to_pylist())], add_special_tokens=False)[0].ids

    def symbols_of(self, part: pa.Array) -> list[int]:
        return self.words.encode_batch_fast([self.in_symbols(part, " ")], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Special strings as their own ids, long texts in slices."""
        if not self.by_pieces:
            return self.each(texts)
        special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        spans: list[str] = []
        made: list[list[bytes | int]] = []  # of each text: ids of special strings, and numbers of spans
        for t in texts:
            made.append(of := [])
            for p in special.split(t) if any(s in t for s in self.special) else [t]:
                if p in self.special:
                    of.append(np.array([self.special[p]], self.kind).tobytes())
                else:
                    for first, s in slices(p):
                        of.append(len(spans))
                        spans.append(s if first else " " + s)
        found = [x for g in grouped(spans, GROUP_CHARS) for x in self.regular(g)]
        return [found[of[0]] if len(of) == 1 and isinstance(of[0], int) else b"".join(found[x] if isinstance(x, int) else x for x in of) for of in made]

    def regular(self, texts: list[str]) -> list[bytes]:
        """Each distinct piece is looked up once, and ids are gathered by number."""
        column = pa.array(texts, pa.string())
        ends, data = _raw(column)
        if not len(data):
            return [b""] * len(texts)
        cut = cuts(data, ends[1:])
        named = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), column.buffers()[2]).dictionary_encode()
        number = named.indices.to_numpy()
        ids, start, size = self.table(named.dictionary)
        each = size[number]
        total = gathered(ids, start[number], each)
        stops = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(cut, ends)].tolist()
        return [total[x:y].tobytes() for x, y in zip(stops, stops[1:])]

    def table(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece start and how many they are; what was not known is from now on."""
        self.group += 1
        # the group's pieces are fewer than the table's, so they are what is hashed
        met = pc.index_in(self.known, value_set=distinct).fill_null(-1).to_numpy()
        again = np.flatnonzero(met >= 0)
        place = np.full(len(distinct), -1)
        place[met[again]] = again
        self.seen[again] = self.group
        gaps = np.flatnonzero(place < 0)
        if not len(gaps):
            return self.ids, starts(self.size)[place], self.size[place]
        new = distinct.take(pa.array(gaps))
        more, more_size = self.fill(new)
        ids, size = np.concatenate([self.ids, more]), np.concatenate([self.size, more_size])
        start = starts(size)
        place[gaps] = len(self.known) + np.arange(len(gaps))
        out = ids, start[place], size[place]
        self.known, self.size, self.ids = pa.concat_arrays([self.known, new]), size, ids
        self.seen = np.concatenate([self.seen, np.full(len(new), self.group)])
        short = pc.binary_length(new).to_numpy() <= KEPT_BYTES
        if len(size) > self.entries or not short.all():
            keep = np.concatenate([np.ones(len(size) - len(new), bool), short])
            if keep.sum() > self.entries:  # three quarters, those seen last, stay
                last = np.flatnonzero(keep)[np.argsort(self.seen[keep], kind="stable")]
                keep[last[: len(last) - self.entries * 3 // 4]] = False
            keep = np.flatnonzero(keep)
            self.known, self.seen = self.known.take(pa.array(keep)), self.seen[keep]
            self.ids, self.size = gathered(ids, start[keep], size[keep]), size[keep]
        return out


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings that begin at the start of their buffers."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(strings) + 1) if len(strings) else np.zeros(1, np.int32)
    return offsets, np.frombuffer(data, np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8)


def encoder(path: str) -> Encoder:
    return kept(__name__, path, lambda: Encoder(path))


class Order(NamedTuple):
    """Runs of the order null keys first, then ascending keys; rows of one key by the hash of their text.

    A key that fills several runs, and the null keys, are dealt over their runs by that hash, in its order.
    """

    nulls: int  # runs of null keys alone
    cuts: np.ndarray  # sorted; a value that is there k times has k + 1 runs

    def run(self, key: np.ndarray, null: np.ndarray, share: np.ndarray) -> np.ndarray:
        """``share``: the hash's place between 0 and 1."""
        first, last = np.searchsorted(self.cuts, key, "left"), np.searchsorted(self.cuts, key, "right")
        own = self.nulls + first + ((last - first + 1) * share).astype(np.int64)
        return np.where(null, (max(self.nulls, 1) * share).astype(np.int64), own).astype(np.int32)


def _order(docs: DataFrame, key: str, n: int) -> Order:
    long = F.col(key).cast("long")
    rows, nulls, cuts = docs.agg(F.count("*"), F.count_if(long.isNull()), F.percentile_approx(long, [i / max(n, 2) for i in range(1, max(n, 2))], 10_000)).head()
    k = min(n - 1, round(n * nulls / rows)) if rows else 0
    cuts = np.array(cuts or [], np.int64)
    return Order(k, cuts[np.round(np.linspace(0, len(cuts) - 1, n - k + 1)[1:-1]).astype(np.int64)] if len(cuts) and n - k > 1 else cuts[:0])


def ordered_ids(docs: DataFrame, key: str, path: str, end_id: int, text: str) -> tuple[DataFrame, str]:
    """Rows (k, h, ids) in ascending order of the key (null first, k is null) over the partitions, ids as little-endian bytes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    kind = encoder(path).kind.str
    order = _order(docs, key, n)

    def encoded(batch):
        out: list[bytes] = []
        end = np.array([end_id], kind).tobytes()
        for group in grouped(batch.column(1).to_pylist(), GROUP_CHARS):
            out += [x + end for x in encoder(path).encode(group)]
        share = (batch.column(2).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) / 2.0**64  # in the order of signed longs
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        yield {"run": order.run(batch.column(0).fill_null(0).to_numpy(), null, np.minimum(share, 1 - 2.0**-53)), "k": batch.column(0), "h": batch.column(2), "ids": out}

    rows = map_batches(docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("_text"), F.xxhash64(text_or_empty(text)).alias("h")), encoded, "run int, k long, h long, ids binary")
    return rows.repartitionById(n, "run").sortWithinPartitions("k", "h", "ids").select("k", "ids"), kind


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write ``folder``/ids (blocks) and ``folder``/ranks (one row: ids by rank).

    Null and empty texts hold the end id only.  Null keys stay null and come first; rows of one key are in the
    order of a hash of their texts, so repeated ids and ties give the same files each time, and repeated rows
    stay.  Very long texts are encoded in slices.  An empty table gives files without blocks; other columns are
    left out.  Both passes, counting and writing, read the same shuffled partitions; a lost part is recomputed
    by Spark.
    """
    spark = docs.sparkSession
    ordered, kind = ordered_ids(docs, key, path, end_id, text)
    rows = ordered.rdd
    size = max(encoder(path).lib.get_vocab_size(), end_id + 1)

    def counts(part) -> Iterator[np.ndarray]:
        total = np.zeros(size, np.int64)
        held, n = [], 0
        for r in part:
            held.append(r.ids)
            n += len(r.ids)
            if n >= COUNT_BYTES:
                total += np.bincount(np.frombuffer(b"".join(held), kind), minlength=size)
                held, n = [], 0
        yield total + np.bincount(np.frombuffer(b"".join(held), kind), minlength=size)

    total = rows.mapPartitions(counts).treeAggregate(np.zeros(size, np.int64), np.add, np.add, depth=2)
    by_rank = np.argsort(-total, kind="stable").astype("<u4")
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(run: int, part) -> Iterator[tuple]:
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        n = start = block = 0
        for r in part:
            keys.append(r.k)
            held.append(np.frombuffer(r.ids, kind))
            n += len(held[-1])
            if n >= BLOCK_IDS:
                yield run, block, start, n, bytearray(_packed(keys, held, shared.value))
                keys, held, n, start, block = [], [], 0, start + n, block + 1
        if keys:
            yield run, block, start, n, bytearray(_packed(keys, held, shared.value))

    spark.createDataFrame(rows.mapPartitionsWithIndex(blocks), "run int, block int, start long, n long, payload binary", verifySchema=False).write.option("compression", "none").parquet(f"{folder}/ids")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "by_rank binary").write.parquet(f"{folder}/ranks")


def _packed(keys: list[int | None], held: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    nulls = sum(k is None for k in keys)
    return pack_block(np.array([k or 0 for k in keys], np.int64), np.array([len(h) for h in held], np.uint32), rank_of[np.concatenate(held)], nulls)


def read_token_files(spark, folder: str, full: bool = False) -> DataFrame:
    """Per document, from the files: ``key``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``; with ``full`` the ids."""
    ids = spark.read.parquet(f"{folder}/ids")
    ranks = spark.read.parquet(f"{folder}/ranks").head()[0]
    sums = {r.run: r["n"] for r in ids.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for run in sorted(sums):
        before[run] = total
        total += sums[run]
    shared = spark.sparkContext.broadcast((np.frombuffer(ranks, "<u4"), before))

    def decoded(batch):
        by_rank, offset = shared.value
        for run, start, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            keys, sizes, rank, nulls = unpack_block(block.as_py())
            raw = by_rank[rank]
            ends = np.cumsum(sizes.astype(np.int64))
            starts = ends - sizes
            out = {"key": pa.array(keys, mask=np.arange(len(keys)) < nulls), "start": starts + start + offset[run], "n_tokens": sizes.astype(np.int64)}
            out["ids_crc32"] = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield out | ({"ids": [raw[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]} if full else {})

    return map_batches(ids.select("run", "start", "payload"), decoded, "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if full else ""))
