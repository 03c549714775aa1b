"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie one behind the other in one symbol array.  Each round looks up the ranks of all
neighbouring pairs, takes every sequence's lowest rank with a segmented minimum, merges all its
occurrences at once, and drops the sequences that have no pair left; the survivors are counted.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SLICE_CHARS, Cache, grouped, pieces, slices, whole
from .common import bounded_batches, kept, map_batches, text_or_empty

#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1 << 40)
#: Pre-tokens merged at once.
MERGE_BATCH = 50_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.cache = Cache(self.counts_of_pieces)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        q = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return np.where(self.keys[at] == q, self.ranks[at], _NONE)

    def merged_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty pre-token."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = size.copy()
        sym = self.base[np.frombuffer(b"".join(tokens), np.uint8)]
        who = np.flatnonzero(size > 1)
        keep = np.repeat(size > 1, size)
        sym, size = sym[keep], size[who]
        while len(who):
            ends = np.cumsum(size)
            rank = np.full(len(sym), _NONE)
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[ends - 1] = _NONE
            least = np.minimum.reduceat(rank, ends - size)
            go = least < _NONE
            out[who[~go]] = size[~go]
            if not go.all():
                keep = np.repeat(go, size)
                sym, rank, who, size, least = sym[keep], rank[keep], who[go], size[go], least[go]
                if not len(who):
                    break
            hit = rank == np.repeat(least, size)
            # of overlapping occurrences (a a a) the first, third, ... count
            at = np.arange(len(hit))
            before = np.maximum.accumulate(np.where(hit, -1, at))
            hit &= (at - before) % 2 == 1
            firsts = np.flatnonzero(hit)
            sym[firsts] = self.made[rank[firsts]]
            keep = np.ones(len(sym), bool)
            keep[firsts + 1] = False
            size = np.add.reduceat(keep.astype(np.int64), np.cumsum(size) - size)
            sym = sym[keep]
        return out

    def counts_of_pieces(self, todo: list[str]) -> list[int]:
        pre = [self.pattern.findall(whole(p)) for p in todo]
        index = {t: i for i, t in enumerate(dict.fromkeys(t for x in pre for t in x))}
        tokens = [t.encode("utf-8", "surrogatepass") for t in index]
        count: list[int] = []
        for a in range(0, len(tokens), MERGE_BATCH):
            count += self.merged_counts(tokens[a : a + MERGE_BATCH]).tolist()
        return [sum(count[index[t]] for t in x) for x in pre]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text are one token each."""
        out = [self._long(t) if len(t) > SLICE_CHARS else self._pieces(t) for t in texts]
        counts, at = self.cache.values([p for x in out if not isinstance(x, int) for p in x[1]]), 0
        for i, x in enumerate(out):
            if not isinstance(x, int):
                out[i] = x[0] + sum(counts[at : at + len(x[1])])
                at += len(x[1])
        return out

    def _parts(self, text: str) -> list[str]:
        return self.split.split(text) if self.split and any(s in text for s in self.special) else [text]

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        parts = self._parts(text)
        return len(parts) - 1, pieces(parts[0]) if len(parts) == 1 else [x for p in parts for x in pieces(p)]

    def _long(self, text: str) -> int:
        parts = self._parts(text)
        n = len(parts) - 1
        for p in parts:
            for first, s in slices(p):
                n += sum(self.cache.values(pieces(s, first)))
        return n


def merger(path: str) -> Merger:
    return kept(__name__, path, lambda: Merger(path))


def count_tokens(docs: DataFrame, key: list[str], path: str, limit: int, text: str = "text") -> DataFrame:
    """Per row: key columns, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts have no tokens.  Very long texts are counted in slices that no token crosses; of equal
    ranks in a pre-token all occurrences merge at once, overlapping ones from the left.  Repeated rows and null keys
    are counted like others.  An empty table gives none; columns that are not named in ``key`` are left out.
    """
    bounded_batches(docs.sparkSession)
    n = len(key)

    def counted(batch):
        texts = batch.column(n).to_pylist()
        tokens: list[int] = []
        for group in grouped(texts):
            tokens += merger(path).count(group)
        yield {k: batch.column(i) for i, k in enumerate(key)} | {"n_bytes": batch.column(n + 1), "n_tokens": tokens, "over_limit": [t > limit for t in tokens]}

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key) + ", n_bytes long, n_tokens long, over_limit boolean"
    rows = docs.select(*key, text_or_empty(text).alias("_text"), F.octet_length(text_or_empty(text)).cast("long").alias("_bytes"))
    return map_batches(rows, counted, schema)
