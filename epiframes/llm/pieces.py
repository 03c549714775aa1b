"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For each prefix of a piece of text the table stores the one token that ends its encoding: the automaton
of all pieces gives the tokens that end at a position, and the right one is the only one that is
compatible with the last token of the prefix before it, that is, the pair encodes as itself.  The ids are
then read off backwards.  Characters outside the vocabulary are their UTF-8 bytes' tokens.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .chunks import Cache, grouped
from .common import bounded_batches, kept, map_batches, text_or_empty

SPACE = "▁"
_RUNS = re.compile(r" +[^ ]*")


class PieceCoder:
    def __init__(self, path: str) -> None:
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id = {
            sp.id_to_piece(i): i
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses a space: texts cannot be cut there")
        self.piece = {i: p for p, i in self.id.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {p for p in self.id if len(p) == 1}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, i in self.id.items():
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        self.alone: dict[int, bool] = {}
        self.pair: dict[int, bool] = {}
        self.kind = np.uint16 if sp.get_piece_size() <= 1 << 16 else np.uint32
        self.cache = Cache(lambda todo: [np.array(self.encode_piece(k), self.kind).tobytes() for k in todo])
        self.begin, self.end = sp.bos_id(), sp.eos_id()

    def merges(self, text: str) -> list[str]:
        """Plain merging of a short text: the definition that compatibility tests rest on."""
        s = list(text)
        while len(s) > 1:
            best = max(range(len(s) - 1), key=lambda i: (self.score.get(s[i] + s[i + 1], -np.inf), -i))
            if s[best] + s[best + 1] not in self.id:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def encodes_itself(self, t: int) -> bool:
        if t not in self.alone:
            self.alone[t] = self.merges(self.piece[t]) == [self.piece[t]]
        return self.alone[t]

    def compatible(self, a: int, b: int) -> bool:
        k = a << 24 | b
        got = self.pair.get(k)
        if got is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            x, y = self.piece[a], self.piece[b]
            got = self.pair[k] = self.merges(x + y) == [x, y]
        return got

    def known_run(self, s: str) -> list[int]:
        """Ids of a text of known characters."""
        last = [0] * (len(s) + 1)
        pair = self.pair
        for end, (t, n) in self.find.iter(s):
            if last[end + 1]:
                continue
            at = end + 1 - n
            if at == 0:
                if self.encodes_itself(t):
                    last[end + 1] = t
            else:
                p = last[at]
                if p:
                    ok = pair.get(p << 24 | t)
                    if self.compatible(p, t) if ok is None else ok:
                        last[end + 1] = t
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= len(self.piece[last[at]])
        ids.reverse()
        return ids

    def encode_piece(self, key: str) -> list[int]:
        s = SPACE + key.replace(" ", SPACE)
        if self.chars.issuperset(s):
            return self.known_run(s)
        ids: list[int] = []
        start = 0
        for i, c in enumerate(s):
            if c not in self.chars:
                if i > start:
                    ids += self.known_run(s[start:i])
                ids += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        return ids + (self.known_run(s[start:]) if start < len(s) else [])

    def keys(self, text: str) -> list[str]:
        """Cut before every run of spaces; a space at the front is added, as the model does."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [k[1:] for k in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with begin and end."""
        cut = [self.keys(t) for t in texts]
        known = self.cache.of(cut).__getitem__ if any(cut) else None
        ends = (np.array([self.begin], self.kind).tobytes(), np.array([self.end], self.kind).tobytes())
        return [np.frombuffer(b"".join((ends[0], *map(known, k), ends[1])), self.kind) if k else np.array([self.begin, self.end], self.kind) for k in cut]


def coder(path: str) -> PieceCoder:
    return kept(__name__, path, lambda: PieceCoder(path))


def encode_decode(docs: DataFrame, key: list[str], path: str, text: str = "text", full: bool = False) -> DataFrame:
    """Per row: key columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``full`` also ``ids`` and ``decoded``.

    Null and empty texts have the begin and end ids only.  Very long texts are encoded whole; what a worker
    keeps between batches is bounded by the cache's size.  Repeated rows and null keys are coded like others.
    An empty table gives none; columns that are not named in ``key`` are left out, so none can clash.
    """
    bounded_batches(docs.sparkSession)
    n = len(key)

    def coded(batch):
        c = coder(path)
        rows = []
        for group in grouped(batch.column(n).to_pylist()):
            for ids in c.encode(group):
                decoded = c.lib.decode(ids.tolist())
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()]
                rows.append([*row, ids.tolist(), decoded] if full else row)
        names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")[: 5 if full else 3]
        yield {k: batch.column(i) for i, k in enumerate(key)} | {m: [r[i] for r in rows] for i, m in enumerate(names)}

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return map_batches(docs.select(*key, text_or_empty(text).alias("_text")), coded, schema)
