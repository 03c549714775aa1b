"""Cutting texts at spaces that no token crosses, and a bounded cache of what the cuts give."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Entries of each of a worker's two cache generations: bounds its memory and never changes results.
CACHE_ENTRIES = 350_000
#: Characters that are cut and held as pieces at a time.
SLICE_CHARS = 1 << 20
#: Marks a piece without a space before it: never part of a valid text.
HEAD = "\ud800"

_IRREGULAR = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


class Cache:
    """Piece -> value; ``fill`` computes many missing pieces at once."""

    def __init__(self, fill: Callable[[list[str]], list], entries: int = CACHE_ENTRIES) -> None:
        self.fill, self.entries = fill, entries
        self.known: dict = {}
        self.old: dict = {}

    def of(self, groups: list[list[str]]) -> dict:
        """A dict that has every piece of the groups; what a full generation held and is met again moves on."""
        known = self.known
        need = {p for g in groups for p in g if p not in known}
        if need and len(known) + len(need) > self.entries:
            self.old, self.known, need = known, {}, set().union(*groups)
        if need:
            again = {k: self.old[k] for k in need if k in self.old}
            self.known.update(again)
            todo = [k for k in need if k not in again]
            self.known.update(zip(todo, self.fill(todo), strict=True))
        return self.known

    def values(self, flat: list[str]) -> list:
        """The value of each piece, with one look-up for those that are known."""
        out = list(map(self.known.get, flat))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            new = dict.fromkeys([flat[i] for i in gaps])
            if len(self.known) + len(new) > self.entries:
                self.old, self.known = self.known, {}
            again = map(self.old.get, new)
            new = dict(zip(new, again, strict=True)) if self.old else new
            todo = [p for p, v in new.items() if v is None]
            new.update(zip(todo, self.fill(todo), strict=True))
            self.known.update(new)
            for i in gaps:
                out[i] = new[flat[i]]
        return out


def slices(text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[bool, str]]:
    """A text in parts of about ``limit`` characters, each later one cut off after a boundary space."""
    first, at = True, 0
    while len(text) - at > limit:
        m = _CUT.search(text, at + limit)
        if not m:
            break
        yield first, text[at : m.start()]
        first, at = False, m.end()
    yield first, text[at:]


def irregular(text: str) -> bool:
    """Whether some space is not followed by a character that is no white space."""
    return bool(_IRREGULAR.search(text))


def pieces(text: str, first: bool = True) -> list[str]:
    """The text cut before each space that a non-space follows; the space itself is left out.

    Byte-level pre-tokens never cross such a cut: a run of white space before a word gives its last
    space to the word.  The first piece of a text has no space before it and is marked.
    """
    out = _CUT.split(text) if irregular(text) else text.split(" ")
    if first:
        out[0] = HEAD + out[0]
    return out


def whole(piece: str) -> str:
    return piece[1:] if piece[:1] == HEAD else " " + piece


def grouped(texts: Iterable[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts in groups of about ``limit`` characters."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
