"""Plain single-machine definitions that the operators are held against."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cov = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cov.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(text, items):
    w = item_words(text)
    hit, who = set(), set()
    for name, t in items:
        v = item_words(t)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                who.add(str(name))
    return len(w), len(hit), sorted(who), len(hit) > 0 and 20 * len(hit) >= len(w)


def repeats(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1) if i is not None else ():
            first[b[p : p + span]] = min(i, first.get(b[p : p + span], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1) if i is not None else ():
            if first[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        gone = bytes(gone)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def personal(text):
    found = [(m.start(), j, m.end(), k) for j, (k, p) in enumerate(PII) for m in re.finditer(p, text or "") if _valid(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def jaccard(rows, width, num):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(UPPER)) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        common.update(itertools.combinations(sorted(ids), 2))
    for (a, b), k in common.items():
        if 100 * k >= num * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
