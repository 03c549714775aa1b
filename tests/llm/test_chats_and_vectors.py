"""Prefix trie, chat formatting and whitening against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from epiframes.llm import chats, trie, whitening
from epiframes.llm import queries as tq

CONV = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))


def ordered(rows):
    """conv_id -> [(role, text)]; ties by role, which the cases below have no ties beyond."""
    got = defaultdict(list)
    for c, turn, role, text in rows:
        got[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in got.items()}


def rebuilt(rows):
    own = ordered([r for r in rows if r[0] is not None])
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (words(p[-1][1]) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def made_conversations(n, seed, most=7):
    rnd = random.Random(seed)
    said = ["", "hi", "hi there", "a\tb\x0bc d", "ok   ok", "<|im_end|>", "x" * 50]
    rows = []
    for c in range(n):
        if rnd.random() < 0.1:
            continue
        k = rnd.randint(1, most)
        for t in range(k):
            rows.append((c, rnd.choice([None, t]) if t == 0 else t, rnd.choice(["user", "assistant", None]), rnd.choice([*said, None])))
    return rows


@pytest.mark.parametrize("limits", [(2048, 40_000), (3, 40_000), (2048, 5), (4, 1)])
def test_trie(spark, monkeypatch, limits):
    monkeypatch.setattr(trie, "SHARD_CONVS", limits[0])
    monkeypatch.setattr(trie, "SHARD_TURNS", limits[1])
    rows = made_conversations(150, 1) + [(c, t, "user", f"same {t}") for c in (500, 501, 502, 517, 900, 999) for t in range(25)] + [(1000, 0, "user", "x"), (1001, 5, "user", "alone"), (2005, 1, "user", "no leader")]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    assert trie_rows(trie.prefix_trie(df, rebuild=True)) == brute_trie(rebuilt(rows))
    assert trie_rows(trie.prefix_trie(df)) == brute_trie(ordered(rows))


def test_trie_edges(spark, monkeypatch):
    long = "word 　x\n" * 200_000
    rows = [(None, 0, "user", "no id"), (3, None, None, None), (3, None, "", ""), (3, 1, "user", long), (4, 1, "user", long), (4, 1, "user", long), (-7, 0, "user", "minus"), (2**40, 0, "user", "far")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", depth int, a string").repartition(3)
    assert trie_rows(trie.prefix_trie(df)) == brute_trie(ordered([r for r in rows if r[0] is not None]))
    assert trie.prefix_trie(df.where("false"), rebuild=True).count() == 0
    only = spark.createDataFrame([(5, 0, "user", "a")], CONV)  # crc32("5") % 4 is not 0 and there is no leader: no turn is left
    assert zlib.crc32(b"5") % 4
    assert trie_rows(trie.prefix_trie(only, rebuild=True)) == [(5, 0, None, 1, 0, 1, 0, sha("5"))]


def test_trie_of_one_long_conversation(spark, monkeypatch):
    """One conversation with most rows, cut into many shards, beside others that share its first turns."""
    monkeypatch.setattr(trie, "SHARD_TURNS", 64)
    rows = [(c, t, "user", f"w {t}") for c, k in ((7, 3000), (8, 700), (9, 5), (11, 700)) for t in range(k)] + [(8, 700, "user", "other")]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    assert trie_rows(trie.prefix_trie(df)) == brute_trie(ordered(rows))


def test_trie_query(spark):
    got = trie_rows(tq.op11_prefix_trie(spark, "/root/testdata/sf0.01"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_trie(rebuilt(rows))


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x<|", "<<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "a<", "|b", "\\n\\\\n\n", "<\\<|"])
def test_escapes(text):
    assert chats.unescape(chats.escape(text)) == text
    assert "<|" not in chats.escape(text)
    assert chats.unescape_role(chats.escape_role(text)) == text
    assert "\n" not in chats.escape_role(text)


def test_machine():
    def walk(*roles):
        m = chats.Machine(chats.CHATML)
        for r in roles:
            m.step(r)
        return m.valid, m.fault

    assert walk("user", "assistant") == (True, None)
    assert walk("system", "user", "assistant", "user", "assistant") == (True, None)
    assert walk("user", "assistant", "user") == (False, None)
    assert walk("assistant", "user") == (False, 0)
    assert walk("user", "user", "assistant") == (False, 1)
    assert walk() == (False, None)


def brute_chats(rows):
    def one(turns):
        loss = "".join(t for r, t in turns if r == "assistant")
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)

    return {c: one(v) for c, v in ordered(rows).items()}


HARD = ["", None, "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|a<", "|", "\\", "🙂\nline", "<|", "a" * 300]


@pytest.mark.parametrize("chunk", [1 << 22, 40])
def test_chats(spark, monkeypatch, chunk):
    monkeypatch.setattr(chats, "CHUNK_CHARS", chunk)
    rnd = random.Random(4)
    rows = [(c, t if t else None, rnd.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_start|>\\"]), rnd.choice(HARD)) for c in range(120) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "answer"), (7000, 0, "user", "x" * (1 << 20) + "<|"), (7000, 1, "assistant", "<|im_end|>" * 1000)] + [(8000, t, "assistant", f"turn {t}") for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", chunk int, last string").repartition(3)
    formatted = chats.format_chats(df)
    got = {r[0]: tuple(r)[1:] for r in chats.read_chats(formatted).collect()}
    want = brute_chats(rows)
    assert {c: v[:4] for c, v in got.items()} == want
    texts = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: r.chunk):
        assert all(a <= b for a, b in zip(r.starts, r.starts[1:])) and len(r.starts) == len(r.loss)
        texts[r.conv_id] += r.text
    assert {c: v[4] for c, v in got.items()} == {c: len(t) for c, t in texts.items()}
    for c, turns in ordered(rows).items():
        assert texts[c].count("<|im_start|>") == texts[c].count("<|im_end|>\n") == len(turns)
    assert chats.read_chats(chats.format_chats(df.where("false"))).count() == 0


def test_chats_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chats, "CHUNK_CHARS", 64)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {c} {t} <|im_end|>") for c in range(40) for t in range(c % 7 + 1)]
    chats.format_chats(spark.createDataFrame(rows, CONV)).write.parquet(str(tmp_path / "f"))
    again = spark.read.parquet(str(tmp_path / "f")).repartition(3, "conv_id").sortWithinPartitions("conv_id", "chunk")
    got = chats.read_chats(again).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute_chats(rows)
    assert {r.conv_id: r.valid for r in got} == {c: (c % 7 + 1) % 2 == 0 for c in range(40)}


def test_other_template(spark):
    t = chats.Template(segments=("<|turn|>", chats.ROLE, "\n", chats.TEXT, "<|done|>"), loss_roles=frozenset({"bot", "tool"}), order={chats.START: {"human": "h"}, "h": {"bot": "b", "tool": "h"}, "b": {"human": "h"}}, final=frozenset({"b"}))
    rows = [(1, 0, "human", "q <|done|>"), (1, 1, "tool", "42"), (1, 2, "bot", "a<|turn|>b"), (2, 0, "bot", "first")]
    got = {r.conv_id: r for r in chats.read_chats(chats.format_chats(spark.createDataFrame(rows, CONV), t), t).collect()}
    assert got[1].loss_sha256 == sha("42a<|turn|>b") and got[1].valid and not got[2].valid and got[2].n_turns == 1


def test_chats_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    got = tq.op12_chat_format(spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute_chats([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def check_whitened(rows, got, k=4):
    """Every row of ``got`` against the definition over ``rows`` of (vec_id, vector)."""
    kept = [(i, np.array([int(np.floor(np.float64(c) * 256)) for c in v], dtype=object)) for i, v in rows]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, total = len(distinct), distinct.sum(axis=0)
    c = ((distinct * n - total) / n).astype(float)
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    assert sorted({r.component for r in got}) == list(range(1, k + 1)) and len(got) == k * len(kept)
    by_id = defaultdict(list)
    for i, x in kept:
        by_id[i].append(x)
    signs = {}
    for r in got:
        i = r.component - 1
        assert r.n == n and r.explained == pytest.approx(e[i] / np.trace(v), rel=1e-6)
        devs = [sum(int(a) ** 2 for a in x * n - total) for x in by_id[r.vec_id]]
        assert r.deviation in devs
        whites = [float(((x * n - total) / n).astype(float) @ axes[:, i] / np.sqrt(e[i])) for x in by_id[r.vec_id]]
        near = min(whites, key=lambda w: abs(abs(w) - abs(r.whitened)))
        assert abs(near) == pytest.approx(abs(r.whitened), rel=1e-6, abs=1e-9)
        if abs(near) > 1e-3:
            assert signs.setdefault(i, near * r.whitened > 0) == (near * r.whitened > 0)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


VECS = "vec_id long, embedding array<float>"


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    base = (rnd.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + 5).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[7]) for i in range(400)] + [(5, base[5]), (5, base[9])]
    bad = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (2004, [-float("inf")] * 6), (2005, [1.0, 2.0]), (2006, [])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 2) for r in rows + bad], VECS + ", k1 int, n int").repartition(5), "vec_id").collect()
    check_whitened(rows, got)


def test_whitening_minus_zero_and_double(spark):
    rows = [(1, [-0.0, 1.0, 3.0]), (2, [0.0, 1.0, 3.0]), (3, [0.25, -1.0, 2.0]), (4, [1.5, 0.0, 2.5]), (5, [-0.001, 4.0, 1.0]), (6, [2.0, 2.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id").collect()
    check_whitened(rows, got, k=3)
    assert {r.n for r in got} == {5}


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECS), "vec_id").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], VECS), "vec_id").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], VECS), "vec_id").count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], VECS), "vec_id").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0])], VECS), "vec_id").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert {r.explained for r in line if r.component == 2} == {0.0}
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [3.0, 3.0]), (3, [-1e300, 7.0])], "vec_id long, embedding array<double>"), "vec_id").collect()
    assert len(far) == 6 and {r.deviation for r in far} == {None, (3 * 768 - 767) ** 2 + (3 * 768 - 2816) ** 2}


def test_whitening_by_counts(spark):
    """With counts as weights the covariance is that of all rows."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 5)).astype(np.float32)
    rows = [(i, base[i % 40 if i < 80 else 3].tolist()) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, VECS), "vec_id", components=2, weight="count").collect()
    x = np.floor(np.array([v for _, v in rows]).astype(float) * 256)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert {r.n for r in got} == {200}
    assert {r.component: r.explained for r in got} == pytest.approx({1: e[0] / e.sum(), 2: e[1] / e.sum()})
    assert got[0].identity_error < 1e-8


def test_whitening_query(spark):
    got = tq.op13_whitening(spark, "/root/testdata/sf0.01").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, got)
