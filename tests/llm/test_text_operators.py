"""Operators against brute force and the libraries, on odd texts: nulls, empties, ties, repeats, long runs."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from epiframes.llm import queries as tq
from epiframes.llm.bytebpe import Merger, count_tokens
from epiframes.llm.components import components
from epiframes.llm.decontaminate import decontaminate
from epiframes.llm.jaccard import allocate, band_bounds, near_duplicates
from epiframes.llm.pieces import PieceCoder, encode_decode
from epiframes.llm.pii import _SPAN, BASE, CANDIDATES, KINDS, base_spans, candidate_spans, digest, located, marked, masked, personal_data, reliabilities
from epiframes.llm.quality import quality
from epiframes.llm.sharding import hilbert_index, hilbert_shards, write_shards
from epiframes.llm.suffixes import multikey, remove_repeats
from epiframes.llm.tokenfiles import Encoder, pack_block, read_token_files, unpack_block, write_token_files
from epiframes.llm.urls import default_rules, judge_urls, prefix_rule, token_counts

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def made(parts, n, most, seed, join=""):
    rnd = random.Random(seed)
    return [join.join(rnd.choices(parts, k=rnd.randint(0, most))) for _ in range(n)]


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


TOKENS = ["a", "b", " ", "  ", "\n", "\n ", "é", "ß", "漢", "字", "'s", "'ll", "12", "٣", "Ⅷ", "½", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", " <|endoftext|>", "<s>", "▁", "▁▁", "<0x0A>", "the", "ing", "!", "🙂", "\x00", "    ", "aaaa", "---"]
ODD = [*made(TOKENS, 600, 30, 1), "x" * 3000, "ab" * 2000, " " * 500, "\n" * 300, "word " * 4000, ""]


def test_quality(spark):
    texts = [*made(["the", "of", "cat", "x1", "##", "a|b", "\n", "Two", "é"], 300, 60, 2, " "), "a b c d e f " * 400, *ODD[:100], "", None, "  \n \t", "one"]
    texts += ["the cat of x\n" * 40, " ".join(f"w{i % 300}" for i in range(2500))]
    got = quality(frame(spark, texts)).select("doc_id", "quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality(frame(spark, texts).where("false")).count() == 0


def test_urls(spark):
    urls = ["https://a.b.example.org/es/x", "https://EXAMPLE.org/es/", "http://example.org/en/12?x", "http://example.org", "http://x.org/", "http://x.com/fr/1", "http://www.x.com/de/", "http://x.com/DE/", "http://cheap-pills.net/a", "http://pillsbury.net/a", "no scheme", "", None, "http://", "x://u@h/p://q#f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.m) for r in judge_urls(df).select("page_id", "host", "path", F.col("match.rule").alias("m")).collect()}
    want = ["example.org/es/", "example.org/es/", "example.org/en/1", None, "org/", "com/fr/", "com/de/", None, "pills", None, None, None, None, None, None]
    assert [got[i][2] for i in range(len(urls))] == want
    assert got[14][:2] == ("u@h", "/p://q") and got[12][:2] == ("", "") and got[3][:2] == ("example.org", "")
    assert token_counts(df, "url", default_rules())["org"] == 5
    with pytest.raises(ValueError):
        judge_urls(df, rules=[prefix_rule("block", "", "/")])


@pytest.mark.parametrize("most", [100_000, 100])
def test_thousands_of_url_rules(spark, monkeypatch, most):
    from epiframes.llm import urls as module

    monkeypatch.setattr(module, "MAX_RULES", most)
    rnd = random.Random(17)
    label = lambda: rnd.choice(["a", "b", "cc", "news", "shop", "x1"]) + str(rnd.randint(0, 60))
    rules = {}
    for _ in range(3000):
        r = module.prefix_rule(rnd.choice(["allow", "block"]), ".".join(label() for _ in range(rnd.randint(1, 3))), "/" + "/".join(label() for _ in range(rnd.randint(0, 2))))
        rules[r.rule] = r
    rules = list(rules.values()) + [module.word_rule("block", w) for w in ("news1", "shop2")]
    urls = ["http://" + ".".join(label() for _ in range(rnd.randint(1, 4))) + "/" + "/".join(label() for _ in range(rnd.randint(0, 3))) for _ in range(1500)] + [None, "", "http://news1", "x", "http://a1.b2/" + "cc3/" * 300_000 + "shop4"]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls + urls[:20])), "page_id long, url string"), rules=rules).collect()
    compiled = [(r.rank, r.rule, r.verdict, re.compile(r.pattern)) for r in rules]
    assert len(got) == len(urls) + 20
    for r in got:
        want = max(((k, n, v) for k, n, v, p in compiled if p.search(r.host + r.path)), default=None)
        assert (tuple(r.match) if r.match else None) == want
    none = judge_urls(spark.createDataFrame([(1, None), (2, "")], "page_id long, url string"), rules=rules).collect()
    assert [r.match for r in none] == [None, None]


def test_url_paths_and_empty_pages(spark):
    urls = ["http://a.net/x/crack/", "http://a.net/cracker", "http://a.net/a.exe", "http://a.net/exed", "http://crack.net/", "http://poker.a.net/", "http://example.com/fr/xxx"]
    got = [r.match.verdict if r.match else None for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == ["block", None, "block", None, None, "block", "allow"]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, match int")).count() == 0


def test_op7_against_brute_force(spark, tmp_path):
    rnd = random.Random(23)
    texts = [None, "", "é漢🙂", "x" * (1 << 20), *("w " * rnd.randint(0, 300) for _ in range(400))]
    rows = [(i if i % 17 else None, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c"]), 3) for i, t in enumerate(texts)] + [(5, "same", "en", "a", 3)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = tq.op7_hilbert_shards(spark, str(tmp_path)).collect()
    want = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_are_skipped_by_any_dimension(spark, tmp_path):
    import pyarrow.parquet as pq

    rnd = random.Random(29)
    rows = [(i, rnd.randint(0, 10**6), rnd.randint(0, 10**6), f"s{rnd.randint(0, 40)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, score long, source string").repartition(5)
    write_shards(hilbert_shards(df, ["size", "score"], ["doc_id"], 16), str(tmp_path / "s"), files=128)
    files = [pq.ParquetFile(p).metadata.row_group(0) for p in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) >= 100 and sum(f.num_rows for f in files) == len(rows)
    for name in ("size", "score"):
        at = [f.column(i).statistics for f in files for i in range(f.num_columns) if f.column(i).path_in_schema == name]
        met = sum(x.min <= 110_000 and x.max >= 100_000 for x in at)
        assert met < 0.4 * len(at), (name, met, len(at))


def test_hilbert(spark, tmp_path):
    side = spark.range(16)
    grid = side.select(F.col("id").alias("x")).crossJoin(side.select(F.col("id").alias("y")))
    order = sorted((r.h, r.x, r.y) for r in grid.withColumn("h", hilbert_index([F.col("x"), F.col("y")], 4)).collect())
    assert [h for h, _, _ in order] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(order, order[1:], strict=False))
    rows = [(i if i % 11 else None, "en" if i % 3 else None, i % 7) for i in range(103)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, size int").repartition(5)
    got = hilbert_shards(df, ["lang", "size", "doc_id"], ["doc_id", "size"], 8).collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1 and sum(map(len, sizes)) == 103
    assert hilbert_shards(df.where("false"), ["lang", "size"], ["doc_id"], 8).count() == 0
    write_shards(hilbert_shards(df, ["size"], ["doc_id"], 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 103


def test_decontaminate(spark):
    vocab = [f"w{i}" for i in range(12)]
    items = [*enumerate(made(vocab, 30, 40, 3, " ")), (30, "Alpha, Beta"), (31, None), (32, "..."), (33, "Alpha, Beta"), (33, "Alpha, Beta")]
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice([items[rnd.randrange(30)][1], "x y z", " ".join(rnd.choices(vocab, k=9)), "ALPHA beta!"]) for _ in range(rnd.randint(0, 6))) for _ in range(200)]
    texts += ["", None, "Ünï " * 50, items[0][1] or "w1"]
    ds = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(frame(spark, texts), ds, ["doc_id"], cut=True).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"]), got[i].contaminated) == brute.contamination(t, items)
        left = brute.item_words(got[i].clean_text)
        assert len(left) == got[i].n_words - got[i].n_hit
    none = decontaminate(frame(spark, texts), ds.where("false"), ["doc_id"]).agg(F.sum("n_hit"), F.count_if("contaminated")).head()
    assert tuple(none) == (0, 0)


@pytest.mark.parametrize("each", [20_000, 3])
def test_decontaminate_in_many_blocks(spark, monkeypatch, each):
    """More items than one block, null and repeated keys, a text of over 1 MiB, blocks dealt to several tasks."""
    from epiframes.llm import decontaminate as module

    vocab = [f"w{i}" for i in range(14)]
    items = [*enumerate(made(vocab, 40, 40, 13, " ")), (40, " ".join(random.Random(14).choices(vocab, k=500))), (None, "Alpha, Beta"), (33, "Alpha, Beta"), (50, "one two three four five six seven"), (51, None), (52, "...")]
    rnd = random.Random(15)
    texts = [" ".join(rnd.choice([items[rnd.randrange(40)][1], "x y z", items[40][1][rnd.randrange(900) :][:120], "ALPHA beta!", "zero one two three four five six seven eight"]) for _ in range(rnd.randint(0, 6))) for _ in range(120)] + [None, ""]
    long = "nothing known here " * 60_000 + items[3][1] + " and more " * 10 + items[40][1][:300]
    rows = [*enumerate(texts), (None, texts[0]), (None, texts[1]), (3, texts[4]), (5, texts[5]), (6, long), (None, long)]
    monkeypatch.setattr(module, "BLOCK_WORDS", 200)
    monkeypatch.setattr(module, "TEXTS_EACH", each)
    pieces = module.item_pieces(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 200, 13)
    blocks = module.item_blocks(pieces, 200)
    assert len(blocks) > 6 and all(pieces.where(F.col("chunk").isin(c)).agg(F.sum("n")).head()[0] <= 200 for c in blocks)
    df, ds = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = decontaminate(df, ds, ["doc_id"], cut=True).collect()
    want = [(i, *brute.contamination(t, [("" if k is None else k, x) for k, x in items])) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)) for r in got)
    assert all(len(brute.item_words(r.clean_text)) == r.n_words - r.n_hit for r in got)
    assert decontaminate(df.where("false"), ds, ["doc_id"]).count() == 0


def test_anchors():
    """Equal windows have a common anchor, wherever they are."""
    from epiframes.llm.decontaminate import anchors, run_hashes

    rnd = random.Random(9)
    for k in (1, 4, 5, 6, 9, 13):
        a = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        b = [rnd.choice([b"a", b"b", b"x"]) for _ in range(30)] + a[20 : 20 + k] + [b"z"]
        assert set(anchors(a, k)) & set(anchors(b, k)) and set(anchors(a[20 : 20 + k], k)) <= set(anchors(b, k))
        assert len(anchors(a[: k - 1], k)) == 0
        same = {tuple(a[i : i + k]) for i in range(61 - k)}
        assert len(set(run_hashes(a, k))) == len(same)


def test_jaccard_beyond_broadcasts(spark, monkeypatch):
    """With no table small enough to be broadcast: near copies, copies, null ids and very long texts still meet."""
    from epiframes.llm import common, jaccard

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert jaccard.broadcast_if_small is common.broadcast_if_small
    rnd = random.Random(31)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.choice([6, 30, 120]))) for _ in range(25)]
    long = " ".join(f"w{i % 5000} x{i % 7919}" for i in range(110_000))
    texts = [*base, *(t.replace("a1", "zz", 1) for t in base), *base[:5], None, "", "one two", "ONE two", long, long + " tail", long.replace("w17 ", "q ", 3)]
    rows = [*enumerate(texts), (None, base[0]), (3, base[3])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4, num=85).collect()
    want = brute.jaccard([(i, t) for i, t in rows if i is not None], 4, 85)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id >= len(texts) - 3} == {len(texts) - 3}


def test_suffixes(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcd e") for _ in range(n)) for n in (60, 80, 150, 400, 49, 50, 51)]
    rows = []
    for i in range(150):
        part = lambda: rnd.choice([rnd.choice(base), rnd.choice(base)[3:70], "".join(rnd.choice("abcdefgh é\n") for _ in range(rnd.randint(0, 90))), "At " * rnd.randint(1, 60), "漢字" * rnd.randint(0, 20)])
        rows.append((i, "".join(part() for _ in range(rnd.randint(0, 5)))))
    rows += [(401, None), (402, ""), (None, base[3]), (5, base[3]), (5, base[3])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in remove_repeats(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[4]))
    assert got == brute.repeats(rows)
    assert remove_repeats(df.where("false")).count() == 0
    cols = [np.array(x, np.uint64) for x in ([3, 1, 3, 1, 3], [2, 9, 1, 9, 2], [5, 0, 0, 0, 4])]
    order, new = multikey(cols)
    assert [tuple(int(c[i]) for c in cols) for i in order] == sorted(zip(*[c.tolist() for c in cols], strict=True)) and new.tolist() == [True, False, True, True, True]


def test_suffixes_spread_a_hot_anchor(spark, monkeypatch):
    rnd = random.Random(31)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(45))
    around = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(40))
    rows = [(i, around()[:35] + rnd.choice("xy") + line + rnd.choice("xyz") + around()) for i in range(3000)]
    rows += [(4000 + i, rows[i][1][:70]) for i in range(0, 900, 3)]
    sent, deal = [], type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda df, *a: (sent.append(df), deal(df, *a))[1])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted(tuple(r) for r in remove_repeats(df).collect()) == brute.repeats(rows)
        sizes = [r.n for r in sent[-1].where("kind <> 1").groupBy("bucket").agg(F.sum(F.length("payload")).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert max(sizes) < 0.2 * sum(sizes)


def test_suffixes_compare_a_bounded_number_of_windows(monkeypatch):
    from epiframes.llm import suffixes

    rng = np.random.default_rng(32)
    n, wide = 50_000, suffixes.WIDE
    rows = np.zeros((n, wide + 2), np.uint8)
    rows[:, :wide] = rng.integers(97, 100, (n, wide), dtype=np.uint8)
    rows[:, suffixes.SIDE : suffixes.SIDE + suffixes.K + 18] = 120
    rows[:, wide] = suffixes.SIDE
    most, sort = [], suffixes.multikey
    monkeypatch.setattr(suffixes, "multikey", lambda cols: (most.append(len(cols[0])), sort(cols))[1])
    first, key = np.arange(n) * 100, np.arange(n)
    got = list(suffixes._bucket_runs([(1, rows, first, key)]))
    gone = np.zeros(100 * n, bool)
    for batch in got:
        for x in batch.column(1).to_pylist():
            raw = suffixes._unzip(x)
            a = suffixes._from_planes(raw, len(raw) // 16, 0)
            more = suffixes._from_planes(raw, len(raw) // 16, len(raw) // 2)
            for j, m in zip(a.tolist(), more.tolist(), strict=True):
                gone[j : j + m + 1] = True
    seen: dict = {}
    for i in range(n):
        for j in range(suffixes.SIDE + 1):
            assert gone[100 * i + j] == (seen.setdefault(rows[i, j : j + suffixes.SPAN].tobytes(), i) < i)
    assert max(most) < 1.2 * 27 * 20_000


def _removed(batches):
    from epiframes.llm import suffixes

    out = []
    for batch in batches:
        for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = suffixes._unzip(x)
            first, more = (suffixes._from_planes(raw, len(raw) // 16, at) for at in (0, len(raw) // 2))
            out += [(block, p) for a, m in zip(first.tolist(), more.tolist(), strict=True) for p in range(a, a + m + 1)]
    return sorted(set(out))


def test_suffixes_deal_anchors_evenly():
    """Anchors are least hashes: their fingerprints must not crowd into the first buckets."""
    from epiframes.llm import suffixes

    data = np.random.default_rng(33).integers(97, 123, 1 << 20, dtype=np.uint8)
    fp = suffixes.Block(np.arange(1), np.zeros(1, bool), np.array([len(data)]), data).families()[0]
    cut = suffixes._listed(fp, np.zeros(len(fp), np.int64), 64)[2]
    assert cut[-1] == len(np.unique(fp)) > 50_000
    assert np.diff(cut).max() < 1.2 * cut[-1] / 64


def test_suffixes_sort_a_large_bucket_in_parts(monkeypatch):
    """A bucket of many families and windows comes back the same from parts, out of a file, and no part is large."""
    from epiframes.llm import suffixes

    rng = np.random.default_rng(34)
    base = rng.integers(97, 100, (1500, suffixes.WIDE + 2), dtype=np.uint8)
    base[:, -2], base[:, -1] = suffixes.SIDE, 0
    base[:, suffixes.SIDE : suffixes.SIDE + suffixes.K] = base[rng.integers(0, 700, 1500), suffixes.SIDE : suffixes.SIDE + suffixes.K]
    base[:40, suffixes.SIDE : suffixes.SIDE + suffixes.K] = 0
    families, windows, want = suffixes.Held(suffixes.WIDE + 2), suffixes.Held(suffixes.SPAN), ([], [])
    for block in range(25):
        rows = base[rng.choice(len(base), 400, replace=False)]
        rows = rows[np.lexsort(rows[:, suffixes.SIDE : suffixes.SIDE + suffixes.K].T[::-1])]
        first, key = np.arange(400) * 100, rng.integers(0, 60, 400)
        families.add(block, pa.py_buffer(suffixes._packed(suffixes._turned(rows, suffixes.SIDE), first, key)))
        windows.add(block, pa.py_buffer(suffixes._packed(rows[:, : suffixes.SPAN], first, key)))
        for found, offsets in zip(want, (range(suffixes.SIDE + 1), (0,)), strict=True):
            found += [(row[j : j + suffixes.SPAN].tobytes(), k, (block, a + j)) for row, a, k in zip(rows, first.tolist(), key.tolist(), strict=True) for j in offsets]
    assert families.many == windows.many == 10_000
    most, sort = [], suffixes.multikey
    monkeypatch.setattr(suffixes, "multikey", lambda cols: (most.append(len(cols[0])), sort(cols))[1])
    for part, held_bytes in ((1_000, 5_000), (suffixes.PART, suffixes.HELD)):
        monkeypatch.setattr(suffixes, "PART", part)
        monkeypatch.setattr(suffixes, "WINDOWS", part)
        monkeypatch.setattr(suffixes, "STEP", 20)
        for held, parts, run, found in ((families, suffixes._family_parts, suffixes._bucket_runs, want[0]), (windows, lambda h: suffixes._window_parts(h, 4), suffixes._equal_windows, want[1])):
            monkeypatch.setattr(suffixes, "HELD", held_bytes)
            again = suffixes.Held(held.width)
            held.file.seek(0)
            for block, size in held.names:
                again.add(block, pa.py_buffer(held.file.read(size)))
            least: dict = {}
            for text, k, _ in found:
                least[text] = min(k, least.get(text, k))
            most.clear()
            assert _removed(x for p in parts(again) for x in run(p)) == sorted({at for text, k, at in found if k > least[text]})
            assert max(most) < 1.6 * part


def test_personal_data(spark):
    parts = ["a@b.c", "_x@d.fr", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (234) 567-8901", "+", "12", "é", 'token = "', "04dbebab91ab85687d33eeaaf9ac699e1188f962", '"', "x", "字", "a.b%c@d-e.co.uk", "+44 20 7946 0958..", "\n", "🙂"]
    texts = [*made(parts, 500, 14, 5), "a" * 20000, "1" * 20000, "1 " * 9000, "a@" * 6000, "1." * 6000, None, ""]
    got = personal_data(frame(spark, texts), ["doc_id"])
    base = got.select("doc_id", digest(F.filter("spans", lambda s: s["kind"] < len(BASE))).alias("b")).collect()
    assert all(r.b == brute.personal(texts[r.doc_id]) for r in base)
    one = frame(spark, ['my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is here a@b.co'] * 30 + ["plainwordthatislongbutnosecret12 x"] * 3)
    spans = personal_data(one, ["doc_id", "text"])
    text = {r.doc_id: r.t for r in spans.select("doc_id", masked(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert text[0] == 'my token = "<secret>" is here <email>' and "long" in text[31]
    assert personal_data(one.where("false"), ["doc_id"]).count() == 0
    prior, table = reliabilities([((1, 1), 50), ((-1, -1), 50), ((1, 0), 5)])
    assert 0.3 < prior < 0.7 and table[0][1][1] > table[0][1][0]


def test_personal_data_candidates_need_no_digit_elsewhere(spark):
    secret = 'password = "abcdefghijklmnopqrstuvwxyzABCD" '
    texts = [secret, secret + "7", "7 and 12345678 here", "none of them here", "a" * 19, "1234567"]
    df = frame(spark, texts).withColumn("spans", candidate_spans(F.col("text"), F.array().cast(_SPAN)))
    got = {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.spans] for r in df.collect()}
    assert got == {0: [("secret", 12, 42)], 1: [("secret", 12, 42)], 2: [("id_number", 6, 14)], 3: [], 4: [], 5: [("id_number", 0, 7)]}


def test_personal_data_in_texts_of_many_matches(spark):
    rnd = random.Random(8)
    bits = ["1234567 ", "4111111111111111 ", "+44 20 7946 0958, ", "1.2.3.4 ", "a@b.co ", "ключ = ", "token=04dbebab91ab85687d33eeaaf9ac699e1188f962 ", "12 ", "\n", "🙂 "]
    texts = [" ".join(rnd.choices(bits, k=k)) for k in (20, 300, 3000, 20000)]
    df = frame(spark, texts)
    found = personal_data(df, ["doc_id", "text"])
    rows = found.select("doc_id", "text", "spans", digest(F.filter("spans", lambda s: s["kind"] < len(BASE))).alias("b"), masked(F.col("text"), F.col("spans")).alias("m")).collect()
    for r in rows:
        assert r.b == brute.personal(r.text)
        out, at = [], 0
        for start, kind, end in r.spans:
            if start >= at:
                out.append(r.text[at:start] + f"<{KINDS[kind]}>")
            at = max(at, end)
        assert r.m == "".join(out) + r.text[at:]
    none = F.array().cast(_SPAN)
    for r in df.select("text", located(F.col("text"), CANDIDATES["id_number"], contexts=True).alias("f")).collect():
        assert [(x.start, x.end, x.match) for x in r.f] == [(*m.span(), m.group()) for m in re.finditer(r"(?<![0-9A-Za-z.+-])[0-9]{7,13}(?![0-9A-Za-z])", r.text)]
        assert all(x.before == r.text[max(0, x.start - 24) : x.start] and x.after == r.text[x.end : x.end + 8] for x in r.f)
    few = df.select("doc_id", candidate_spans(F.col("text"), none).alias("all"), "text").collect()
    based = df.withColumn("b", base_spans(F.col("text"))).withColumn("m", marked(F.col("b")))
    kept = {r.doc_id: r for r in based.select("doc_id", "b", candidate_spans(F.col("text"), F.col("b"), F.col("m")).alias("c")).collect()}
    for r in few:
        taken = bytearray(len(r.text))
        for x in kept[r.doc_id].b:
            taken[x.start : x.end] = b"\1" * (x.end - x.start)
        want = [(x.start, x.end, x.kind) for x in r["all"] if not any(taken[x.start : x.end])]
        assert [(x.start, x.end, x.kind) for x in kept[r.doc_id].c] == want


def test_personal_data_finds_planted_secrets_and_numbers(spark):
    rnd = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choices(letters, k=rnd.randint(2, 9)))
    secret = lambda: rnd.choice(["".join(rnd.choices("0123456789abcdef", k=40)), "".join(rnd.choices(letters + letters.upper() + "0123456789", k=32))])
    texts, planted = [], {}
    for i in range(900):
        before, after = " ".join(word() for _ in range(rnd.randint(3, 40))), " ".join(word() for _ in range(rnd.randint(3, 40)))
        if i % 3 == 0:
            what = ("secret", secret()) if i % 2 else ("id_number", "".join(rnd.choices("0123456789", k=9)))
            head = rnd.choice(['api token = "', 'my password: "', 'auth key = "']) if what[0] == "secret" else rnd.choice(["ssn: ", "passport = ", "tax account: "])
            texts.append(f"{before} {head}{what[1]}" + ('" ' if what[0] == "secret" else " ") + after)
            planted[i] = (what[0], len(before) + 1 + len(head), len(before) + 1 + len(head) + len(what[1]))
        else:
            noise = rnd.choice(["".join(word() for _ in range(5)), "| 1234567 | 7654321 |", "-" * 30, "aaaaaaaa" * 4, "very_long_name_of_a_thing_without_digits", "the 20000000 people"])
            texts.append(f"{before} {noise} {after}")
    got = {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.spans] for r in personal_data(frame(spark, texts), ["doc_id"]).collect()}
    caught = {k: [planted[i] in got[i] for i in planted if planted[i][0] == k] for k in ("secret", "id_number")}
    clean = [not got[i] for i in range(900) if i not in planted]
    shares = {k: sum(v) / len(v) for k, v in caught.items()} | {"clean": sum(clean) / len(clean)}
    assert min(shares.values()) >= 0.9, shares


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in lib.encode_batch_fast(ODD, add_special_tokens=False)]
    assert Merger(BPE).count(ODD) == want
    got = {r.doc_id: r for r in count_tokens(frame(spark, [*ODD, None]), ["doc_id"], BPE, 512).collect()}
    assert [got[i].n_tokens for i in range(len(ODD))] == want and got[len(ODD)].n_tokens == 0
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(ODD))


def test_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    want = lib.encode(ODD, add_bos=True, add_eos=True, num_threads=1)
    assert [x.tolist() for x in PieceCoder(SP).encode(ODD)] == want
    got = {r.doc_id: r for r in encode_decode(frame(spark, [*ODD, None]), ["doc_id"], SP, full=True).collect()}
    for i, ids in enumerate(want):
        assert list(got[i].ids) == ids and got[i].decoded == lib.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[len(ODD)].n_tokens == 2


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    ranks = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    back = unpack_block(pack_block(np.array([5, 9]), np.array([4, 5]), ranks))
    assert (back[2] == ranks).all() and back[0].tolist() == [5, 9] and back[1].tolist() == [4, 5]
    with pytest.raises(ValueError):
        unpack_block(pack_block(np.array([5]), np.array([9]), ranks)[:-1] + b"\xff")
    lib = Tokenizer.from_file(BPE)
    assert [np.frombuffer(x, "<u2").tolist() for x in Encoder(BPE).encode(ODD)] == [e.ids for e in lib.encode_batch_fast(ODD, add_special_tokens=False)]
    texts = [*ODD, None]
    write_token_files(frame(spark, texts), str(tmp_path / "f"), BPE, 2)
    got = sorted(read_token_files(spark, str(tmp_path / "f"), full=True).collect())
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    write_token_files(frame(spark, texts).where("false"), str(tmp_path / "e"), BPE, 2)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_token_files_with_null_repeated_and_hot_ids(spark, tmp_path):
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"hot {i % 30}") for i in range(60)] + [(i, f"text {i}") for i in range(30)] + [(-(1 << 63), "least"), (3, None)]
    for name, seed in (("a", 1), ("b", 2)):
        random.Random(seed).shuffle(rows)
        write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / name), BPE, 2)
    runs = [r["count"] for r in spark.read.parquet(str(tmp_path / "a" / "ids")).groupBy("run").count().collect()]
    a, b = (sorted(map(tuple, read_token_files(spark, str(tmp_path / x)).collect()), key=lambda r: r[1]) for x in "ab")
    assert a == b and len(a) == len(rows) and len(runs) == 4
    assert [r[0] for r in a] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in a] == [sum(x[2] for x in a[:i]) for i in range(len(a))]


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard(spark, width, num):
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 40)) for _ in range(rnd.choice([3, 5, 8, 9, 12, 20, 30, 60, 120, 300]))]
        for _ in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = ["zz" + str(rnd.randint(0, 9))]
            texts.append(" ".join(w))
    texts += ["", None, "  ", "one", "one", "ONE", "the same words again and again in this text"] + ["the same words again and again in this text"] * 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts), width, num).collect()}
    assert got == brute.jaccard(list(enumerate(texts)), width, num)
    plans = [allocate(lo, hi, 1000, num, 100) for lo, hi in band_bounds(5000)]
    assert all(p.whole + 2 * p.delete >= p.budget + 1 + p.spare and p.spare <= p.whole for p in plans)


def _edited(rnd, base, edits, tag):
    w = list(base)
    for k in rnd.sample(range(len(w)), edits):
        w[k] = f"{tag}x{k}"
    return " ".join(w)


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_of_a_cluster_around_a_hub_and_of_a_common_passage(spark, monkeypatch, width, num):
    from epiframes.llm import jaccard

    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    hub, passage = rnd.choices(vocab, k=150), rnd.choices(vocab, k=45)
    texts = [" ".join(hub)] + [_edited(rnd, hub, rnd.choice([1, 2, 2, 3, 3, 4, 4, 5, 6, 8]), f"t{i}") for i in range(500)]
    texts += [_edited(rnd, texts[i].split(), rnd.choice([1, 2, 3]), f"u{i}") for i in range(1, 500, 5)]  # copies of copies
    texts += [" ".join([*rnd.choices(vocab, k=rnd.randint(2, 90)), *passage, *rnd.choices(vocab, k=rnd.randint(2, 90))]) for _ in range(500)]
    texts += [" ".join([*passage, *rnd.choices(vocab, k=rnd.randint(1, 12))]) for _ in range(200)]
    met = []
    count = jaccard._met_in_prefix
    monkeypatch.setattr(jaccard, "_met_in_prefix", lambda *a: (met.append(count(*a)), met[-1])[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts), width, num).collect()}
    assert got == brute.jaccard(list(enumerate(texts)), width, num)
    assert met[0].count() < 3 * len(texts)


def test_open_signatures_keep_two_that_are_left_of_more(spark):
    from epiframes.llm.jaccard import _open

    roots = spark.createDataFrame([(9, 9)], "vertex long, root long")
    members = spark.createDataFrame([(64, 1), (64, 2), (128, 1), (128, 2), (192, 3), (192, 4)], "sig long, class long")
    extra = [0] * 64
    assert _open(members, roots, extra, least=3).count() == 0
    assert {(r.sig, r["class"]) for r in _open(members, roots, extra, least=2).collect()} == {(64, 1), (64, 2), (128, 1), (128, 2), (192, 3), (192, 4)}
    assert {r["class"] for r in _open(members, roots, [1] * 64, least=2).collect()} == {1, 2}


def test_jaccard_names_rows_by_id_and_text(spark):
    rows = [(3, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "other words that are here and clean"), (9, "one two three four five six"), (9, "one two three four five six"), (None, "a b c d e f g h"), (5, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows_too=True).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.first) for r in got) == [(-1, 4, True), (3, 4, True), (5, 0, True), (7, 3, True), (7, 4, False), (9, 2, True), (9, 2, True)]


def test_jaccard_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(df).collect()) == [(-1, None), (3, 3), (4, 3)]
    assert near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.vertex: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[102]} == {100}


def test_columns_that_clash(spark, tmp_path):
    rows = [(1, "the cat of the house is in it and on the mat", "x", 7, [1]), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, class long, spans array<int>")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the cat", 3)], "item_id long, text string, doc_id int").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, width in (("op2_decontaminate", 6), ("op3_suffix_dedup", 5), ("op4_personal_data", 7), ("op6_quality", 8), ("op8_token_counts", 4), ("op9_jaccard_join", 3)):
        out = tq.QUERIES[name](spark, str(tmp_path))
        assert len(out.columns) == width and out.count() == 2
