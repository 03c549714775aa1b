"""Every query on rows that are null, empty, repeated, very long or carry clashing columns, and on empty tables."""

import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from test_chats_and_vectors import brute_chats, brute_trie, check_whitened, rebuilt

from epiframes.llm import queries as tq

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = "".join(f"word{i % 977} und Größe {i}. " for i in range(60_000)) + "x" * 5000 + " <|endoftext|> end"
ROWS = [(None, "a null id with some words in it that are more than ten"), (None, None), (1, LONG), (2, ""), (3, None), (4, "the same row"), (4, "the same row"), (4, "the same id"), (5, "Mail me@a.co or 1.2.3.4 now"), (6, "the same row"), (-7, " \t\n ")]
#: Names that the operators use inside, or return.
CLASH = "key int, k int, h int, ids int, class int, th int, rep int, n int, spans int, quality int, n_words string, run int, rank int, curve int, shard int, slot int, _text int, _base int, _marks int, block int, payload int, host int, match int, token int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    extra = [c.split() for c in CLASH.split(", ")]
    rows = [(i, t, "en", None, len(t or ""), *("1" if kind == "string" else 1 for _, kind in extra)) for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / "full" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(path / "none" / "documents.parquet"))
    for name, items in (("full", [(1, "the same row", 2), (None, None, 1), (2, "", 1)]), ("none", [])):
        spark.createDataFrame(items, "item_id long, text string, doc_id int").write.parquet(str(path / name / "benchmark.parquet"))
    for name, pages in (("full", [(1, "http://a.org/x", 1, 1), (1, "http://a.org/x", 1, 1), (2, None, 1, 1), (None, "", 1, 1), (3, "http://a.org/" + "y/" * 600_000, 1, 1)]), ("none", [])):
        spark.createDataFrame(pages, "page_id long, url string, host int, match int").write.parquet(str(path / name / "pages.parquet"))
    for name, chats in (("full", CHATS), ("none", [])):
        spark.createDataFrame([(*r, 1, "x") for r in chats], "conv_id long, turn long, role string, text string, depth int, last string").write.parquet(str(path / name / "conversations.parquet"))
    for name, vectors in (("full", VECTORS), ("none", [])):
        spark.createDataFrame([(*r, 1, 1, "x") for r in vectors], "vec_id long, embedding array<float>, label int, x int, w string").write.parquet(str(path / name / "embeddings.parquet"))
    return path


CHATS = [(None, 0, "user", "no id"), (1, None, None, None), (1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, 0, "user", "twice"), (2, 0, "user", "twice"), (41, 3, "assistant", ""), (3, 0, "user", LONG)]
VECTORS = [(None, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [0.5, -0.0]), (4, [0.5, 0.0]), (5, []), (6, [-3.0, 0.25]), (7, [1.0, 2.0])]
#: Rows that other queries than those of one row a document give: pages, trie nodes, conversations, rows and components.
COUNTS = {"op10_url_rules": 5, "op12_chat_format": 6, "op13_whitening": 10}

QUERIES = [*tq.QUERIES.items(), ("pipeline", corpus_pipeline.run)]


@pytest.mark.parametrize(("name", "fn"), QUERIES)
def test_empty_tables(spark, folder, name, fn):
    assert fn(spark, str(folder / "none")).count() == (1 if name == "op12_chat_format" else 0)  # op12 adds a conversation of its own


def test_rows_of_all_kinds(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    got = {n: sorted((tuple(r) for r in f(spark, str(folder / "full")).collect()), key=key) for n, f in tq.QUERIES.items()}
    nodes = got.pop("op11_prefix_trie")
    assert all(len(v) == COUNTS.get(n, len(ROWS)) for n, v in got.items()), {n: len(v) for n, v in got.items()}
    assert nodes == sorted(brute_trie(rebuilt(CHATS)), key=key)
    said = "<|im_end|><|im_start|>assistant ok"
    assert {r[0]: r[1:5] for r in got["op12_chat_format"]} == brute_chats([*CHATS, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    check_whitened([(i, v) for i, v in VECTORS if i in (None, 4, 6, 7)], tq.op13_whitening(spark, str(folder / "full")).collect(), k=2)
    texts = [(i, t or "") for i, t in ROWS]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def piece(i, t):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        return i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())

    assert got["op1_pieces"] == sorted((piece(i, t) for i, t in texts), key=key)
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [bpe.encode(t, add_special_tokens=False).ids for _, t in texts]
    assert got["op8_token_counts"] == sorted(((i, len(t.encode()), len(x), len(x) > 512) for (i, t), x in zip(texts, ids, strict=True)), key=key)
    files = sorted(got["op5_token_files"], key=lambda r: r[1])
    assert sorted(((r[0], r[2], r[3]) for r in files), key=key) == sorted(((i, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (i, _), x in zip(texts, ids, strict=True)), key=key)
    assert [r[0] for r in files] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    assert got["op3_suffix_dedup"] == sorted(brute.repeats([(i, t) for i, t in ROWS]), key=key)
    items = [(1, "the same row"), ("", None), (2, "")]
    want = sorted(((i, *brute.contamination(t, items)) for i, t in ROWS), key=key)
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in got["op2_decontaminate"]] == [(i, n, h, len(who), c) for i, n, h, who, c in want]
    assert sorted(((r[0], *r[1:6]) for r in got["op6_quality"]), key=key) == sorted(((i, *brute.quality(t)) for i, t in ROWS), key=key)
    spans = {t: brute.personal(t) for _, t in ROWS}
    assert sorted(((r[0], r[5]) for r in got["op4_personal_data"]), key=key) == sorted(((i, sha(spans[t].encode())) for i, t in ROWS), key=key)
    sets = {i: t for i, t in texts}
    near = {(r[0], r[1]): r[2] for r in got["op9_jaccard_join"]}
    assert near[(4, 1)] == 4 and near[(6, 1)] == 4 and near[(2, 0)] == 2 and near[(3, 0)] == 3 and all(c is None for (i, _), c in near.items() if i is None) and sets
    assert [r[3] for r in got["op10_url_rules"]].count("org/") == 3


def test_pipeline_keeps_ids_and_columns(spark, folder):
    docs = spark.read.parquet(str(folder / "full" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder / "full"))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.where("doc_id = 1 AND length(text) > 1000000").count() == 1 or name == "quality_rules"


def test_token_ids_of_pieces_of_several_parts():
    """Words, signs and line breaks in any order, as the library has them."""
    import random

    import public_tokenizers

    from epiframes.llm.tokenfiles import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    signs = [*"abcXYZ\u00e9\u00df\u00f1\u024f\u0431\u042f\u03a9\u03c2\u03d0", *"  \n\n\t\r.,;!'\"$#&-_@[`{~", *"0129\u00b2\u00bd", "'s", "'ll", "don't", " \n", "\n\n"]
    signs += ["\u00a0", "\u3000", "\u2003", "\u02bc", "\u00aa", "\u6f22", "\u0301", "\x01", "\x00", "\U0001f600", "\u0481", "\u0482", "\u0378", "\u2028", "\u00d7", "\x7f", "\x85", "\x1c"]
    for _ in range(4):
        texts = ["".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(2000)]
        assert e.encode(texts) == e.each(texts)


def test_library_sees_each_word_once():
    """A word with other signs behind it is not a new piece for the library."""
    import random

    import public_tokenizers

    from epiframes.llm.tokenfiles import Encoder

    class Told:
        def __init__(self, lib):
            self.lib, self.chars = lib, 0

        def encode_batch_fast(self, texts, **options):
            self.chars += sum(map(len, texts))
            return self.lib.encode_batch_fast(texts, **options)

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=10)) for _ in range(300)]
    text = " ".join(w + end for end in ("", ".", ",", "!!", "$$$", ".\nThen") for w in words)
    want = e.each([text])
    told = [Told(getattr(e, name)) for name in ("lib", "words") if hasattr(e, name)]
    for name, x in zip(("lib", "words"), told):
        setattr(e, name, x)
    assert e.encode([text]) == want
    assert sum(x.chars for x in told) < 2 * 12 * len(words)


def test_encoder_makes_no_objects_of_pieces():
    """The work in Python does not grow with the words, known or not: they are cut, looked up and put together as arrays."""
    import cProfile
    import pstats
    import random

    import public_tokenizers

    from epiframes.llm.tokenfiles import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    words = list({"".join(rnd.choices("abcdefgh", k=8)) for _ in range(20_000)})
    texts = [" ".join(words[i : i + 500]) + ".\n" + ", ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    for some in (texts, texts[::-1]):  # unknown ones, then known ones
        told = cProfile.Profile()
        got = told.runcall(e.encode, some)
        assert pstats.Stats(told).total_calls < len(words) // 4
        assert got == e.each(some)


def test_cuts_between_odd_signs_and_a_full_table():
    """The library's ids, also where white space is odd or pieces leave the table; long pieces are not kept in it."""
    import random

    import public_tokenizers

    from epiframes.llm.tokenfiles import KEPT_BYTES, Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), entries=200)
    rnd = random.Random(6)
    signs = ["a", "the", "Ωμ", "я", "ÿ", "×", "÷", "Ϊ", "7", "'s", ".", "“", "—", "漢字", "한", "́", "<|endoftext|>", "\n", "\r\n", "\t", " ", "  ", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "\ufeff"]
    for _ in range(20):
        texts = ["".join(rnd.choices(rnd.sample(signs, rnd.choice([2, 4, 12])), k=rnd.choice([0, 1, 3, 9, 30]))) for _ in range(300)]
        assert e.encode(texts) == e.each(texts)
        assert len(e.known) <= 200
    long = ["漢" * 5000, "x" * 5000, ""]
    assert e.encode(long) == e.each(long)
    assert max(len(p.encode()) for p in e.known.to_pylist()) <= KEPT_BYTES
