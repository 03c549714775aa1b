"""The pipeline's stages, each against plain definitions on a small table."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    words = [*["the", "of", "and"] * 8, *[f"word{i}" for i in range(300)]]
    item = " ".join(rnd.choices(words, k=30))
    texts = {i: " ".join(rnd.choices(words, k=120)) for i in range(20)}
    texts[20] = texts[3] + " tail"  # near copy
    texts[21] = "### $$$ %%% " * 40  # junk
    texts[22] = " ".join(rnd.choices(words, k=60)) + " " + item  # contaminated
    texts[23] = " ".join(rnd.choices(words, k=900)) + " " + item + " me@mail.example.com"  # a small share: cut
    texts[24] = None
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in df.collect()}
    assert set(kept["quality_rules"]) == {*range(21), 22, 23}
    assert set(kept["jaccard_join"]) == {*range(20), 22, 23}
    assert set(kept["benchmark_decontamination"]) == {*range(20), 23}
    assert brute.contamination(kept["benchmark_decontamination"][23].text, [(0, item)])[1] == 0
    assert "<email>" in kept["personal_data"][23].text and "@" not in kept["personal_data"][23].text
    assert all(kept["personal_data"][i].text == texts[i] for i in range(20))
    assert set(kept["sentencepiece"]) == {*range(20), 23}
    assert all(list(r.asDict())[:5] == list(corpus_pipeline.COLUMNS) for k in list(kept)[:4] for r in kept[k].values())


def test_near_duplicate_stage_with_repeated_ids_and_rows(spark, tmp_path):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, near), (7, near), (7, "a clean text that shares its id with a copy of another one"), (9, "the same row twice is one document"), (9, "the same row twice is one document"), (None, near), (None, near), (4, None), (4, None), (5, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, first int"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1) for i, t in rows], schema)
    left = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.jaccard_join(spark, df, str(tmp_path)).collect())
    want = [(-1, near), (-1, near), (3, near), (4, ""), (4, ""), (5, ""), (7, rows[2][1]), (9, rows[3][1])]
    assert left == want


def test_whole_pipeline_on_odd_rows(spark, tmp_path):
    """run() on repeated rows, null ids and texts, an empty text and one of over 1 MiB."""
    import hashlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    rnd = random.Random(12)
    words = [*["the", "of", "and"] * 8, *[f"word{i}" for i in range(400)]]
    plain = [" ".join(rnd.choices(words, k=150)) for _ in range(6)]
    long = "\n".join(" ".join(rnd.choices([*words, *(f"long{i}" for i in range(3000))], k=40)) for _ in range(4500))
    assert len(long) > 1 << 20
    rows = [(1, plain[0]), (1, plain[0]), (2, plain[1]), (3, plain[1] + " tail"), (4, long), (5, None), (6, ""), (None, plain[2]), (7, plain[3]), (7, plain[4])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "not in any of them " * 5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def coded(i, t):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    want = [coded(i, t) for i, t in ((1, plain[0]), (2, plain[1]), (4, long), (None, plain[2]), (7, plain[3]), (7, plain[4]))]
    got = [tuple(r)[:3] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


class _Captured:
    """Stands for a DataFrame; keeps the functions that its batches would go through."""

    def __init__(self, spark):
        self.sparkSession, self.functions = spark, []

    def mapInArrow(self, fn, schema):
        self.functions.append(fn)
        return self

    def select(self, *columns):
        return self

    repartitionById = select


def test_workers_drop_what_other_operators_keep(spark):
    """Workers serve all stages: the coder's tables beside the join's arrays overfilled an executor."""
    import weakref

    import public_tokenizers

    from epiframes.llm import common, jaccard, pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    for start in ("batches", "signatures"):
        held = weakref.ref(pieces.coder(path))
        common.keep_only(pieces.__name__)
        assert held() is pieces.coder(path)
        docs = _Captured(spark)
        if start == "batches":
            common.map_batches(docs, lambda batch: iter(()), "x long")
        else:
            jaccard.tied(docs, [], 5, 80, 100)
        assert list(docs.functions[0]([])) == []
        assert held() is None


def test_signatures_are_dealt_in_bounded_memory(spark):
    import tracemalloc

    import pyarrow as pa

    from epiframes.llm import jaccard

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(250)]
    plans = [jaccard.allocate(lo, hi, 1000, 80, 100) for lo, hi in jaccard.band_bounds(400)]
    docs = _Captured(spark)
    jaccard.tied(docs, plans, 5, 80, 100)
    # each batch says the same in other words, as each comes with a word of its own
    batches = (pa.RecordBatch.from_arrays([pa.array([f"b{k}x " + t.replace("w", f"b{k}x") for t in texts])], names=["t"]) for k in range(44))
    tracemalloc.start()
    try:
        sent = sum(sum(map(len, b.column(2).to_pylist())) for b in docs.functions[0](batches))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 0.8 * (16 << 20)  # a million signatures were held before
    assert most < 64 << 20
