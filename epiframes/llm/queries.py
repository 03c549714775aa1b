"""Queries over the text tables: each applies its operator to a whole table and derives fixed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import count_tokens
from .chats import format_chats, read_chats
from ..sources.shared import shared_dir
from .common import table, text_or_empty
from .decontaminate import decontaminate
from .oracles import ORACLES
from .jaccard import near_duplicates
from .pieces import encode_decode
from .pii import BASE, digest, personal_data
from .quality import quality
from .sharding import hilbert_shards
from .suffixes import remove_repeats
from .tokenfiles import read_token_files, write_token_files
from .trie import prefix_trie
from .urls import judge_urls
from .whitening import whiten


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and their decoded text, as digests.  Edge cases: see the operator."""
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hit.  Edge cases: see the operator."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    got = decontaminate(docs, items, ["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that earlier documents hold in strings of 50.  Edge cases: see the operator."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and judged spans of every document.  Edge cases: see the operator."""
    got = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [_of_kind(code).alias(f"n_{kind}") for code, kind in enumerate(BASE)]
    return got.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _of_kind(code: int):
    return F.size(F.filter("spans", lambda s: s["kind"] == code)).cast("long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back.  Edge cases: see the operator."""
    folder = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder).withColumnRenamed("key", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics and verdict of every document.  Edge cases: see the operator."""
    got = quality(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "quality.*")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal counts along the curve.  Edge cases: see the operator."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    size = F.octet_length(text_or_empty()).cast("long") + 1
    meta = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    placed = hilbert_shards(meta, ["lang", "source", "size", "doc_id"], ["doc_id", "size", "text_crc32"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document.  Edge cases: see the operator."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word sets reach 0.85.  Edge cases: see the operator."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=4, num=85)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page.  Edge cases: see the operator."""
    got = judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))
    fixed = F.col("match.rank") >= 1000  # host and path rules; the others are the method's own words
    return got.select("page_id", "host", "path", F.when(fixed, F.col("match.rule")).alias("rule"), F.coalesce("match.verdict", F.lit("allow")).alias("verdict"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt with their leaders' turns.  Edge cases: see the operator."""
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), rebuild=True)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that consists of control strings, formatted and read back.  Edge cases: see the operator."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(rows.union(own)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding, fitted on the distinct vectors.  Edge cases: see the operator."""
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", components=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_rules": op10_url_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = ORACLES
