"""A corpus pipeline: five stages over documents, each applying one text operator to all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframes.llm.common import broadcast_if_small, table, text_or_empty, written
from epiframes.llm.decontaminate import decontaminate
from epiframes.llm.jaccard import near_duplicates
from epiframes.llm.pieces import encode_decode
from epiframes.llm.pii import masked, personal_data
from epiframes.llm.quality import quality
from epiframes.sources.shared import owned, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null and empty texts have no words and go; repeated rows are judged alike; very long texts are judged
    whole; an empty table stays empty; other columns are left out.
    """
    return quality(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the least (doc_id, text hash) stays.

    Rows are named by id and text: with repeated ids only the near copy goes.  Of repeated rows with one id and
    one text one stays.  Documents without words or without an id link with nothing and stay; an empty table
    stays empty; other columns are left out.
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(text_or_empty()))
    got = written(near_duplicates(docs.select("doc_id", "text"), width=5, num=80, rows_too=True))
    gone = written(got.where("NOT first").select("doc_id", "text_hash").distinct())
    kept = docs.join(broadcast_if_small(gone), ["doc_id", "text_hash"], "left_anti")
    twice = written(got.where("first AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    if twice.head(1):
        again = broadcast_if_small(twice)
        one = kept.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(one)
    return kept.select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others each hit run of words is removed.

    Null and empty texts have no words and stay; repeated rows are treated alike; very long texts are streamed
    whole; an empty table stays empty, and an empty benchmark removes nothing; other columns are left out.
    """
    docs = docs.select(*COLUMNS)
    got = decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id", "lang", "source"], cut=True)
    return _sized(got.where("NOT contaminated").withColumnRenamed("clean_text", "text"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in angle brackets.

    A null text comes back empty; repeated rows are masked alike; very long texts are read whole; an empty
    table stays empty; other columns are left out.
    """
    got = personal_data(docs.select(*COLUMNS), ["doc_id", "text", "lang", "source"])
    return _sized(got.withColumn("text", masked(F.coalesce("text", F.lit("")), F.col("spans"))))


def piece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as SentencePiece ids, with digests of the ids and of the decoded text.

    Null and empty texts have the begin and end ids only; repeated rows are coded alike; very long texts are
    coded whole; an empty table gives none; other columns are left out.
    """
    return encode_decode(docs.select("doc_id", "text"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data_masking),
    ("sentencepiece", piece_coding),
]

#: SQL cannot express the join's components, the span classifier or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage has put aside goes once its result is written."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
