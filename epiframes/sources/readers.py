"""Sources: CSV, Parquet, npy and JSON files as tables with explicit schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOCATIONS, OBSERVATIONS
from .named_files import published
from .npy import read_npy


def _csv(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """All columns as text; the caller casts.  Columns are found by header name, in any order."""
    df = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options).csv(path)
    return df if columns is None else df.select(*columns)


def _below(glob: str) -> dict:
    """Options of a read that takes all files of a kind below a folder."""
    return {"recursiveFileLookup": True, "pathGlobFilter": glob}


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """date, location (trimmed text), value."""
    raw = _csv(spark, path, ["date", "location", "value"])
    return nan_to_null(raw.select(F.col("date").try_cast("date").alias("date"), F.trim("location").alias("location"), F.col("value").try_cast("double").alias("value")))


def read_hub_forecasts(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """All ``<model>/<date>-<model>.csv`` below a folder in one read; model and date come from the path.

    Of a folder with manifests only the files that these list are read."""
    raw = spark.read.options(header=True, enforceSchema=False, **_below("*.csv")).csv(published(spark, path) or path)
    file = F.col("_metadata.file_path")
    out = raw.select("*", F.url_decode(F.regexp_extract(file, r"/([^/]+)/[^/]+\.csv$", 1)).alias("model"), F.regexp_extract(file, r"/(\d{4}-\d{2}-\d{2})-[^/]+\.csv$", 1).try_cast("date").alias("file_date"))
    out = out.where(F.col("file_date").isNotNull())
    return out.where(~F.col("model").isin(*ignore)) if ignore else out


def read_run_forecasts(spark: SparkSession, path: str, skip: str = "-copaint.csv") -> DataFrame:
    """Forecasts in nested run folders; model is ``<folder before ::conf_>::<config>``."""
    raw = spark.read.options(header=True, **_below("*.csv")).csv(published(spark, path) or path)
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(file, r"/([^/]*::conf_[^/]*)/", 1)
    out = raw.select("*", file.alias("_file"), folder.alias("folder")).where(~F.endswith("_file", F.lit(skip)) & (F.col("folder") != ""))
    config = F.regexp_extract("folder", r"::conf_([^:]+)", 1)
    return out.withColumn("model", F.concat(F.regexp_extract("folder", r"^(.*?)::conf_", 1), F.lit("::"), config)).drop("_file")


def read_trajectories(spark: SparkSession, path: str, example: str = "example") -> DataFrame:
    """Scenario-hub Parquet, optional columns as nulls; per model the first file (by path) that has sample rows."""
    raw = spark.read.options(mergeSchema=True, **_below("*.parquet")).parquet(*(published(spark, path) or [path]))
    for c, kind in (("run_grouping", "double"), ("stochastic_run", "string"), ("output_type_id", "double")):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast(kind))
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("model", F.url_decode(F.regexp_extract("_file", r"/([^/]+)/[^/]+$", 1)))
    rows = rows.where(~F.contains("model", F.lit(example)))
    first = rows.where("output_type = 'sample'").groupBy("model").agg(F.min("_file").alias("_file"))
    return rows.join(first, ["model", "_file"], "left_semi").drop("_file")


def read_surveillance_csv(spark: SparkSession, path: str, value: str, region: str = "region", week: str = "epiweek") -> DataFrame:
    """Cached weekly series: epidemiological week, region, value, and the week's end."""
    from ..functions.seasons import epiweek_to_enddate

    raw = _csv(spark, path, [week, region, value])
    out = raw.select(F.col(week).try_cast("int").alias("epiweek"), F.col(region).alias("region"), F.col(value).try_cast("double").alias("value"))
    return nan_to_null(out.withColumn("week_enddate", epiweek_to_enddate(F.col("epiweek"))))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATIONS).parquet(path).withColumn("sample", F.col("sample").cast("string"))


def sample_tensors(files: DataFrame) -> DataFrame:
    """.npy ensembles (samples, weeks, places) or (samples, features, weeks, places), given as (path, content), as
    rows (file, sample_id, feature, week_idx, place, value); one file at a time per task, no pickles."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[:, None] if a.ndim == 3 else a
                for s in range(a.shape[0]):
                    f, w, p = np.indices(a.shape[1:])
                    yield pd.DataFrame({"file": file, "sample_id": s, "feature": f.ravel(), "week_idx": w.ravel(), "place": p.ravel(), "value": a[s].ravel().astype(float)})

    return files.select("path", "content").mapInPandas(unpack, "file string, sample_id int, feature int, week_idx int, place int, value double")


def read_sample_tensors(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """All .npy ensembles below a folder, in byte ranges planned from their headers; a filter on sample_id prunes ranges.

    ``whole_files`` reads each file at once instead, through Spark, for stores that nothing else reaches.
    """
    if not whole_files:
        return read_npy(spark, path)
    return sample_tensors(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path))


def read_run_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", finished: bool = True) -> DataFrame:
    raw = spark.read.schema(schema).format(fmt).option("header", True).load(path)
    return raw.where(F.col("status") == "FINISHED") if finished and "status" in raw.columns else raw


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Location dimension; codes stay text with their leading zeros."""
    raw = _csv(spark, path)
    return raw.select(*[(F.trim(f.name) if f.dataType == T.StringType() else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in LOCATIONS.fields if f.name in raw.columns])
