"""Sinks: partitioned Parquet, hub CSV files, tensors and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .named_files import write_named
from .npy import file_system, npy_bytes


def write_observations(df: DataFrame, path: str) -> None:
    df.withColumn("sample", F.col("sample").cast("string")).write.partitionBy("datasetH1").parquet(path)


def write_hub_forecasts(df: DataFrame, path: str, date: str = "reference_date") -> None:
    """``<model>/<date>-<model>.csv``, one file for each model and date, rows in order: what ``read_hub_forecasts`` reads."""
    # the date is repeated as data, as the hub's files hold it themselves
    inner = [c for c in df.columns if c != "model"]
    write_named(df.withColumn("_date", F.col(date).cast("string")), path, "{model}/{_date}-{model}.csv", ["model", "_date"], order=inner)


def write_run_forecasts(df: DataFrame, path: str, date: str = "reference_date") -> None:
    """``<folder>/<date>.csv`` for each run folder and date: what ``read_run_forecasts`` reads."""
    write_named(df.withColumn("_date", F.col(date).cast("string")), path, "{folder}/{_date}.csv", ["folder", "_date"])


def write_trajectories(df: DataFrame, path: str) -> None:
    """``<model>/samples.parquet``: what ``read_trajectories`` reads."""
    write_named(df, path, "{model}/samples.parquet", ["model"], kind="parquet")


def write_tensors(df: DataFrame, path: str, mix: str) -> None:
    """Tensors with their main origins and the mix's description as columns."""
    df.withColumn("mix_cfg", F.lit(mix)).write.parquet(path)


def write_ensembles(df: DataFrame, path: str) -> None:
    """``<run_id>/<location>.npy`` for each run and place, samples by weeks by one place: what ``read_sample_tensors`` reads.

    Samples and weeks are numbered in order within the file; cells that no row has are 0.  A file is built in the task that holds its rows.
    """

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        weeks, week = np.unique(pdf["week"].to_numpy(), return_inverse=True)
        ids, sample = np.unique(pdf["sample_id"].to_numpy(), return_inverse=True)
        a = np.zeros((len(ids), len(weeks), 1))
        a[sample, week, 0] = pdf["value"].to_numpy(float)
        system, root = file_system(path)
        target = f"{root}/{pdf['run_id'].iloc[0]}/{pdf['location'].iloc[0]}.npy"
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(target) as out:
            out.write(npy_bytes(a))
        return pd.DataFrame({"file": [target], "cells": [a.size]})

    df.groupBy("run_id", "location").applyInPandas(save, "file string, cells long").agg(F.sum("cells")).collect()


def write_summary_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)
