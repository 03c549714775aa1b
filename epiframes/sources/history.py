"""A history of observations by season, each season replaced as a whole.

A season's rows lie in ``fluseason=<season>/version=<digest of the rows>``; numbered pointers in ``_current/<season>``
say which version holds.  A replacement writes a new version and then creates one pointer, which is atomic: readers see
the old season or the new one.  The other seasons' files are not touched.  A version is named by what is in
it, so doing the same again writes nothing, and a run that broke off is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_current"


def _digest(columns: list[str]) -> Column:
    """Order-free digest of rows: their number and two exclusive ors of hashes; equal rows are told apart by the sum."""
    one = F.xxhash64(*sorted(columns))
    two = F.hash(*sorted(columns)).cast("long")
    return F.format_string("%d-%x-%x", F.count("*"), F.bit_xor(one), F.sum(two))


class _Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.place = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointers(self, season: str | None = None) -> dict[str, list[str]]:
        """Season -> names of its pointers (number-version), ascending."""
        root = self.place(f"{self.path}/{POINTERS}")
        if not self.fs.exists(root):
            return {}
        folders = [s.getPath() for s in self.fs.listStatus(root)]
        return {p.getName(): sorted(s.getPath().getName() for s in self.fs.listStatus(p)) for p in folders if season in (None, p.getName())}

    def point(self, season: str, version: str) -> None:
        number = len(self.pointers(season).get(season, []))
        target = self.place(f"{self.path}/{POINTERS}/{season}/{number:08d}-{version}")
        if not self.fs.createNewFile(target):
            raise OSError(f"season {season} was replaced by another run")


def _version(pointer: str) -> str:
    return pointer.split("-", 1)[1]


def write_seasons(df: DataFrame, path: str) -> dict[int, str]:
    """Make the rows' seasons the current ones, in one write; what is current already is left alone.  Season -> version."""
    spark = df.sparkSession
    store = _Store(spark, path)
    data = [c for c in df.columns if c != "fluseason"]
    new = {r.fluseason: r.version for r in df.where("fluseason IS NOT NULL").groupBy("fluseason").agg(_digest(data).alias("version")).collect()}
    held = {s: _version(p[-1]) for s, p in store.pointers().items() if p}
    todo = {s: v for s, v in new.items() if held.get(str(s)) != v}
    if todo:
        versions = F.create_map(*[F.lit(x) for s, v in todo.items() for x in (s, v)])
        rows = df.where(F.col("fluseason").isin(*todo)).withColumn("version", versions[F.col("fluseason")])
        rows = rows.repartition("fluseason").write.partitionBy("fluseason", "version")
        rows.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        for s, v in sorted(todo.items()):
            store.point(str(s), v)
    return new


def replace_season(payload: DataFrame, path: str, season: int) -> str | None:
    """The payload's rows of one season take the place of the history's.  A payload without any leaves the history alone."""
    return write_seasons(payload.where(F.col("fluseason") == season), path).get(season)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the current version of every season."""
    current = {s: _version(p[-1]) for s, p in _Store(spark, path).pointers().items() if p}
    folders = [f"{path}/fluseason={s}/version={v}" for s, v in sorted(current.items())]
    return spark.read.option("basePath", path).parquet(*folders).drop("version")
