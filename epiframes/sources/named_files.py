"""A data source writer for files whose names come from the rows, published by one manifest.

Each task writes its files in place, under their final names, one at a time as its sorted rows go by, and reports
them when it is done.  Nothing is renamed.  When every task has reported, the driver adds one manifest that
lists the files; a reader of such a folder takes the files of its manifests only, so a job that failed
leaves nothing visible.  A name is made of the row's keys, so a task that runs twice writes the same file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .npy import file_system

#: The folder of manifests; hidden from Spark's listing by its first letter.
MANIFESTS = "_published"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, keys: list[str], kind: str) -> None:
        self.path, self.name, self.keys, self.kind = path, name, keys, kind
        self.job = uuid.uuid4().hex
        system, root = file_system(path)
        system.create_dir(f"{root}/{MANIFESTS}", recursive=True)

    def _open(self, system, target: str, schema: pa.Schema):
        import pyarrow.csv as pc
        import pyarrow.parquet as pq

        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        stream = system.open_output_stream(target)
        return stream, pc.CSVWriter(stream, schema, write_options=pc.WriteOptions(quoting_style="needed")) if self.kind == "csv" else pq.ParquetWriter(stream, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        done, key, stream, sink = Written(), None, None, None

        def close() -> None:
            if sink is not None:
                sink.close()
                stream.close()

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                inner = batch.drop_columns(self.keys)
                columns = [batch.column(k).to_pylist() for k in self.keys]
                named = list(zip(*columns, strict=True))
                at = 0
                while at < batch.num_rows:
                    to = at
                    while to < batch.num_rows and named[to] == named[at]:
                        to += 1
                    if named[at] != key:
                        close()
                        key = named[at]
                        file = self.name.format(**{k: quote(str(v), safe=" :+,;@$&()'!~") for k, v in zip(self.keys, key, strict=True)})
                        if file in done.files:
                            raise ValueError(f"rows of {file} do not follow one another")
                        done.files.append(file)
                        stream, sink = self._open(system, f"{root}/{file}", inner.schema)
                    sink.write_batch(inner.slice(at, to - at))
                    done.rows += to - at
                    at = to
            close()
        except BaseException:
            self._remove(done.files)
            raise
        return done

    def _remove(self, files: list[str]) -> None:
        system, root = file_system(self.path)
        for f in files:
            try:
                system.delete_file(f"{root}/{f}")
            except OSError:
                pass  # never written, or gone already

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        target = f"{root}/{MANIFESTS}/{self.job}.json"
        with system.open_output_stream(f"{target}.tmp") as out:
            for m in messages:
                for f in m.files if m else []:
                    out.write(json.dumps({"file": f}).encode() + b"\n")
        system.move(f"{target}.tmp", target)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            self._remove(m.files if m else [])


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        o = self.options
        return NamedFilesWriter(o["path"], o["file"], o["keys"].split(","), o.get("kind", "csv"))


def write_named(df: DataFrame, path: str, name: str, keys: list[str], kind: str = "csv", order: list[str] | None = None) -> None:
    """One file for each combination of ``keys``, called ``name`` with the keys filled in; the key columns are left out of the files."""
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    rows.write.format("named_files").mode("append").option("path", path).option("file", name).option("keys", ",".join(keys)).option("kind", kind).save()


def published(spark: SparkSession, path: str) -> list[str] | None:
    """Paths of the files that the manifests of a folder list; None for a folder without manifests."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.schema("file string").option("pathGlobFilter", "*.json").json(str(place)).distinct().collect()
    return [f"{path}/{r.file}" for r in rows]
