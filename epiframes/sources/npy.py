"""A data source for .npy ensembles: byte ranges planned from the headers, samples pruned by filters.

Only version headers of plain C-ordered numbers are read, never pickles.  Files are opened through pyarrow's file
systems, so local paths and the schemes that pyarrow knows (hdfs, s3, gs, abfs) can be read in parts; for a
store that only Spark reaches, ``readers.read_sample_tensors(..., whole_files=True)`` takes whole files.
"""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_INDICES = ("sample_id", "feature", "week_idx", "place")
SCHEMA = "file string, " + ", ".join(f"{c} int" for c in _INDICES) + ", value double"
_ARROW = pa.schema([("file", pa.string()), *((c, pa.int32()) for c in _INDICES), ("value", pa.float64())])
#: Bytes of one planned range at least one sample long, and rows of one batch: what a task holds.
RANGE_BYTES, BATCH_CELLS = 32 << 20, 200_000


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    shape: tuple[int, int, int, int]  # samples, features, weeks, places
    dtype: str
    start: int


def read_header(stream) -> Header:
    """Shape and type of an array from the first bytes of its file."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size = struct.unpack("<H", stream.read(2))[0] if magic[6] == 1 else struct.unpack("<I", stream.read(4))[0]
    told = ast.literal_eval(stream.read(size).decode("latin1" if magic[6] < 3 else "utf8"))
    dtype = np.dtype(told["descr"])
    if dtype.hasobject or dtype.kind not in "fiu":
        raise ValueError(f"only numbers can be read, not {dtype}")
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("only C-ordered arrays can be read in parts")
    shape = tuple(told["shape"])
    if len(shape) == 3:
        shape = (shape[0], 1, *shape[1:])
    if len(shape) != 4:
        raise ValueError(f"an ensemble has 3 or 4 dimensions, not {len(shape)}")
    return Header(shape, dtype.str, stream.tell())


@dataclass
class Range(InputPartition):
    """Samples first to last - 1 of a file."""

    uri: str
    file: str
    header: Header
    first: int
    last: int

    def __post_init__(self) -> None:
        InputPartition.__init__(self, (self.file, self.first, self.last))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes
        self.least, self.most = 0, None
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of sample_id with constants choose byte ranges; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("sample_id",):
                yield f
            elif isinstance(f, EqualTo):
                self._keep({f.value})
            elif isinstance(f, In):
                self._keep(set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.most = top if self.most is None else min(self.most, top)
            else:
                yield f

    def _keep(self, ids: set[int]) -> None:
        self.only = ids if self.only is None else self.only & ids

    def _runs(self, n: int, step: int) -> Iterator[tuple[int, int]]:
        """Runs of at most ``step`` wanted samples."""
        low, high = self.least, n if self.most is None else min(n, self.most)
        if self.only is None:
            yield from ((i, min(i + step, high)) for i in range(low, high, step))
            return
        first = last = None
        for i in sorted(x for x in self.only if low <= x < high):
            if last == i and i - first < step:
                last = i + 1
                continue
            if first is not None:
                yield first, last
            first, last = i, i + 1
        if first is not None:
            yield first, last

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in found if f.type == FileType.File and f.path.endswith(".npy")), key=lambda f: f.path):
            with system.open_input_file(f.path) as stream:
                header = read_header(stream)
            bytes_each = int(np.prod(header.shape[1:])) * np.dtype(header.dtype).itemsize
            step = max(1, self.range_bytes // max(1, bytes_each))
            name = f.path[len(root) :].lstrip("/") or f.path.rsplit("/", 1)[-1]
            out += [Range(f.path, name, header, a, b) for a, b in self._runs(header.shape[0], step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no range was planned
            return
        system, _ = file_system(self.path)
        _, features, weeks, places = part.header.shape
        dtype = np.dtype(part.header.dtype)
        cells = features * weeks * places
        with system.open_input_file(part.uri) as stream:
            at, end = part.first * cells, part.last * cells
            while at < end:
                n = min(BATCH_CELLS, end - at)
                stream.seek(part.header.start + at * dtype.itemsize)
                value = np.frombuffer(stream.read(n * dtype.itemsize), dtype)
                cell = np.arange(at, at + n)
                place, cell = cell % places, cell // places
                week, cell = cell % weeks, cell // weeks
                cols = [pa.array([part.file] * n), *(pa.array(x.astype(np.int32)) for x in (cell // features, cell % features, week, place)), pa.array(value.astype(float))]
                yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)
                at += n


class NpySamples(DataSource):
    """Rows (file, sample_id, feature, week_idx, place, value) of all .npy files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "npy_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(NpySamples)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return spark.read.format("npy_samples").option("range_bytes", range_bytes).load(path)


def npy_bytes(array: np.ndarray) -> bytes:
    """A C-ordered array as the bytes of a .npy file."""
    np.save(out := io.BytesIO(), np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()
