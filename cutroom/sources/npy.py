"""Files of clips' features as Spark data sources: NumPy matrices, shape before values, and action-unit tables.

Tasks read groups of files. Of a matrix file the header is read first; values only if its shape is the expected one, so
a wrong file costs its first few KB. Files are opened through pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import ColumnPath, DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of a task's files, and of a batch that it gives.
GROUP, BATCH = 64 << 20, 4 << 20
#: A file's clip and modality, by its name.
NAME = re.compile(r"^(?P<clip_id>.+)_(?P<modality>[a-z]+)_aligned\.npy$")
_HEADER = 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    folder: str
    files: list[tuple[str, int]]


def grouped(folder: str, suffix: str, most: int, wanted=lambda path: True) -> list[Files]:
    """All files under folder with the suffix, in groups of about `most` bytes."""
    system, root = opened(folder)
    found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(suffix) and wanted(i.path))
    groups, held = [], 0
    for path, size in found:
        if not groups or held + size > most:
            groups.append(Files(folder, []))
            held = 0
        groups[-1].files.append((path, size))
        held += size
    return groups or [Files(folder, [])]


def named(path: str) -> tuple[str, str | None]:
    name = path.rsplit("/", 1)[-1]
    parts = NAME.match(name)
    return (parts["clip_id"], parts["modality"]) if parts else (name.removesuffix(".npy"), None)


def header(start: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """shape, column-major, dtype, and where values begin, of a file's first bytes."""
    text = io.BytesIO(start)
    version = np.lib.format.read_magic(text)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return *read(text), text.tell()


def matrix(file, expected: tuple[int, ...] | None, values: bool) -> tuple[list[int] | None, str | None, np.ndarray | None]:
    """(shape, error, values) of an open file. Values are read only of a sound file of the expected shape."""
    try:
        shape, columns_first, kind, at = header(file.read(_HEADER))
    except ValueError as e:
        return None, f"not a matrix file: {e}", None
    if kind.hasobject or kind.kind not in "fiub":
        return list(shape), f"values of type {kind}", None
    if expected is not None and tuple(shape) != expected or expected is None and len(shape) > 2:
        return list(shape), f"shape {tuple(shape)}", None
    if not values:
        return list(shape), None, None
    size = int(np.prod(shape, dtype=np.int64)) * kind.itemsize
    file.seek(at)
    body = file.read(size)
    if len(body) < size:
        return list(shape), "truncated", None
    flat = np.frombuffer(body, kind).astype(np.float64)
    return list(shape), None, flat.reshape(shape, order="F" if columns_first else "C").reshape((-1, shape[-1]) if len(shape) > 1 else (1, -1))


def nested(matrices: list[np.ndarray | None]) -> pa.Array:
    """Matrices, or nulls, as lists of lists."""
    some = [m for m in matrices if m is not None]
    flat = pa.array(np.concatenate([m.ravel() for m in some]) if some else np.zeros(0))
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([m.shape[1] for m in some for _ in range(len(m))])]).astype(np.int32)), flat)
    ends = np.cumsum([0 if m is None else len(m) for m in matrices])
    begins = pa.array([None if m is None else int(e) - len(m) for m, e in zip(matrices, ends, strict=True)] + [int(ends[-1]) if len(ends) else 0], pa.int32())
    return pa.ListArray.from_arrays(begins, rows)


class Matrices(DataSource):
    """format("npy"): path, clip_id, modality, shape, error (null: sound), matrix of each .npy file under `path`.

    Options: shape ("50x768": expected of all files) or shape.<modality>; values ("false": headers only); group_bytes; by_name ("true": filters on names
    choose files, for sessions that push filters to Python sources).
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, clip_id string, modality string, shape array<int>, error string, matrix array<array<double>>"

    def reader(self, schema) -> MatrixReader:
        return (NamedReader if self.options.get("by_name") == "true" else MatrixReader)(dict(self.options))


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.values = options["path"], options.get("values", "true").lower() != "false"
        self.most = int(options.get("group_bytes", GROUP))
        self.shapes = {k.lower(): tuple(map(int, v.split("x"))) for k, v in options.items() if k.lower().startswith("shape")}
        self.only: list[tuple[str, set]] = []

    def wanted(self, path: str) -> bool:
        return all(dict(zip(("clip_id", "modality"), named(path), strict=True))[c] in values for c, values in self.only)

    def partitions(self) -> Sequence[InputPartition]:
        return grouped(self.path, ".npy", self.most, self.wanted)

    def read(self, group: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(group.folder)
        rows, held = [], 0
        for path, size in group.files:
            clip_id, modality = named(path)
            expected = self.shapes.get(f"shape.{modality}", self.shapes.get("shape"))
            with system.open_input_file(path) as file:
                rows.append((path, clip_id, modality, *matrix(file, expected, self.values)))
            held += size
            if held > BATCH:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, clip_id, modality, shape, error, values = zip(*rows, strict=True)
        strings = [pa.array(c, pa.string()) for c in (path, clip_id, modality)]
        return pa.RecordBatch.from_arrays([*strings, pa.array(shape, pa.list_(pa.int32())), pa.array(error, pa.string()), nested(list(values))], names=["path", "clip_id", "modality", "shape", "error", "matrix"])


class NamedReader(MatrixReader):
    """Chooses files by name before any is opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on clip_id and modality choose files by name; the rest is left to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if column in ("clip_id", "modality"):
                self.only.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f


class ActionUnits(DataSource):
    """format("action_units"): path, frame, au of each row of the .csv files under `path`. Each file has its own columns.

    au: the file's intensities (AU.._r; if it has none, AU and digits) in order of name, `most` (35) at most, what is
    missing or no number as 0, filled up with 0.
    """

    @classmethod
    def name(cls) -> str:
        return "action_units"

    def schema(self) -> str:
        return "path string, frame int, au array<double>"

    def reader(self, schema) -> ActionUnitReader:
        return ActionUnitReader(dict(self.options))


class ActionUnitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.group = options["path"], int(options.get("most", 35)), int(options.get("group_bytes", GROUP))

    def partitions(self) -> Sequence[InputPartition]:
        return grouped(self.path, ".csv", self.group)

    def columns(self, names: list[str]) -> list[int]:
        clean = [n.strip() for n in names]
        found = [n for n in clean if n.startswith("AU") and "_r" in n] or [n for n in clean if n.startswith("AU") and n[2:].isdigit()]
        return [clean.index(n) for n in sorted(found)[: self.most]]

    def read(self, group: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(group.folder)
        for path, _ in group.files:
            with system.open_input_stream(path) as raw:
                lines = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""))
                at, n = self.columns(next(lines, [])), 0
                while rows := list(islice(lines, 4096)):
                    values = np.zeros((len(rows), self.most))
                    for i, row in enumerate(rows):
                        values[i, : len(at)] = [_number(row[j]) if j < len(row) else 0.0 for j in at]
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.most), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(np.arange(n, n + len(rows), dtype=np.int32)), arrays], names=["path", "frame", "au"])
                    n += len(rows)


def _number(text: str) -> float:
    try:
        x = float(text)
    except ValueError:
        return 0.0
    return 0.0 if np.isnan(x) else x


def read(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    """The rows of a source of this module. Filters on clip_id and modality choose files where the session lets them be pushed (spark.sql.python.filterPushdown.enabled)."""
    spark.dataSource.register(kind)
    options["by_name"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format(kind.name()).options(**{k.replace("__", "."): str(v) for k, v in options.items()}).load(path)


def written(path: str, array: np.ndarray) -> int:
    """Writes array to a file, whole or not at all: a repeated task puts the same file in its place. Bytes written."""
    system, place = opened(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    text = io.BytesIO()
    np.save(text, array)
    part = f"{place}.{np.random.default_rng().integers(1 << 62)}.part"
    with system.open_output_stream(part) as out:
        out.write(text.getbuffer())
    system.move(part, place)
    return text.tell()


def write_matrices(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (clip_id, modality, matrix), a file each, as tasks come to it; path and bytes of each file. What is ragged is filled up with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for clip_id, modality, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths.append(f"{folder}/{clip_id}_{modality}_aligned.npy")
                sizes.append(written(paths[-1], rectangle(values)))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(F.col("clip_id").cast("string"), "modality", F.col("matrix").cast("array<array<double>>")).mapInArrow(run, "path string, bytes bigint")


def rectangle(rows: list[list[float]] | None, columns: int | None = None) -> np.ndarray:
    """Rows of numbers as a matrix: cut or filled up with 0 to `columns` (or the longest), null as nan."""
    rows = rows or []
    columns = max((len(r) for r in rows), default=0) if columns is None else columns
    out = np.zeros((len(rows), columns))
    for i, r in enumerate(rows):
        out[i, : min(columns, len(r))] = [np.nan if x is None else x for x in r[:columns]]
    return out
