"""Whitening of embeddings by a covariance in two passes.

Entries become integers, x = floor(SCALE * c) + SHIFT, so sums are exact whatever the order: the first pass gives the
number n and the sums S. The second subtracts the mean S / n from each entry before anything is multiplied; a task
multiplies its centred block by itself (GEMM) and adds up one matrix, and treeAggregate merges the tasks' matrices. The
driver holds one matrix of dimension x dimension, solves it by LAPACK's symmetric eigensolver, and broadcasts the
projection on at most COMPONENTS components. A third pass of the same kind is over the whitened rows: how far their
covariance is from the identity.

Rows whose vector is null or has null or non-finite entries are left out. So are vectors of another length than the most
frequent one (of equally frequent ones the longest): there is no covariance with them. Repeated rows count each time; a
null vec_id is an id like others. A component without variance (a constant dimension, fewer rows than dimensions) has a
null whitened value and explains 0. Entries beyond 2**36 in size count as 2**36. deviation is null where it does not fit
a long. No vectors give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries of a block of rows: 8 MB as doubles.
_BLOCK = 1 << 20
_MOST = 2.0**36


def _blocks(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of the usable vectors of (vec_id, embedding), of one length or of each length by itself."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float), nan=-1).astype(np.int64)
    for n in [size] if size else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        for some in np.array_split(rows, max(1, -(-len(rows) * n // _BLOCK))):
            if len(some):
                entries = vectors.take(pa.array(some)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)  # a null is nan
                sound = np.isfinite(entries).all(axis=1)
                x = np.floor(SCALE * np.clip(entries[sound], -_MOST, _MOST)).astype(np.int64) + SHIFT
                yield ids.take(pa.array(some[sound])), x


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "embedding")


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n, and S as whole numbers of any size, of vectors of the most frequent length. A task gives one row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                own = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                own[0] += len(x)
                own[1] += x.sum(axis=0).astype(object)  # 2**20 entries under 2**43: fits
        for length, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["length", "n", "sums"])

    parts = _rows(vectors).mapInArrow(run, "length int, n bigint, sums array<string>")
    sums = parts.select("length", "n", F.posexplode("sums").alias("at", "s")).groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    every = sums.groupBy("length").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
    best = every.filter("n > 0").orderBy(F.desc("n"), F.desc("length")).first()
    return (best["n"], [int(x["s"]) for x in best["sums"]]) if best else (0, [])


def _products(rows: DataFrame, dim: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of y'y: of_block makes y of a block of centred vectors. One matrix a task, merged as a tree."""

    def run(batches: Iterator[pa.RecordBatch], total=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in of_block(batch):
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(total: np.ndarray, matrix) -> np.ndarray:
        return total + (matrix if isinstance(matrix, np.ndarray) else np.frombuffer(matrix["m"]).reshape(dim, dim))

    return rows.mapInArrow(run, "m binary").rdd.treeAggregate(np.zeros((dim, dim)), add, add, depth=2)


@dataclass
class Whitening:
    """n, S, and the components: eigenvalues in falling order, projection (dimension x components), shares of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    projection: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts first, so that nothing is rounded before the last step."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n for s in self.sums], object).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)**2, exact: in longs where they hold it, else in whole numbers of any size."""
        whole, rest = (np.array(v, object) for v in zip(*(divmod(s, self.n) for s in self.sums), strict=True))
        apart = x - whole.astype(np.int64)
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            return pa.array(((apart * self.n - rest.astype(np.int64)) ** 2).sum(axis=1))
        exact = ((apart.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; nan where a component has no variance."""
        root = np.sqrt(self.values)
        return self.centred(x) @ self.projection / np.where(root > 0, root, np.nan)


def fit(vectors: DataFrame) -> Whitening | None:
    """Over all usable vectors; None without any."""
    n, sums = exact_sums(vectors)
    if not n:
        return None
    dim = len(sums)
    shell = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    covariance = _products(_rows(vectors), dim, lambda batch: (shell.centred(x) for _, x in _blocks(batch, dim))) / n
    values, components = np.linalg.eigh((covariance + covariance.T) / 2)
    values, components = values[::-1][:COMPONENTS], components[:, ::-1][:, :COMPONENTS]
    trace = np.trace(covariance)
    values = np.where(values > dim * np.finfo(float).eps * max(trace, 0), values, 0.0)
    return Whitening(n, sums, values, np.ascontiguousarray(components), values / trace if trace > 0 else values)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry by size of the whitened rows' covariance minus the identity, over components that have variance."""
    shared, some = vectors.sparkSession.sparkContext.broadcast(model), model.values > 0
    if not some.any():
        return 0.0
    products = _products(_rows(vectors), int(some.sum()), lambda batch: (shared.value.whiten(x)[:, some] for _, x in _blocks(batch, len(shared.value.sums))))
    return float(np.abs(products / model.n - np.eye(int(some.sum()))).max())


_FIELDS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each usable vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, {_FIELDS}"
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], schema)
    shared, error = spark.sparkContext.broadcast(model), identity_error(vectors, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for batch in batches:
            for ids, x in _blocks(batch, len(model.sums)):
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                whitened = pa.array(model.whiten(x).ravel(), from_pandas=True)
                columns = [ids.take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), model.deviations(x).take(pa.array(each)), whitened, np.tile(model.explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", *(f.split()[0] for f in _FIELDS.split(", "))])

    return _rows(vectors).mapInArrow(run, schema)
