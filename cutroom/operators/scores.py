"""Scores of feature vectors against templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ranked

_LEAST = 1e-8


def _sums(terms: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of terms, one after the other: unlike a matrix product's it does not depend on how many rows a batch has."""
    out = np.zeros(shape)
    for term in terms:
        out += term
    return out


def similarities(vectors: np.ndarray, templates: list[np.ndarray]) -> np.ndarray:
    """Cosine, 0 at least, of each vector with each template over their common length; 0 for a vector of no length.

    Products are added in order of place, so that scores which differ by their last digit alone rank alike in any batch and engine.
    """
    places, rows = np.ascontiguousarray(vectors.T), len(vectors)
    size = lambda v: np.sqrt(_sums((x * x for x in v), v.shape[1:]))
    whole = size(places)
    known = whole >= _LEAST
    out = np.zeros((rows, len(templates)))
    for n in {min(len(t), len(places)) for t in templates}:
        own = [i for i, t in enumerate(templates) if min(len(t), len(places)) == n]
        given = np.stack([templates[i][:n] for i in own], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(known, size(places[:n]) / whole, 0.0) + _LEAST
            dots = _sums((np.outer(x, y) for x, y in zip(places[:n], given, strict=True)), (rows, len(own)))
            found = dots / whole[:, None] / part[:, None] / (size(given) + _LEAST)
        out[:, own] = np.where(known[:, None], np.maximum(0.0, found), 0.0)
    return out


def against_templates(df: DataFrame, column: str, templates: dict[str, list[float]], means: list[float] | None = None, deviations: list[float] | None = None) -> DataFrame:
    """df with `scores`: (label, score) of the templates, highest first, equal ones in the order given.

    Vectors of a batch are multiplied by the templates place by place. Nan, infinities and nulls count as 0; with means
    and deviations (of 0: 1) vectors are standardised first. Templates are part of a model, so they are a parameter; they
    go along with the code.
    """
    given = [np.asarray(t, float) for t in templates.values()]
    shift, scale = (None if v is None else np.asarray(v, float) for v in (means, deviations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            found = np.zeros((batch.num_rows, len(given)))
            for n in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == n)
                values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(float)
                values = np.where(np.isfinite(values), values, 0.0)
                if shift is not None:
                    values = values - np.resize(shift, n)
                if scale is not None:
                    values = values / np.where(np.resize(scale, n) == 0, 1.0, np.resize(scale, n))
                found[rows] = similarities(values, given)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(given)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "__scores"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.withColumn("__v", F.col(column).cast("array<double>")).mapInArrow(run, f"{schema}, __scores array<double>")
    return rows.withColumn("scores", ranked({label: F.col("__scores")[i] for i, label in enumerate(templates)})).drop("__scores")
