"""Frames of a video: numbers that describe a face's picture, and the scenes between cuts."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.npy import rectangle

_ALL, _MOUTH = (0, 1), (0.6, 1)
_HALF, _THIRD = Fraction(1, 2), Fraction(1, 3)
# The 35 numbers of a face in order. Pictures are grey, 0 to 255, and all numbers but ratios of lengths are
# divided by 255 (variances by its square). Regions are (rows, columns), each from and to a share of the face.
STATISTICS = (
    ("mean", (0, 0.5), _ALL), ("variance", (0, 0.5), _ALL), ("mean", (0, _THIRD), _ALL), ("difference", 2, 9), ("width to height",), ("width to picture",), ("height to picture",),
    ("mean", _MOUTH, _ALL), ("variance", _MOUTH, _ALL), ("mean", (2 * _THIRD, 1), _ALL), ("difference", 9, 2), ("mean", _MOUTH, (0, _HALF)), ("mean", _MOUTH, (_HALF, 1)), ("mean", (_THIRD, 2 * _THIRD), _ALL),
    ("mean", (0.3, 0.7), _ALL), ("mean", (0.4, 0.55), _ALL), ("mean", (0.55, 0.7), _ALL), ("deviation",), ("range",), ("left to right",),
    ("size of", 19), ("mean", _ALL, (0.25, 0.45)), ("mean", _ALL, (0.55, 0.75)), ("mean", (0.1, 0.25), _ALL), ("mean", (0.25, 0.4), _ALL), ("mean", (0.7, 0.85), _ALL), ("mean", (0.85, 1), _ALL),
    ("slope", 1), ("slope", 0), ("steepness", 1), ("steepness", 0), ("percentile", 50), ("percentile", 25), ("percentile", 75), ("difference", 33, 32),
)


def _upto(n: int, share) -> int:
    return n if share == 1 else n * share.numerator // share.denominator if isinstance(share, Fraction) else int(n * share)


def _region(face: np.ndarray, rows: tuple, columns: tuple) -> np.ndarray:
    (h, w), cut = face.shape, _upto
    return face[cut(h, rows[0]) : cut(h, rows[1]), cut(w, columns[0]) : cut(w, columns[1])]


def slopes(face: np.ndarray, axis: int) -> np.ndarray:
    """Sobel: differences of neighbours along an axis, smoothed (1, 2, 1) along the other; the picture is mirrored about its border pixels."""
    padded = np.pad(face, 1, mode="reflect" if min(face.shape) > 1 else "edge")
    along = padded if axis else padded.T
    steps = along[:, 2:] - along[:, :-2]
    smooth = steps[:-2] + 2 * steps[1:-1] + steps[2:]
    return smooth if axis else smooth.T


def describe(picture: np.ndarray, box: tuple[int, int, int, int] | None) -> np.ndarray:
    """STATISTICS of the face in box (x1, y1, x2, y2) of a picture; zeros without a face, 0 for a region without pixels."""
    out = np.zeros(len(STATISTICS))
    if box is None or box[2] <= box[0] or box[3] <= box[1]:
        return out
    x1, y1, x2, y2 = (max(0, int(v)) for v in box)
    face = picture[y1:y2, x1:x2].astype(np.float64)
    if not face.size:
        return out
    mean = lambda part: part.mean() / 255 if part.size else 0.0
    slope = [slopes(face, axis) for axis in (0, 1)]
    for i, (what, *about) in enumerate(STATISTICS):
        match what:
            case "mean":
                out[i] = mean(_region(face, *about))
            case "variance":
                out[i] = part.var() / 255**2 if (part := _region(face, *about)).size else 0.0
            case "width to height":
                out[i] = (x2 - x1) / (y2 - y1)
            case "width to picture":
                out[i] = (x2 - x1) / picture.shape[1]
            case "height to picture":
                out[i] = (y2 - y1) / picture.shape[0]
            case "deviation":
                out[i] = face.std() / 255
            case "range":
                out[i] = (face.max() - face.min()) / 255
            case "left to right":
                out[i] = mean(_region(face, _ALL, (0, _HALF))) - mean(_region(face, _ALL, (_HALF, 1)))
            case "slope":
                out[i] = mean(slope[about[0]])
            case "steepness":
                out[i] = mean(np.abs(slope[about[0]]))
            case "percentile":
                out[i] = np.percentile(face, about[0]) / 255
    for i, (what, *about) in enumerate(STATISTICS):  # of other numbers
        if what == "difference":
            out[i] = out[about[0]] - out[about[1]]
        elif what == "size of":
            out[i] = abs(out[about[0]])
    return out


def statistics(frames: DataFrame, picture: str = "picture", box: str = "box") -> DataFrame:
    """frames with `statistics`, an array of 35; picture is a matrix of grey values, box [x1, y1, x2, y2] or null. No shuffle: a frame is described where it is read."""
    kept = [c for c in frames.columns if c not in (picture, box)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures, boxes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__picture", "__box"))
            found = [describe(rectangle(p), tuple(b) if b and len(b) == 4 and None not in b else None) for p, b in zip(pictures, boxes, strict=True)]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(np.concatenate(found) if found else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], values], names=[*kept, "statistics"])

    rows = frames.select(*kept, F.col(picture).cast("array<array<double>>").alias("__picture"), F.col(box).cast("array<int>").alias("__box"))
    return rows.mapInArrow(run, f"{schema}{', ' if kept else ''}statistics array<double>")


def moments(described: DataFrame, key: str, column: str = "statistics") -> DataFrame:
    """key, place, n, mean, variance, least and most of each number over a key's frames: partial moments of each task are merged, so a key may have any number of frames."""
    each = described.select(key, F.posexplode(column).alias("place", "x"))
    return each.groupBy(key, "place").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.min("x").alias("least"), F.max("x").alias("most"))


#: Frames of a block, by their number.
BLOCK = 1024


def change(frames: DataFrame, key: str, at: str, vector: str) -> DataFrame:
    """(key, at, change): mean size of the difference of each frame's vector from the frame before it; null for a key's first.

    Frames are dealt by key and block of `at`; a block's last frame goes along with the next block that the key has
    frames in, so neither a long video nor a gap makes one task's work. `at` is a whole number, one frame each.
    """
    rows = frames.select(key, at, F.col(vector).alias("__v"), F.floor(F.col(at) / BLOCK).alias("__block"))
    ends = rows.groupBy(key, "__block").agg(F.max(F.struct(at, "__v")).alias("__last"))
    before = ends.select(key, F.lead("__block").over(Window.partitionBy(key).orderBy("__block")).alias("__block"), "__last").filter("__block IS NOT NULL")
    halo = before.select(key, F.col(f"__last.{at}").alias(at), "__last.__v", "__block", F.lit(True).alias("__halo"))
    both = rows.withColumn("__halo", F.lit(False)).unionByName(halo)
    last = F.lag("__v").over(Window.partitionBy(key, "__block").orderBy(at))
    apart = F.aggregate(F.zip_with("__v", "__before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    found = both.withColumn("__before", last).filter("NOT __halo")
    return found.select(key, at, F.when(F.col("__before").isNotNull(), apart / F.size("__v")).alias("change"))


def cuts(changes: DataFrame, key: str, at: str, threshold: float, least: int) -> DataFrame:
    """(key, at) of cuts: changes of threshold or more, but none within `least` frames of the cut before it.

    A candidate that comes `least` or more after the candidate before it is a cut whatever came before, so only runs of
    closer candidates are gone through in order.
    """
    found = changes.filter(F.col("change") >= threshold).select(key, at)
    order = Window.partitionBy(key).orderBy(at)
    begins = F.coalesce(F.col(at) - F.lag(at).over(order) >= least, F.lit(True))
    runs = found.withColumn("__run", F.sum(begins.cast("int")).over(order)).groupBy(key, "__run").agg(F.array_sort(F.collect_list(at)).alias("__at"))
    none = F.slice("__at", 1, 0)
    taken = F.aggregate("__at", none, lambda done, x: F.when((F.size(done) == 0) | (x - F.try_element_at(done, F.lit(-1)) >= least), F.concat(done, F.array(x))).otherwise(done))
    return runs.select(key, F.explode(taken).alias(at))


def scenes(frames: DataFrame, key: str, at: str, vector: str, threshold: float = 30.0, least: int = 15) -> DataFrame:
    """(key, scene_index, start, end): stretches between cuts, from a cut's frame to the frame of the next cut; the last one ends with the key's last frame, and has to be longer than nothing."""
    changes = change(frames, key, at, vector)
    first = frames.groupBy(key).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    begins = cuts(changes, key, at, threshold, least).select(key, F.col(at).alias("start")).union(first.select(key, "__first")).distinct()
    order = Window.partitionBy(key).orderBy("start")
    rows = begins.withColumns({"scene_index": F.row_number().over(order) - 1, "end": F.lead("start").over(order)}).join(first, key)
    return rows.select(key, "scene_index", "start", F.coalesce("end", "__last").alias("end")).filter(F.col("end") > F.col("start"))
