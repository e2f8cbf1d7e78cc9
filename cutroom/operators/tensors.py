"""A clip's modalities on one time line, and stacks of them for training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import npy

# Steps of a clip, numbers of each modality's step, frames a second of what is not yet by word.
STEPS = 50
SIZES = {"text": 768, "audio": 74, "vision": 35}
FRAMES_A_SECOND = 100.0
#: Clips of a stack: about 90 MB of the sizes above.
STACK = 256
#: Clips of a batch that aligned() gives: about 6 MB of the sizes above.
CLIPS = 16


def by_word(frames: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean of the frames in each word (start, end in seconds); 0 for a word without frames."""
    n = len(frames)
    start = np.nan_to_num(words[:, 0], nan=0.0)
    end = np.where(np.isnan(words[:, 1]), start, words[:, 1])
    first, last = (np.minimum((x * FRAMES_A_SECOND).astype(np.int64), n) for x in (np.maximum(0.0, start), np.minimum(n / FRAMES_A_SECOND, end)))
    out = np.zeros((len(words), frames.shape[1]))
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if b > a:
            out[i] = frames[a:b].mean(axis=0)
    return out


def aligned(modalities: dict[str, DataFrame], words: DataFrame, sizes: dict[str, int] = SIZES, steps: int = STEPS, whole: tuple[str, ...] = ("text",)) -> DataFrame:
    """clip_id, n_words, and of each modality a matrix of steps x size, in one shuffle: all modalities and words meet by clip.

    modalities: name -> (clip_id, at, values); words: (clip_id, at, start, end). Frames in order of `at` are pooled by
    word if the clip has words and another number of frames; modalities in `whole` are by word already. Then they are
    cut or filled up with 0; nan and infinities become 0. A clip without a modality has zeros. A clip's frames are one
    task's: a clip is some seconds long.
    """
    parts = [d.select(F.col("clip_id"), F.lit(name).alias("kind"), F.col("at").cast("bigint").alias("at"), F.col("values").cast("array<double>").alias("values")) for name, d in modalities.items()]
    spoken = words.select("clip_id", F.lit("").alias("kind"), F.col("at").cast("bigint").alias("at"), F.array(F.col("start").cast("double"), F.col("end").cast("double")).alias("values"))
    rows = reduce(DataFrame.unionByName, parts, spoken)
    names, kind = list(modalities), rows.schema["clip_id"].dataType.simpleString()

    def one(clip: Iterator[tuple]) -> tuple[int, list[np.ndarray]]:
        held: dict[str, list] = {}
        for _, name, _, values in clip:
            held.setdefault(name, []).append(values)
        spans, made = npy.rectangle(held.get(""), 2), []
        for name in names:
            frames = npy.rectangle(held.get(name), sizes[name])
            if len(spans) and name not in whole and len(frames) != len(spans):
                frames = by_word(frames, spans[:steps])
            out = np.zeros((steps, sizes[name]))
            out[: min(steps, len(frames))] = frames[:steps]
            out[~np.isfinite(out)] = 0.0
            made.append(out)
        return len(spans), made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def given() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        clips = ((key, *one(rows)) for key, rows in groupby(given(), lambda row: row[0]))
        while done := list(islice(clips, CLIPS)):
            ids, n, made = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(n, pa.int32()), *(npy.nested([m[i] for m in made]) for i in range(len(names)))], names=["clip_id", "n_words", *names])

    matrices = ", ".join(f"{n} array<array<double>>" for n in names)
    met = rows.repartition("clip_id").sortWithinPartitions("clip_id", F.col("at").asc_nulls_last())
    return met.mapInArrow(run, f"clip_id {kind}, n_words int, {matrices}")


def write_stacks(clips: DataFrame, folder: str, split: str = "split", modalities: tuple[str, ...] = tuple(SIZES), most: int = STACK, sizes: DataFrame | None = None) -> DataFrame:
    """Writes clips' matrices as stacks (clips x steps x size), about `most` clips each, whatever the sizes of splits: split, part, modality, path, shape and total of each file.

    A split's clips are dealt to its parts by a hash of clip_id, and each part is one task's, in order of clip_id, whose
    stack beside the others (`clip_id`) names its rows. A repeated task writes the same files again. Nothing is written
    before the result is read. sizes: (split, count) of the clips, where that is known without making their matrices.
    """
    found = clips.groupBy(split).count() if sizes is None else sizes
    counts = sorted(((r[0], r[1]) for r in found.collect()), key=lambda r: str(r[0]))
    if not counts:
        return clips.sparkSession.createDataFrame([], "split string, part int, modality string, path string, shape array<int>, total double")
    parts = [(name, -(-n // most)) for name, n in counts]
    before = dict(zip((name for name, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    own = lambda values: reduce(lambda c, x: c.when(F.col(split).eqNullSafe(F.lit(x[0])), F.lit(x[1])), values, F.when(F.lit(False), F.lit(0)))
    part = F.pmod(F.xxhash64("clip_id"), own(parts)).cast("int")
    rows = clips.select(F.col(split).cast("string").alias("split"), part.alias("part"), own(list(before.items())).alias("before"), F.col("clip_id").cast("string").alias("clip_id"), *(F.col(m).cast("array<array<double>>").alias(m) for m in modalities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        name, at = table["split"][0].as_py(), table["part"][0].as_py()
        found = []
        for m in ("clip_id", *modalities):
            values = table[m].to_pylist()
            stack = np.array(values) if m == "clip_id" else np.stack([npy.rectangle(v) for v in values])
            path = f"{folder}/{name}/{m}-{at:05d}.npy"
            npy.written(path, stack)
            found.append((name, at, m, path, list(stack.shape), None if m == "clip_id" else float(stack.sum())))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["split", "part", "modality", "path", "shape", "total"])

    total = sum(n for _, n in parts)
    dealt = rows.repartitionById(total, F.col("before").cast("int") + F.col("part")).drop("before").sortWithinPartitions("clip_id")
    return dealt.mapInArrow(run, "split string, part int, modality string, path string, shape array<int>, total double")
