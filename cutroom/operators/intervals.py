"""Interval algebra. Times are whole milliseconds; key columns name the video (or scene) an interval is in.

Joins between intervals go by key and time bucket, so a long video is spread over many tasks and no pair
is made outside a shared bucket. Gaps and islands are windows over the key. Folds that depend on the order
of a video's intervals gather one run of overlapping intervals (face tracks: one clip's few dozen frames).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, CurationConf
from ..functions.numbers import fixed
from ..session import cut
from .ranks import ranked_within

BUCKET_MS = 60_000


def _bucketed(df: DataFrame, start: str, end: str, name: str, bucket_ms: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.greatest(F.col(start), F.col(end)) / bucket_ms))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, how: str = "left", bucket_ms: int = BUCKET_MS, touching: bool = False) -> DataFrame:
    """a (a_start, a_end) with every b (b_start, b_end) of its key that it overlaps; touching: also where they only meet.

    A pair that shares several buckets is made in the first of them only. With how="left", a without any
    b comes once, b's columns null; a needs a unique column a_id.
    """
    left, right = _bucketed(a, "a_start", "a_end", "__bucket", bucket_ms), _bucketed(b, "b_start", "b_end", "__bucket", bucket_ms)
    meet = (F.col("b_start") <= F.col("a_end")) & (F.col("b_end") >= F.col("a_start")) if touching else (F.col("b_start") < F.col("a_end")) & (F.col("b_end") > F.col("a_start"))
    pairs = left.join(right, [key, "__bucket"]).filter(meet & (F.col("__bucket") == F.floor(F.greatest("a_start", "b_start") / bucket_ms)))
    if how == "inner":
        return pairs.drop("__bucket")
    own = [c for c in b.columns if c != key]
    return a.join(pairs.select("a_id", *own), "a_id", "left")


def contained_best(clips: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """a_id, best (largest intensity of the segments that contain the clip, 0 if none) and found."""
    pairs = overlap_join(clips, segments, key, touching=True)
    inside = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end"))
    return pairs.groupBy("a_id").agg(F.coalesce(F.max(F.when(inside, F.col("intensity"))), F.lit(0.0)).alias("best"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("found"))


def coverage(segments: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """a_id and the share of each segment that speech covers, 0 to 1 (overlapping speech counts twice, up to 1)."""
    met = F.when(F.col("b_start").isNotNull(), F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start")))
    sums = overlap_join(segments, speech, key).groupBy("a_id", "a_start", "a_end").agg(F.coalesce(F.sum(met), F.lit(0)).alias("met"))
    length = (F.col("a_end") - F.col("a_start")).cast("double")
    return sums.select("a_id", F.when(length > 0, F.least(F.lit(1.0), F.col("met") / length)).otherwise(0.0).alias("coverage"))


def intersections(segments: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """a_id and the pieces (start, end) that segments share with others."""
    return overlap_join(segments, others, key, "inner").select("a_id", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


def sample_coverage(segments: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """a_id, share of samples (ts, n_faces) inside, ends included, that have a face, and their mean number of faces."""
    points = samples.select(key, F.col("ts").alias("b_start"), F.col("ts").alias("b_end"), "n_faces")
    pairs = overlap_join(segments, points, key, touching=True)
    share = F.sum(F.when(F.col("n_faces") > 0, 1).otherwise(0)) / F.nullif(F.count("n_faces"), F.lit(0))
    return pairs.groupBy("a_id").agg(F.coalesce(share, F.lit(0.0)).alias("coverage"), F.coalesce(F.sum("n_faces") / F.nullif(F.count("n_faces"), F.lit(0)), F.lit(0.0)).alias("avg_faces"))


def _islands(df: DataFrame, key: str, gap_ms: int = 0) -> DataFrame:
    """df with __island: intervals of a key are in one where the next begins at most gap_ms after all before have ended."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") - reach > gap_ms), 1).otherwise(0)
    island = F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__fresh", fresh).withColumn("__island", island).drop("__fresh")


def merged(df: DataFrame, key: str, gap_ms: int = DEFAULT.merge_gap_ms, min_ms: int = 0) -> DataFrame:
    """(key, start, end): intervals joined where the next begins at most gap_ms after all before have ended; shorter than min_ms go."""
    rows = _islands(df.select(key, "start", "end"), key, gap_ms)
    return rows.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("end") - F.col("start") >= min_ms).drop("__island")


def complement(silences: DataFrame, lengths: DataFrame, key: str, min_ms: int = DEFAULT.merge_min_ms) -> DataFrame:
    """(key, start, end): what silences leave of 0 to length_ms, min_ms or longer. A video without silences is one piece."""
    ends = lengths.select(key, F.col("length_ms").alias("start"), F.col("length_ms").alias("end"))
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = silences.select(key, "start", "end").unionByName(ends).withColumn("from", F.coalesce(F.max("end").over(order), F.lit(0)))
    return rows.filter(F.col("start") - F.col("from") >= min_ms).select(key, F.col("from").alias("start"), F.col("start").alias("end"))


def voiced_intervals(frames: DataFrame, key: str, step_ms: int) -> DataFrame:
    """(key, start, end) of runs of voiced frames (ts, voiced); a run ends at the next unvoiced frame, the last one a step after its last frame."""
    order = Window.partitionBy(key).orderBy("ts")
    changed = F.when(F.coalesce(F.lag("voiced").over(order), F.lit(False)) != F.col("voiced"), 1).otherwise(0)
    rows = frames.withColumn("__next", F.lead("ts").over(order)).withColumn("__new", changed)
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.max_by(F.coalesce(F.col("__next"), F.col("ts") + step_ms), "ts")
    return rows.filter("voiced").groupBy(key, "__run").agg(F.min("ts").alias("start"), last.alias("end")).drop("__run")


def face_runs(samples: DataFrame, key: str, conf: CurationConf = DEFAULT) -> DataFrame:
    """(key, start, end, n_samples, n_faces, faces_seen): runs of samples (ts, n_faces, scene_end) with a face.

    A run closes at the first faceless sample more than gap_ms after the last face; it ends frame_ms after
    that face, within the scene. Samples since the last close, the closing one included, are its
    denominator. Runs under 0.6 * clip_min_ms go.
    """
    order = Window.partitionBy(key).orderBy("ts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    face = F.col("n_faces") > 0
    rows = samples.withColumn("__last", F.last(F.when(face, F.col("ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    late = ~face & (F.col("ts") - F.col("__last") > conf.gap_ms)
    # of the late samples after one face, the first closes the run
    rows = rows.withColumn("__late", F.coalesce(late, F.lit(False)))
    rows = rows.withColumn("__closes", F.col("__late") & (F.coalesce(F.lag("__late").over(order), F.lit(False)) == F.lit(False)))
    rows = rows.withColumn("__run", F.coalesce(F.sum(F.col("__closes").cast("int")).over(before), F.lit(0)))
    runs = rows.groupBy(key, "__run").agg(
        F.min(F.when(face, F.col("ts"))).alias("start"),
        F.least(F.max("scene_end"), F.max(F.when(face, F.col("ts"))) + conf.frame_ms).alias("end"),
        F.count("*").alias("n_samples"),
        F.count_if(face).alias("n_faces"),
        F.sum("n_faces").alias("faces_seen"),
    )
    return runs.filter(F.col("start").isNotNull() & ((F.col("end") - F.col("start")) * 10 >= conf.clip_min_ms * 6)).drop("__run")


def gathered(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """One row a key: its rows as structs, in order of the first columns."""
    items = F.array_sort(F.collect_list(F.struct(*columns)))
    return df.groupBy(key).agg(items.alias("items"))


def gathered_islands(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """One row for each run of intervals (start, end) of a key that overlap or meet. Intervals of different runs have nothing to do with each other, so a fold over a run is as long as the run, not as the video."""
    items = F.array_sort(F.collect_list(F.struct(*columns)))
    return _islands(df, key).groupBy(key, "__island").agg(items.alias("items")).drop("__island")


def overlap_nms(df: DataFrame, key: str, conf: CurationConf = DEFAULT) -> DataFrame:
    """(key, id, start, end, intensity) kept when the most intense go first and later ones overlap none kept by more than conf.overlap of the shorter."""
    kind = "array<struct<neg:double,start:bigint,end:bigint,id:bigint>>"
    rows = gathered_islands(df, key, (-F.col("intensity")).alias("neg"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("id").cast("bigint").alias("id"))

    def clash(k: Column, x: Column) -> Column:
        shared = F.least(k["end"], x["end"]) - F.greatest(k["start"], x["start"])
        return (shared > 0) & (shared.cast("double") / F.greatest(F.lit(0.001), F.least(k["end"] - k["start"], x["end"] - x["start"]).cast("double")) > conf.overlap)

    kept = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(key, F.explode(kept).alias("__k")).select(key, "__k.id", "__k.start", "__k.end", (-F.col("__k.neg")).alias("intensity"))


def adjacent_dedup(df: DataFrame, key: str, slack_ms: int = 250) -> DataFrame:
    """(key, id, start, end, rank): in order of start, one that begins before the last kept ends (less slack) replaces it if it ranks higher, else goes."""
    kind = "array<struct<start:bigint,end:bigint,id:bigint,rank:double>>"
    rows = gathered_islands(df, key, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("id").cast("bigint").alias("id"), F.col("rank").cast("double").alias("rank"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        replaced = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        hits = (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"] - slack_ms)
        return F.when(hits, F.when(x["rank"] > last["rank"], replaced).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))

    return rows.select(key, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("__k")).select(key, "__k.id", "__k.start", "__k.end", "__k.rank")


def rank(face: Column, speech: Column, length_ms: Column, conf: CurationConf = DEFAULT) -> Column:
    return face * 0.6 + speech * 0.3 + F.least(F.lit(1.0), length_ms.cast("double") / conf.clip_target_ms) * 0.1


def dialogue_refined(segments: DataFrame, speech: DataFrame, key: str, conf: CurationConf = DEFAULT) -> DataFrame:
    """a_id, start, end: each end moved out to that of the last speech interval around it, if that is at most dialogue_ms away."""
    pairs = overlap_join(segments, speech, key, touching=True)

    def moved(edge: str, other: str, far: Column) -> Column:
        fits = (F.col("b_start") <= F.col(edge)) & (F.col(edge) <= F.col("b_end")) & (far <= conf.dialogue_ms)
        return F.coalesce(F.max_by(F.when(fits, F.col(other)), F.when(fits, F.struct("b_start", "b_end"))), F.first(edge))

    return pairs.groupBy("a_id").agg(moved("a_start", "b_start", F.col("a_start") - F.col("b_start")).alias("start"), moved("a_end", "b_end", F.col("b_end") - F.col("a_end")).alias("end"))


def _chunks(start: Column, end: Column, size: int, least: int) -> Column:
    """Pieces of `size` from start; a tail shorter than `least` is left out."""
    n = F.floor((end - start) / size).cast("int")
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((start + i * size).cast("bigint").alias("start"), F.least(end, start + (i + 1) * size).cast("bigint").alias("end")))
    return F.filter(whole, lambda p: p["end"] - p["start"] >= least)


def enforced(df: DataFrame, conf: CurationConf = DEFAULT) -> DataFrame:
    """Rows (start, end, speech: sorted array of (start, end)) as pieces of at most clip_max_ms.

    A longer one is cut at edges of speech inside it where that gives a piece of allowed length, and what
    is still too long into pieces of clip_target_ms, without a tail under clip_min_ms.
    """
    low, high = conf.clip_min_ms, conf.clip_max_ms
    piece = "struct<start:bigint,end:bigint>"
    state = f"struct<cursor:bigint,pieces:array<{piece}>>"
    inside = F.filter(
        F.transform("speech", lambda s: F.struct(F.greatest(s["start"], F.col("start")).cast("bigint").alias("start"), F.least(s["end"], F.col("end")).cast("bigint").alias("end"))), lambda s: s["end"] > s["start"]
    )
    edges = F.flatten(F.transform(inside, lambda s: F.array(s["start"], s["end"])))

    def step(acc: Column, edge: Column) -> Column:
        cut = F.struct(edge.alias("cursor"), F.concat(acc["pieces"], F.array(F.struct(acc["cursor"].alias("start"), edge.alias("end")))).alias("pieces"))
        return F.when((edge - acc["cursor"] >= low) & (edge - acc["cursor"] <= high), cut).otherwise(acc)

    begin = F.struct(F.col("start").cast("bigint").alias("cursor"), F.array().cast(f"array<{piece}>").alias("pieces")).cast(state)
    done = F.aggregate(edges, begin, step)
    whole = F.array(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))
    rest = F.when(F.col("end") - F.col("__done.cursor") >= low, F.concat(F.col("__done.pieces"), F.array(F.struct(F.col("__done.cursor").alias("start"), F.col("end").cast("bigint").alias("end"))))).otherwise(F.col("__done.pieces"))
    rows = df.withColumn("__done", done)
    cut = F.when((F.size(inside) == 0) | (F.size(rest) == 0), whole).otherwise(rest)
    final = F.flatten(F.transform(cut, lambda p: F.when(p["end"] - p["start"] <= high, F.array(p)).otherwise(_chunks(p["start"], p["end"], conf.clip_target_ms, low))))
    pieces = F.when(F.col("end") - F.col("start") <= high, whole).otherwise(final)
    return rows.withColumn("__piece", F.explode(pieces)).drop("start", "end", "speech", "__done").select("*", F.col("__piece.start").alias("start"), F.col("__piece.end").alias("end")).drop("__piece")


def normalized_scenes(df: DataFrame, key: str, low: int = 3000, high: int = 15000) -> DataFrame:
    """Scenes (start, end) of low to high ms; a shorter one goes unless its video has no other, a longer one is cut by high, a short tail left out. parent_start and parent_end are those of a cut scene."""
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    length = F.col("end") - F.col("start")
    rows = df.withColumn("__alone", alone).filter((length > 0) & ((length >= low) | F.col("__alone")))
    whole = F.array(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))
    rows = rows.withColumn("__piece", F.explode(F.when(length <= high, whole).otherwise(_chunks(F.col("start"), F.col("end"), high, low))))
    cut = length > high
    return rows.withColumns({"parent_start": F.when(cut, F.col("start")), "parent_end": F.when(cut, F.col("end"))}).withColumns({"start": F.col("__piece.start"), "end": F.col("__piece.end")}).drop("__piece", "__alone")


def smart_segments(samples: DataFrame, speech: DataFrame, scene: str, conf: CurationConf = DEFAULT) -> DataFrame:
    """Segments of each scene from its face samples (ts, n_faces, scene_start, scene_end) and speech (start, end).

    Face runs (a scene of clip_min_ms or more without any, but with speech, is one run), moved out to dialogue, held to
    the scene and to allowed lengths, with coverage by face and speech, a hint (good, review, weak), without those that
    have little of both, and near duplicates gone.
    """
    bounds = samples.groupBy(scene).agg(F.min("scene_start").alias("scene_start"), F.max("scene_end").alias("scene_end"))
    talk = speech.select(scene, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    runs = face_runs(samples, scene, conf).select(scene, "start", "end")
    silent = bounds.filter(F.col("scene_end") - F.col("scene_start") >= conf.clip_min_ms).join(runs.select(scene).distinct(), scene, "left_anti")
    heard = silent.join(talk, scene).filter((F.col("b_end") > F.col("scene_start")) & (F.col("b_start") < F.col("scene_end")) & (F.col("b_end") > F.col("b_start")))
    runs = runs.union(heard.select(scene, F.col("scene_start"), F.col("scene_end")).distinct())
    # what several later joins read is written once
    runs = cut(runs.select(scene, F.concat_ws(":", scene, "start").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end")))
    moved = dialogue_refined(runs, talk, scene, conf).join(runs.select("a_id", scene), "a_id").join(bounds, scene)
    moved = moved.withColumns({"start": F.greatest("start", "scene_start"), "end": F.least("end", "scene_end")}).filter("end > start")
    said = speech.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("speech"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    parts = enforced(moved.join(said, scene, "left").withColumn("speech", F.coalesce("speech", none)).select(scene, "start", "end", "speech"), conf)
    parts = parts.filter(F.col("end") - F.col("start") >= conf.clip_min_ms)
    pieces = cut(parts.select(scene, F.concat_ws(":", scene, "start", "end").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).distinct())
    faces = sample_coverage(pieces, samples.select(scene, "ts", "n_faces"), scene).withColumnRenamed("coverage", "face")
    rows = pieces.join(faces, "a_id").join(coverage(pieces, talk, scene).withColumnRenamed("coverage", "speech"), "a_id")
    length = F.col("a_end") - F.col("a_start")
    rows = rows.filter(~((F.col("face") < 0.70) & (F.col("speech") < 0.6))).withColumn("quality_hint", quality_hint(F.col("face"), F.col("speech"), length, conf))
    rows = rows.withColumns({c: fixed(F.col(c), 3).cast("double") for c in ("face", "speech")}).withColumn("rank", rank(F.col("face"), F.col("speech"), length, conf))
    rows = cut(rows)
    kept = adjacent_dedup(rows.select(scene, F.xxhash64("a_id").alias("id"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), "rank"), scene)
    return kept.join(rows.select(F.xxhash64("a_id").alias("id"), "face", "speech", "quality_hint"), "id").select(scene, "start", "end", "face", "speech", "rank", "quality_hint")


def quality_hint(face: Column, speech: Column, length_ms: Column, conf: CurationConf = DEFAULT) -> Column:
    short = length_ms <= conf.clip_max_ms
    return F.when((face >= 0.7) & (length_ms >= 2000) & short & (speech >= 0.2), "good").when((face >= 0.4) & short, "review").otherwise("weak")


def split_at(df: DataFrame, at: Column, guard_ms: int = 500) -> DataFrame:
    """Rows (start, end) cut in two where `at` is more than guard_ms inside them."""
    inside = (at - F.col("start") > guard_ms) & (F.col("end") - at > guard_ms)
    part = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    pieces = F.when(F.coalesce(inside, F.lit(False)), F.array(part(F.col("start"), at), part(at, F.col("end")))).otherwise(F.array(part(F.col("start"), F.col("end"))))
    return df.withColumn("__p", F.explode(pieces)).withColumns({"start": F.col("__p.start"), "end": F.col("__p.end")}).drop("__p")


def track_faces(frames: DataFrame, key: str, least: float = 0.25, oldest: int = 2) -> DataFrame:
    """(key, frame, face, track_id): faces (frame, face, box array<double>) joined to the free track of the best IoU, in order of frame and face.

    A track is lost after more than `oldest` frames without a face. Frames follow each other by one; a
    clip has a few dozen, which are gathered in one row.
    """
    box = "array<double>"
    rows = gathered(frames, key, F.col("frame").cast("bigint").alias("frame"), F.col("face").cast("bigint").alias("face"), F.col("box").cast(box).alias("box"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(1)
            sizes, flat = items.value_lengths().fill_null(0).to_numpy(), items.flatten()
            places = zip(flat.field("frame").to_pylist(), flat.field("box").to_pylist(), strict=True)
            tracks = [track for n in sizes.tolist() for track in _tracks(islice(places, n), least, oldest)]
            made = [batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), flat.field("frame"), flat.field("face"), pa.array(tracks, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["key", "frame", "face", "track_id"])

    kind = frames.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, frame bigint, face bigint, track_id int").withColumnRenamed("key", key)


def _tracks(faces: Iterable[tuple[int | None, list | None]], least: float, oldest: int) -> Iterator[int]:
    """The track of each face (frame, box) of a clip, in order."""
    tracks: list[tuple[int, list | None, int]] = []  # id, box and frame of the last face
    following = 0
    for frame, box in faces:
        tracks = [t for t in tracks if frame is not None and t[2] is not None and frame - t[2] - 1 <= oldest]
        scored = [(x, -t[0]) for t in tracks if t[2] < frame and (x := _iou(box, t[1])) >= least]
        if scored:
            mine = -max(scored)[1]
            tracks = [t for t in tracks if t[0] != mine]
        else:
            mine, following = following, following + 1
        tracks.append((mine, box, frame))
        yield mine


def _iou(a: list | None, b: list | None) -> float:
    """vectors.iou() of two boxes: 0 unless both have four numbers."""
    if a is None or b is None or len(a) != 4 or len(b) != 4 or None in a or None in b:
        return 0.0
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda v: max(0.0, v[2] - v[0]) * max(0.0, v[3] - v[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def padded_and_capped(df: DataFrame, key: str, tie: str, length: Column, conf: CurationConf = DEFAULT) -> DataFrame:
    """Segments (start, end) moved out by pad_ms on both sides, within 0 and the video's length; of each video the first max_segments."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("start", tie))
    out = {"start": F.greatest(F.lit(0), F.col("start") - conf.pad_ms), "end": F.least(length, F.col("end") + conf.pad_ms), "__place": place}
    return df.withColumns(out).filter(F.col("__place") <= conf.max_segments).drop("__place")


def voice_threshold(energy: DataFrame, key: str, value: str) -> DataFrame:
    """key and the energy from which its frames count as voiced: from the 35th and the 70th percentile, 0.008 at least."""
    at = lambda p: F.percentile(value, F.lit(p))
    return energy.groupBy(key).agg(F.greatest(F.lit(0.008), at(0.35) * 2.3, at(0.70) * 0.45).alias("threshold"))


def manually_ordered(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Segments that end after they begin, with their place in their video from 1."""
    return df.filter("end > start").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", tie)))


def edited(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """segments (id, video_id, start, end, status) after edits (id, action, other): `delete` takes one out, `reject` marks it, `merge` gives it the reach of both and takes the other (of the same video) out. An edit without its segment changes nothing."""
    made = edits.select("id", "action", F.col("other").alias("__other"))
    rows = segments.join(made, "id", "left")
    reach = segments.select(F.col("id").alias("__other"), F.col("video_id").alias("__video"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    rows = rows.join(reach, "__other", "left")
    merges = (F.col("action") == "merge") & (F.col("__video") == F.col("video_id"))
    out = rows.withColumns({"start": F.when(merges, F.least("start", "__start")).otherwise(F.col("start")), "end": F.when(merges, F.greatest("end", "__end")).otherwise(F.col("end")), "status": F.when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))})
    gone = rows.filter(F.col("action") == "delete").select("id").union(rows.filter(merges).select(F.col("__other").alias("id")))
    return out.select(*segments.columns).join(gone, "id", "left_anti")


def pooled_by_word(frames: DataFrame, words: DataFrame, key: str, fps: int = 100) -> DataFrame:
    """key, word and the mean of the frames (place, x) in it; words have word, start and end in seconds. A word without frames has 0.

    Frames are dealt to words by an equi-join on each word's frame places, so a long clip is spread over tasks.
    """
    n = frames.groupBy(key).agg((F.max("place") + 1).alias("__n"))
    at = lambda t: F.least("__n", F.floor(F.greatest(F.lit(0.0), t) * fps))
    reach = words.join(n, key).withColumns({"__a": at(F.coalesce("start", F.lit(0.0))), "__b": at(F.coalesce("end", "start", F.lit(0.0)))})
    inside = reach.filter("__b > __a").select(key, "word", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)).alias("place"))
    means = inside.join(frames, [key, "place"]).groupBy(key, "word").agg(F.avg("x").alias("mean"))
    return words.select(key, "word").join(means, [key, "word"], "left").select(key, "word", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def reindexed(df: DataFrame, key: str, order: list, valid: Column | None = None, index: str = "clip_index") -> DataFrame:
    """Valid rows with their place in their key, from 0 without gaps. The places of a key with very many rows are counted over many tasks (ranks.ranked_within)."""
    rows = df if valid is None else df.filter(valid)
    return ranked_within(rows, key, order, "__place", "__size").withColumn(index, F.col("__place") - 1).drop("__place", "__size")


def frame_batches(frames: DataFrame, key: str, at: str, size: int = 24) -> DataFrame:
    """frames (numbered from 0 by at, one a second) with batch and offset, the first frame of their batch: what is said of a batch is moved by it."""
    batch = F.floor(F.col(at) / size)
    return frames.withColumns({"batch": batch, "offset": batch * size})


def batched_segments(segments: DataFrame, offset: str = "offset", failed: Column | None = None) -> DataFrame:
    """Segments (start_time, end_time in seconds of their batch) in seconds of the video; those of failed batches are left out."""
    rows = segments if failed is None else segments.filter(~F.coalesce(failed, F.lit(False)))
    moved = {c: F.coalesce(F.col(c), F.lit(0.0)) + F.col(offset) for c in ("start_time", "end_time")}
    return rows.withColumns(moved)
