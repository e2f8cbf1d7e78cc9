"""From reviewed clips to a dataset: quality gate, splits without leaks, paths, records and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective_label, hash_rank, label_source, safe_name
from . import ranks
from .dashboard import APPROVED

DEFAULT_BYTES = 2 * 1024 * 1024


def quality_gate(records: DataFrame, order: list[str]) -> DataFrame:
    """records with rejection_reasons (empty: valid). Of rows with one clip_id, all but the first in order are duplicates.

    order may be any columns of records, so no place over all records is needed; each clip_id is a group of its own.
    """
    again = F.row_number().over(Window.partitionBy("clip_id").orderBy(*order)) > 1
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # Reason codes.
    reasons = F.array(
        F.when(blank("final_emotion"), "missing_label"), F.when(blank("clip_path"), "missing_file"),
        F.when(F.coalesce("duration", F.lit(0.0)) <= 0, "invalid_duration"), F.when(again, "duplicate_clip_id"),
    )
    return records.withColumn("rejection_reasons", F.array_compact(reasons))


def same_span(start_ms: str, end_ms: str) -> dict[str, Column]:
    """Start and end in whole tenths of a second, halves up: spans that agree in both count as one."""
    tenth = lambda ms: F.floor((F.col(ms) + 50) / 100).cast("bigint")
    return {"start_ds": tenth(start_ms), "end_ds": tenth(end_ms)}


def best_of_key(rows: DataFrame, keys: list[str], intensity: str, tie: str) -> DataFrame:
    """One row for each key: that of highest intensity, of those the one with the least tie (a number)."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(intensity), -F.col(tie))).alias("__best")
    return rows.groupBy(*keys).agg(best).select(*keys, "__best.*")


def _named(place: Column, n: Column, train: int, val: int, names: tuple[str, str, str], least: int = 0) -> Column:
    first = F.greatest(F.lit(least), F.floor(n * train / 100))
    return F.when(place <= first, names[0]).when(place <= first + F.floor(n * val / 100), names[1]).otherwise(names[2])


def stratified_split(records: DataFrame, label: str, key: str, train: int = 70, val: int = 15) -> DataFrame:
    """records with split: of each label, in hashed order, the first train % (one at least), then val %, the rest test."""
    rows = ranks.hashed(records, hash_rank(F.col(key)), key, label, "__place", "__n")
    return rows.withColumn("split", _named(F.col("__place"), F.col("__n"), train, val, ("train", "val", "test"), 1)).drop("__place", "__n")


def plain_split(records: DataFrame, key: str, train: int = 70, val: int = 15) -> DataFrame:
    """records with split over all of them, in hashed order; fewer than three are all in `all`."""
    n = records.count()
    if n < 3:
        return records.withColumn("split", F.lit("all"))
    rows = ranks.ranked(records, [hash_rank(F.col(key)), key], "__place")
    return rows.withColumn("split", _named(F.col("__place"), F.lit(n), train, val, ("train", "val", "test"), 1)).drop("__place")


def group_split(records: DataFrame, group: str, train: int = 80, val: int = 10) -> DataFrame:
    """records with split, the same for all rows of a group. Only the distinct groups are ranked."""
    groups = ranks.hashed(records.select(group).distinct(), hash_rank(F.col(group)), group, None, "__place", "__n")
    named = groups.withColumn("split", _named(F.col("__place"), F.col("__n"), train, val, ("train", "valid", "test"))).drop("__place", "__n")
    return records.join(named, group)


def records(clips: DataFrame) -> DataFrame:
    """Export records of clips: labels with their source, and what `per_model` (JSON text) says of segment, faces and audio."""
    said = lambda path, kind: F.get_json_object("per_model", f"$.{path}").try_cast(kind)
    empty = lambda c: F.coalesce(c, F.lit(""))
    final = effective_label(F.col("user_emotion"), F.col("emotion"), None)
    return clips.select(
        "clip_id", "video_id", "clip_index", empty(F.col("clip_path")).alias("clip_path"), empty(F.element_at(F.split("clip_path", "/"), -1)).alias("file_name"),
        (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), "duration", F.col("emotion").alias("ai_emotion"), F.col("confidence").alias("ai_confidence"), "user_emotion",
        final.alias("final_emotion"), final.alias("label"), label_source(F.col("status"), F.col("user_emotion"), F.col("emotion")).alias("label_source"), F.col("quality").alias("quality_score"),
        empty(F.col("transcript")).alias("transcript"), "status", F.coalesce("has_incongruity", F.lit(False)).alias("has_incongruity"), empty(F.col("notes")).alias("reviewer_notes"), F.coalesce("all_scores", F.lit("{}")).alias("all_scores"),
        F.coalesce("per_model", F.lit("{}")).alias("per_model_scores"), said("segment.face_coverage", "double").alias("face_coverage"), said("segment.speech_coverage", "double").alias("speech_coverage"),
        said("segment.num_faces_avg", "double").alias("num_faces_avg"), said("segment.source", "string").alias("segment_source"), said("segment.quality_hint", "string").alias("segment_quality_hint"), said("segment.cut_reason", "string").alias("cut_reason"),
        empty(said("face_extraction.detections_path", "string")).alias("face_detections_path"), F.coalesce(said("face_extraction.track_count", "int"), F.lit(0)).alias("track_count"), empty(said("face_extraction.detector", "string")).alias("face_detector"),
        empty(said("audio_features.audio_path", "string")).alias("audio_path"), said("audio_features.audio_clarity", "double").alias("audio_clarity"), said("audio_features.has_speech_energy", "boolean").alias("has_speech_energy"),
    )


# The columns of labels.csv, in order.
LABEL_COLUMNS = (
    "clip_id", "video_id", "clip_index", "split", "clip_path", "exported_clip_path", "audio_path", "exported_audio_path", "face_detections_path", "exported_face_detections_path",
    "start_time", "end_time", "duration", "ai_emotion", "ai_confidence", "user_emotion", "final_emotion", "label", "label_source", "quality_score", "face_coverage", "speech_coverage",
    "num_faces_avg", "track_count", "segment_source", "segment_quality_hint", "cut_reason", "transcript", "status", "has_incongruity", "reviewer_notes", "quality_flags", "rejection_reasons",
)


def labels(made: DataFrame) -> DataFrame:
    """Records as rows of labels.csv: its columns in order, empty where a record has none."""
    return made.select(*(F.col(c) if c in made.columns else F.lit(None).cast("string").alias(c) for c in LABEL_COLUMNS))


def strict(passed: DataFrame) -> DataFrame:
    """passed, if it has a row; else an error: nothing came through the filter."""
    if passed.isEmpty():
        raise ValueError("no segment passed the filter")
    return passed


def export_paths(records: DataFrame) -> DataFrame:
    """records (split, final_emotion, clip_id, clip_path) with exported_clip_path; with exported_audio_path and exported_face_detections_path where there is an audio_path or a face_detections_path, else null."""
    named = F.concat(F.col("split"), F.lit("/"), safe_name(F.col("final_emotion")), F.lit("/"), F.col("clip_id").cast("string"))
    ending = lambda c: F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))
    paths = {"exported_clip_path": F.concat(F.lit("clips/"), named, ending("clip_path"))}
    if "audio_path" in records.columns:
        paths["exported_audio_path"] = F.when(F.col("audio_path") != "", F.concat(F.lit("audio/"), named, ending("audio_path")))
    if "face_detections_path" in records.columns:
        paths["exported_face_detections_path"] = F.when(F.col("face_detections_path") != "", F.concat(F.lit("annotations/face_detections/"), F.col("clip_id").cast("string"), F.lit(".json")))
    return records.withColumns(paths)


def quality_flags(label_source: Column, face: Column, tracks: Column, speech: Column, transcript: Column, incongruity: Column, hint: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(label_source, F.lit("")).startswith("human"), "human_verified"),
            F.when((zero(face) >= 0.5) | (zero(tracks) > 0), "has_face"),
            F.when((zero(speech) >= 0.2) | (F.coalesce(transcript, F.lit("")) != ""), "has_dialogue"),
            F.when(F.coalesce(incongruity, F.lit(False)), "incongruity"),
            F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("segment_"), hint)),
        )
    )


def export_reasons(clips: DataFrame, approved_only: bool = True) -> DataFrame:
    """clips with reasons why each can't be exported (empty: it can), label, and bytes (2 MiB where unknown)."""
    label = effective_label(F.col("user_emotion"), F.col("emotion"), None)
    # Reason codes.
    reasons = F.array(
        F.when(~F.coalesce(F.col("status"), F.lit("")).isin(*APPROVED) & F.lit(approved_only), "not_approved"), F.when(label.isNull(), "missing_label"),
        F.when(F.coalesce("clip_path", F.lit("")) == "", "missing_file"), F.when(F.coalesce("duration", F.lit(0.0)) <= 0, "invalid_duration"),
    )
    return clips.withColumns({"label": label, "reasons": F.array_compact(reasons), "bytes": F.coalesce("bytes", F.lit(DEFAULT_BYTES)) if "bytes" in clips.columns else F.lit(DEFAULT_BYTES)})


def reason_histogram(checked: DataFrame) -> DataFrame:
    """reason, n: a clip counts under each of its reasons, and under `exportable` without any."""
    found = F.when(F.size("reasons") == 0, F.array(F.lit("exportable"))).otherwise(F.col("reasons"))
    return checked.select(F.explode(found).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
