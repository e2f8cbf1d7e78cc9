"""Tables that change: updates, upserts, syncs, queues. DataFrames in, the new state as a DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], added: tuple[str, ...] = ()) -> DataFrame:
    """target with `columns` of matching source rows, and source rows without a match, with `columns` and `added`; change: kept, updated or added."""
    new = source.select(*keys, *(F.col(c).alias(f"__{c}") for c in (*columns, *added)), F.lit(True).alias("__in"))
    rows = target.withColumn("__had", F.lit(True)).join(new, keys, "full_outer")
    changed = {c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    changed |= {c: F.when(F.col("__had").isNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in added}
    change = F.when(F.col("__had").isNull(), "added").when(F.col("__in"), "updated").otherwise("kept")
    return rows.withColumn("change", change).withColumns(changed).select(*target.columns, "change")


def last_writer_wins(target: DataFrame, source: DataFrame, key: str, stamp: str, always: tuple[str, ...] = ()) -> DataFrame:
    """target after a sync from source: absent rows come in; a row changes only if both stamps are there and source's is later; nulls of source never overwrite. Columns in `always` take what source has, whatever the stamps. change: kept, updated or inserted."""
    others = [c for c in target.columns if c != key]
    new = source.select(key, *(F.col(c).alias(f"__{c}") for c in others), F.lit(True).alias("__in"))
    rows = target.withColumn("__had", F.lit(True)).join(new, key, "full_outer")
    later = F.coalesce(F.col("__had") & F.col("__in") & (F.col(f"__{stamp}") > F.col(stamp)), F.lit(False))
    fresh = F.col("__had").isNull()
    both = F.coalesce(F.col("__had") & F.col("__in"), F.lit(False))
    values = {c: F.when(fresh, F.col(f"__{c}")).when(both if c in always else later, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in others}
    change = F.when(fresh, "inserted").when(later, "updated").otherwise("kept")
    return rows.withColumn("change", change).withColumns(values).select(*target.columns, "change")


def apply_reviews(clips: DataFrame, reviews: DataFrame) -> DataFrame:
    """clips after reviews (clip_id, status, user_emotion, notes, reviewed_at): a review overwrites, and decides as human."""
    rows = clips.join(reviews.select("clip_id", *(F.col(c).alias(f"__{c}") for c in ("status", "user_emotion"))), "clip_id", "left")
    seen = F.col("__status").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(seen, F.col("__status")).otherwise(F.col("status")),
            "user_emotion": F.when(seen, F.col("__user_emotion")).otherwise(F.col("user_emotion")),
            "decision_by": F.when(seen, "human").otherwise(F.col("decision_by")),
        }
    ).select(*clips.columns)


def reviewed(clips: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """clips after reviews (clip_id, status, user_emotion, sentiment, notes, reject_reason): all of these are taken over, nulls too; a human decided, now."""
    taken = ["status", "user_emotion", "sentiment", "notes", "reject_reason"]
    rows = clips.join(reviews.select("clip_id", *(F.col(c).alias(f"__{c}") for c in taken), F.lit(True).alias("__seen")), "clip_id", "left")
    seen = F.coalesce("__seen", F.lit(False))
    values = {c: F.when(seen, F.col(f"__{c}")).otherwise(F.col(c)) for c in taken}
    values |= {"decision_by": F.when(seen, "human").otherwise(F.col("decision_by")), **{c: F.when(seen, now).otherwise(F.col(c)) for c in ("reviewed_at", "updated_at")}}
    return rows.withColumns(values).select(*clips.columns)


def recounted(videos: DataFrame, clips: DataFrame) -> DataFrame:
    """videos with total_clips and approved_clips counted anew; those without clips have 0."""
    n = clips.groupBy("video_id").agg(F.count("*").alias("total_clips"), F.count_if(F.col("status") == "approved").alias("approved_clips"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    own = [c for c in videos.columns if c not in ("total_clips", "approved_clips")]
    return videos.select(*own).join(n, "video_id", "left").select(*own, zero("total_clips"), zero("approved_clips"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(video_id, old_status, new_status, had, has) of clips (clip_id, video_id, status) as they were and as they are: rows that came (had is false), went (has is false) or changed. Give it the changed rows only."""
    one = lambda df, name, there: df.select("clip_id", "video_id", F.col("status").alias(name), F.lit(True).alias(there))
    both = one(before, "old_status", "had").join(one(after, "new_status", "has"), ["clip_id", "video_id"], "full_outer")
    return both.select("video_id", "old_status", "new_status", F.coalesce("had", F.lit(False)).alias("had"), F.coalesce("has", F.lit(False)).alias("has"))


def adjusted(videos: DataFrame, changed: DataFrame) -> DataFrame:
    """videos with total_clips and approved_clips moved by what changes() gives: only changed rows and videos are read, whatever the number of clips. The same as recounted() if the counts were right before."""
    counts = lambda there: F.col(there).cast("int")
    approved = lambda there, status: (F.col(there) & F.coalesce(F.col(status) == "approved", F.lit(False))).cast("int")
    total = F.sum(counts("has") - counts("had")).alias("__total")
    by = changed.groupBy("video_id").agg(total, F.sum(approved("has", "new_status") - approved("had", "old_status")).alias("__approved"))
    moved_by = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    rows = videos.join(by, "video_id", "left")
    return rows.withColumns({"total_clips": moved_by("total_clips", "__total"), "approved_clips": moved_by("approved_clips", "__approved")}).select(*videos.columns)


def deleted(clips: DataFrame, gone: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clips without those in gone (clip_id), and videos counted anew."""
    left = clips.join(gone, "clip_id", "left_anti")
    return left, recounted(videos, left)


# What a clip that automatic cutting finds has at first, and how much of its notes is kept.
FOUND = {"is_manual_segment": False, "status": "needs_review", "decision_by": "gemini_autocut", "pipeline_stage": "ai_autocut_done"}
NOTES, NOTES_BEGIN = 1000, "[Gemini AutoCut] subject="
_FOUND = ("emotion", "confidence", "face_ratio", "verify_verdict", "verify_status", "verify_reasoning", "rejected_by_verify")


def persisted(clips: DataFrame, segments: DataFrame, now: Column) -> DataFrame:
    """clips after automatic cutting found segments (clip_id, video_id, clip_index, start_time, end_time, clip_path, emotion, intensity, face_coverage, has_transcript, subject, reasoning, and of the second look verify_verdict, verify_status, verify_reasoning, rejected_by_verify, reject_reason).

    A clip that is there gets emotion, confidence, face_ratio and what the second look says, a reject_reason only if there
    is one, and updated_at; its review stays. Others come in with all of a segment's values. change: kept, updated or
    inserted. Columns that clips lacks are left out.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    made = {
        "video_id": F.col("video_id"), "clip_index": F.col("clip_index"), "start_time": F.col("start_time"), "end_time": F.col("end_time"), "duration": F.col("end_time") - F.col("start_time"),
        "clip_path": F.col("clip_path"), "emotion": F.col("emotion"), "confidence": F.col("intensity"), "face_ratio": F.col("face_coverage"), "has_speech": F.col("has_transcript"),
        "verify_verdict": blank("verify_verdict"), "verify_status": F.coalesce(blank("verify_status"), F.lit("not_run")), "verify_reasoning": blank("verify_reasoning"),
        "rejected_by_verify": F.col("rejected_by_verify"), "reject_reason": blank("reject_reason"), "all_scores": F.create_map("emotion", "intensity"),
        "reviewer_notes": F.substring(F.concat(F.lit(NOTES_BEGIN), F.coalesce("subject", F.lit("")), F.lit(" | "), F.coalesce("reasoning", F.lit(""))), 1, NOTES),
        **{c: F.lit(v) for c, v in FOUND.items()},
    }
    own = [c for c in clips.columns if c in made]
    new = segments.select("clip_id", *(made[c].alias(f"__{c}") for c in own), F.lit(True).alias("__in"))
    rows = clips.withColumn("__had", F.lit(True)).join(new, "clip_id", "full_outer")
    seen, fresh = F.coalesce("__in", F.lit(False)), F.col("__had").isNull()
    values = {c: F.when(seen if c in _FOUND else fresh, F.col(f"__{c}")).otherwise(F.col(c)) for c in own}
    if "reject_reason" in own:
        values["reject_reason"] = F.when(seen, F.coalesce("__reject_reason", "reject_reason")).otherwise(F.col("reject_reason"))
    if "updated_at" in clips.columns:
        values["updated_at"] = F.when(seen & ~fresh, now).otherwise(F.col("updated_at"))
    change = F.when(fresh, "inserted").when(seen, "updated").otherwise("kept")
    return rows.withColumn("change", change).withColumns(values).select(*clips.columns, "change")


# Fields that a patch may set.
PATCHABLE = ("status", "user_emotion", "user_sentiment", "review_type", "review_notes")


def patched(clips: DataFrame, patches: DataFrame, now: Column, allowed: tuple[str, ...] = PATCHABLE) -> DataFrame:
    """clips after patches (clip_id, data: map of field to text): allowed fields that a patch names are set, to null too; others are ignored. updated_at is set for every clip with a patch."""
    rows = clips.join(patches.select("clip_id", F.col("data").alias("__data")), "clip_id", "left")
    named = lambda c: F.coalesce(F.map_contains_key("__data", F.lit(c)), F.lit(False))
    kinds = dict(clips.dtypes)
    values = {c: F.when(named(c), F.try_element_at("__data", F.lit(c)).try_cast(kinds[c])).otherwise(F.col(c)) for c in allowed if c in kinds}
    return rows.withColumns({**values, "updated_at": F.when(F.col("__data").isNotNull(), now).otherwise(F.col("updated_at"))}).select(*clips.columns)


def moved(queue: DataFrame, event: Column, now: Column) -> DataFrame:
    """queue after events: status by TRANSITIONS; started_at is now where a run starts, null where one is skipped or comes back to the queue."""
    new = transition(F.col("status"), event)
    begins, ends = (new == "running") & (F.col("status") != "running"), (new == "queued") & (F.col("status") != "queued")
    return queue.withColumns({"started_at": F.when(begins, now).when(~ends | ends.isNull(), F.col("started_at")), "status": new})


def claim_next(queue: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """The queued row that is next (of each group)."""
    queued = queue.filter("status = 'queued'")
    if group is None:
        return queued.orderBy(*order).limit(1)
    return queued.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__n = 1").drop("__n")


# What an event makes of a status; other pairs change nothing.
TRANSITIONS = {
    ("queued", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "error", ("running", "skip"): "queued",
    ("queued", "pause"): "paused", ("paused", "resume"): "queued", ("error", "retry"): "queued",
}


def transition(status: Column, event: Column) -> Column:
    steps = [F.when((status == a) & (event == e), b) for (a, e), b in TRANSITIONS.items()]
    return F.coalesce(*steps, status)


def enqueue_if_absent(queue: DataFrame, wanted: DataFrame, key: str, active: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Rows of wanted that are not active in the queue."""
    return wanted.join(queue.filter(F.col("status").isin(*active)), key, "left_anti")


def cascade_delete(gone: DataFrame, parents: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """parents without the keys in gone (its one column), then each child (table, its parent's key) without what lost its parent."""
    (key,) = gone.columns
    left = [parents.join(gone, key, "left_anti")]
    lost = gone
    for child, own in children:
        dropped = child.join(lost, key, "left_semi")
        left.append(child.join(lost, key, "left_anti"))
        lost, key = dropped.select(own).distinct(), own
    return left


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with every column of the schema that it lacks, as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last row of each key."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("__l")).select(key, "__l.*")


def stale(beats: DataFrame, key: str, at: str, now: Column, idle_s: int) -> DataFrame:
    """key, last_seen and is_stale: its last beat is more than idle_s before now."""
    last = beats.groupBy(key).agg(F.max(at).alias("last_seen"))
    return last.withColumn("is_stale", F.col("last_seen") < now - idle_s)


def contains_all(haystack: list[Column], words: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", *haystack))
    return reduce(Column.__and__, (F.contains(text, F.lit(w.lower())) for w in words))
