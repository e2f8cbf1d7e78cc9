"""Counts and progress for dashboards: one pass over the clips, instead of one query for each number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, QUOTA
from ..functions.scoring import rounded
from ..functions.text import effective_label
from .selection import percentiles

APPROVED = ("approved", "auto_approved")
PENDING = ("pending", "needs_review")


def status_counts(clips: DataFrame, approved: tuple[str, ...] = APPROVED, pending: tuple[str, ...] = PENDING) -> DataFrame:
    """One row: total, approved, pending, rejected, videos, approval_rate in percent (0 when empty)."""
    s = F.col("status")
    n = clips.agg(
        F.count("*").alias("total"), F.count_if(s.isin(*approved)).alias("approved"), F.count_if(s.isin(*pending)).alias("pending"),
        F.count_if(s == "rejected").alias("rejected"), F.count_distinct("video_id").alias("videos"),
    )
    return n.withColumn("approval_rate", F.when(F.col("total") > 0, rounded(F.col("approved") * 100 / F.col("total"), 1)).otherwise(0.0))


def decision_counts(clips: DataFrame) -> DataFrame:
    return clips.agg(F.count_if(F.col("decision_by") == "auto").alias("auto"), F.count_if(F.col("decision_by") == "human").alias("human"))


def emotion_counts(clips: DataFrame, label: Column | None = None) -> DataFrame:
    """emotion, n over approved clips that have a label."""
    label = label if label is not None else F.col("emotion")
    return clips.filter(F.col("status").isin(*APPROVED)).select(label.alias("emotion")).filter("emotion IS NOT NULL AND emotion <> ''").groupBy("emotion").agg(F.count("*").alias("n"))


def quota_progress(clips: DataFrame, quota: dict[str, int] = QUOTA) -> DataFrame:
    """All emotions of the quota with count, remaining and percentage, zero-filled."""
    wanted = clips.sparkSession.createDataFrame(sorted(quota.items()), "emotion string, target int")
    n = F.coalesce("n", F.lit(0))
    rows = F.broadcast(wanted).join(emotion_counts(clips), "emotion", "left")
    return rows.select("emotion", "target", n.alias("n"), F.greatest(F.lit(0), F.col("target") - n).alias("remaining"), rounded(n * 100 / F.col("target"), 2).alias("percentage"))


def emotion_distribution(clips: DataFrame) -> DataFrame:
    """Effective labels of clips that are not rejected, with their share of the total in percent."""
    n = clips.filter("status <> 'rejected'").groupBy(effective_label(F.col("user_emotion"), F.col("emotion")).alias("label")).agg(F.count("*").alias("n"))
    return n.select("label", "n", rounded(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2).alias("percentage"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def video_rollup(videos: DataFrame, clips: DataFrame) -> DataFrame:
    """Every video with its clips counted by status; remaining is never negative."""
    s = F.col("status")
    n = clips.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(s.isin(*APPROVED)).alias("approved"), F.count_if(s.isin(*PENDING)).alias("pending"), F.count_if(s == "rejected").alias("rejected"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = videos.join(n, "video_id", "left").select(*videos.columns, *(zero(c) for c in ("total", "approved", "pending", "rejected")))
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("approved")))


def verify_summary(clips: DataFrame) -> DataFrame:
    """One row: total, passed, rejected, errors and one count for each verdict."""
    v = F.col("verify_verdict")
    return clips.agg(
        F.count("*").alias("total"), F.count_if(F.col("verify_status") == "passed").alias("passed"), F.count_if(F.col("verify_status") == "rejected").alias("rejected"),
        F.count_if(v.isNull()).alias("errors"), *(F.count_if(v == x).alias(f"n_{x}") for x in ("confirmed", "wrong_emotion", "unstable", "low_quality", "stats_mismatch")),
    )


def bucket_summary(routed: DataFrame) -> DataFrame:
    """One row: how many clips each bucket has, and their ratios (0 when empty)."""
    names = {"approve": "auto_approve_candidates", "reject": "auto_reject_candidates", "review": "needs_human_review"}
    n = routed.agg(F.count("*").alias("total"), *(F.count_if(F.col("bucket") == b).alias(f"n_{k}") for k, b in names.items()))
    return n.select("*", *(F.when(F.col("total") > 0, rounded(F.col(f"n_{k}") / F.col("total"), 4)).otherwise(0.0).alias(f"{k}_ratio") for k in names))


def approval_progress(clips: DataFrame, goal: int = 3000) -> DataFrame:
    """One row: approved clips and their percentage of the goal."""
    n = clips.agg(F.count_if(F.col("status") == "approved").alias("approved"))
    return n.withColumn("approval_progress", rounded(F.col("approved") * 100 / goal, 2))


def has_idle_worker(workers: DataFrame) -> DataFrame:
    """One row: how many workers there are, and whether any has no video in hand (false without workers)."""
    return workers.agg(F.count("*").alias("worker_count"), F.coalesce(F.bool_or(F.col("processing_video_id").isNull()), F.lit(False)).alias("has_idle_worker"))


def verdict_map(clips: DataFrame) -> DataFrame:
    """One row: total, passed, rejected, and by_verdict, a map from each verdict that occurs to its count."""
    n = clips.groupBy("verify_verdict").agg(F.count("*").alias("n"), F.count_if(F.col("verify_status") == "passed").alias("p"), F.count_if(F.col("verify_status") == "rejected").alias("r"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found = F.array_sort(F.collect_list(F.when(F.col("verify_verdict").isNotNull(), F.struct("verify_verdict", "n"))))
    return n.agg(zero("n").alias("total"), zero("p").alias("passed"), zero("r").alias("rejected"), F.map_from_entries(found).alias("by_verdict"))


def batch_totals(items: DataFrame, batch: Column, usd: Column, failed: Column) -> DataFrame:
    """batch, segments, usd and errors of each batch; dollars are added as decimals."""
    return items.groupBy(batch.alias("batch")).agg(F.count("*").alias("segments"), F.sum(usd.cast("decimal(18,6)")).cast("double").alias("usd"), F.count_if(failed).alias("errors"))


def drift(clips: DataFrame, day: Column) -> DataFrame:
    """day, decided and overridden (a human chose another label than the model), and their share: the log that shows a model drifting."""
    human = F.coalesce("user_emotion", F.lit("")) != ""
    n = clips.groupBy(day.alias("day")).agg(F.count_if(human).alias("decided"), F.count_if(human & (F.col("user_emotion") != F.col("emotion"))).alias("overridden"))
    return n.withColumn("share", F.when(F.col("decided") > 0, rounded(F.col("overridden") / F.col("decided"), 4)).otherwise(0.0))


def monitor_metrics(clips: DataFrame, usd: Column) -> DataFrame:
    """One row: share of second looks that confirm, share of labels that a human changed, the exact median of face_coverage, and dollars for each approved clip (null without one)."""
    human = F.coalesce("user_emotion", F.lit("")) != ""
    share = lambda a, b, digits=4: rounded(F.try_divide(a, b), digits)
    counted = clips.agg(
        share(F.count_if(F.col("verify_verdict") == "confirmed"), F.count("verify_verdict")).alias("verify_agreement"),
        share(F.count_if(human & (F.col("user_emotion") != F.col("emotion"))), F.count("*")).alias("override_rate"),
        share(F.sum(usd.cast("decimal(18,6)")).cast("double"), F.count_if(F.col("status") == "approved"), 6).alias("cost_per_approved"),
    )
    middle = percentiles(clips, "face_coverage", {"median_face": 0.5})
    return counted.join(F.broadcast(middle.select(rounded(F.col("median_face"), 4).alias("median_face"))), F.lit(True), "left")


def searched_clips(clips: DataFrame, words: str = "", status: str | None = None, label: str | None = None) -> DataFrame:
    """Clips of a status and an effective label, if asked for, whose path, transcript, notes, label or status holds the words."""
    shown = effective_label(F.col("user_emotion"), F.col("emotion"), "unlabeled")
    rows = clips if status is None else clips.filter(F.col("status") == status)
    rows = rows if label is None else rows.filter(shown == label)
    text = words.strip().lower()
    return rows.filter(F.contains(_haystack(clips, ("clip_path", "transcript", "notes"), shown, F.col("status")), F.lit(text))) if text else rows


def video_tree(videos: DataFrame, clips: DataFrame, words: str = "", status: str | None = None, clip_status: str | None = None, label: str | None = None, empty: bool = False) -> DataFrame:
    """videos with visible_clips, the number of their clips that searched_clips() gives: those of a status, with a visible clip (or `empty`), whose title, movie, address, path or status, or a visible clip, holds the words."""
    visible = searched_clips(clips, words, clip_status, label).groupBy("video_id").agg(F.count("*").alias("visible_clips"))
    rows = videos.join(visible, "video_id", "left").withColumn("visible_clips", F.coalesce("visible_clips", F.lit(0).cast("bigint")))
    rows = rows if status is None else rows.filter(F.col("status") == status)
    some, text = F.col("visible_clips") > 0, words.strip().lower()
    rows = rows if empty else rows.filter(some)
    own = F.contains(_haystack(videos, ("title", "movie_name", "source_url", "file_path"), F.col("status")), F.lit(text))
    return rows.filter(own | some) if text else rows


def _haystack(df: DataFrame, names: tuple[str, ...], *more: Column) -> Column:
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.lower(F.concat_ws(" ", *parts, *(F.coalesce(m, F.lit("")) for m in more)))


# Shares of clips that automatic decisions aim at.
TARGETS = {"target_approve_ratio": DEFAULT.approve_target, "target_reject_ratio": DEFAULT.reject_target}


def bucket_targets(routed: DataFrame) -> DataFrame:
    """bucket_summary with the shares aimed at, and how far the clips are from them."""
    rows = bucket_summary(routed).withColumns({name: F.lit(share) for name, share in TARGETS.items()})
    off = {f"{k}_off": rounded(F.col(f"{k}_ratio") - F.col(f"target_{k}_ratio"), 4) for k in ("approve", "reject")}
    return rows.withColumns(off)


def counted(records: DataFrame, **columns: str) -> DataFrame:
    """kind, value, n: how often each value of each column occurs, in one pass over the records; null is a value."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in columns.items()))
    return records.select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def cache_usage(entries: DataFrame, payload: str, at: str, ttl_s: int = DEFAULT.cache_ttl_s) -> DataFrame:
    """One row: entries, their bytes as UTF-8, when the oldest was kept, and how long entries are good for."""
    size = F.coalesce(F.sum(F.octet_length(F.coalesce(F.col(payload).cast("string"), F.lit("")))), F.lit(0))
    return entries.agg(F.count("*").alias("entries"), size.alias("total_bytes"), F.min(at).alias("oldest_cached_at"), F.lit(ttl_s).alias("ttl_seconds"))


def model_status(loads: DataFrame, key: str, at: str, error: str) -> DataFrame:
    """One row for each model of a log of loads: loaded (a load had no error: it is not loaded again), else the error of the last one."""
    ever = F.bool_or(F.col(error).isNull())
    return loads.groupBy(key).agg(ever.alias("loaded"), F.when(~ever, F.max_by(error, at)).alias("error"))


def model_health(statuses: DataFrame) -> DataFrame:
    """One row: status (`degraded` if a model has an error), how many models there are, are loaded and have failed."""
    failed = F.count_if(F.col("error").isNotNull())
    return statuses.agg(F.when(failed > 0, "degraded").otherwise("healthy").alias("status"), F.count("*").alias("total_count"), F.count_if("loaded").alias("loaded_count"), failed.alias("failed_count"))
