"""Queries: what comes in, what is shown, and what it costs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import dashboard, intervals
from ..session import shared_folder
from ..sources import sinks, tables
from .catalog import query
from .rules import _ROUTE, _USD, _dec, _routed

c = F.col

_URL = "case page_id % 7 when 0 then concat('  ', url, ' ') when 1 then '   ' when 2 then null when 3 then 'https://www.tiktok.com/@a/video/1' when 4 then 'https://youtu.be/abcdefghijk' else url end"


@query("url_list", f"SELECT page_id, trim({_URL}) AS source_url, trim({_URL}) AS title, case page_id % 7 when 3 then 'tiktok' when 4 then 'youtube' else 'url' end AS source_type, 'queued' AS status, 'fear' AS target_emotion FROM pages WHERE trim({_URL}) <> ''")
def _(t):
    return tables.url_list(t("pages").select("page_id", F.expr(_URL).alias("u")), "u", "fear")


_NAME = "case page_id % 5 when 0 then concat('clip.', page_id, '.MP4') when 1 then concat('a/b/', page_id, '.mkv') when 2 then 'notes.txt' when 3 then '' else concat('raw', page_id) end"


@query("uploads", f"""WITH n AS (SELECT page_id, {_NAME} AS name FROM pages) SELECT page_id, case page_id % 5 when 0 then concat('clip.', page_id) when 1 then cast(page_id as varchar) when 3 then 'video' end AS title, case when page_id % 5 in (0, 1, 3) then 'upload' end AS source_type,
case page_id % 5 when 0 then concat('videos/upload_20240131_120000_', name) when 1 then concat('videos/upload_20240131_120000_', page_id, '.mkv') when 3 then 'videos/upload_20240131_120000_video.mp4' end AS file_path, case page_id % 5 when 2 then 'unsupported: .txt' when 4 then 'unsupported: ' end AS error FROM n""")
def _(t):
    rows = tables.uploads(t("pages").select("page_id", F.expr(_NAME).alias("name")), "name", F.lit(1706702400000000))
    return rows.select("page_id", "title", "source_type", "file_path", "error")


@query("file_sync", "SELECT clip_id, clip_path FROM clips WHERE clip_path LIKE '%.MP4' AND clip_path NOT IN (SELECT clip_path FROM clips WHERE clip_id % 3 = 0 AND clip_path IS NOT NULL)")
def _(t):
    rows = t.clips.select("clip_id", "clip_path")
    return tables.to_copy(rows, rows.filter("clip_id % 3 = 0"), "clip_path", ("mp4",)).select("clip_id", "clip_path")


_SHOWN = "coalesce(nullif(user_emotion, ''), nullif(emotion, ''), 'unlabeled')"


@query("video_tree", f"""WITH h AS (SELECT video_id, count(*) AS n FROM clips WHERE status <> 'x' AND {_SHOWN} = 'fear' AND contains(lower(concat_ws(' ', coalesce(clip_path, ''), transcript, {_SHOWN}, status)), 'ban vui') GROUP BY 1)
SELECT videos.video_id, coalesce(n, 0) AS visible_clips FROM videos LEFT JOIN h USING (video_id) WHERE status = 'completed' AND (n > 0 OR contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(movie_name, ''), status)), 'ban vui'))""")
def _(t):
    return dashboard.video_tree(t.videos, t.clips, " Ban vui ", status="completed", label="fear", empty=True).select("video_id", "visible_clips")


@query("clip_search", f"SELECT clip_id FROM clips WHERE status = 'rejected' AND contains(lower(concat_ws(' ', coalesce(clip_path, ''), transcript, {_SHOWN}, status)), 'happy')")
def _(t):
    return dashboard.searched_clips(t.clips, "HAPPY", status="rejected").select("clip_id")


@query("bucket_targets", f"""WITH {_ROUTE}, z AS (SELECT count(*) AS total, {_dec("count(*) filter (bucket like 'auto_app%')::double / count(*)", 4)} AS approve_ratio, {_dec("count(*) filter (bucket like 'auto_rej%')::double / count(*)", 4)} AS reject_ratio FROM b)
SELECT total, approve_ratio, reject_ratio, 0.3::double AS target_approve_ratio, 0.2::double AS target_reject_ratio, {_dec("approve_ratio - 0.3::double", 4)} AS approve_off, {_dec("reject_ratio - 0.2::double", 4)} AS reject_off FROM z""")
def _(t):
    return dashboard.bucket_targets(_routed(t)).select("total", "approve_ratio", "reject_ratio", "target_approve_ratio", "target_reject_ratio", "approve_off", "reject_off")


@query("cache_usage", "SELECT count(*) AS entries, sum(octet_length(encode(text)))::bigint AS total_bytes, min(length(text) * 1000 + event_id) AS oldest_cached_at, 604800 AS ttl_seconds FROM (SELECT clip_id AS event_id, text FROM responses)")
def _(t):
    return dashboard.cache_usage(t.responses.withColumn("at", F.char_length("text") * 1000 + c("clip_id")), "text", "at")


_LOADS = "l AS (SELECT concat('m', user_id % 40) AS model, event_id AS pos, case when event_id % 40 in (0, 1) then null else concat('error ', event_id) end AS error FROM events)"


@query("model_status", f"WITH {_LOADS} SELECT model, bool_or(error IS NULL) AS loaded, case when bool_or(error IS NULL) then null else arg_max(error, pos) end AS error FROM l GROUP BY 1")
def _(t):
    return dashboard.model_status(_loads(t), "model", "pos", "error")


def _loads(t):
    return t("events").select(F.concat(F.lit("m"), c("user_id") % 40).alias("model"), c("event_id").alias("pos"), F.expr("case when event_id % 40 in (0, 1) then null else concat('error ', event_id) end").alias("error"))


@query("model_summary", f"WITH {_LOADS}, s AS (SELECT model, bool_or(error IS NULL) AS loaded FROM l GROUP BY 1) SELECT case when count(*) FILTER (NOT loaded) > 0 then 'degraded' else 'healthy' end AS status, count(*) AS total_count, count(*) FILTER (loaded) AS loaded_count, count(*) FILTER (NOT loaded) AS failed_count FROM s")
def _(t):
    return dashboard.model_health(dashboard.model_status(_loads(t), "model", "pos", "error"))


_SAID = {"ratio": "case when clip_id % 3 = 0 then face_coverage end", "track": "case when clip_id % 7 = 0 then null else num_faces end", "head": "case when clip_id % 2 = 0 then verify_intensity end"}


@query("face_proxies", f"""SELECT clip_id, coalesce({_SAID['ratio']}, coalesce({_SAID['track']}, 0)::double / greatest(coalesce(num_frames, 1), 1)) AS face_ratio, coalesce(frontal_ratio, {_SAID['head']}, 1.0::double) AS frontal, coalesce(face_quality, quality, 0.0::double) AS quality,
coalesce(snr, least(30.0::double, greatest(0.0::double, clarity * 30.0::double))) AS snr FROM clips""")
def _(t):
    return t.clips.select(
        "clip_id", scoring.face_ratio(F.expr(_SAID["ratio"]), F.expr(_SAID["track"]), c("num_frames")).alias("face_ratio"), scoring.frontal_ratio(c("frontal_ratio"), F.expr(_SAID["head"])).alias("frontal"),
        scoring.face_quality(c("face_quality"), c("quality")).alias("quality"), scoring.snr_proxy(c("snr"), c("clarity")).alias("snr"),
    )


_SCAN, _VERIFY = _USD("secs * 7000", "1024"), _USD("7 * 7000 + 500", "256")


@query("cost_estimate", f"""WITH v AS (SELECT video_id, count(*) n, sum(duration_ms) // 1000 AS secs FROM clips GROUP BY 1), u AS (SELECT video_id, cast({_SCAN} as decimal(18,6)) AS s, cast({_VERIFY} as decimal(18,6)) * n AS w FROM v)
SELECT video_id, s::double AS scan_usd, w::double AS verify_usd, (s + w)::double AS total_usd, floor(1000 / (s + w)::double)::bigint AS videos_covered FROM u""")
def _(t):
    n = t.clips.groupBy("video_id").agg(F.count("*").alias("n"), F.floor(F.sum("duration_ms") / 1000).alias("secs"))
    return n.select("video_id", *(v.alias(k) for k, v in scoring.estimated_cost(c("secs"), c("n"), F.lit(7.9)).items()))


@query("clip_places", "SELECT clip_id, video_id, row_number() over (partition by video_id order by start_ms, clip_id) - 1 AS clip_index FROM clips WHERE duration_ms >= 4000")
def _(t):
    rows = t.clips.select("clip_id", "video_id", "start_ms", "duration_ms")
    return intervals.reindexed(rows, "video_id", ["start_ms", "clip_id"], c("duration_ms") >= 4000).select("clip_id", "video_id", "clip_index")


@query("batched_segments", "SELECT clip_id, clip_id // 24 * 24 + coalesce(cast(event_k as double) / 10, 0) AS start_time, clip_id // 24 * 24 + 5.5::double AS end_time FROM (SELECT clip_id, num_frames AS event_k FROM clips) WHERE clip_id // 24 % 5 <> 0")
def _(t):
    frames = intervals.frame_batches(t.clips.select("clip_id", "video_id", (c("num_frames") / 10).alias("start_time"), F.lit(5.5).alias("end_time")), "video_id", "clip_id")
    return intervals.batched_segments(frames, failed=c("batch") % 5 == 0).select("clip_id", "start_time", "end_time")


_MICROS = "created_us + case when clip_id % 3 = 0 then 0 else clip_id % 1000000 end"


@query("iso_times", f"SELECT clip_id, concat(strftime(make_timestamp({_MICROS}), '%Y-%m-%dT%H:%M:%S'), case when ({_MICROS}) % 1000000 = 0 then '' else concat('.', lpad(cast(({_MICROS}) % 1000000 as varchar), 6, '0')) end) AS iso, strftime(make_timestamp({_MICROS}), '%Y%m%d_%H%M%S') AS folder FROM clips")
def _(t):
    rows = t.clips.withColumn("at", F.expr(_MICROS))
    return rows.select("clip_id", text.iso_time(c("at")).alias("iso"), text.stamp(c("at")).alias("folder"))


@query("batch_results", "SELECT case when clip_id % 2 = 0 then concat('/v/', clip_id) else concat('gs://b/', clip_id) end AS video_path, case when clip_id % 13 = 1 then '[]' else text end AS segments, case when clip_id % 13 = 0 then 'bad' end AS error FROM responses")
def _(t):
    results = t.responses.selectExpr("case when clip_id % 2 = 0 then concat('/v/', clip_id) when clip_id % 4 = 1 then '' end AS video_path", "concat('gs://b/', clip_id) AS gcs_uri", "case when clip_id % 13 = 1 then null else text end AS segments", "case when clip_id % 13 = 0 then 'bad' end AS error")
    return sinks.write_batch_results(results, f"{shared_folder(t.spark)}/{uuid.uuid4()}")
