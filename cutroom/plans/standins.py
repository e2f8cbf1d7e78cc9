"""Stand-ins for videos, clips, queue and model responses over the driver's tables, in Spark SQL and DuckDB SQL.

Where one text serves both dialects it is given once. Times are whole milliseconds, so both engines agree.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: name -> expression over events, or (Spark's, DuckDB's).
CLIP = {
    "clip_id": "event_id",
    "video_id": "user_id",
    "clip_index": "cast(event_id % 100 as int)",
    "start_ms": ("(unix_micros(cast(ts as timestamp)) div 1000) % 600000", "(epoch_us(ts) // 1000) % 600000"),
    "duration_ms": "2000 + (event_id % 11) * 1000",
    "emotion": "case event_type when 'click' then 'happy' when 'view' then 'neutral' when 'purchase' then 'surprise' when 'error' then 'angry' else 'sad' end",
    "user_emotion": "case event_id % 5 when 0 then '' when 1 then 'fear' when 2 then 'happy' else null end",
    "confidence": ("cast(get_json_object(props, '$.k') as double) / 99", "cast(json_extract_string(props, '$.k') as double) / 99"),
    "quality": "least(cast(1 as double), value / 150)",
    "face_coverage": "cast((event_id * 37) % 101 as double) / 100",
    "frontal_ratio": "case when event_id % 9 = 0 then null else cast((event_id * 53) % 101 as double) / 100 end",
    "people_count": "case when event_id % 10 = 0 then null else cast(event_id % 3 as int) end",
    "speech_quality": "case event_id % 4 when 0 then 'none' when 1 then 'good' when 2 then 'poor' else null end",
    "n_words": "cast(event_id % 6 as int)",
    "transcript": ("array_join(slice(split('xin chao ban vui qua', ' '), 1, cast(event_id % 6 as int)), ' ')", "array_to_string(list_slice(string_split('xin chao ban vui qua', ' '), 1, event_id % 6), ' ')"),
    "status": "case event_id % 5 when 0 then 'pending' when 1 then 'needs_review' when 2 then 'approved' when 3 then 'rejected' else 'auto_approved' end",
    "decision_by": "case event_id % 3 when 0 then 'auto' when 1 then 'human' else null end",
    "has_incongruity": "event_id % 7 = 0",
    "verify_verdict": "case event_id % 6 when 0 then 'confirmed' when 1 then 'wrong_emotion' when 2 then 'unstable' when 3 then 'low_quality' when 4 then 'stats_mismatch' else null end",
    "verify_status": "case when event_id % 6 in (2, 3) then 'rejected' when event_id % 6 = 5 then 'not_run' else 'passed' end",
    "verify_emotion": "case event_id % 4 when 0 then 'sad' when 1 then '' else 'happy' end",
    "verify_intensity": "cast((event_id * 29) % 101 as double) / 100",
    "rejected_by_verify": "event_id % 13 = 0",
    "agreement": "case event_id % 8 when 0 then '3/3' when 1 then '2/3' when 2 then '3/4' when 3 then '1/3' when 4 then 'x/3' when 5 then '1/0' when 6 then '' else null end",
    "num_frames": "cast(event_id % 25 as int)",
    "num_faces": "cast(event_id % 21 as int)",
    "clarity": "cast(event_id % 97 as double) / 300",
    "snr": "case when event_id % 4 = 0 then null else cast(event_id % 40 as double) end",
    "face_quality": "case when event_id % 5 = 0 then null else cast((event_id * 17) % 101 as double) / 100 end",
    "clip_path": "case when event_id % 17 = 0 then null else concat('/media/', user_id, '/', event_id, case when event_id % 2 = 0 then '.MP4' else '.mkv' end) end",
    "created_us": ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
}
#: Further columns over those.
CLIP_MORE = {"end_ms": "start_ms + duration_ms", "duration": "cast(duration_ms as double) / 1000"}

VIDEO = {
    "video_id": "c_custkey", "title": "case when c_custkey % 4 = 0 then '' when c_custkey % 7 = 0 then null else c_name end", "movie_name": "case when c_custkey % 28 = 0 then null else c_mktsegment end",
    "balance": "c_acctbal", "status": "case c_custkey % 5 when 0 then 'error' when 1 then 'processing' else 'completed' end",
}

QUEUE = {
    "id": "o_orderkey", "video_id": "o_custkey", "priority": "cast(substr(o_orderpriority, 1, 1) as int)", "status": "case o_orderstatus when 'P' then 'queued' when 'O' then 'running' else 'done' end",
    "created_us": ("unix_micros(cast(o_orderdate as timestamp))", "epoch_us(o_orderdate)"),
}

_SEGMENT = """'{"start_time": ', event_id % 50, '.25, "end_time": ', event_id % 50 + event_id % 23, '.5, "emotion": "', case event_id % 9 when 0 then ' Happy ' when 1 then 'bored' when 2 then 'SAD' else 'angry' end, '", "intensity": ', '0.', 50 + event_id % 50, ', "face_coverage": 0.', 10 + event_id % 90, ', "has_transcript": ', case when event_id % 2 = 0 then 'true' else 'false' end, '}'"""
#: Responses of a model: fenced lists, objects with a list, single segments, and broken text.
RESPONSE = {
    "clip_id": "event_id",
    "text": f"""case when event_id % 13 = 0 then 'not json at all' when event_id % 13 = 1 then '' else concat(case event_id % 4 when 0 then '```json\n[' when 1 then '[' when 2 then '{{"segments": [' else '' end, {_SEGMENT}, case event_id % 4 when 0 then ', {{"emotion": "fear", "intensity": 0.9, "start_time": 1, "end_time": 8}}]\n```' when 1 then ']' when 2 then ']}}' else '' end) end""".replace("{{", "{").replace("}}", "}"),
}


def select(columns: dict, dialect: int) -> list[str]:
    return [f"{e if isinstance(e, str) else e[dialect]} AS {n}" for n, e in columns.items()]


def _with(name: str, columns: dict, table: str, more: dict | None = None) -> str:
    inner = f"SELECT {', '.join(select(columns, 1))} FROM {table}"
    return f"{name} AS (SELECT *, {', '.join(select(more, 1))} FROM ({inner}))" if more else f"{name} AS ({inner})"


DUCK = {"clips": _with("clips", CLIP, "events", CLIP_MORE), "videos": _with("videos", VIDEO, "customer"), "queue": _with("queue", QUEUE, "orders"), "responses": _with("responses", RESPONSE, "events")}


class Tables:
    """The driver's tables and the stand-ins, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clips(self) -> DataFrame:
        return self("events").selectExpr(*select(CLIP, 0)).selectExpr("*", *select(CLIP_MORE, 0))

    @cached_property
    def videos(self) -> DataFrame:
        return self("customer").selectExpr(*select(VIDEO, 0))

    @cached_property
    def queue(self) -> DataFrame:
        return self("orders").selectExpr(*select(QUEUE, 0))

    @cached_property
    def responses(self) -> DataFrame:
        return self("events").selectExpr(*select(RESPONSE, 0))
