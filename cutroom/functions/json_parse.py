"""Model responses (JSON in text, perhaps fenced) as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, EMOTIONS, VERDICTS, CurationConf
from .scoring import rounded
from .text import strip_fence

SEGMENT = "struct<start_time:double,end_time:double,emotion:string,intensity:double,face_coverage:double,frontal_ratio:double,people_count:int,speech_quality:string,has_transcript:boolean>"
KEYS = ("segments", "results", "clips", "highlights")


def parsed_segments(df: DataFrame, text: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df, one row for each segment of its response, as columns of SEGMENT.

    A response is a list, an object with a list at one of the keys (the first that has one), or one
    segment. What is no JSON gives no rows.
    """
    fields = SEGMENT[len("struct<") : -1]
    either = f"struct<__list:array<{SEGMENT}>,{','.join(f'{k}:array<{SEGMENT}>' for k in keys)},{fields}>"
    body = strip_fence(F.coalesce(F.col(text), F.lit("")))
    listed = body.startswith("[")
    whole = F.when(listed, F.concat(F.lit('{"__list": '), body, F.lit("}"))).when(body.startswith("{") & F.json_object_keys(body).isNotNull(), body)
    one = F.struct(*(F.col(f"__got.{f.split(':')[0]}") for f in fields.split(",")))
    rows = df.withColumn("__got", F.from_json(whole, either))  # a column of its own, so that it is parsed once
    found = F.when(F.col("__got").isNotNull(), F.when(listed, F.col("__got.__list")).otherwise(F.coalesce(*(F.col(f"__got.{k}") for k in keys), F.array(one))))
    return rows.withColumn("__s", F.explode(found)).filter("__s IS NOT NULL").select(*df.columns, "__s.*")


def valid_segments(df: DataFrame, length: Column, conf: CurationConf = DEFAULT) -> DataFrame:
    """Segments with sound times, a known emotion, enough intensity and length, cut to scan_max and the video's length (seconds)."""
    start, end = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("start_time", "end_time"))
    emotion, intensity = F.lower(F.trim(F.coalesce("emotion", F.lit("")))), F.coalesce(F.col("intensity"), F.lit(0.0))
    low, high = conf.scan_min_ms / 1000, conf.scan_max_ms / 1000
    ok = (start >= 0) & (end > start) & emotion.isin(*EMOTIONS) & (intensity >= conf.scan_intensity) & (end - start >= low)
    cut = F.least(length, F.when(end - start > high, start + high).otherwise(end))
    return df.filter(ok & (cut - start >= low)).withColumns({"start_time": rounded(start, 2), "end_time": rounded(cut, 2), "emotion": emotion, "intensity": rounded(F.least(F.lit(1.0), intensity), 3), "face_coverage": rounded(F.coalesce("face_coverage", F.lit(0.0)), 3)})


def valid_labels(df: DataFrame, least: float = 0.6, low: float = 3.0, high: float = 30.0) -> DataFrame:
    """The labeller's rules: low to high seconds, known emotion, intensity; speaker_visible from face coverage."""
    start, end = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("start_time", "end_time"))
    emotion, intensity, face = F.lower(F.trim(F.coalesce("emotion", F.lit("")))), F.coalesce(F.col("intensity"), F.lit(0.0)), F.coalesce(F.col("face_coverage"), F.lit(0.0))
    ok = (end - start).between(low, high) & (start >= 0) & emotion.isin(*EMOTIONS) & (intensity >= least)
    return df.filter(ok).withColumns({"start_time": rounded(start, 2), "end_time": rounded(end, 2), "emotion": emotion, "intensity": rounded(F.least(F.lit(1.0), intensity), 3), "face_coverage": rounded(face, 3), "speaker_visible": face >= 0.3})


# Fixed value: "12.5 - 28.3: angry (0.87)" in running text.
LINE = r"(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)\s*[:\-\|]\s*(\w+)\s*\(?(\d+\.?\d*)\)?"


def segments_in_text(df: DataFrame, text: str, least: float = 0.6) -> DataFrame:
    """df, one row for each "start - end: emotion (intensity)" of its text that names a known emotion."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(LINE), F.lit(i)) for i in (1, 2, 3, 4)]
    rows = df.withColumn("__m", F.explode(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups)))))
    field = lambda i: F.col(f"__m.g{i}")
    out = rows.select(*df.columns, field(0).cast("double").alias("start_time"), field(1).cast("double").alias("end_time"), F.lower(field(2)).alias("emotion"), field(3).cast("double").alias("intensity"))
    return out.filter(F.col("emotion").isin(*EMOTIONS) & (F.col("intensity") >= least))


def parsed_verdict(text: Column, emotion: Column, intensity: Column) -> dict[str, Column]:
    """A second look's answer; what is missing or no JSON falls back on the first look, as stats_mismatch."""
    kind = "struct<verdict:string,emotion:string,intensity:double,face_coverage:double,frontal_ratio:double,speech_quality:string,stable:boolean,reasoning:string>"
    body = strip_fence(F.coalesce(text, F.lit("")))
    broken = F.from_json(body, "map<string,string>").isNull() | ~body.startswith("{")
    got = F.when(~broken, F.from_json(body, kind))
    return {
        "verdict": F.when(got["verdict"].isin(*VERDICTS), got["verdict"]).otherwise("stats_mismatch"),
        "emotion": F.coalesce(got["emotion"], emotion),
        "intensity": F.coalesce(got["intensity"], intensity),
        "face_coverage": F.coalesce(got["face_coverage"], F.lit(0.0)),
        "frontal_ratio": F.coalesce(got["frontal_ratio"], F.lit(0.0)),
        "speech_quality": F.coalesce(got["speech_quality"], F.lit("unknown")),
        "stable": F.coalesce(got["stable"], F.lit(True)),
        "parse_failed": broken,
    }


def agent_text(response: Column) -> Column:
    """The text of an agent's answer (JSON): the first part with text of the first candidate, without a fence; else its `text`, else its `raw`, else ''."""
    got = F.from_json(response, "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,text:string,raw:string>")
    parts = F.filter(F.try_element_at(got["candidates"], F.lit(1))["content"]["parts"], lambda p: p["text"].isNotNull())
    first = strip_fence(F.try_element_at(parts, F.lit(1))["text"])
    return F.coalesce(first, F.nullif(got["text"], F.lit("")), got["raw"], F.lit(""))
