"""Queries: feature files and tensors, frame statistics, scenes, ranked scores, exact percentiles, retries, and writes that are merged or taken once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..operators import frames, retries, scores, selection, state, tensors
from ..session import cut, shared_folder
from ..sources import npy, sinks
from ..streaming import streams
from .catalog import query

c = F.col


def _folder(t) -> str:
    """A new folder of the session's shared one, for data that a query derives and writes."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4()}"


_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::double, 4)) AS v FROM embeddings)"


def _v(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))


def _matrix(v: str, columns: int):
    """v in rows of that many columns."""
    return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(columns)), lambda i: F.slice(v, i, F.lit(columns)))


@query("npy_matrices", f"WITH {_V} SELECT cast(vec_id as varchar) AS clip_id, vec_id % 7 <> 0 AS sound, case when vec_id % 7 = 0 then 4 else 8 end AS n_rows, case when vec_id % 7 = 0 then null else round(list_sum(list_transform(v, lambda x, i: x * ((i - 1) // 8 + 1))), 6) end AS total FROM v")
def _(t):
    folder = _folder(t)
    rows = _v(t).select(c("vec_id").alias("clip_id"), F.lit("vision").alias("modality"), F.when(c("vec_id") % 7 == 0, _matrix("v", 16)).otherwise(_matrix("v", 8)).alias("matrix"))
    cut(npy.write_matrices(rows, folder))
    found = npy.read(t.spark, npy.Matrices, folder, shape__vision="8x8")
    weighed = F.aggregate(F.transform("matrix", lambda r, i: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("clip_id", c("error").isNull().alias("sound"), c("shape")[0].alias("n_rows"), F.round(weighed, 6).alias("total"))


def _region(rows: tuple[str, str], columns: tuple[str, str] = ("0", "fw"), what: str = "avg") -> str:
    area = 255 if what == "avg" else 65025
    return f"{what}(g) FILTER (r >= {rows[0]} AND r < {rows[1]} AND q >= {columns[0]} AND q < {columns[1]}) / {area}"


def _share(x: float, n: str = "fh") -> str:
    return f"floor({n} * {x}::double)"


_MOUTH, _SIDES = (_share(0.6), "fh"), (("0", "fw // 2"), ("fw // 2", "fw"))
_THIRDS = [_region(rows) for rows in (("0", "fh // 3"), ("fh // 3", "2 * fh // 3"), ("2 * fh // 3", "fh"))]
_LEFT, _RIGHT = (_region(("0", "fh"), s) for s in _SIDES)
_NUMBERS = [
    _region(("0", _share(0.5))), _region(("0", _share(0.5)), what="var_pop"), _THIRDS[0], f"{_THIRDS[0]} - {_THIRDS[2]}", "any_value(fw) / any_value(fh)", "any_value(fw) / 8", "any_value(fh) / 8",
    _region(_MOUTH), _region(_MOUTH, what="var_pop"), _THIRDS[2], f"{_THIRDS[2]} - {_THIRDS[0]}", _region(_MOUTH, _SIDES[0]), _region(_MOUTH, _SIDES[1]), _THIRDS[1],
    *(_region((_share(a), _share(b))) for a, b in ((0.3, 0.7), (0.4, 0.55), (0.55, 0.7))), "stddev_pop(g) / 255", "(max(g) - min(g)) / 255", f"{_LEFT} - {_RIGHT}", f"abs({_LEFT} - {_RIGHT})",
    *(_region(("0", "fh"), (_share(a, "fw"), _share(b, "fw"))) for a, b in ((0.25, 0.45), (0.55, 0.75))), *(_region((_share(a), _share(b))) for a, b in ((0.1, 0.25), (0.25, 0.4), (0.7, 0.85))), _region((_share(0.85), "fh")),
    "avg(gx) / 255", "avg(gy) / 255", "avg(abs(gx)) / 255", "avg(abs(gy)) / 255", *(f"quantile_cont(g, {p}) / 255" for p in (0.5, 0.25, 0.75)), "(quantile_cont(g, 0.75) - quantile_cont(g, 0.25)) / 255",
]
_AT = "f[{0} * fw + {1} + 1]"
_FACE = f"""p AS (SELECT vec_id, (list_transform(embedding, lambda x: floor(abs(x::double) * 1000) % 256)) AS g, vec_id % 2 AS x1, vec_id % 3 AS y1, case when vec_id % 13 = 0 then vec_id % 2 else 8 end AS x2, 8 - vec_id % 2 AS y2 FROM embeddings),
f AS (SELECT *, x2 - x1 AS fw, y2 - y1 AS fh, list_filter(g, lambda x, i: (i - 1) // 8 >= y1 AND (i - 1) // 8 < y2 AND (i - 1) % 8 >= x1 AND (i - 1) % 8 < x2) AS f FROM p),
k AS (SELECT *, unnest(range(0, fh * fw)) AS i FROM f),
n AS (SELECT vec_id, fh, fw, f, i // fw AS r, i % fw AS q, f[i + 1]::double AS g, case when i // fw = 0 then 1 else i // fw - 1 end AS u, case when i // fw = fh - 1 then fh - 2 else i // fw + 1 end AS d, case when i % fw = 0 then 1 else i % fw - 1 end AS l, case when i % fw = fw - 1 then fw - 2 else i % fw + 1 end AS h FROM k),
s AS (SELECT *, {" + ".join(f"{w} * ({_AT.format(r, 'h')} - {_AT.format(r, 'l')})" for r, w in (("u", 1), ("r", 2), ("d", 1)))} AS gx, {" + ".join(f"{w} * ({_AT.format('d', q)} - {_AT.format('u', q)})" for q, w in (("l", 1), ("q", 2), ("h", 1)))} AS gy FROM n),
m AS (SELECT vec_id, [{", ".join(f"coalesce({x}, 0)::double" for x in _NUMBERS)}] AS m FROM s GROUP BY vec_id)"""


def _pictures(t) -> DataFrame:
    """Vectors as grey pictures of 8 x 8 with a face's box; every thirteenth has no face."""
    x1, y1 = c("vec_id") % 2, c("vec_id") % 3
    rows = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256).alias("g"))
    return rows.select("vec_id", "label", _matrix("g", 8).alias("picture"), F.array(x1, y1, F.when(c("vec_id") % 13 == 0, x1).otherwise(8), 8 - c("vec_id") % 2).alias("box"))


@query("frame_statistics", f"WITH {_FACE} SELECT p.vec_id, i AS place, round(coalesce(m[i + 1], 0.0::double), 8) AS x FROM p LEFT JOIN m USING (vec_id), range(0, {len(frames.STATISTICS)}) y(i)")
def _(t):
    return frames.statistics(_pictures(t)).select("vec_id", F.posexplode("statistics").alias("place", "x")).withColumn("x", F.round("x", 8))


@query("frame_moments", f"WITH {_FACE}, e AS (SELECT label, i AS place, coalesce(m[i + 1], 0.0::double) AS x FROM embeddings LEFT JOIN m USING (vec_id), range(0, {len(frames.STATISTICS)}) y(i)) SELECT label, place, count(*) AS n, round(avg(x), 8) AS mean, round(var_pop(x), 8) AS variance, round(min(x), 8) AS least, round(max(x), 8) AS most FROM e GROUP BY ALL")
def _(t):
    rows = frames.moments(frames.statistics(_pictures(t)), "label")
    return rows.select("label", "place", "n", *(F.round(x, 8).alias(x) for x in ("mean", "variance", "least", "most")))


_CHANGE = """d AS (SELECT label, vec_id * 100 AS pos, list_sum(list_transform(list_zip(embedding, lag(embedding) over (partition by label order by vec_id)), lambda z: abs(z[1]::double - z[2]::double))) / len(embedding) AS change, vec_id = min(vec_id) over (partition by label) AS first FROM embeddings),
k AS (SELECT label, pos, row_number() over (partition by label order by pos) AS k FROM d WHERE change >= 0.145 AND NOT first),
r AS (SELECT label, 0::bigint AS k, null::bigint AS last, false AS cut FROM (SELECT DISTINCT label FROM k) UNION ALL SELECT r.label, k.k, case when last is null or pos - last >= 1500 then pos else last end, last is null or pos - last >= 1500 FROM r JOIN k ON k.label = r.label AND k.k = r.k + 1)"""


def _film(t) -> DataFrame:
    """Vectors as frames: one film a label, a frame every hundred places."""
    return t("embeddings").select("label", (c("vec_id") * 100).alias("pos"), "embedding")


@query("frame_changes", f"WITH RECURSIVE {_CHANGE} SELECT label, pos, case when first then null else round(change, 8) end AS change FROM d")
def _(t):
    return frames.change(_film(t), "label", "pos", "embedding").withColumn("change", F.round("change", 8))


@query("scene_cuts", f"""WITH RECURSIVE {_CHANGE}, b AS (SELECT label, last AS "start" FROM r WHERE cut UNION SELECT label, min(pos) FROM d GROUP BY 1)
SELECT * FROM (SELECT label, row_number() over (partition by label order by "start") - 1 AS scene_index, "start", coalesce(lead("start") over (partition by label order by "start"), e) AS "end" FROM b JOIN (SELECT label, max(pos) AS e FROM d GROUP BY 1) USING (label)) WHERE "end" > "start" """)
def _(t):
    return frames.scenes(_film(t), "label", "pos", "embedding", 0.145, 1500)


_SIZES = {"text": 6, "audio": 3, "vision": 1}
_ALIGNED = f"""{_V}, q AS (SELECT *, vec_id % 6 AS words FROM v),
f AS (SELECT vec_id, words, 'text' AS modality, pos, 4 AS n, i, v[pos * 8 + i + 1] AS x FROM q, range(0, 4) a(pos), range(0, 6) b(i) UNION ALL SELECT vec_id, words, 'audio', pos, 10, i, v[pos * 2 + i + 33] FROM q, range(0, 10) a(pos), range(0, 2) b(i)
UNION ALL SELECT vec_id, words, 'vision', pos, 1 + vec_id % 4, 0, v[pos + 55] FROM q, range(0, 4) a(pos) WHERE pos <= vec_id % 4),
w AS (SELECT vec_id, w, w * 0.015::double AS a, w * 0.015::double + 0.03::double AS b FROM q, range(0, 5) r(w) WHERE w < words),
m AS (SELECT vec_id, modality, pos AS place, sum((i + 1) * x) AS total FROM f WHERE (modality = 'text' OR words = 0 OR words = n) AND pos < 5 GROUP BY ALL UNION ALL
SELECT vec_id, modality, place, sum((i + 1) * x) FROM (SELECT f.vec_id, modality, w AS place, i, avg(x) AS x FROM f JOIN w ON w.vec_id = f.vec_id AND modality <> 'text' AND words <> n AND pos >= least(n, floor(a * 100.0::double)) AND pos < least(n, floor(least(n / 100.0::double, b) * 100.0::double)) GROUP BY ALL) GROUP BY ALL)"""


def _aligned(t) -> DataFrame:
    v = _v(t)
    frame = lambda n, first, size, step: F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("v", i * step + first, size))).alias("at", "values")
    made = {"text": v.select(c("vec_id").alias("clip_id"), frame(F.lit(4), 1, 8, 8)), "audio": v.select(c("vec_id").alias("clip_id"), frame(F.lit(10), 33, 2, 2)), "vision": v.select(c("vec_id").alias("clip_id"), frame((c("vec_id") % 4 + 1).cast("int"), 55, 1, 1))}
    words = v.filter("vec_id % 6 > 0").select(c("vec_id").alias("clip_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), c("vec_id") % 6 - 1)).alias("at"))
    words = words.withColumn("start", c("at") * 0.015).withColumn("end", c("start") + 0.03)
    return tensors.aligned(made, words, _SIZES, 5)


@query("aligned_modalities", f"WITH {_ALIGNED} SELECT q.vec_id AS clip_id, y.modality, p AS place, round(coalesce(total, 0.0::double), 8) AS total FROM q, range(0, 5) r(p), (VALUES ('text'), ('audio'), ('vision')) y(modality) LEFT JOIN m ON m.vec_id = q.vec_id AND m.modality = y.modality AND m.place = p")
def _(t):
    weighed = lambda row: F.aggregate(F.transform(row, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    each = _aligned(t).select("clip_id", F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), c(m).alias("steps")) for m in _SIZES))).alias("m"))
    return each.select("clip_id", "m.modality", F.posexplode("m.steps").alias("place", "row")).select("clip_id", "modality", "place", F.round(weighed("row"), 8).alias("total"))


_SPLIT = "case when {0} % 10 < 7 then 'train' when {0} % 10 < 8 then 'val' else 'test' end"


@query("tensor_stacks", f"WITH {_ALIGNED}, s AS (SELECT {_SPLIT.format('vec_id')} AS split, count(*) AS n FROM q GROUP BY 1) SELECT s.split, d.modality, s.n, d.width, round(coalesce(total, 0), 5) AS total FROM s, (VALUES ('text', 6), ('audio', 3), ('vision', 1)) d(modality, width) LEFT JOIN (SELECT {_SPLIT.format('vec_id')} AS split, modality, sum(x) AS total FROM (SELECT vec_id, modality, x FROM f WHERE (modality = 'text' OR words = 0 OR words = n) AND pos < 5 UNION ALL SELECT f.vec_id, modality, avg(x) FROM f JOIN w ON w.vec_id = f.vec_id AND modality <> 'text' AND words <> n AND pos >= least(n, floor(a * 100.0::double)) AND pos < least(n, floor(least(n / 100.0::double, b) * 100.0::double)) GROUP BY f.vec_id, modality, w, i) GROUP BY ALL) z ON z.split = s.split AND z.modality = d.modality")
def _(t):
    clips = _aligned(t).withColumn("split", F.expr(_SPLIT.format("clip_id")))
    # every vector is one clip, so splits are counted without aligning the clips a second time
    sizes = t("embeddings").select(F.expr(_SPLIT.format("vec_id")).alias("split"), "vec_id").distinct().groupBy("split").count()
    made = cut(tensors.write_stacks(clips, _folder(t), modalities=tuple(_SIZES), most=50, sizes=sizes)).filter("modality <> 'clip_id'")
    return made.groupBy("split", "modality").agg(F.sum(c("shape")[0]).alias("n"), F.max(c("shape")[2]).alias("width"), F.round(F.sum("total"), 5).alias("total"))


_LABELS = ("happy", "sad", "angry", "fear", "surprise", "disgust")
_TEMPLATES = {x: [((i * (j + 2) + j) % 7 - 3) / 10 for i in range(74)] for j, x in enumerate(_LABELS)}
_RANKED = "SELECT {0}, row_number() over (partition by {0} order by s desc, j) - 1 AS place, label, cast(round(cast(s as decimal(20,8)), 4) as double) AS score FROM {1}"
_NAMES = f"(VALUES {', '.join(f'({j}, {chr(39)}{x}{chr(39)})' for j, x in enumerate(_LABELS))}) l(j, label)"


@query("template_scores", f"""WITH v AS (SELECT vec_id, case when vec_id % 11 = 0 then list_transform(embedding, lambda x: 0.0::double) else list_transform(embedding, lambda x: round(x::double, 4)) end AS v FROM embeddings),
e AS (SELECT vec_id, j, label, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM v, {_NAMES}), g AS (SELECT *, ((i * (j + 2) + j) % 7 - 3) / 10.0::double AS y FROM e),
s AS (SELECT vec_id, j, label, case when sqrt(sum(x * x)) < 0.00000001 then 0.0::double else greatest(0.0::double, sum(x * y) / sqrt(sum(x * x)) / (1 + 0.00000001::double) / (sqrt(sum(y * y)) + 0.00000001::double)) end AS s FROM g GROUP BY ALL)
{_RANKED.format("vec_id", "s")}""")
def _(t):
    rows = _v(t).withColumn("v", F.when(c("vec_id") % 11 == 0, F.transform("v", lambda _: F.lit(0.0))).otherwise(c("v")))
    return scores.against_templates(rows, "v", _TEMPLATES).select("vec_id", F.posexplode("scores").alias("place", "s")).select("vec_id", "place", "s.label", "s.score")


_FIRST = {"happy": "coalesce(confidence, 0)", "sad": "face_coverage", "disgust": "0.25"}
_SECOND = {"angry": "round(quality, 4)", "happy": "clarity", "fear": "case when clip_id % 5 = 0 then 0.5 else 0 end"}


@query("blended_scores", f"""WITH e AS (SELECT clip_id, j, label, case when clip_id % 17 = 0 then 0.0::double else 0.6::double * (case label {" ".join(f"when '{k}' then {x}" for k, x in _FIRST.items())} else 0 end)::double
+ (1 - 0.6::double) * (case label {" ".join(f"when '{k}' then {x}" for k, x in _SECOND.items())} else 0 end)::double end AS x FROM clips, {_NAMES}),
s AS (SELECT clip_id, j, label, case when sum(x) over (partition by clip_id) > 0 then x / sum(x) over (partition by clip_id) else x end AS s FROM e) {_RANKED.format("clip_id", "s")}""")
def _(t):
    as_map = lambda parts: F.when(c("clip_id") % 17 > 0, F.create_map(*(y for k, x in parts.items() for y in (F.lit(k), F.expr(x).cast("double")))))
    # each step is a column that later ones name, so that Spark works it out once a row
    maps = t.clips.select("clip_id", as_map(_FIRST).alias("first"), as_map(_SECOND).alias("second"))
    mixed = maps.select("clip_id", F.array(*vectors.blended(c("first"), c("second"), 0.6, _LABELS).values()).alias("mixed"))
    rows = mixed.select("clip_id", F.posexplode(vectors.ranked({x: c("mixed")[i] for i, x in enumerate(_LABELS)})).alias("place", "s"))
    return rows.select("clip_id", "place", "s.label", "s.score")


@query("map_merge", """SELECT clip_id, confidence AS happy, case when clip_id % 3 = 0 then clarity else face_coverage end AS sad, case when clip_id % 3 = 0 then quality end AS fear FROM clips""")
def _(t):
    first = F.create_map(F.lit("happy"), c("confidence"), F.lit("sad"), c("face_coverage"))
    merged = vectors.merged_maps(first, F.when(c("clip_id") % 3 == 0, F.create_map(F.lit("sad"), c("clarity"), F.lit("fear"), c("quality"))))
    return t.clips.select("clip_id", merged.alias("m")).select("clip_id", *(F.try_element_at("m", F.lit(x)).alias(x) for x in ("happy", "sad", "fear")))


@query("exact_percentiles", "SELECT status, count(quality) AS n, quantile_cont(quality, 0.05) AS p5, quantile_cont(quality, 0.5) AS p50, quantile_cont(quality, 0.99) AS p99 FROM clips GROUP BY 1")
def _(t):
    return selection.percentiles(t.clips, "quality", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, ["status"], small=500)


_EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, case when event_id % 9 = 8 then 'job' when event_id % 9 = 7 then 'idle' else 'error' end AS outcome FROM events)"


@query("retry_policy", f"""WITH {_EVENTS}, r AS (SELECT *, count(*) FILTER (outcome = 'job') over (partition by user_id order by ms, event_id) AS run FROM e),
n AS (SELECT *, count(*) FILTER (outcome = 'error') over (partition by user_id, run order by ms, event_id) AS consecutive_errors FROM r),
s AS (SELECT user_id, min((ms, event_id)) AS stop FROM n WHERE consecutive_errors >= 5 GROUP BY 1),
a AS (SELECT user_id, event_id, ms, outcome, consecutive_errors, case when (ms, event_id) > stop then 'stopped' when (ms, event_id) = stop then 'stop' when outcome = 'error' then 'wait' else 'go on' end AS action FROM n LEFT JOIN s USING (user_id))
SELECT *, case when action in ('stop', 'stopped') then 0 when outcome = 'error' then 30 else 10 end AS wait_s FROM a""")
def _(t):
    outcome = F.expr("case when event_id % 9 = 8 then 'job' when event_id % 9 = 7 then 'idle' else 'error' end").alias("outcome")
    return retries.decided(t("events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), outcome), "user_id", "ms", "event_id")


@query("stream_append_once", "SELECT event_type, count(*) AS n, sum(event_id)::bigint AS ids FROM events GROUP BY 1")
def _(t):
    """The events as a stream, by a sink that gets each batch twice."""
    schema, path = "event_id bigint, event_type string", _folder(t)
    sink = streams.append_once(path)
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(t.sf_dir)
    streams.run_available(rows, lambda batch, n: [sink(batch, n) for _ in range(2)], f"{path}-checkpoint")
    return streams.appended(t.spark, path, schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("feature_upsert", """SELECT clip_id, clip_id % 8 AS part, case when clip_id % 16 in (2, 5) then concat('/new/', clip_id) else concat('/old/', clip_id) end AS text_path, case when clip_id % 16 in (2, 5) then clip_id % 3 = 0 else false end AS aligned FROM clips WHERE clip_id % 5 <> 0 OR clip_id % 16 in (2, 5)""")
def _(t):
    path = _folder(t)
    rows = lambda some, text, aligned: t.clips.filter(some).select("clip_id", (c("clip_id") % 8).alias("part"), F.concat(F.lit(text), c("clip_id")).alias("text_path"), F.expr(aligned).alias("aligned"))
    rows("clip_id % 5 <> 0", "/old/", "false").write.partitionBy("part").parquet(path)
    sinks.upsert_partitions(rows("clip_id % 16 in (2, 5)", "/new/", "clip_id % 3 = 0"), path, ["clip_id", "part"], ["text_path", "aligned"], "part")
    return t.spark.read.parquet(path).select("clip_id", c("part").cast("bigint").alias("part"), "text_path", "aligned")


_NOW = "1700000000000000"


@query("clip_persist", f"""WITH s AS (SELECT clip_id, 'fear' AS emotion, verify_intensity AS intensity, verify_verdict, case when clip_id % 4 = 0 then '' else verify_status end AS verify_status, case when clip_id % 8 = 2 then 'late' else '' end AS reject_reason FROM clips WHERE clip_id % 6 <> 0)
SELECT clip_id, case when b.clip_id is null then 'needs_review' else b.status end AS status, case when s.clip_id is null then b.emotion else s.emotion end AS emotion, case when s.clip_id is null then b.confidence else s.intensity end AS confidence,
case when s.clip_id is null then b.verify_status else coalesce(nullif(s.verify_status, ''), 'not_run') end AS verify_status, case when s.clip_id is null then b.reject_reason else coalesce(nullif(s.reject_reason, ''), b.reject_reason) end AS reject_reason,
case when b.clip_id is null then concat('[Gemini AutoCut] subject=x | ', clip_id) else null end AS reviewer_notes, case when s.clip_id is not null and b.clip_id is not null then {_NOW} else b.updated_at end AS updated_at,
case when b.clip_id is null then 'inserted' when s.clip_id is null then 'kept' else 'updated' end AS change
FROM (SELECT clip_id, status, emotion, confidence, verify_status, case when clip_id % 9 = 0 then 'old' end AS reject_reason, created_us AS updated_at FROM clips WHERE clip_id % 4 <> 1) b FULL JOIN s USING (clip_id)""")
def _(t):
    old = t.clips.filter("clip_id % 4 <> 1").selectExpr("clip_id", "status", "emotion", "confidence", "verify_status", "case when clip_id % 9 = 0 then 'old' end AS reject_reason", "cast(null as string) AS reviewer_notes", "created_us AS updated_at")
    found = t.clips.filter("clip_id % 6 <> 0").selectExpr(
        "clip_id", "video_id", "clip_index", "start_ms / 1000 AS start_time", "end_ms / 1000 AS end_time", "clip_path", "'fear' AS emotion", "verify_intensity AS intensity", "face_coverage", "true AS has_transcript", "'x' AS subject", "cast(clip_id as string) AS reasoning",
        "verify_verdict", "case when clip_id % 4 = 0 then '' else verify_status end AS verify_status", "'' AS verify_reasoning", "rejected_by_verify", "case when clip_id % 8 = 2 then 'late' else '' end AS reject_reason",
    )
    return state.persisted(old, found, F.lit(int(_NOW)))


@query("recount_deltas", "SELECT video_id, count(c.clip_id) AS total_clips, count(*) FILTER (c.status = 'approved') AS approved_clips FROM videos LEFT JOIN (SELECT clip_id, video_id, case when clip_id % 4 = 0 then 'approved' when clip_id % 4 = 1 then 'rejected' else status end AS status FROM clips WHERE clip_id % 7 <> 0) c USING (video_id) GROUP BY 1")
def _(t):
    clips = t.clips.select("clip_id", "video_id", "status")
    before = clips.filter("clip_id % 11 <> 0")  # the others come in
    after = clips.filter("clip_id % 7 <> 0").withColumn("status", F.expr("case when clip_id % 4 = 0 then 'approved' when clip_id % 4 = 1 then 'rejected' else status end"))
    touched = "clip_id % 11 = 0 OR clip_id % 7 = 0 OR clip_id % 4 < 2"
    return state.adjusted(state.recounted(t.videos.select("video_id"), before), state.changes(before.filter(touched), after.filter(touched)))
