"""Queries: interval algebra, ordered folds and dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import intervals
from .catalog import query

c = F.col

#: Speech that begins 0.7 s into each clip and lasts half as long.
_SPEECH = "s AS (SELECT video_id, start_ms + 700 AS b_start, start_ms + 700 + duration_ms // 2 AS b_end FROM clips)"
_MET = "least(end_ms, b_end) - greatest(start_ms, b_start)"
_MEET = "s.video_id = clips.video_id AND b_start < end_ms AND b_end > start_ms"


def _a(t) -> DataFrame:
    return t.clips.select("video_id", c("clip_id").alias("a_id"), c("start_ms").alias("a_start"), c("end_ms").alias("a_end"))


def _b(t) -> DataFrame:
    return t.clips.select("video_id", (c("start_ms") + 700).alias("b_start"), (c("start_ms") + 700 + F.expr("duration_ms div 2")).alias("b_end"))


def _spans(t) -> DataFrame:
    return t.clips.select("video_id", c("clip_id").alias("id"), c("start_ms").alias("start"), c("end_ms").alias("end"), c("confidence").alias("intensity"))


@query("interval_containment", "SELECT a.clip_id AS a_id, coalesce(max(b.confidence), 0.0) AS best, count(b.clip_id) > 0 AS found FROM clips a LEFT JOIN clips b ON a.video_id = b.video_id AND b.start_ms + 500 <= a.start_ms AND a.end_ms <= b.end_ms + 3000 GROUP BY 1")
def _(t):
    segments = t.clips.select("video_id", (c("start_ms") + 500).alias("b_start"), (c("end_ms") + 3000).alias("b_end"), c("confidence").alias("intensity"))
    return intervals.contained_best(_a(t), segments, "video_id")


@query("interval_coverage", f"WITH {_SPEECH} SELECT clip_id AS a_id, least(1.0::double, coalesce(sum({_MET}), 0)::double / any_value(end_ms - start_ms)) AS coverage FROM clips LEFT JOIN s ON {_MEET} GROUP BY 1")
def _(t):
    return intervals.coverage(_a(t), _b(t), "video_id")


@query("interval_intersect", f'WITH {_SPEECH} SELECT clip_id AS a_id, greatest(start_ms, b_start) AS "start", least(end_ms, b_end) AS "end" FROM clips JOIN s ON {_MEET}')
def _(t):
    return intervals.intersections(_a(t), _b(t), "video_id")


@query("sample_coverage", "SELECT a.clip_id AS a_id, sum(case when b.num_faces % 3 > 0 then 1 else 0 end)::double / count(*) AS coverage, sum(b.num_faces % 3)::double / count(*) AS avg_faces FROM clips a JOIN clips b ON a.video_id = b.video_id AND b.start_ms BETWEEN a.start_ms AND a.end_ms GROUP BY 1")
def _(t):
    return intervals.sample_coverage(_a(t), t.clips.select("video_id", c("start_ms").alias("ts"), (c("num_faces") % 3).alias("n_faces")), "video_id")


def _merged_sql(gap: int, least: int) -> str:
    return f"""WITH r AS (SELECT *, max(end_ms) over (partition by video_id order by start_ms, end_ms, clip_id rows between unbounded preceding and 1 preceding) AS reach FROM clips),
i AS (SELECT *, sum(case when reach is null or start_ms - reach > {gap} then 1 else 0 end) over (partition by video_id order by start_ms, end_ms, clip_id rows unbounded preceding) AS island FROM r)
SELECT video_id, min(start_ms) AS "start", max(end_ms) AS "end" FROM i GROUP BY video_id, island HAVING max(end_ms) - min(start_ms) >= {least}"""


@query("merge_gaps", _merged_sql(350, 2500))
def _(t):
    return intervals.merged(_spans(t), "video_id", 350, 2500)


@query("merge_overlaps", _merged_sql(0, 0))
def _(t):
    return intervals.merged(_spans(t), "video_id", 0)


@query("interval_complement", """WITH x AS (SELECT video_id, start_ms, end_ms FROM clips UNION ALL SELECT DISTINCT video_id, 620000, 620000 FROM clips),
r AS (SELECT video_id, start_ms, coalesce(max(end_ms) over (partition by video_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) AS reach FROM x)
SELECT video_id, reach AS "start", start_ms AS "end" FROM r WHERE start_ms - reach >= 250""")
def _(t):
    return intervals.complement(_spans(t), t.clips.select("video_id").distinct().withColumn("length_ms", F.lit(620000).cast("bigint")), "video_id")


@query("voiced_intervals", """WITH f AS (SELECT video_id, clip_id * 15 AS ts, confidence >= 0.5 AS voiced FROM clips),
g AS (SELECT *, lead(ts) over w AS nxt, row_number() over w - row_number() over (partition by video_id, voiced order by ts) AS run FROM f WINDOW w AS (partition by video_id order by ts))
SELECT video_id, min(ts) AS "start", arg_max(coalesce(nxt, ts + 15), ts) AS "end" FROM g WHERE voiced GROUP BY video_id, run""")
def _(t):
    return intervals.voiced_intervals(t.clips.select("video_id", (c("clip_id") * 15).alias("ts"), (c("confidence") >= 0.5).alias("voiced")), "video_id", 15)


def _samples(t) -> DataFrame:
    """Each video's clips in order as face samples every half second."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("clip_id")) - 1
    scene_end = F.count("*").over(Window.partitionBy("video_id")) * 500
    return t.clips.select("video_id", (place * 500).cast("bigint").alias("ts"), F.when(c("clip_id") % 7 < 5, c("clip_id") % 3).otherwise(0).alias("n_faces"), F.lit(0).cast("bigint").alias("scene_start"), scene_end.alias("scene_end"))


@query("face_runs", """WITH f AS (SELECT video_id, (row_number() over (partition by video_id order by clip_id) - 1) * 500 AS ts, case when clip_id % 7 < 5 then clip_id % 3 else 0 end AS n, count(*) over (partition by video_id) * 500 AS scene_end FROM clips),
l AS (SELECT *, max(case when n > 0 then ts end) over (partition by video_id order by ts) AS face FROM f),
d AS (SELECT *, n = 0 and face is not null and ts - face > 1000 AS late FROM l),
e AS (SELECT *, late and not coalesce(lag(late) over (partition by video_id order by ts), false) AS closes FROM d),
g AS (SELECT *, coalesce(sum(closes::int) over (partition by video_id order by ts rows between unbounded preceding and 1 preceding), 0) AS run FROM e)
SELECT video_id, min(ts) filter (n > 0) AS "start", least(max(scene_end), max(ts) filter (n > 0) + 500) AS "end", count(*) AS n_samples, count(*) filter (n > 0) AS n_faces, sum(n)::bigint AS faces_seen
FROM g GROUP BY video_id, run HAVING (least(max(scene_end), max(ts) filter (n > 0) + 500) - min(ts) filter (n > 0)) * 10 >= 12000""")
def _(t):
    return intervals.face_runs(_samples(t), "video_id")


@query("overlap_nms", """WITH RECURSIVE o AS (SELECT video_id, clip_id AS id, start_ms AS s, end_ms AS e, confidence AS i, row_number() over (partition by video_id order by confidence desc, start_ms, end_ms, clip_id) AS k FROM clips),
r AS (SELECT video_id, k, [{'id': id, 's': s, 'e': e, 'i': i}] AS kept FROM o WHERE k = 1 UNION ALL
SELECT r.video_id, o.k, case when len(list_filter(kept, lambda x: least(x.e, o.e) > greatest(x.s, o.s) and (least(x.e, o.e) - greatest(x.s, o.s))::double / least(x.e - x.s, o.e - o.s) > 0.3)) > 0 then kept else list_append(kept, {'id': o.id, 's': o.s, 'e': o.e, 'i': o.i}) end FROM r JOIN o ON o.video_id = r.video_id AND o.k = r.k + 1),
f AS (SELECT video_id, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1) SELECT video_id, x.id AS id, x.s AS "start", x.e AS "end", x.i AS intensity FROM f""")
def _(t):
    return intervals.overlap_nms(_spans(t), "video_id")


@query("adjacent_dedup", """WITH RECURSIVE o AS (SELECT video_id, clip_id AS id, start_ms AS s, end_ms AS e, quality AS q, row_number() over (partition by video_id order by start_ms, end_ms, clip_id) AS k FROM clips),
r AS (SELECT video_id, k, [{'id': id, 's': s, 'e': e, 'q': q}] AS kept FROM o WHERE k = 1 UNION ALL
SELECT r.video_id, o.k, case when o.s >= kept[-1].e - 250 then list_append(kept, {'id': o.id, 's': o.s, 'e': o.e, 'q': o.q}) when o.q > kept[-1].q then list_append(kept[:-2], {'id': o.id, 's': o.s, 'e': o.e, 'q': o.q}) else kept end FROM r JOIN o ON o.video_id = r.video_id AND o.k = r.k + 1),
f AS (SELECT video_id, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1) SELECT video_id, x.id AS id, x.s AS "start", x.e AS "end", x.q AS rank FROM f""")
def _(t):
    return intervals.adjacent_dedup(t.clips.select("video_id", c("clip_id").alias("id"), c("start_ms").alias("start"), c("end_ms").alias("end"), c("quality").alias("rank")), "video_id")


@query("dialogue_refine", f"""WITH {_SPEECH} SELECT clip_id AS a_id, coalesce(max(b_start) filter (b_start <= start_ms and start_ms <= b_end and start_ms - b_start <= 1500), any_value(start_ms)) AS "start",
coalesce(arg_max(b_end, b_start * 10000000 + b_end) filter (b_start <= end_ms and end_ms <= b_end and b_end - end_ms <= 1500), any_value(end_ms)) AS "end"
FROM clips LEFT JOIN s ON s.video_id = clips.video_id AND b_start <= end_ms AND b_end >= start_ms GROUP BY 1""")
def _(t):
    return intervals.dialogue_refined(_a(t), _b(t), "video_id")


@query("enforce_duration", """WITH RECURSIVE x AS (SELECT clip_id, start_ms AS s, start_ms + duration_ms * 3 AS e FROM clips),
g AS (SELECT *, flatten(list_transform(list_filter([0, 1, 2], lambda i: s + i * 9000 < e), lambda i: [s + i * 9000, least(e, s + i * 9000 + 4000)])) AS edges FROM x WHERE e - s > 12000),
r AS (SELECT clip_id, s, e, edges, 0 AS k, s AS cur, cast([] AS struct(a bigint, b bigint)[]) AS ps FROM g UNION ALL
SELECT clip_id, s, e, edges, k + 1, case when hit then edges[k + 1] else cur end, case when hit then list_append(ps, {'a': cur, 'b': edges[k + 1]}) else ps end FROM (SELECT *, edges[k + 1] - cur between 2000 and 12000 AS hit FROM r WHERE k < len(edges))),
d AS (SELECT *, case when e - cur >= 2000 then list_append(ps, {'a': cur, 'b': e}) else ps end AS rest FROM r WHERE k = len(edges)),
p AS (SELECT clip_id, unnest(case when len(rest) = 0 then [{'a': s, 'b': e}] else rest end) AS p FROM d),
c AS (SELECT clip_id, p.a AS a, p.b AS b FROM p WHERE p.b - p.a <= 12000 UNION ALL SELECT clip_id, q, least(b, q + 6000) FROM (SELECT clip_id, p.b AS b, unnest(range(p.a, p.b + 1, 6000)) AS q FROM p WHERE p.b - p.a > 12000) WHERE least(b, q + 6000) - q >= 2000)
SELECT clip_id, a AS "start", b AS "end" FROM c UNION ALL SELECT clip_id, s, e FROM x WHERE e - s <= 12000""")
def _(t):
    rows = t.clips.select("clip_id", c("start_ms").alias("start"), (c("start_ms") + c("duration_ms") * 3).alias("end"))
    talk = F.array(*(F.struct((c("start") + i * 9000).alias("start"), (c("start") + i * 9000 + 4000).alias("end")) for i in range(3)))
    return intervals.enforced(rows.withColumn("speech", talk))


@query("normalize_scenes", """WITH x AS (SELECT video_id, clip_id, start_ms AS s, start_ms + duration_ms * 3 - 5000 AS e, count(*) over (partition by video_id) AS n FROM clips),
y AS (SELECT * FROM x WHERE e > s AND (e - s >= 3000 OR n = 1)), z AS (SELECT *, unnest(case when e - s <= 15000 then [0] else range(0, (e - s) // 15000 + 1) end) AS i FROM y)
SELECT video_id, clip_id, case when e - s <= 15000 then s else s + i * 15000 end AS "start", case when e - s <= 15000 then e else least(e, s + (i + 1) * 15000) end AS "end", case when e - s > 15000 then s else -1 end AS parent_start, case when e - s > 15000 then e else -1 end AS parent_end
FROM z WHERE e - s <= 15000 OR least(e, s + (i + 1) * 15000) - (s + i * 15000) >= 3000""")
def _(t):
    rows = intervals.normalized_scenes(t.clips.select("video_id", "clip_id", c("start_ms").alias("start"), (c("start_ms") + c("duration_ms") * 3 - 5000).alias("end")), "video_id")
    return rows.fillna(-1, ["parent_start", "parent_end"])


@query("manual_normalize", """SELECT clip_id, start_ms AS "start", start_ms + (clip_id % 7 - 2) * 1000 AS "end", row_number() over (partition by video_id order by start_ms, clip_id) AS place FROM clips WHERE clip_id % 7 > 2""")
def _(t):
    rows = t.clips.select("clip_id", "video_id", c("start_ms").alias("start"), (c("start_ms") + (c("clip_id") % 7 - 2) * 1000).alias("end"))
    return intervals.manually_ordered(rows, "video_id", "clip_id").drop("video_id")


@query("segment_edits", """WITH s AS (SELECT clip_id AS id, video_id, start_ms AS a, end_ms AS b, status FROM clips), e AS (SELECT id, case id % 8 when 0 then 'delete' when 2 then 'reject' else 'merge' end AS action, id + 1 AS other FROM s WHERE id % 8 IN (0, 2, 4)),
j AS (SELECT s.*, e.action, o.id AS oid, o.a AS oa, o.b AS ob, coalesce(e.action = 'merge' AND o.video_id = s.video_id, false) AS merges FROM s LEFT JOIN e USING (id) LEFT JOIN s o ON o.id = e.other)
SELECT id, video_id, case when merges then least(a, oa) else a end AS "start", case when merges then greatest(b, ob) else b end AS "end", case when action = 'reject' then 'rejected' else status end AS status
FROM j WHERE coalesce(action, '') <> 'delete' AND id NOT IN (SELECT oid FROM j WHERE merges)""")
def _(t):
    rows = t.clips.select(c("clip_id").alias("id"), "video_id", c("start_ms").alias("start"), c("end_ms").alias("end"), "status")
    edits = rows.filter("id % 8 in (0, 2, 4)").select("id", F.expr("case id % 8 when 0 then 'delete' when 2 then 'reject' else 'merge' end").alias("action"), (c("id") + 1).alias("other"))
    return intervals.edited(rows, edits)


@query("split_merge_edit", """WITH x AS (SELECT clip_id, start_ms AS s, end_ms AS e, start_ms + (clip_id % 12) * 1000 AS p FROM clips), y AS (SELECT *, p - s > 500 and e - p > 500 AS inside FROM x)
SELECT clip_id, s AS "start", case when inside then p else e end AS "end" FROM y UNION ALL SELECT clip_id, p, e FROM y WHERE inside""")
def _(t):
    rows = t.clips.select("clip_id", c("start_ms").alias("start"), c("end_ms").alias("end"))
    return intervals.split_at(rows, c("start") + (c("clip_id") % 12) * 1000)


@query("smart_segments", None)
def _(t):
    talk = _samples(t).filter("n_faces > 0").select("video_id", c("ts").alias("start"), (c("ts") + 900).alias("end"))
    return intervals.smart_segments(_samples(t), intervals.merged(talk, "video_id"), "video_id")


@query("pad_and_cap", 'SELECT clip_id, greatest(0, start_ms - 500) AS "start", least(600000, end_ms + 500) AS "end" FROM clips QUALIFY row_number() over (partition by video_id order by start_ms, clip_id) <= 40')
def _(t):
    rows = t.clips.select("clip_id", "video_id", c("start_ms").alias("start"), c("end_ms").alias("end"))
    return intervals.padded_and_capped(rows, "video_id", "clip_id", F.lit(600000)).drop("video_id")


@query("clip_reindex", "SELECT clip_id, row_number() over (partition by video_id order by start_ms, clip_id) - 1 AS place FROM clips")
def _(t):
    return t.clips.select("clip_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "clip_id")) - 1).alias("place"))


@query("batch_offset", "WITH f AS (SELECT video_id, clip_id, row_number() over (partition by video_id order by clip_id) - 1 AS place FROM clips) SELECT clip_id, place // 24 AS batch, place // 24 * 24 + place % 24 % 5 AS at FROM f")
def _(t):
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("clip_id")) - 1
    rows = t.clips.select("clip_id", place.alias("place")).withColumn("batch", F.floor(c("place") / 24))
    return rows.select("clip_id", "batch", (c("batch") * 24 + c("place") % 24 % 5).alias("at"))


@query("flatten_words", "WITH w AS (SELECT clip_id, start_ms, duration_ms, string_split(transcript, ' ') AS words FROM clips WHERE transcript <> ''), x AS (SELECT *, unnest(range(0, len(words))) AS i FROM w) SELECT clip_id, i AS place, words[i + 1] AS word, start_ms + i * duration_ms // len(words) AS at FROM x")
def _(t):
    words = F.split("transcript", " ")
    rows = t.clips.filter("transcript <> ''").select("clip_id", "start_ms", "duration_ms", F.size(words).alias("n"), F.posexplode(words).alias("place", "word"))
    return rows.select("clip_id", "place", "word", (c("start_ms") + F.floor(c("place") * c("duration_ms") / c("n"))).alias("at"))


@query("vad_threshold", "SELECT video_id, greatest(0.008, quantile_cont(clarity, 0.35) * 2.3, quantile_cont(clarity, 0.70) * 0.45) AS threshold FROM clips GROUP BY 1")
def _(t):
    return intervals.voice_threshold(t.clips, "video_id", "clarity")


@query("word_times_pool", """WITH f AS (SELECT video_id, row_number() over (partition by video_id order by clip_id) - 1 AS place, round(quality, 4) AS x, count(*) over (partition by video_id) AS n FROM clips),
w AS (SELECT video_id, word, word * 0.05::double AS a, word * 0.05::double + 0.04::double * (word % 3) AS b, n FROM (SELECT DISTINCT video_id, n FROM f), range(0, 8) r(word))
SELECT w.video_id, word, round(coalesce(avg(x), 0.0), 8) AS mean FROM w LEFT JOIN f ON f.video_id = w.video_id AND place >= least(w.n, floor(a * 100)) AND place < least(w.n, floor(b * 100)) GROUP BY 1, 2""")
def _(t):
    frames = t.clips.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("clip_id")) - 1).cast("bigint").alias("place"), F.round("quality", 4).alias("x"))
    words = t.clips.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("word"))
    words = words.withColumns({"start": c("word") * 0.05, "end": c("word") * 0.05 + (c("word") % 3) * 0.04})
    return intervals.pooled_by_word(frames, words, "video_id").withColumn("mean", F.round("mean", 8))


@query("stat_vector", "SELECT video_id, avg(quality) AS mean, var_pop(quality) AS var, stddev_pop(quality) AS std, quantile_cont(quality, 0.25) AS p25, quantile_cont(quality, 0.5) AS p50, quantile_cont(quality, 0.75) AS p75 FROM clips GROUP BY 1")
def _(t):
    at = lambda p: F.percentile("quality", F.lit(p))
    return t.clips.groupBy("video_id").agg(F.avg("quality").alias("mean"), F.var_pop("quality").alias("var"), F.stddev_pop("quality").alias("std"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))


def _box(shift: int):
    x, y = (c("clip_id") * 7 + shift) % 40, (c("clip_id") * 11) % 40
    return F.array(*(v.cast("double") for v in (x, y, x + 20, y + 20)))


@query("iou", """WITH b AS (SELECT clip_id, clip_id * 7 % 40 AS ax, (clip_id * 7 + 9) % 40 AS bx FROM clips), o AS (SELECT clip_id, greatest(0, 20 - abs(ax - bx)) * 20.0 AS inter FROM b) SELECT clip_id, inter::double / (800 - inter)::double AS iou FROM o""")
def _(t):
    return t.clips.select("clip_id", vectors.iou(_box(0), _box(9)).alias("iou"))


def _frames(t) -> DataFrame:
    return t.clips.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("clip_id")).alias("frame"), F.lit(0).alias("face"), _box(0).alias("box"))


_TRACKS = """f AS (SELECT video_id, row_number() over (partition by video_id order by clip_id) AS k, clip_id * 7 % 40 AS x, clip_id * 11 % 40 AS y FROM clips),
r AS (SELECT video_id, 0::bigint AS k, cast([] AS struct(id int, x bigint, y bigint, f bigint)[]) AS tracks, 0 AS nxt, -1 AS track_id FROM (SELECT DISTINCT video_id FROM f) UNION ALL
SELECT video_id, k, list_append(list_filter(tracks, lambda t: t.id <> tid and k - t.f - 1 <= 2), {'id': tid, 'x': x, 'y': y, 'f': k}), case when tid = nxt then nxt + 1 else nxt end, tid FROM (
SELECT *, case when len(s) > 0 then -(list_sort(s)[-1].neg) else nxt end AS tid FROM (SELECT r.video_id, f.k, f.x, f.y, tracks, nxt,
list_filter(list_transform(list_filter(tracks, lambda t: f.k - t.f - 1 <= 2), lambda t: {'iou': (greatest(0, 20 - abs(t.x - f.x)) * greatest(0, 20 - abs(t.y - f.y)))::double / (800 - greatest(0, 20 - abs(t.x - f.x)) * greatest(0, 20 - abs(t.y - f.y))), 'neg': -t.id}), lambda q: q.iou >= 0.25) AS s
FROM r JOIN f ON f.video_id = r.video_id AND f.k = r.k + 1)))"""


@query("track_assign", f"WITH RECURSIVE {_TRACKS} SELECT video_id, k AS frame, 0::bigint AS face, track_id FROM r WHERE k > 0")
def _(t):
    return intervals.track_faces(_frames(t), "video_id")


@query("track_count", f"WITH RECURSIVE {_TRACKS} SELECT video_id, count(DISTINCT track_id) AS n_tracks FROM r WHERE k > 0 GROUP BY 1")
def _(t):
    return intervals.track_faces(_frames(t), "video_id").groupBy("video_id").agg(F.count_distinct("track_id").alias("n_tracks"))


#: A vector's numbers as exact doubles, so that both engines add the same values.
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::double, 4)) AS v FROM embeddings)"


def _vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))


@query("cosine_template", f"WITH {_V}, d AS (SELECT vec_id, list_sum(list_transform(v[:16], lambda x, i: x * (i % 3 + 1))) AS dot, sqrt(list_sum(list_transform(v[:16], lambda x: x * x))) * sqrt(list_sum(list_transform(range(1, len(v[:16]) + 1), lambda i: (i % 3 + 1) * (i % 3 + 1)))) AS size FROM v) SELECT vec_id, round(greatest(0.0::double, dot / nullif(size, 0)), 6) AS score FROM d")
def _(t):
    template = F.array(*(F.lit(float(i % 3 + 1)) for i in range(1, 17)))
    return _vectors(t).select("vec_id", F.round(vectors.cosine(c("v"), template), 6).alias("score"))


@query("pad_truncate", f"WITH {_V} SELECT vec_id, 80 AS n, coalesce(v[vec_id % 80 + 1], 0.0) AS x FROM v")
def _(t):
    rows = _vectors(t).select("vec_id", vectors.padded(c("v"), 80).alias("p"))
    return rows.select("vec_id", F.size("p").alias("n"), F.element_at("p", (c("vec_id") % 80 + 1).cast("int")).alias("x"))


@query("resample_linear", f"WITH {_V}, p AS (SELECT vec_id, v, i, i * (len(v) - 1)::double / 49 AS x FROM v, range(0, 50) r(i)) SELECT vec_id, i AS place, round(v[floor(x)::int + 1] + (v[least(len(v), floor(x)::int + 2)] - v[floor(x)::int + 1]) * (x - floor(x)), 6) AS value FROM p")
def _(t):
    rows = _vectors(t).select("vec_id", F.posexplode(vectors.resampled(c("v"), 50)).alias("place", "value"))
    return rows.select("vec_id", "place", F.round("value", 6).alias("value"))


def _pooled(t) -> DataFrame:
    """Mean of each vector's frames in every word, a word being 8 frames."""
    frames = _vectors(t).select("vec_id", F.posexplode("v").alias("i", "x"))
    return frames.groupBy("vec_id", F.floor(c("i") / 8).alias("word")).agg(F.round(F.avg("x"), 8).alias("mean"))


_POOL = "f AS (SELECT vec_id, v, unnest(range(0, len(v))) AS i FROM v), w AS (SELECT vec_id, i // 8 AS word, round(avg(v[i + 1]), 8) AS mean FROM f GROUP BY 1, 2)"


@query("word_pool", f"WITH {_V}, {_POOL} SELECT vec_id, word, mean FROM w")
def _(t):
    return _pooled(t)


@query("align_modalities", f"WITH {_V}, {_POOL} SELECT q.vec_id, p AS place, coalesce(mean, 0.0) AS value FROM (SELECT vec_id, unnest(range(0, 12)) AS p FROM v) q LEFT JOIN w ON w.vec_id = q.vec_id AND w.word = q.p")
def _(t):
    words = _pooled(t).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mean"))), lambda x: x["mean"]).alias("v"))
    return words.select("vec_id", F.posexplode(vectors.finite(vectors.padded(c("v"), 12))).alias("place", "value"))
