"""Queries: sources, filters, joins, dashboards, export and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..conf import DEFAULT
from ..functions import scoring, text
from ..operators import dashboard, export, ranks, state
from ..sources import sinks, tables
from .catalog import query

c = F.col


def _dec(sql: str, digits: int) -> str:
    return f"cast(round(cast({sql} as decimal(20,8)), {digits}) as double)"


_LABEL = "coalesce(nullif(user_emotion, ''), nullif(emotion, ''))"


@query("scan_tables", "SELECT * FROM nation")
def _(t):
    return tables.scan(t.spark, f"{t.sf_dir}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int")


@query("point_lookup", "SELECT clip_id, video_id, emotion, start_ms FROM clips WHERE clip_id = 17")
def _(t):
    return tables.lookup(t.clips.select("clip_id", "video_id", "emotion", "start_ms"), clip_id=17)


@query("inbox_anti", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
@query("inbox_anti_all", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(t):
    return tables.unseen(t("part").select("p_partkey", "p_name"), t("lineitem").filter("l_quantity > 48").select(c("l_partkey").alias("p_partkey")), "p_partkey")


@query("url_dedupe_anti", "SELECT min(page_id) AS page_id, url FROM (SELECT page_id, concat('https://v/', page_id % 40) AS url FROM pages) WHERE url NOT IN (SELECT concat('https://v/', page_id % 40) FROM pages WHERE page_id % 7 = 0) GROUP BY url")
def _(t):
    urls = t("pages").select("page_id", F.concat(F.lit("https://v/"), (c("page_id") % 40).cast("string")).alias("url"))
    return tables.unseen(urls.groupBy("url").agg(F.min("page_id").alias("page_id")), urls.filter("page_id % 7 = 0").dropDuplicates(["url"]), "url").select("page_id", "url")


@query("frame_sample", "WITH f AS (SELECT video_id, clip_id, row_number() over (partition by video_id order by clip_id) - 1 AS place, count(*) over (partition by video_id) AS n FROM clips) SELECT video_id, clip_id FROM f WHERE place % greatest(1, n // 24) = 0 AND place // greatest(1, n // 24) < 24")
def _(t):
    return tables.sampled_frames(t.clips.select("video_id", "clip_id"), "video_id", "clip_id")


@query("cache_ttl", "SELECT clip_id, created_us FROM clips WHERE 1706500000000000 - created_us <= 604800 * 1000000::bigint")
def _(t):
    return tables.fresh(t.clips.select("clip_id", "created_us"), F.lit(1706500000000000), DEFAULT.cache_ttl_s * 1000000, "created_us")


@query("clips_list", "SELECT clip_id, clip_index, emotion FROM clips WHERE status = 'approved' AND emotion = 'happy' AND NOT has_incongruity ORDER BY clip_index, clip_id LIMIT 50 OFFSET 5")
def _(t):
    some = tables.filtered(t.clips, video_id=None, status="approved", emotion="happy", has_incongruity=False)
    return tables.page(some.select("clip_id", "clip_index", "emotion"), [c("clip_index"), c("clip_id")], 5, 50)


@query("clips_page_total", "SELECT clip_id, (SELECT count(*) FROM clips WHERE status = 'needs_review') AS total FROM clips WHERE status = 'needs_review' ORDER BY clip_id DESC LIMIT 20")
def _(t):
    some = t.clips.filter("status = 'needs_review'").select("clip_id")
    return tables.page_with_total(some, [F.desc("clip_id")], 0, 20)


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return tables.page(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), c("o_orderkey")], 50, 25)


@query("multi_sort", "SELECT clip_id, row_number() over (order by status, confidence desc, clip_id) AS place FROM clips")
@query("multi_sort_all", "SELECT clip_id, row_number() over (order by status, confidence desc, clip_id) AS place FROM clips")
def _(t):
    return ranks.ranked(t.clips.select("clip_id", "status", "confidence"), ["status", F.desc("confidence"), "clip_id"]).select("clip_id", "place")


@query("distinct_values", "SELECT DISTINCT emotion, status FROM clips")
def _(t):
    return t.clips.select("emotion", "status").distinct()


@query("topn_per_group", "SELECT video_id, clip_id FROM clips QUALIFY row_number() over (partition by video_id order by confidence desc, clip_id) <= 5")
def _(t):
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("confidence"), "clip_id"))
    return t.clips.withColumn("place", place).filter("place <= 5").select("video_id", "clip_id")


@query("videos_ilike", "SELECT video_id, title FROM videos WHERE movie_name ILIKE '%auto%'")
def _(t):
    return t.videos.filter(c("movie_name").ilike("%auto%")).select("video_id", "title")


@query("haystack_search", "SELECT clip_id FROM clips WHERE contains(lower(concat_ws(' ', transcript, emotion, status, clip_path)), 'vui') AND contains(lower(concat_ws(' ', transcript, emotion, status, clip_path)), 'mp4')")
def _(t):
    return t.clips.filter(state.contains_all([c("transcript"), c("emotion"), c("status"), c("clip_path")], ["Vui", "mp4"])).select("clip_id")


@query("to_dict_defaults", "SELECT clip_id, coalesce(user_emotion, '') AS user_emotion, coalesce(verify_verdict, 'none') AS verify_verdict, coalesce(snr, 0.0) AS snr, coalesce(decision_by, 'none') AS decision_by FROM clips")
def _(t):
    return t.clips.select("clip_id", F.coalesce("user_emotion", F.lit("")).alias("user_emotion"), F.coalesce("verify_verdict", F.lit("none")).alias("verify_verdict"), F.coalesce("snr", F.lit(0.0)).alias("snr"), F.coalesce("decision_by", F.lit("none")).alias("decision_by"))


_ROLL = "n AS (SELECT video_id, count(*) AS total, count(*) filter (status in ('approved', 'auto_approved')) AS approved, count(*) filter (status in ('pending', 'needs_review')) AS pending, count(*) filter (status = 'rejected') AS rejected FROM clips GROUP BY 1), v AS (SELECT videos.*, coalesce(total, 0) AS total, coalesce(approved, 0) AS approved, coalesce(pending, 0) AS pending, coalesce(rejected, 0) AS rejected, greatest(0, coalesce(total, 0) - coalesce(approved, 0)) AS remaining FROM videos LEFT JOIN n USING (video_id))"


@query("video_clip_rollup", f"WITH {_ROLL} SELECT video_id, total, approved, pending, rejected, remaining FROM v")
def _(t):
    return dashboard.video_rollup(t.videos, t.clips).select("video_id", "total", "approved", "pending", "rejected", "remaining")


@query("video_summary", f"WITH {_ROLL} SELECT video_id, coalesce(nullif(title, ''), nullif(movie_name, ''), concat('Video ', substr(cast(video_id as varchar), 1, 8))) AS title, remaining FROM v")
def _(t):
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("movie_name", F.lit("")), F.concat(F.lit("Video "), F.substring(c("video_id").cast("string"), 1, 8)))
    return dashboard.video_rollup(t.videos, t.clips).select("video_id", title.alias("title"), "remaining")


@query("video_tree_filter", f"WITH {_ROLL}, h AS (SELECT DISTINCT video_id FROM clips WHERE contains(transcript, 'chao ban vui')) SELECT video_id FROM v WHERE status = 'completed' AND total > 0 AND (contains(lower(coalesce(title, '')), '00001') OR video_id IN (SELECT video_id FROM h))")
def _(t):
    hits = t.clips.filter(F.contains("transcript", F.lit("chao ban vui"))).select("video_id").distinct().withColumn("hit", F.lit(True))
    rows = dashboard.video_rollup(t.videos, t.clips).join(hits, "video_id", "left")
    own = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("00001"))
    return rows.filter((c("status") == "completed") & (c("total") > 0) & (own | F.coalesce("hit", F.lit(False)))).select("video_id")


@query("export_record", f"SELECT clip_id, {_LABEL} AS final_emotion, cast(json_extract_string(props, '$.k') as int) AS k, coalesce(json_extract_string(props, '$.audio'), clip_path) AS audio_path FROM clips JOIN (SELECT event_id, props FROM events) ON event_id = clip_id")
def _(t):
    props = t("events").select(c("event_id").alias("clip_id"), "props")
    return t.clips.join(props, "clip_id").select("clip_id", text.effective_label(c("user_emotion"), c("emotion"), None).alias("final_emotion"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.audio"), "clip_path").alias("audio_path"))


@query("quality_flags", """SELECT clip_id, concat_ws(',', case when coalesce(user_emotion, '') <> '' then 'human_verified' end, case when face_coverage >= 0.5 or num_faces > 10 then 'has_face' end, case when transcript <> '' then 'has_dialogue' end,
case when has_incongruity then 'incongruity' end, case when quality >= 0.5 then 'segment_good' end) AS flags FROM clips""")
def _(t):
    flags = export.quality_flags(text.label_source(c("status"), c("user_emotion"), c("emotion")), c("face_coverage"), F.greatest(F.lit(0), c("num_faces") - 10), F.lit(0.0), c("transcript"), c("has_incongruity"), F.when(c("quality") >= 0.5, "good"))
    return t.clips.select("clip_id", F.array_join(flags, ",").alias("flags"))


@query("review_order", "SELECT clip_id, title, row_number() over (order by videos.video_id desc, start_ms, clip_id) AS place FROM clips JOIN videos USING (video_id)")
@query("review_order_all", "SELECT clip_id, title, row_number() over (order by videos.video_id desc, start_ms, clip_id) AS place FROM clips JOIN videos USING (video_id)")
def _(t):
    both = t.clips.select("clip_id", "video_id", "start_ms").join(t.videos.select("video_id", "title"), "video_id")
    return ranks.ranked(both, [F.desc("video_id"), "start_ms", "clip_id"]).select("clip_id", "title", "place")


@query("queue_join", "SELECT id, title, priority, queue.status, row_number() over (order by priority desc, created_us, id) AS place FROM queue JOIN videos USING (video_id)")
@query("queue_join_all", "SELECT id, title, priority, queue.status, row_number() over (order by priority desc, created_us, id) AS place FROM queue JOIN videos USING (video_id)")
def _(t):
    both = t.queue.join(t.videos.select("video_id", "title"), "video_id")
    return ranks.ranked(both, [F.desc("priority"), "created_us", "id"]).select("id", "title", "priority", "status", "place")


@query("aligned_semi", "SELECT clip_id FROM clips WHERE status in ('approved', 'auto_approved') AND clip_id IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def _(t):
    ready = t("embeddings").filter("label < 5").select(c("vec_id").alias("clip_id"))
    return t.clips.filter(c("status").isin(*dashboard.APPROVED)).join(ready, "clip_id", "left_semi").select("clip_id")


@query("status_counts", f"SELECT count(*) AS total, count(*) filter (status in ('approved', 'auto_approved')) AS approved, count(*) filter (status in ('pending', 'needs_review')) AS pending, count(*) filter (status = 'rejected') AS rejected, count(distinct video_id) AS videos, {_dec('count(*) filter (status in ($approved$, $auto_approved$))::double * 100 / count(*)'.replace('$', chr(39)), 1)} AS approval_rate FROM clips")
def _(t):
    return dashboard.status_counts(t.clips)


@query("status_counts_strict", f"SELECT count(*) AS total, count(*) filter (status = 'approved') AS approved, count(*) filter (status = 'pending') AS pending, count(*) filter (status = 'rejected') AS rejected, count(distinct video_id) AS videos, {_dec('count(*) filter (status = $approved$)::double * 100 / count(*)'.replace('$', chr(39)), 1)} AS approval_rate FROM clips")
def _(t):
    return dashboard.status_counts(t.clips, ("approved",), ("pending",))


@query("emotion_counts", "SELECT emotion, count(*) AS n FROM clips WHERE status in ('approved', 'auto_approved') GROUP BY 1")
def _(t):
    return dashboard.emotion_counts(t.clips)


_QUOTA = "q(emotion, target) AS (VALUES ('happy', 600), ('sad', 450), ('angry', 450), ('neutral', 450), ('surprise', 450), ('fear', 300), ('disgust', 300))"
_COUNTED = f"WITH {_QUOTA}, n AS (SELECT emotion, count(*) AS n FROM clips WHERE status in ('approved', 'auto_approved') GROUP BY 1)"


@query("quota_progress", f"{_COUNTED} SELECT q.emotion, target, coalesce(n, 0) AS n, greatest(0, target - coalesce(n, 0)) AS remaining, {_dec('coalesce(n, 0)::double * 100 / target', 2)} AS percentage FROM q LEFT JOIN n ON n.emotion = q.emotion")
def _(t):
    return dashboard.quota_progress(t.clips)


@query("quota_left_join", f"{_COUNTED} SELECT q.emotion, greatest(0, target - coalesce(n, 0)) AS remaining FROM q LEFT JOIN n ON n.emotion = q.emotion")
def _(t):
    return dashboard.quota_progress(t.clips).select("emotion", "remaining")


@query("queue_counts", "SELECT status, count(*) AS n FROM queue GROUP BY 1")
def _(t):
    return dashboard.counts_by(t.queue, "status")


@query("decision_counts", "SELECT count(*) filter (decision_by = 'auto') AS auto, count(*) filter (decision_by = 'human') AS human FROM clips")
def _(t):
    return dashboard.decision_counts(t.clips)


@query("emotion_distribution", f"WITH n AS (SELECT coalesce({_LABEL}, 'unlabeled') AS label, count(*) AS n FROM clips WHERE status <> 'rejected' GROUP BY 1) SELECT label, n, {_dec('n::double * 100 / (sum(n) over ())::double', 2)} AS percentage FROM n")
def _(t):
    return dashboard.emotion_distribution(t.clips)


_REASONS = f"""r AS (SELECT *, {_LABEL} AS label, list_filter([case when status not in ('approved', 'auto_approved') then 'not_approved' end, case when {_LABEL} is null then 'missing_label' end, case when coalesce(clip_path, '') = '' then 'missing_file' end, case when duration <= 0 then 'invalid_duration' end], lambda x: x is not null) AS reasons FROM clips)"""


@query("export_reasons", f"WITH {_REASONS}, u AS (SELECT unnest(case when len(reasons) = 0 then ['exportable'] else reasons end) AS reason FROM r) SELECT reason, count(*) AS n FROM u GROUP BY 1")
def _(t):
    return export.reason_histogram(export.export_reasons(t.clips))


@query("export_size", f"WITH {_REASONS} SELECT label, count(*) AS n, cast(count(*) * 2097152 as bigint) AS bytes FROM r WHERE len(reasons) = 0 GROUP BY 1")
def _(t):
    return export.export_reasons(t.clips).filter(F.size("reasons") == 0).groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").cast("bigint").alias("bytes"))


@query("export_metadata", "SELECT count(*) AS n, min(duration) AS min_duration, max(duration) AS max_duration, cast(sum(duration_ms) as double) / 1000 / count(*) AS avg_duration FROM clips WHERE status = 'approved'")
def _(t):
    return sinks.metadata(t.clips.filter("status = 'approved'").select("duration"))


@query("verify_summary", "SELECT count(*) AS total, count(*) filter (verify_status = 'passed') AS passed, count(*) filter (verify_status = 'rejected') AS rejected, count(*) filter (verify_verdict is null) AS errors, " + ", ".join(f"count(*) filter (verify_verdict = '{v}') AS n_{v}" for v in ("confirmed", "wrong_emotion", "unstable", "low_quality", "stats_mismatch")) + " FROM clips")
def _(t):
    return dashboard.verify_summary(t.clips)


@query("cache_stats", "SELECT count(*) AS entries, cast(sum(length(text)) as bigint) AS chars, min(conv_id * 100 + turn) AS oldest FROM conversations")
def _(t):
    return t("conversations").agg(F.count("*").alias("entries"), F.sum(F.char_length("text")).alias("chars"), F.min(c("conv_id") * 100 + c("turn")).alias("oldest"))


_COST = "cast(round((floor(duration_ms // 1000) * 7000 + 500) * 0.30 / 1000000 + 256 * 2.50 / 1000000, 6) as double)"


@query("monitor_metrics", f"SELECT {_dec('count(*) filter (verify_verdict = $confirmed$)::double / count(verify_verdict)'.replace('$', chr(39)), 4)} AS verify_agreement, {_dec('count(*) filter (coalesce(user_emotion, $$) <> $$ and user_emotion <> emotion)::double / count(*)'.replace('$', chr(39)), 4)} AS override_rate, {_dec('quantile_cont(face_coverage, 0.5)', 4)} AS median_face, {_dec(f'sum(cast({_COST} as decimal(18,6)))::double / count(*) filter (status = $approved$)'.replace('$', chr(39)), 6)} AS cost_per_approved FROM clips")
def _(t):
    return dashboard.monitor_metrics(t.clips, scoring.verify_cost(c("duration_ms") / 1000))


_BEST = "SELECT video_id, start_ds, end_ds, emotion, clip_id, intensity FROM (SELECT video_id, (start_ms + 50) // 100 AS start_ds, (end_ms + 50) // 100 AS end_ds, emotion, clip_id, confidence AS intensity FROM clips) QUALIFY row_number() over (partition by video_id, start_ds, end_ds, emotion order by intensity desc, clip_id) = 1"


@query("dedup_max_key", _BEST)
@query("dedup_max_key_all", _BEST)
def _(t):
    rows = t.clips.withColumns(export.same_span("start_ms", "end_ms")).select("video_id", "start_ds", "end_ds", "emotion", "clip_id", c("confidence").alias("intensity"))
    return export.best_of_key(rows, ["video_id", "start_ds", "end_ds", "emotion"], "intensity", "clip_id")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _gated(lines):
    """Verdicts on lineitem rows as clips; duplicates are ordered by the rows' own columns."""
    made = {"final_emotion": "case when l_partkey % 11 = 0 then '' else l_returnflag end", "clip_path": "case when l_suppkey % 13 = 0 then null else 'x.mp4' end"}
    rows = lines.withColumns({"clip_id": c("l_orderkey") * 10 + c("l_linenumber"), **{k: F.expr(v) for k, v in made.items()}, "duration": (c("l_quantity") - 2).cast("double")})
    return export.quality_gate(rows, _LINE)


def _report(rows, *columns):
    valid, bad = (rows.filter(F.size("rejection_reasons") == 0), rows.filter(F.size("rejection_reasons") > 0))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), *columns)
    return kind(valid, "valid").unionByName(kind(bad, "rejected"))


_GATE = f"""rec AS (SELECT *, l_orderkey * 10 + l_linenumber AS clip_id, case when l_partkey % 11 = 0 then '' else l_returnflag end AS final_emotion, case when l_suppkey % 13 = 0 then null else 'x.mp4' end AS clip_path, (l_quantity - 2)::double AS duration FROM lineitem),
g AS (SELECT *, concat_ws(',', case when final_emotion = '' then 'missing_label' end, case when clip_path is null then 'missing_file' end, case when duration <= 0 then 'invalid_duration' end, case when row_number() over (partition by clip_id order by {', '.join(_LINE)}) > 1 then 'duplicate_clip_id' end) AS reasons FROM rec)"""


@query("quality_gate", f"WITH {_GATE} SELECT clip_id, l_partkey, l_suppkey, reasons FROM g")
@query("quality_gate_all", f"WITH {_GATE} SELECT clip_id, l_partkey, l_suppkey, reasons FROM g")
def _(t):
    return _gated(t("lineitem")).select("clip_id", "l_partkey", "l_suppkey", F.array_join("rejection_reasons", ",").alias("reasons"))


@query("quality_report_union", f"WITH {_GATE} SELECT 'valid' AS kind, clip_id, l_partkey, l_suppkey FROM g WHERE reasons = '' UNION ALL SELECT 'rejected', clip_id, l_partkey, l_suppkey FROM g WHERE reasons <> ''")
@query("quality_report_all", f"WITH {_GATE} SELECT 'valid' AS kind, clip_id, l_partkey, l_suppkey FROM g WHERE reasons = '' UNION ALL SELECT 'rejected', clip_id, l_partkey, l_suppkey FROM g WHERE reasons <> ''")
def _(t):
    return _report(_gated(t("lineitem")), "clip_id", "l_partkey", "l_suppkey")


_HASH = "('0x' || substr(md5(cast({} as varchar)), 1, 8))::bigint"
_SPLIT = f"s AS (SELECT clip_id, emotion, status, clip_path, row_number() over (partition by emotion order by {_HASH.format('clip_id')}, clip_id) AS place, count(*) over (partition by emotion) AS n FROM clips), t AS (SELECT *, case when place <= greatest(1, n * 70 // 100) then 'train' when place <= greatest(1, n * 70 // 100) + n * 15 // 100 then 'val' else 'test' end AS split FROM s)"


@query("stratified_split", f"WITH {_SPLIT} SELECT clip_id, emotion, split FROM t")
def _(t):
    return export.stratified_split(t.clips.select("clip_id", "emotion"), "emotion", "clip_id").select("clip_id", "emotion", "split")


@query("group_split", f"WITH g AS (SELECT video_id, row_number() over (order by {_HASH.format('video_id')}, video_id) AS place, count(*) over () AS n FROM (SELECT DISTINCT video_id FROM clips)) SELECT clip_id, case when place <= n * 80 // 100 then 'train' when place <= n * 80 // 100 + n * 10 // 100 then 'valid' else 'test' end AS split FROM clips JOIN g USING (video_id)")
def _(t):
    return export.group_split(t.clips.select("clip_id", "video_id"), "video_id").select("clip_id", "split")


@query("export_paths", f"WITH {_SPLIT} SELECT clip_id, concat('clips/', split, '/', emotion, '/', clip_id, lower(regexp_extract(clip_path, '(\\.[^./]+)$', 1))) AS exported_clip_path FROM t WHERE clip_path is not null")
def _(t):
    rows = export.stratified_split(t.clips.select("clip_id", c("emotion").alias("final_emotion"), "clip_path"), "final_emotion", "clip_id")
    return export.export_paths(rows.filter("clip_path IS NOT NULL")).select("clip_id", "exported_clip_path")


@query("export_csv_projection", "SELECT clip_id, emotion, array_to_string(string_split(transcript, ' '), ';') AS words FROM clips")
def _(t):
    return sinks.flat(t.clips.select("clip_id", "emotion", F.split("transcript", " ").alias("words")), ["clip_id", "emotion", "words"])


@query("file_sync_anti", "SELECT clip_path FROM clips WHERE clip_path is not null AND clip_path NOT IN (SELECT clip_path FROM clips WHERE clip_id % 3 = 0 AND clip_path is not null)")
def _(t):
    here = t.clips.filter("clip_path IS NOT NULL").select("clip_path")
    return here.join(t.clips.filter("clip_id % 3 = 0").select("clip_path"), "clip_path", "left_anti")


_KEYS = "clip_id, confidence"


@query("segment_upsert", "WITH src AS (SELECT clip_id + 5 AS clip_id, 0.5::double AS confidence FROM clips WHERE clip_id % 4 = 0) SELECT coalesce(c.clip_id, s.clip_id) AS clip_id, coalesce(s.confidence, c.confidence) AS confidence, case when c.clip_id is null then 'added' when s.clip_id is not null then 'updated' else 'kept' end AS change FROM clips c FULL JOIN src s ON s.clip_id = c.clip_id")
def _(t):
    source = t.clips.filter("clip_id % 4 = 0").select((c("clip_id") + 5).alias("clip_id"), F.lit(0.5).alias("confidence"))
    return state.upsert(t.clips.select("clip_id", "confidence"), source, ["clip_id"], ["confidence"])


_LWW = """WITH src AS (SELECT clip_id + 3 AS clip_id, case when clip_id % 7 = 0 then null else 'new' end AS notes, case when clip_id % 5 = 0 then null else created_us + (clip_id % 3 - 1) * 60000000 end AS updated FROM clips WHERE clip_id % 2 = 0), dst AS (SELECT clip_id, 'old' AS notes, case when clip_id % 11 = 0 then null else created_us end AS updated FROM clips),
m AS (SELECT coalesce(d.clip_id, s.clip_id) AS clip_id, case when d.clip_id is null then s.notes when coalesce(s.updated > d.updated, false) then coalesce(s.notes, d.notes) else d.notes end AS notes, case when d.clip_id is null then 'inserted' when coalesce(s.updated > d.updated, false) then 'updated' else 'kept' end AS change FROM dst d FULL JOIN src s ON s.clip_id = d.clip_id)"""


def _synced(t):
    src = t.clips.filter("clip_id % 2 = 0").selectExpr("clip_id + 3 as clip_id", "case when clip_id % 7 = 0 then null else 'new' end as notes", "case when clip_id % 5 = 0 then null else created_us + (clip_id % 3 - 1) * 60000000 end as updated")
    dst = t.clips.selectExpr("clip_id", "'old' as notes", "case when clip_id % 11 = 0 then null else created_us end as updated")
    return state.last_writer_wins(dst, src, "clip_id", "updated")


@query("sync_lww", _LWW + " SELECT clip_id, notes, change FROM m")
def _(t):
    return _synced(t).select("clip_id", "notes", "change")


@query("sync_report", _LWW + " SELECT change, count(*) AS n FROM m GROUP BY 1")
def _(t):
    return dashboard.counts_by(_synced(t), "change")


@query("last_sync", "SELECT video_id, clip_id, status FROM clips QUALIFY row_number() over (partition by video_id order by created_us desc, clip_id desc) = 1")
def _(t):
    return state.latest(t.clips.select("video_id", "clip_id", "status", "created_us"), "video_id", ["created_us", "clip_id"]).select("video_id", "clip_id", "status")


@query("apply_review", "SELECT clip_id, case when clip_id % 9 = 0 then 'approved' else status end AS status, case when clip_id % 9 = 0 then 'sad' else user_emotion end AS user_emotion, case when clip_id % 9 = 0 then 'human' else decision_by end AS decision_by FROM clips")
def _(t):
    reviews = t.clips.filter("clip_id % 9 = 0").select("clip_id", F.lit("approved").alias("status"), F.lit("sad").alias("user_emotion"))
    return state.apply_reviews(t.clips.select("clip_id", "status", "user_emotion", "decision_by"), reviews)


@query("cascade_delete", "WITH gone AS (SELECT video_id FROM videos WHERE video_id % 10 = 3) SELECT (SELECT count(*) FROM videos WHERE video_id NOT IN (SELECT video_id FROM gone)) AS videos, (SELECT count(*) FROM clips WHERE video_id NOT IN (SELECT video_id FROM gone)) AS clips, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT clip_id FROM clips WHERE video_id IN (SELECT video_id FROM gone))) AS labels")
def _(t):
    gone = t.videos.filter("video_id % 10 = 3").select("video_id")
    labels = t("embeddings").select(c("vec_id").alias("clip_id"))
    left = state.cascade_delete(gone, t.videos.select("video_id"), (t.clips.select("clip_id", "video_id"), "clip_id"), (labels, "clip_id"))
    counts = [df.agg(F.count("*").alias(n)) for df, n in zip(left, ("videos", "clips", "labels"), strict=True)]
    return counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True))


@query("cleanup_errors", "SELECT clip_id FROM clips WHERE video_id NOT IN (SELECT video_id FROM videos WHERE status = 'error')")
def _(t):
    bad = t.videos.filter("status = 'error'").select("video_id")
    return state.cascade_delete(bad, t.videos, (t.clips.select("clip_id", "video_id"), "clip_id"))[1].select("clip_id")


@query("enqueue_if_absent", "SELECT video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM queue WHERE status in ('queued', 'running'))")
def _(t):
    return state.enqueue_if_absent(t.queue, t.videos.select("video_id"), "video_id")


@query("schema_evolve", "SELECT clip_id, emotion, cast(null as double) AS verify_score, 'x' AS kept FROM clips")
def _(t):
    return state.evolve(t.clips.select("clip_id", "emotion", F.lit("x").alias("kept")), {"emotion": "string", "verify_score": "double"})


@query("queue_claim", "SELECT id, priority FROM queue WHERE status = 'queued' ORDER BY priority DESC, id LIMIT 1")
def _(t):
    return state.claim_next(t.queue, [F.desc("priority"), c("id")]).select("id", "priority")


@query("queue_claim_per_video", "SELECT video_id, id FROM queue WHERE status = 'queued' QUALIFY row_number() over (partition by video_id order by priority desc, id) = 1")
def _(t):
    return state.claim_next(t.queue, [F.desc("priority"), c("id")], "video_id").select("video_id", "id")


_EVENT = "case id % 6 when 0 then 'start' when 1 then 'finish' when 2 then 'pause' when 3 then 'skip' when 4 then 'fail' else 'resume' end"


@query("queue_transition", f"SELECT id, case when status = 'queued' and e = 'start' then 'running' when status = 'running' and e = 'finish' then 'done' when status = 'running' and e = 'fail' then 'error' when status = 'running' and e = 'skip' then 'queued' when status = 'queued' and e = 'pause' then 'paused' when status = 'paused' and e = 'resume' then 'queued' else status end AS status FROM (SELECT *, {_EVENT} AS e FROM queue)")
def _(t):
    return t.queue.select("id", state.transition(c("status"), F.expr(_EVENT)).alias("status"))


@query("stale_workers", "SELECT video_id, max(created_us) AS last_seen, max(created_us) < 1706659200000000 - 300000000::bigint AS is_stale FROM clips GROUP BY 1")
def _(t):
    return state.stale(t.clips, "video_id", "created_us", F.lit(1706659200000000), DEFAULT.worker_idle_s * 1000000)


@query("model_health", "SELECT emotion AS model, count(*) filter (status = 'rejected') AS failed, count(*) AS calls, case when count(*) filter (status = 'rejected') * 2 > count(*) then 'degraded' else 'healthy' end AS health FROM clips GROUP BY 1")
def _(t):
    n = t.clips.groupBy(c("emotion").alias("model")).agg(F.count_if(c("status") == "rejected").alias("failed"), F.count("*").alias("calls"))
    return n.withColumn("health", F.when(c("failed") * 2 > c("calls"), "degraded").otherwise("healthy"))


@query("approval_progress", f"SELECT count(*) filter (status = 'approved') AS approved, {_dec("count(*) filter (status = 'approved')::double * 100 / 3000", 2)} AS approval_progress FROM clips")
def _(t):
    return dashboard.approval_progress(t.clips)


@query("has_idle_worker", "SELECT count(*) AS worker_count, bool_or(w is null) AS has_idle_worker FROM (SELECT case when id % 50 = 0 then null else video_id end AS w FROM queue WHERE status = 'running')")
def _(t):
    return dashboard.has_idle_worker(t.queue.filter("status = 'running'").select(F.expr("case when id % 50 = 0 then null else video_id end").alias("processing_video_id")))


@query("verdict_map", "SELECT n.*, k AS verdict, m AS verdict_count FROM (SELECT count(*) AS total, count(*) filter (verify_status = 'passed') AS passed, count(*) filter (verify_status = 'rejected') AS rejected FROM clips) n, (SELECT verify_verdict AS k, count(*) AS m FROM clips WHERE verify_verdict IS NOT NULL GROUP BY 1)")
def _(t):
    return dashboard.verdict_map(t.clips).select("total", "passed", "rejected", F.explode("by_verdict").alias("verdict", "verdict_count"))


@query("drift_log", f"SELECT created_us // 86400000000 AS day, count(*) filter (coalesce(user_emotion, '') <> '') AS decided, count(*) filter (coalesce(user_emotion, '') <> '' and user_emotion <> emotion) AS overridden, case when count(*) filter (coalesce(user_emotion, '') <> '') > 0 then {_dec("count(*) filter (coalesce(user_emotion, '') <> '' and user_emotion <> emotion)::double / count(*) filter (coalesce(user_emotion, '') <> '')", 4)} else 0.0::double end AS share FROM clips GROUP BY 1")
def _(t):
    return dashboard.drift(t.clips, F.floor(c("created_us") / 86400000000))


_FULL = "case when clip_id % 3 = 0 then null else '{{\"segment\": {{\"face_coverage\": 0.5, \"quality_hint\": \"good\"}}, \"face_extraction\": {{\"track_count\": 2, \"detections_path\": \"/d.json\"}}, \"audio_features\": {{\"audio_path\": \"/a.WAV\", \"has_speech_energy\": true}}}}' end".replace("{{", "{").replace("}}", "}")


def _records(t):
    return export.records(t.clips.withColumns({"per_model": F.expr(_FULL), "all_scores": F.lit(None).cast("string"), "notes": F.lit(None).cast("string")}))


_SOURCE = "case when coalesce(user_emotion, '') <> '' and user_emotion = emotion then 'human_verified' when coalesce(user_emotion, '') <> '' then 'human_corrected' when status = 'auto_approved' then 'ai_auto' else 'ai_suggested' end"
_ON = "case when clip_id % 3 > 0 then {0} else {1} end".format
#: What a record says, by its column.
_RECORD = {
    "clip_id": "clip_id", "video_id": "video_id", "clip_index": "clip_index", "clip_path": "coalesce(clip_path, '')", "file_name": "coalesce(split_part(clip_path, '/', -1), '')",
    "start_time": "start_ms::double / 1000", "end_time": "end_ms::double / 1000", "duration": "duration", "ai_emotion": "emotion", "ai_confidence": "confidence", "user_emotion": "user_emotion", "final_emotion": _LABEL, "label": _LABEL,
    "label_source": _SOURCE, "quality_score": "quality", "transcript": "transcript", "status": "status", "has_incongruity": "has_incongruity", "reviewer_notes": "''", "all_scores": "'{}'",
    "per_model_scores": f"coalesce({_FULL}, '{{}}')".replace("{{}}", "{}"), "face_coverage": _ON("0.5::double", "null"), "speech_coverage": "null::double", "num_faces_avg": "null::double", "segment_source": "null::varchar",
    "segment_quality_hint": _ON("'good'", "null"), "cut_reason": "null::varchar", "face_detections_path": _ON("'/d.json'", "''"), "track_count": _ON("2", "0"), "face_detector": "''", "audio_path": _ON("'/a.WAV'", "''"),
    "audio_clarity": "null::double", "has_speech_energy": _ON("true", "null"),
}


@query("export_record_full", f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in _RECORD.items())} FROM clips")
def _(t):
    return _records(t)


_EXPORTED = {
    "split": "split", "exported_clip_path": "concat('clips/', split, '/', final_emotion, '/', clip_id, lower(regexp_extract(clip_path, '(\\.[^./]+)$', 1)))",
    "exported_audio_path": "case when audio_path <> '' then concat('audio/', split, '/', final_emotion, '/', clip_id, '.wav') end", "exported_face_detections_path": "case when face_detections_path <> '' then concat('annotations/face_detections/', clip_id, '.json') end",
    "quality_flags": "concat_ws(';', case when label_source like 'human%' then 'human_verified' end, case when face_coverage >= 0.5 or track_count > 0 then 'has_face' end, case when transcript <> '' then 'has_dialogue' end, case when has_incongruity then 'incongruity' end, case when segment_quality_hint <> '' then concat('segment_', segment_quality_hint) end)",
    "rejection_reasons": "concat_ws(';', case when clip_path = '' then 'missing_file' end)",
}
_SPLIT_RECORDS = f"""m AS (SELECT {', '.join(f'{sql} AS {name}' for name, sql in _RECORD.items())} FROM clips),
p AS (SELECT *, row_number() over (partition by final_emotion order by {_HASH.format('clip_id')}, clip_id) AS place, count(*) over (partition by final_emotion) AS n FROM m),
x AS (SELECT *, case when place <= greatest(1, n * 70 // 100) then 'train' when place <= greatest(1, n * 70 // 100) + n * 15 // 100 then 'val' else 'test' end AS split FROM p)"""


def _split_records(t):
    """Records with split, paths, flags and reasons: rows of labels.csv."""
    rows = export.export_paths(export.stratified_split(_records(t), "final_emotion", "clip_id"))
    flags = export.quality_flags(c("label_source"), c("face_coverage"), c("track_count"), c("speech_coverage"), c("transcript"), c("has_incongruity"), c("segment_quality_hint"))
    return export.quality_gate(rows.withColumn("quality_flags", flags), ["video_id"])


@query("labels_table", f"WITH {_SPLIT_RECORDS} SELECT {', '.join(f'{_EXPORTED[name]} AS {name}' if name in _EXPORTED else name for name in export.LABEL_COLUMNS)} FROM x")
def _(t):
    return sinks.flat(export.labels(_split_records(t)), list(export.LABEL_COLUMNS))


@query("export_paths_all", f"WITH {_SPLIT_RECORDS} SELECT clip_id, {', '.join(f'{_EXPORTED[name]} AS {name}' for name in ('exported_clip_path', 'exported_audio_path', 'exported_face_detections_path'))} FROM x")
def _(t):
    return _split_records(t).select("clip_id", "exported_clip_path", "exported_audio_path", "exported_face_detections_path")


@query("export_counts", f"WITH m AS (SELECT {_LABEL} AS label, {_SOURCE} AS source FROM clips) SELECT 'label' AS kind, label AS value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'label_source', source, count(*) FROM m GROUP BY ALL")
def _(t):
    return dashboard.counted(_records(t), label="final_emotion", label_source="label_source")


@query("plain_split", f"WITH s AS (SELECT clip_id, row_number() over (order by {_HASH.format('clip_id')}, clip_id) AS place, count(*) over () AS n FROM clips) SELECT clip_id, case when place <= greatest(1, n * 70 // 100) then 'train' when place <= greatest(1, n * 70 // 100) + n * 15 // 100 then 'val' else 'test' end AS split FROM s")
def _(t):
    return export.plain_split(t.clips.select("clip_id"), "clip_id")


_NOW = 1706659200000000
_REVIEWED = f"""r AS (SELECT clip_id, video_id, case when clip_id % 9 = 0 then case when clip_id % 2 = 0 then 'approved' else 'rejected' end else status end AS status, case when clip_id % 9 = 0 then 'sad' else user_emotion end AS user_emotion, case when clip_id % 9 = 0 then -1.0::double end AS sentiment,
case when clip_id % 9 = 0 then case when clip_id % 2 = 0 then null else 'seen' end else 'old' end AS notes, case when clip_id % 9 = 0 and clip_id % 2 = 1 then 'blurred' end AS reject_reason, case when clip_id % 9 = 0 then 'human' else decision_by end AS decision_by, case when clip_id % 9 = 0 then {_NOW} end AS reviewed_at, case when clip_id % 9 = 0 then {_NOW} else created_us end AS updated_at FROM clips)"""


def _reviewed(t):
    clips = t.clips.select("clip_id", "video_id", "status", "user_emotion", F.lit(None).cast("double").alias("sentiment"), F.lit("old").alias("notes"), F.lit(None).cast("string").alias("reject_reason"), "decision_by", F.lit(None).cast("bigint").alias("reviewed_at"), c("created_us").alias("updated_at"))
    even = c("clip_id") % 2 == 0
    reviews = t.clips.filter("clip_id % 9 = 0").select("clip_id", F.when(even, "approved").otherwise("rejected").alias("status"), F.lit("sad").alias("user_emotion"), F.lit(-1.0).alias("sentiment"), F.when(~even, "seen").alias("notes"), F.when(~even, "blurred").alias("reject_reason"))
    return state.reviewed(clips, reviews, F.lit(_NOW))


@query("review_update", f"WITH {_REVIEWED} SELECT * FROM r")
def _(t):
    return _reviewed(t)


@query("review_recount", f"WITH {_REVIEWED} SELECT video_id, count(clip_id) AS total_clips, count(*) filter (r.status = 'approved') AS approved_clips FROM videos LEFT JOIN r USING (video_id) GROUP BY 1")
def _(t):
    return state.recounted(t.videos.select("video_id"), _reviewed(t))


@query("delete_recount", "SELECT video_id, count(clip_id) AS total_clips, count(*) filter (c.status = 'approved') AS approved_clips FROM videos LEFT JOIN (SELECT * FROM clips WHERE clip_id % 7 <> 0) c USING (video_id) GROUP BY 1")
def _(t):
    return state.deleted(t.clips.select("clip_id", "video_id", "status"), t.clips.filter("clip_id % 7 = 0").select("clip_id"), t.videos.select("video_id"))[1]


@query("clip_patch", f"SELECT clip_id, case when clip_id % 4 = 0 then 'approved' else status end AS status, case when clip_id % 4 = 0 and clip_id % 8 = 0 then null else user_emotion end AS user_emotion, emotion, case when clip_id % 4 = 0 then {_NOW} else created_us end AS updated_at FROM clips")
def _(t):
    data = F.when(c("clip_id") % 8 == 0, F.expr("map('status', 'approved', 'emotion', 'hacked', 'user_emotion', cast(null as string))")).otherwise(F.expr("map('status', 'approved', 'clip_id', '0')"))
    patches = t.clips.filter("clip_id % 4 = 0").select("clip_id", data.alias("data"))
    return state.patched(t.clips.select("clip_id", "status", "user_emotion", "emotion", c("created_us").alias("updated_at")), patches, F.lit(_NOW))


@query("sync_labels", _LWW + ", l AS (SELECT clip_id + 3 AS clip_id, 'fresh' AS label FROM clips WHERE clip_id % 2 = 0 AND clip_id % 7 <> 0) SELECT clip_id, notes, case when change = 'inserted' then label when l.clip_id is not null then label else 'stale' end AS label, change FROM m LEFT JOIN l USING (clip_id)")
def _(t):
    src = t.clips.filter("clip_id % 2 = 0").selectExpr("clip_id + 3 as clip_id", "case when clip_id % 7 = 0 then null else 'new' end as notes", "case when clip_id % 7 = 0 then null else 'fresh' end as label", "case when clip_id % 5 = 0 then null else created_us + (clip_id % 3 - 1) * 60000000 end as updated")
    dst = t.clips.selectExpr("clip_id", "'old' as notes", "'stale' as label", "case when clip_id % 11 = 0 then null else created_us end as updated")
    return state.last_writer_wins(dst, src, "clip_id", "updated", ("label",)).select("clip_id", "notes", "label", "change")


@query("segment_upsert_span", """WITH d AS (SELECT video_id, (start_ms + 50) // 100 AS start_ds, (end_ms + 50) // 100 AS end_ds, max(confidence) AS confidence FROM clips GROUP BY 1, 2, 3), s AS (SELECT video_id, (start_ms + 40 * (clip_id % 3) + 50) // 100 AS start_ds, (end_ms + 50) // 100 AS end_ds, max(0.25::double) AS confidence FROM clips WHERE clip_id % 4 = 0 GROUP BY 1, 2, 3)
SELECT video_id, start_ds, end_ds, coalesce(s.confidence, d.confidence) AS confidence, case when d.video_id is null then 'added' when s.video_id is not null then 'updated' else 'kept' end AS change FROM d FULL JOIN s USING (video_id, start_ds, end_ds)""")
def _(t):
    key = ["video_id", "start_ds", "end_ds"]
    best = lambda df: df.withColumns(export.same_span("start_ms", "end_ms")).groupBy(*key).agg(F.max("confidence").alias("confidence"))
    new = t.clips.filter("clip_id % 4 = 0").withColumns({"start_ms": c("start_ms") + 40 * (c("clip_id") % 3), "confidence": F.lit(0.25)})
    return state.upsert(best(t.clips), best(new), key, ["confidence"])


@query("queue_moves", f"""WITH m AS (SELECT id, status, {_EVENT} AS e FROM queue), n AS (SELECT *, case when status = 'queued' and e = 'start' then 'running' when status = 'running' and e = 'finish' then 'done' when status = 'running' and e = 'fail' then 'error' when status = 'running' and e = 'skip' then 'queued' when status = 'queued' and e = 'pause' then 'paused' else status end AS s FROM m)
SELECT id, s AS status, case when s = 'running' and status <> 'running' then {_NOW} when s = 'queued' and status <> 'queued' then null else case when status = 'queued' then null else 1 end end AS started_at FROM n""")
def _(t):
    rows = t.queue.select("id", "status", F.when(c("status") != "queued", F.lit(1).cast("bigint")).alias("started_at"))
    return state.moved(rows, F.expr(_EVENT), F.lit(_NOW))


@query("cache_lookup", "WITH r AS (SELECT clip_id, video_id % 50 AS k FROM clips), s AS (SELECT video_id % 50 AS k, clip_id AS payload, created_us AS us FROM clips WHERE video_id % 3 = 0 AND 1706500000000000 - created_us <= 604800000000) SELECT clip_id, k, payload FROM r LEFT JOIN (SELECT k, arg_max(payload, us * 1000 + payload % 1000) AS payload FROM s GROUP BY 1) USING (k)")
def _(t):
    cache = t.clips.filter("video_id % 3 = 0").select((c("video_id") % 50).alias("k"), c("clip_id").alias("payload"), c("created_us"), (c("created_us") * 1000 + c("clip_id") % 1000).alias("cached_at"))
    fresh = tables.fresh(cache, F.lit(1706500000000000), DEFAULT.cache_ttl_s * 1000000, "created_us").drop("created_us")
    return tables.cached(t.clips.select("clip_id", (c("video_id") % 50).alias("k")), fresh, "k", F.lit(0), 0).select("clip_id", "k", "payload")
