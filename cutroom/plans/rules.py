"""Queries: scores, decisions, verdicts, text and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..conf import EMOTIONS
from ..functions import json_parse, scoring, text, vectors
from ..operators import dashboard, ranks
from .catalog import query

c = F.col


def _dec(sql: str, digits: int) -> str:
    return f"cast(round(cast({sql} as decimal(20,8)), {digits}) as double)"


_CLAMP = "least(1.0::double, greatest(0.0::double, coalesce({}, 0.0)))".format
_AGREE = "coalesce(case when len(string_split(agreement, '/')) = 2 then try_cast(string_split(agreement, '/')[1] as int)::double / nullif(try_cast(string_split(agreement, '/')[2] as int), 0) end, 0.0)"


@query("agreement_parse", f"SELECT clip_id, {_AGREE} AS share FROM clips")
def _(t):
    return t.clips.select("clip_id", scoring.agreement(c("agreement")).alias("share"))


@query("quality_score", f"""WITH s AS (SELECT clip_id, {_CLAMP('confidence')} c, {_CLAMP(_AGREE)} a, {_CLAMP('num_faces::double / greatest(1, num_frames)')} f, {_CLAMP('clarity * 18.0::double')} v FROM clips),
q AS (SELECT *, {_CLAMP('c * 0.42::double + a * 0.28::double + f * 0.2::double + v * 0.1::double')} q FROM s)
SELECT clip_id, {_dec('q', 6)} AS score, case when q >= 0.8 and c >= 0.72 and a >= 0.67 and f >= 0.2 then 'auto_approved' when q >= 0.42 and c >= 0.38 then 'needs_review' else 'failed' end AS status FROM q""")
def _(t):
    score, status = scoring.quality_score(c("confidence"), c("agreement"), c("num_frames"), c("num_faces"), c("clarity"))
    return t.clips.select("clip_id", scoring.rounded(score, 6).alias("score"), status.alias("status"))


@query("snr_proxy", "SELECT clip_id, coalesce(snr, least(30.0::double, greatest(0.0::double, clarity * 30.0::double))) AS snr FROM clips")
def _(t):
    return t.clips.select("clip_id", scoring.snr_proxy(c("snr"), c("clarity")).alias("snr"))


@query("auto_decision", """WITH m AS (SELECT *, coalesce(snr, 20.0) s, coalesce(frontal_ratio, 1.0) fr, coalesce(face_quality, quality) fq FROM clips),
r AS (SELECT *, concat_ws(', ', case when num_faces = 0 then 'no_face' end, case when n_words < 2 then 'transcript_too_short' end, case when duration < 2 then 'duration_too_short' end, case when s < 5 then 'snr_too_low' end,
case when fr < 0.3 then 'head_pose_bad' end, case when fq < 0.2 then 'face_quality_too_low' end, case when coalesce(user_emotion, 'unknown') in ('', 'unknown') then 'unknown_emotion' end) reasons FROM m)
SELECT clip_id, case when reasons <> '' then 'rejected' when quality >= 0.8 and confidence >= 0.7 and coalesce(agreement, '') in ('3/3', '2/3', '3/4', '4/4') and not has_incongruity and n_words >= 3
and duration between 3 and 15 and s >= 15 and fr >= 0.8 and fq >= 0.6 then 'approved' else 'needs_review' end AS status, reasons FROM r""")
def _(t):
    status, reasons = scoring.auto_decision(*(c(x) for x in ("num_faces", "n_words", "duration", "snr", "frontal_ratio", "face_quality", "quality", "user_emotion", "confidence", "agreement", "has_incongruity")))
    return t.clips.select("clip_id", status.alias("status"), reasons.alias("reasons"))


_HARD = f"""h AS (SELECT *, concat_ws(',', case when duration < 3 then 'duration_too_short' end, case when duration > 12 then 'duration_too_long' end, case when confidence < 0.8 then 'intensity_low' end,
case when face_coverage < 0.7 then 'face_coverage_low' end, case when frontal_ratio > 0 and frontal_ratio < 0.75 then 'frontal_ratio_low' end, case when people_count > 1 then 'too_many_people' end,
case when lower(speech_quality) = 'none' then 'no_speech' end, case when n_words < 3 and event_even then 'transcript_too_short' end) codes FROM (SELECT *, clip_id % 2 = 0 AS event_even FROM clips))"""
_HARD_Q = _dec("least(1.0::double, least(1.0::double, face_coverage / 0.7::double) * 0.4::double + least(1.0::double, confidence / 0.8::double) * 0.3::double + least(1.0::double, coalesce(frontal_ratio, 0.0) / 0.75::double) * 0.3::double)", 3)


def _hard(t):
    codes, texts, quality = scoring.hard_filter(c("duration"), c("confidence"), c("face_coverage"), c("frontal_ratio"), c("people_count"), c("speech_quality"), c("n_words"), c("clip_id") % 2 == 0)
    return t.clips.select("clip_id", codes.alias("codes"), texts.alias("reasons"), quality.alias("filter_quality"))


@query("hard_filter", f"""WITH {_HARD} SELECT clip_id, codes, concat_ws(',', case when duration < 3 then printf('duration_too_short(%.1fs<3.0s)', duration) end, case when duration > 12 then printf('duration_too_long(%.1fs>12.0s)', duration) end,
case when confidence < 0.8 then printf('intensity_low(%.2f<0.80)', confidence) end, case when face_coverage < 0.7 then printf('face_coverage_low(%.2f<0.70)', face_coverage) end,
case when frontal_ratio > 0 and frontal_ratio < 0.75 then printf('frontal_ratio_low(%.2f<0.75)', frontal_ratio) end, case when people_count > 1 then printf('too_many_people(%d>1)', people_count) end,
case when lower(speech_quality) = 'none' then 'no_speech' end, case when n_words < 3 and event_even then printf('transcript_too_short(%d<3)', n_words) end) AS reasons,
case when codes = '' then {_HARD_Q} end AS filter_quality FROM h""")
def _(t):
    return _hard(t)


@query("yield_rate", f"WITH {_HARD} SELECT count(*) AS total, count(*) filter (codes = '') AS passed, {_dec('count(*) filter (codes = $$$$)::double / count(*)', 6)} AS rate FROM h".replace("$$$$", "''"))
def _(t):
    n = _hard(t).agg(F.count("*").alias("total"), F.count_if(c("codes") == "").alias("passed"))
    return n.select("*", scoring.rounded(c("passed") / c("total"), 6).alias("rate"))


def _combined(lock: bool) -> str:
    flip = "coalesce(emotion <> seen and 1.0::double - abs(confidence - verify_intensity) > 0.3, false)" if lock else "false"
    return f"""WITH v AS (SELECT *, coalesce(nullif(verify_emotion, ''), emotion) seen FROM clips), l AS (SELECT *, {flip} locked, coalesce(verify_verdict in ('unstable', 'low_quality'), false) bad FROM v)
SELECT clip_id, case when verify_verdict in ('confirmed', 'wrong_emotion') then seen else emotion end AS emotion,
case verify_verdict when 'confirmed' then {_dec('least(1.0::double, greatest(confidence, verify_intensity) * 1.05::double)', 3)} when 'wrong_emotion' then {_dec('least(1.0::double, verify_intensity * 0.7::double)', 3)}
when 'stats_mismatch' then {_dec('(confidence + verify_intensity) / 2', 3)} else confidence end AS intensity,
case when bad or locked then 'rejected' else 'passed' end AS verify_status, bad or locked AS rejected_by_verify,
case when locked then 'emotion_flip_detected' when verify_verdict = 'unstable' then 'emotion_unstable' when verify_verdict = 'low_quality' then 'low_quality_detected' end AS reject_reason FROM l"""


def _verdicts(t, conf):
    got = scoring.combine_verdicts(c("emotion"), c("confidence"), c("verify_verdict"), c("verify_emotion"), c("verify_intensity"), conf)
    return t.clips.select("clip_id", *(v.alias(k) for k, v in got.items()))


@query("combine_verdicts", _combined(False))
def _(t):
    return _verdicts(t, None)


@query("emotion_lock", _combined(True))
def _(t):
    return _verdicts(t, scoring.DEFAULT)


_NEAR = "least(1.0::double, greatest(0.0::double, 1.0::double - (0.85::double - {0}) / 0.85::double))".format
_SURE = _dec(f"least(1.0::double, {_NEAR('confidence')} * 0.3::double + {_NEAR('quality')} * 0.2::double + case when verify_verdict = 'confirmed' then 0.4::double else 0.0::double end + case when has_incongruity then 0.0::double else 0.1::double end)", 4)
_ROUTE = f"""r AS (SELECT *, rejected_by_verify or coalesce(verify_verdict = 'wrong_emotion', false) wrong, confidence < 0.4 low, {_SURE} AS sure,
coalesce(verify_status = 'passed' and verify_verdict = 'confirmed' and confidence >= 0.85 and quality >= 0.85 and not has_incongruity, false) fine FROM clips),
b AS (SELECT *, case when wrong or low then 'auto_reject_candidates' when fine then 'auto_approve_candidates' else 'needs_human_review' end bucket, case when wrong then 0.95::double when low then 0.8::double when fine then sure else 0.5::double end bucket_confidence FROM r)"""


def _routed(t):
    got = scoring.review_route(*(c(x) for x in ("confidence", "quality", "verify_verdict", "verify_status", "rejected_by_verify", "has_incongruity")))
    return t.clips.select("*", *(v.alias(k) for k, v in got.items()))


@query("review_route", f"""WITH {_ROUTE} SELECT clip_id, bucket, bucket_confidence, case when wrong then concat('verify_verdict=', coalesce(nullif(verify_verdict, ''), 'rejected_by_verify=True'))
when low then concat('ai_confidence=', printf('%.2f', confidence), ' < 0.40') when fine then concat('verify=confirmed,ai_confidence=', printf('%.2f', confidence), ',quality_score=', printf('%.2f', quality), ',no_incongruity')
when (has_incongruity and verify_status <> 'rejected') or verify_status = 'not_run' then concat_ws(',', case when has_incongruity and verify_status <> 'rejected' then 'has_incongruity=True' end, case when verify_status = 'not_run' then 'verify_not_yet_run' end)
else 'default_to_human_review' end AS reasons FROM b""")
def _(t):
    return _routed(t).select("clip_id", "bucket", "bucket_confidence", F.array_join("reasons", ",").alias("reasons"))


@query("bucket_summary", f"""WITH {_ROUTE} SELECT count(*) AS total, count(*) filter (bucket like 'auto_app%') AS n_approve, count(*) filter (bucket like 'auto_rej%') AS n_reject, count(*) filter (bucket like 'needs%') AS n_review,
{_dec("count(*) filter (bucket like 'auto_app%')::double / count(*)", 4)} AS approve_ratio, {_dec("count(*) filter (bucket like 'auto_rej%')::double / count(*)", 4)} AS reject_ratio, {_dec("count(*) filter (bucket like 'needs%')::double / count(*)", 4)} AS review_ratio FROM b""")
def _(t):
    return dashboard.bucket_summary(_routed(t))


@query("bucket_order", f"WITH {_ROUTE} SELECT clip_id, bucket, row_number() over (partition by bucket order by bucket_confidence desc, created_us desc, start_ms, clip_id) AS place FROM b")
def _(t):
    order = [F.desc("bucket_confidence"), F.desc("created_us"), "start_ms", "clip_id"]
    return ranks.ranked_within(_routed(t).select("clip_id", "bucket", "bucket_confidence", "created_us", "start_ms"), "bucket", order).select("clip_id", "bucket", "place")


@query("approve_confidence", f"SELECT clip_id, {_SURE} AS approve_confidence FROM clips")
def _(t):
    return t.clips.select("clip_id", scoring.approve_confidence(c("confidence"), c("quality"), c("verify_verdict"), c("has_incongruity")).alias("approve_confidence"))


_USD = "cast(round(cast({0} as decimal(20,0)) * 0.30 / 1000000 + cast({1} as decimal(20,0)) * 2.50 / 1000000, 6) as double)".format


@query("cost_scan", f"SELECT clip_id, {_USD('floor(duration) * 7000', '1024')} AS usd FROM clips")
def _(t):
    return t.clips.select("clip_id", scoring.scan_cost(c("duration")).alias("usd"))


@query("cost_total", f"""WITH v AS (SELECT video_id, count(*) n, sum(duration_ms) // 1000 AS secs, sum(cast({_USD('floor(duration) * 7000 + 500', '256')} as decimal(18,6))) verify FROM clips GROUP BY 1)
SELECT video_id, n, {_USD('secs * 7000', '1024')} AS scan_usd, cast(verify as double) AS verify_usd, cast(cast({_USD('secs * 7000', '1024')} as decimal(18,6)) + verify as double) AS total_usd FROM v""")
def _(t):
    n = t.clips.groupBy("video_id").agg(F.count("*").alias("n"), F.floor(F.sum("duration_ms") / 1000).alias("secs"), F.sum(scoring.verify_cost(c("duration")).cast("decimal(18,6)")).alias("verify"))
    scan = scoring.scan_cost(c("secs"))
    return n.select("video_id", "n", scan.alias("scan_usd"), c("verify").cast("double").alias("verify_usd"), (scan.cast("decimal(18,6)") + c("verify")).cast("double").alias("total_usd"))


@query("cost_frames", f"SELECT clip_id, {_USD('num_frames * 7000', 'least(4096, num_frames * 200)')} AS usd FROM clips")
def _(t):
    return t.clips.select("clip_id", scoring.frame_cost(c("num_frames")).alias("usd"))


@query("batch_totals", f"SELECT video_id % 10 AS batch, count(*) AS segments, cast(sum(cast({_USD('floor(duration) * 7000', '1024')} as decimal(18,6))) as double) AS usd, count(*) filter (clip_path is null) AS errors FROM clips GROUP BY 1")
def _(t):
    return dashboard.batch_totals(t.clips, c("video_id") % 10, scoring.scan_cost(c("duration")), c("clip_path").isNull())


@query("effective_label", "SELECT clip_id, coalesce(nullif(user_emotion, ''), nullif(emotion, ''), 'unlabeled') AS label FROM clips")
def _(t):
    return t.clips.select("clip_id", text.effective_label(c("user_emotion"), c("emotion")).alias("label"))


@query("label_source", "SELECT clip_id, case when coalesce(user_emotion, '') <> '' and user_emotion = emotion then 'human_verified' when coalesce(user_emotion, '') <> '' then 'human_corrected' when status = 'auto_approved' then 'ai_auto' else 'ai_suggested' end AS label_source FROM clips")
def _(t):
    return t.clips.select("clip_id", text.label_source(c("status"), c("user_emotion"), c("emotion")).alias("label_source"))


@query("sentiment_map", "SELECT clip_id, case coalesce(nullif(user_emotion, ''), emotion) when 'happy' then 2.0::double when 'surprise' then 1.0::double when 'neutral' then 0.0::double when 'sad' then -1.0::double when 'fear' then -1.5::double when 'angry' then -2.0::double when 'disgust' then -2.5::double end AS sentiment FROM clips")
def _(t):
    return t.clips.select("clip_id", text.sentiment(text.effective_label(c("user_emotion"), c("emotion"))).alias("sentiment"))


@query("map_emotion", "WITH l AS (SELECT p_partkey, lower(concat(p_type, case p_partkey % 7 when 0 then ' Joyful' when 1 then 'SADness' when 2 then 'angry' when 3 then 'fearful' when 4 then 'surprised' when 5 then 'disgust' else '' end)) x FROM part) SELECT p_partkey, case when x like '%happy%' or x like '%joy%' or x like '%happiness%' then 'happy' when x like '%sad%' then 'sad' when x like '%ang%' then 'angry' when x like '%fear%' then 'fear' when x like '%sur%' then 'surprise' when x like '%dis%' then 'disgust' else 'neutral' end AS emotion FROM l")
def _(t):
    more = F.expr("case p_partkey % 7 when 0 then ' Joyful' when 1 then 'SADness' when 2 then 'angry' when 3 then 'fearful' when 4 then 'surprised' when 5 then 'disgust' else '' end")
    return t("part").select("p_partkey", text.map_emotion(F.concat("p_type", more)).alias("emotion"))


@query("word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n_words FROM documents")
def _(t):
    return t("documents").select("doc_id", text.word_count(c("text")).cast("bigint").alias("n_words"))


@query("normalize_text", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", text.one_spaced(c("text")).alias("text"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents")
@query("strip_accents_all", "SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(text.strip_accents(c("text"))).alias("digest"))


# the phrases by hand: two and more words weigh 1.3 and more, "hanh phuc" stands twice, those of two letters are left out
_LEX = """list_value(
{'e': 'happy', 'w': 1.15, 'p': ['vui', 'cuoi', 'thich', 'yeu', 'tuyet', 'mung', 'suong']}, {'e': 'happy', 'w': 1.30, 'p': ['hanh phuc', 'hanh phuc', 'may qua', 'vui ve', 'hoan hoan', 'ron rang']},
{'e': 'sad', 'w': 1.15, 'p': ['buon', 'khoc', 'mat', 'nho', 'tui', 'sau', 'thuong']}, {'e': 'sad', 'w': 1.30, 'p': ['dau long', 'co don', 'that vong', 'tui nhu', 'nuoc mat', 'bi luy']},
{'e': 'angry', 'w': 1.15, 'p': ['gian', 'tuc', 'buc', 'cam', 'ghet', 'dien']}, {'e': 'angry', 'w': 1.30, 'p': ['do khon', 'im di', 'khong tha', 'cam han', 'tuc gian', 'buc boi']},
{'e': 'fear', 'w': 1.15, 'p': ['hoang', 'cuu', 'dung', 'hai', 'run']}, {'e': 'fear', 'w': 1.30, 'p': ['nguy hiem', 'chay di', 'rung minh', 'lo lang', 'bat an', 'hoang loan']},
{'e': 'surprise', 'w': 1.15, 'p': ['sao']}, {'e': 'surprise', 'w': 1.30, 'p': ['gi co', 'that an', 'khong the', 'bat ngo', 'troi oi', 'chu sao', 'lam sao', 'that khong']}, {'e': 'surprise', 'w': 1.45, 'p': ['khong tin noi']},
{'e': 'disgust', 'w': 1.15, 'p': ['ghe', 'kinh', 'tom', 'ban', 'khinh', 'buc', 'ngay']}, {'e': 'disgust', 'w': 1.30, 'p': ['dang ghet', 'buon non', 'ghe tom', 'kinh tom']})"""
_FOUND = "d AS (SELECT doc_id, strip_accents(lower(trim(text))) x FROM documents), l AS (SELECT unnest(%s) l), f AS (SELECT doc_id, l.e AS e, l.w * len(list_filter(l.p, lambda p: contains(x, p))) AS s FROM d, l), h AS (SELECT doc_id, %s, sum(s) AS total FROM f GROUP BY 1)" % (
    _LEX, ", ".join(f"sum(s) filter (e = '{e}') AS {e}" for e in EMOTIONS if e != "neutral"),
)


@query("lexicon_score", f"WITH {_FOUND} SELECT doc_id, " + ", ".join(f"case when total > 0 then {_dec(f'{e} / (total + 0.25::double)', 6)} end AS {e}" for e in EMOTIONS if e != "neutral") + f", case when total > 0 then {_dec('0.25::double / (total + 0.25::double)', 6)} end AS neutral FROM h")
def _(t):
    return text.with_lexicon_scores(t("documents").select("doc_id", "text"), "text").select("doc_id", *(scoring.rounded(c(k), 6).alias(k) for k in EMOTIONS))


@query("strip_fence", r"SELECT clip_id, case when starts_with(trim(text), '```') then regexp_replace(regexp_replace(trim(text), '^```(?:json)?\s*', ''), '\s*```$', '') else trim(text) end AS body FROM responses")
def _(t):
    return t.responses.select("clip_id", text.strip_fence(c("text")).alias("body"))


_HOST = "lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), ''))"
_URLS = "u AS (SELECT page_id, case page_id % 6 when 0 then 'https://www.YouTube.com/watch?v=abcdefghijk' when 1 then 'http://fb.watch/x/1' when 2 then 'https://vm.tiktok.com/z' when 3 then '' when 4 then 'no url' else url end AS url FROM pages)"
_URL = "case page_id % 6 when 0 then 'https://www.YouTube.com/watch?v=abcdefghijk' when 1 then 'http://fb.watch/x/1' when 2 then 'https://vm.tiktok.com/z' when 3 then '' when 4 then 'no url' else url end"


@query("source_type", f"WITH {_URLS}, h AS (SELECT page_id, {_HOST} h FROM u WHERE trim(url) <> '') SELECT page_id, case when h like '%youtube%' or h like '%youtu.be%' then 'youtube' when h like '%drive.google%' then 'drive' when h like '%tiktok%' then 'tiktok' when h like '%facebook%' or h like '%fb.watch%' then 'facebook' when h like '%dailymotion%' then 'dailymotion' else 'url' end AS source_type FROM h")
def _(t):
    urls = t("pages").select("page_id", F.expr(_URL).alias("url")).filter(F.trim("url") != "")
    return urls.select("page_id", text.source_type(F.trim("url")).alias("source_type"))


@query("valid_url", f"WITH {_URLS} SELECT page_id, url <> '' and (regexp_matches(url, '^(https?://)?(www\\.)?(youtube|youtu|youtube-nocookie)\\.(com|be)/') or starts_with(url, 'http')) AS valid FROM u")
def _(t):
    return t("pages").select("page_id", F.expr(_URL).alias("url")).select("page_id", text.is_video_url(c("url")).alias("valid"))


@query("safe_name", r"SELECT p_partkey, regexp_replace(coalesce(nullif(case when p_partkey % 9 = 0 then '' else concat(p_name, '/', p_brand) end, ''), 'unknown'), '[^\pL\pN_-]', '_', 'g') AS name FROM part")
def _(t):
    return t("part").select("p_partkey", text.safe_name(F.expr("case when p_partkey % 9 = 0 then '' else concat(p_name, '/', p_brand) end")).alias("name"))


@query("format_units", """SELECT clip_id, concat(lpad(cast(start_ms // 60000 as varchar), 2, '0'), ':', lpad(cast(start_ms // 1000 % 60 as varchar), 2, '0')) AS clock,
case when b >= 1073741824 then printf('%.1f GB', b / 1073741824.0::double) when b >= 1048576 then printf('%.1f MB', b / 1048576.0::double) else printf('%.1f KB', b / 1024.0::double) end AS size FROM (SELECT *, start_ms * start_ms // (1 + clip_id % 97) AS b FROM clips)""")
def _(t):
    size = F.floor(c("start_ms") * c("start_ms") / (c("clip_id") % 97 + 1))
    return t.clips.select("clip_id", text.clock(c("start_ms")).alias("clock"), text.size_text(size).alias("size"))


@query("cache_key", """SELECT clip_id, substr(sha256(concat('["', coalesce(clip_path, ''), '", "verify", "', substr(sha256(transcript), 1, 16), '", "', substr(sha256(concat('{"emotion": "', emotion, '"}')), 1, 16), '"]')), 1, 32) AS key FROM clips""")
def _(t):
    params = F.concat(F.lit('{"emotion": "'), c("emotion"), F.lit('"}'))
    return t.clips.select("clip_id", text.cache_key(F.coalesce("clip_path", F.lit("")), F.lit("verify"), c("transcript"), params).alias("key"))


@query("truncate", "SELECT doc_id, text[:200] AS head, length(text[:500]) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", text.truncated(c("text"), 200).alias("head"), F.char_length(text.truncated(c("text"), 500)).cast("bigint").alias("n"))


@query("status_names", "SELECT video_id, case status when 'processing' then 'Đang xử lý' when 'completed' then 'Hoàn thành' when 'error' then 'Lỗi' else status end AS name FROM videos")
def _(t):
    return t.videos.select("video_id", text.status_name(c("status")).alias("name"))


_FAILURE = "case clip_id % 9 when 0 then 'HTTP Error 403: Forbidden' when 1 then 'HTTP Error 429' when 2 then 'Sign in to confirm your age' when 3 then 'ffmpeg was NOT FOUND' when 4 then 'nsig extraction failed' when 5 then 'cookies have expired' when 6 then 'Connection reset' when 7 then concat('odd failure ', clip_id) else null end"


@query("download_errors", f"""SELECT clip_id, case clip_id % 9 when 0 then 'YouTube từ chối truy cập (403). Hãy thử bật cookies trình duyệt, dùng cookies.txt hoặc chuyển sang chế độ tải an toàn.'
when 1 then 'YouTube tạm chặn do quá nhiều yêu cầu (429). Hãy chờ vài phút, đổi mạng hoặc bật cookies rồi thử lại.' when 2 then 'Video yêu cầu đăng nhập hoặc xác minh độ tuổi. Hãy cấu hình cookies trình duyệt hoặc cookies.txt trong Cài đặt.'
when 3 then 'Không tìm thấy FFmpeg. Hãy cài FFmpeg hoặc cấu hình đúng đường dẫn trong Cài đặt.' when 4 then 'YouTube thay đổi cơ chế chữ ký phát video. Hãy cập nhật yt-dlp và cân nhắc cài Deno rồi thử lại.'
when 5 then 'Cookies không hợp lệ hoặc đã hết hạn. Hãy xuất lại cookies.txt hoặc chọn lại trình duyệt lấy cookies.' when 6 then 'Lỗi kết nối mạng khi truy cập nguồn video. Hãy kiểm tra Internet hoặc thử lại với chế độ tải an toàn.'
when 7 then concat('Lỗi tải video: odd failure ', clip_id) else 'Lỗi tải video: Không rõ lỗi' end AS advice FROM clips""")
def _(t):
    return t.clips.select("clip_id", text.download_error(F.expr(_FAILURE)).alias("advice"))


_AGENT = """case clip_id % 5 when 0 then concat('{"candidates": [{"content": {"parts": [{"kind": 1}, {"text": "```json [', clip_id, '] ```"}]}}]}') when 1 then concat('{"candidates": [], "text": "t', clip_id, '"}') when 2 then '{"raw": "r"}' when 3 then '{}' else concat('{"candidates": [{"content": {"parts": [{"text": " plain ', clip_id, ' "}]}}], "text": "no"}') end"""


@query("agent_response", "SELECT clip_id, case clip_id % 5 when 0 then concat('[', clip_id, ']') when 1 then concat('t', clip_id) when 2 then 'r' when 3 then '' else concat('plain ', clip_id) end AS said FROM clips")
def _(t):
    return t.clips.select("clip_id", F.expr(_AGENT).alias("body")).select("clip_id", json_parse.agent_text(c("body")).alias("said"))


@query("json_extract", "SELECT event_id, cast(json_extract_string(props, '$.k') as int) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


_BODY = r"j AS (SELECT clip_id, case when starts_with(trim(text), '```') then regexp_replace(regexp_replace(trim(text), '^```(?:json)?\s*', ''), '\s*```$', '') else trim(text) end AS b FROM responses)"
_PARSED = f"""{_BODY}, k AS (SELECT clip_id, case when b like '[%' then b::json when json_extract(b::json, '$.segments') is not null then json_extract(b::json, '$.segments') else json_array(b::json) end AS a FROM j WHERE json_valid(b) AND b <> ''),
e AS (SELECT clip_id, unnest(cast(a as json[])) AS s FROM k),
p AS (SELECT clip_id, cast(json_extract_string(s, '$.start_time') as double) AS start_time, cast(json_extract_string(s, '$.end_time') as double) AS end_time, json_extract_string(s, '$.emotion') AS emotion, cast(json_extract_string(s, '$.intensity') as double) AS intensity, cast(json_extract_string(s, '$.face_coverage') as double) AS face_coverage, cast(json_extract_string(s, '$.has_transcript') as boolean) AS has_transcript FROM e)"""


@query("parse_segments", f"WITH {_PARSED} SELECT * FROM p")
def _(t):
    return json_parse.parsed_segments(t.responses, "text").select("clip_id", "start_time", "end_time", "emotion", "intensity", "face_coverage", "has_transcript")


_IN = ", ".join(f"'{e}'" for e in EMOTIONS)


@query("validate_segments", f"""WITH {_PARSED}, q AS (SELECT *, least(60.0::double, case when end_time - start_time > 15 then start_time + 15 else end_time end) cut FROM p WHERE start_time >= 0 AND end_time > start_time AND lower(trim(emotion)) IN ({_IN}) AND intensity >= 0.55 AND end_time - start_time >= 3)
SELECT clip_id, {_dec('start_time', 2)} AS start_time, {_dec('cut', 2)} AS end_time, lower(trim(emotion)) AS emotion, {_dec('least(1.0::double, intensity)', 3)} AS intensity, {_dec('coalesce(face_coverage, 0)', 3)} AS face_coverage FROM q WHERE cut - start_time >= 3""")
def _(t):
    return json_parse.valid_segments(json_parse.parsed_segments(t.responses, "text"), F.lit(60.0)).select("clip_id", "start_time", "end_time", "emotion", "intensity", "face_coverage")


@query("validate_segments_v1", f"""WITH {_PARSED} SELECT clip_id, {_dec('start_time', 2)} AS start_time, {_dec('end_time', 2)} AS end_time, lower(trim(emotion)) AS emotion, {_dec('least(1.0::double, intensity)', 3)} AS intensity, {_dec('coalesce(face_coverage, 0)', 3)} AS face_coverage, coalesce(face_coverage, 0) >= 0.3 AS speaker_visible
FROM p WHERE end_time - start_time between 3 and 30 AND start_time >= 0 AND lower(trim(emotion)) IN ({_IN}) AND intensity >= 0.6""")
def _(t):
    got = json_parse.valid_labels(json_parse.parsed_segments(t.responses, "text", ("segments", "results", "emotional_segments", "emotions", "highlights")))
    return got.select("clip_id", "start_time", "end_time", "emotion", "intensity", "face_coverage", "speaker_visible")


_LINES = "concat('Scenes: ', clip_id % 40, '.5 - ', clip_id % 40 + 6, ': Angry (0.', 50 + clip_id % 50, ')\n', clip_id % 7, ' to 9 | happy 0.9, then 3 - 4: bored (0.99)')"


@query("regex_segments", f"""WITH m AS (SELECT clip_id, unnest(regexp_extract_all({_LINES}, '(\\d+\\.?\\d*)\\s*[-–to]+\\s*(\\d+\\.?\\d*)\\s*[:\\-\\|]\\s*(\\w+)\\s*\\(?(\\d+\\.?\\d*)\\)?')) x FROM clips),
g AS (SELECT clip_id, regexp_extract(x, '^(\\d+\\.?\\d*)', 1) a, regexp_extract(x, '[-–to]+\\s*(\\d+\\.?\\d*)\\s*[:\\-\\|]', 1) b, lower(regexp_extract(x, '[:\\-\\|]\\s*([A-Za-z]\\w*)\\s*\\(?\\d', 1)) e, regexp_extract(x, '(\\d+\\.?\\d*)\\)?$', 1) i FROM m)
SELECT clip_id, cast(a as double) AS start_time, cast(b as double) AS end_time, e AS emotion, cast(i as double) AS intensity FROM g WHERE e IN ({_IN}) AND cast(i as double) >= 0.6""")
def _(t):
    return json_parse.segments_in_text(t.clips.select("clip_id", F.expr(_LINES).alias("said")), "said").drop("said")


_ANSWER = """case when clip_id % 13 = 0 then 'not json at all' else concat('{"verdict": "', case clip_id % 5 when 0 then 'bogus' when 1 then 'confirmed' when 2 then 'unstable' else 'wrong_emotion' end, '"', case when clip_id % 3 = 0 then '' else ', "emotion": "sad"' end, case when clip_id % 4 = 0 then '' else ', "intensity": 0.5, "stable": false' end, '}') end"""


@query("parse_verify", f"""WITH a AS (SELECT clip_id, emotion pe, confidence pi, {_ANSWER} x FROM clips), j AS (SELECT *, case when json_valid(x) then x::json end j FROM a)
SELECT clip_id, case when json_extract_string(j, '$.verdict') in ('confirmed', 'wrong_emotion', 'unstable', 'low_quality', 'stats_mismatch') then json_extract_string(j, '$.verdict') else 'stats_mismatch' end AS verdict, coalesce(json_extract_string(j, '$.emotion'), pe) AS emotion,
coalesce(cast(json_extract_string(j, '$.intensity') as double), pi) AS intensity, coalesce(cast(json_extract_string(j, '$.stable') as boolean), true) AS stable, j is null AS parse_failed FROM j""")
def _(t):
    got = json_parse.parsed_verdict(F.expr(_ANSWER), c("emotion"), c("confidence"))
    return t.clips.select("clip_id", *(got[k].alias(k) for k in ("verdict", "emotion", "intensity", "stable", "parse_failed")))


@query("multilabel_models", """SELECT clip_id, case when clip_id % 3 = 0 then least(3.0::double, confidence * 3) when clip_id % 2 = 0 then least(3.0::double, quality * 3) else 0.6::double end AS happy,
case when clip_id % 2 = 0 then least(3.0::double, 0.5::double * 3) when emotion = 'sad' then 1.0::double else 0.0::double end AS sad FROM clips""")
def _(t):
    model = "struct<emotion:string,confidence:double,scores:map<string,double>>"
    none = F.lit(None).cast("map<string,double>")
    first = F.struct(F.lit("x").alias("emotion"), F.lit(0.9).alias("confidence"), F.create_map(F.lit("happy"), F.lit(0.2)).alias("scores")).cast(model)
    even = [F.struct(F.lit("happy").alias("emotion"), c("quality").alias("confidence"), none.alias("scores")).cast(model), F.struct(F.lit("sad").alias("emotion"), F.lit(0.5).alias("confidence"), none.alias("scores")).cast(model)]
    models = F.when(c("clip_id") % 2 == 0, F.array(first, *even)).otherwise(F.array(first))
    scores = F.when(c("clip_id") % 3 == 0, F.create_map(F.lit("happy"), c("confidence"))).otherwise(F.create_map().cast("map<string,double>"))
    v = vectors.multilabel(scores, c("emotion"), ("happy", "sad"), models)
    return t.clips.select("clip_id", v.alias("v")).select("clip_id", *(c("v")[i].alias(n) for i, n in enumerate(("happy", "sad"))))


# score maps: a few labels from a clip's numbers, over all seven
_SCORES = {"happy": "confidence - 0.3", "sad": "face_coverage / 2", "angry": "verify_intensity - 0.5", "neutral": "quality / 3"}


def _scores(shift: int = 0):
    names = list(_SCORES)
    return F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.expr(f"cast({_SCORES[names[(i + shift) % 4]]} as double)"))))


def _norm_sql(shift: int = 0, by: str = "") -> str:
    names = list(_SCORES)
    cols = ", ".join(f"greatest(0.0::double, ({_SCORES[names[(i + shift) % 4]]})::double) AS {n}" for i, n in enumerate(names))
    total = "(0.0::double + happy + sad + angry + 0.0 + 0.0 + 0.0 + neutral)"
    parts = ", ".join(f"case when {total} > 0 then {n} / {total} else {1.0 if n == 'neutral' else 0.0}::double end AS {n}" for n in names)
    return f"(SELECT clip_id{by}, {parts} FROM (SELECT clip_id{by}, {cols} FROM clips))"


@query("normalize_scores", f"SELECT clip_id, {', '.join(_dec(n, 6) + ' AS ' + n for n in _SCORES)} FROM {_norm_sql()}")
def _(t):
    got = t.clips.select("clip_id", vectors.normalized(_scores()).alias("m"))
    return got.select("clip_id", *(scoring.rounded(c("m")[n], 6).alias(n) for n in _SCORES))


_ARG = "case when happy >= greatest(sad, angry, neutral) then 'happy' when sad >= greatest(angry, neutral) then 'sad' when angry >= neutral then 'angry' else 'neutral' end"


@query("argmax_label", f"SELECT clip_id, {_ARG} AS label FROM {_norm_sql()}")
def _(t):
    return t.clips.select("clip_id", vectors.argmax_label(vectors.normalized(_scores())).alias("label"))


_W = (0.45, 0.35, 0.20)


def _mean_sql() -> str:
    names = list(_SCORES)
    has = ["true", "b.clip_id % 3 > 0", "b.clip_id % 4 > 0"]
    w = " + ".join(f"case when {h} then {x}::double else 0.0::double end" for h, x in zip(has, _W, strict=True))
    cols = ", ".join("(" + " + ".join(f"case when {h} then {a}.{n} * {x}::double else 0.0::double end" for h, x, a in zip(has, _W, "abd", strict=True)) + f") / ({w}) AS {n}" for n in names)
    arg = lambda a: _ARG.replace("happy >=", f"{a}.happy >=").replace("(sad,", f"({a}.sad,").replace("angry,", f"{a}.angry,").replace("neutral)", f"{a}.neutral)").replace("when sad", f"when {a}.sad").replace("when angry", f"when {a}.angry").replace(">= neutral", f">= {a}.neutral")
    return f"(SELECT b.clip_id, {cols}, {arg('a')} AS wa, case when {has[1]} then {arg('b')} end AS wb, case when {has[2]} then {arg('d')} end AS wd FROM {_norm_sql(0)} a JOIN {_norm_sql(1)} b USING (clip_id) JOIN {_norm_sql(2)} d USING (clip_id))"


@query("ensemble_vote", f"""WITH m AS (SELECT *, {_ARG} AS label FROM {_mean_sql()}) SELECT clip_id, label, {_dec("case label when 'happy' then happy when 'sad' then sad when 'angry' then angry else neutral end", 6)} AS confidence,
concat(len(list_filter([wa, wb, wd], lambda x: x = label)), '/', len(list_filter([wa, wb, wd], lambda x: x is not null))) AS agreement, len(list_distinct(list_filter([wa, wb, wd], lambda x: x is not null))) > 1 AS has_incongruity FROM m""")
def _(t):
    models = {"visual": (_scores(0), _W[0]), "voice": (F.when(c("clip_id") % 3 > 0, _scores(1)), _W[1]), "text": (F.when(c("clip_id") % 4 > 0, _scores(2)), _W[2])}
    got = vectors.ensemble(t.clips, models)
    return got.select("clip_id", "label", scoring.rounded(c("confidence"), 6).alias("confidence"), "agreement", "has_incongruity")


@query("multilabel_vector", "SELECT clip_id, least(3.0::double, confidence * 3) AS happy, case when emotion = 'sad' then 1.0::double else 0.0::double end AS sad, case when emotion = 'angry' then 1.0::double else 0.0::double end AS angry FROM clips")
def _(t):
    v = vectors.multilabel(F.create_map(F.lit("happy"), c("confidence")), c("emotion"), ("happy", "sad", "angry"))
    return t.clips.select("clip_id", v.alias("v")).select("clip_id", *(c("v")[i].alias(n) for i, n in enumerate(("happy", "sad", "angry"))))


_HOLED = "case when (vec_id + place) % 5 = 0 then {0} when (vec_id + place) % 5 = 1 then {1} when (vec_id + place) % 5 = 2 then {2} else cast(x as double) end"
_HOLES = _HOLED.format("'NaN'::double", "'inf'::double", "null")


@query("nan_clean", f"SELECT vec_id, place, case when x is null or isnan(x) or isinf(x) then 0.0::double else x end AS x FROM (SELECT vec_id, place, {_HOLES} AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS place, unnest(embedding) AS x FROM embeddings))")
def _(t):
    holed = F.expr("transform(embedding, (x, place) -> " + _HOLED.format("double('NaN')", "double('Infinity')", "null") + ")")
    return t("embeddings").select("vec_id", F.posexplode(vectors.finite(holed)).alias("place", "x"))


@query("visual_avg", f"""WITH n AS {_norm_sql(0, ', video_id, clip_index, created_us')}, f AS (SELECT * FROM n QUALIFY row_number() over (partition by video_id order by created_us, clip_id) <= 5)
SELECT video_id, {', '.join(_dec(f'avg({n})', 5) + ' AS ' + n for n in _SCORES)} FROM f GROUP BY 1""")
def _(t):
    first = F.row_number().over(Window.partitionBy("video_id").orderBy("created_us", "clip_id")) <= 5
    rows = t.clips.select("*", first.alias("first")).filter("first")
    means = vectors.mean_scores(rows, "video_id", _scores())
    return means.select("video_id", *(scoring.rounded(c("scores")[n], 5).alias(n) for n in _SCORES))
