"""Decisions on cases worked by hand, and keys and texts whose bytes are known."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cutroom.conf import CurationConf
from cutroom.functions import json_parse, scoring, text
from cutroom.operators import dashboard

c = F.col


def rows_of(spark, schema, rows):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_hard_filter(spark):
    schema = "start double, end double, intensity double, face double, frontal double, people int, speech string, words int, said boolean"
    rows = rows_of(spark, schema, [
        (10.0, 17.0, 0.85, 0.80, 0.85, 1, "good", 5, True), (30.0, 33.0, 0.75, 0.50, 0.80, 1, "good", 5, True), (50.0, 55.0, 0.92, 0.75, 0.78, 2, "good", 5, True),
        (70.0, 73.0, 0.65, 0.80, 0.80, 1, "good", 5, True), (90.0, 91.5, 0.90, 0.85, 0.90, 1, "good", 5, True), (0.0, 13.0, 0.90, 0.85, 0.10, None, "NONE", 2, True), (0.0, 5.0, 0.9, 0.9, None, None, None, None, False),
    ])
    codes, reasons, quality = scoring.hard_filter(c("end") - c("start"), c("intensity"), c("face"), c("frontal"), c("people"), c("speech"), c("words"), c("said"))
    got = [tuple(r) for r in rows.select(reasons, quality).collect()]
    assert got == [
        ("", 1.0), ("intensity_low(0.75<0.80),face_coverage_low(0.50<0.70)", None), ("too_many_people(2>1)", None), ("intensity_low(0.65<0.80)", None), ("duration_too_short(1.5s<3.0s)", None),
        ("duration_too_long(13.0s>12.0s),frontal_ratio_low(0.10<0.75),no_speech,transcript_too_short(2<3)", None), ("", 0.7),
    ]
    assert [r[0] for r in rows.select(codes).collect()][1] == "intensity_low,face_coverage_low"


def test_verify_answers(spark):
    said = [json.dumps({"verdict": "confirmed", "emotion": "happy", "intensity": 0.85, "stable": True}), '```json\n{"verdict":"wrong_emotion","emotion":"sad","intensity":0.5}\n```', "not json at all", json.dumps({"verdict": "bogus", "emotion": "x", "intensity": 0.5}), None]
    rows = rows_of(spark, "said string, emotion string, intensity double", [(s, "angry", 0.9) for s in said])
    got = json_parse.parsed_verdict(c("said"), c("emotion"), c("intensity"))
    found = [tuple(r) for r in rows.select(*(got[k] for k in ("verdict", "emotion", "intensity", "stable", "parse_failed"))).collect()]
    assert found == [("confirmed", "happy", 0.85, True, False), ("wrong_emotion", "sad", 0.5, True, False), ("stats_mismatch", "angry", 0.9, True, True), ("stats_mismatch", "x", 0.5, True, False), ("stats_mismatch", "angry", 0.9, True, True)]


@pytest.mark.parametrize(
    ("flip", "cases"),
    [
        (0.3, [(0.80, "confirmed", "happy", 0.85, ("happy", "passed", None)), (0.80, "wrong_emotion", "sad", 0.90, ("sad", "rejected", "emotion_flip_detected")), (0.80, "unstable", "happy", 0.5, ("happy", "rejected", "emotion_unstable")),
               (0.80, "low_quality", "happy", 0.5, ("happy", "rejected", "low_quality_detected")), (0.80, "stats_mismatch", "happy", 0.6, ("happy", "passed", None))]),
        (0.5, [(0.95, "confirmed", "sad", 0.20, ("sad", "passed", None)), (0.95, "confirmed", "angry", 0.93, ("angry", "rejected", "emotion_flip_detected"))]),
    ],
)
def test_combined_verdicts(spark, flip, cases):
    rows = rows_of(spark, "i double, verdict string, seen string, v double", [x[:4] for x in cases])
    got = scoring.combine_verdicts(F.lit("happy"), c("i"), c("verdict"), c("seen"), c("v"), CurationConf(max_flip=flip))
    found = rows.select(*(got[k].alias(k) for k in ("emotion", "verify_status", "reject_reason", "intensity"))).collect()
    assert [tuple(r)[:3] for r in found] == [x[4] for x in cases]
    if flip == 0.3:
        assert [r.intensity for r in found] == pytest.approx([0.893, 0.63, 0.8, 0.8, 0.7], abs=1.1e-3)


def test_review_routes(spark):
    cases = [
        (0.99, 0.7, None, "not_run", True, False, "auto_reject_candidates", 0.95, ["verify_verdict=rejected_by_verify=True"]),
        (0.90, 0.7, "wrong_emotion", "rejected", False, False, "auto_reject_candidates", 0.95, ["verify_verdict=wrong_emotion"]),
        (0.30, 0.7, "confirmed", "passed", False, False, "auto_reject_candidates", 0.80, ["ai_confidence=0.30 < 0.40"]),
        (0.95, 0.95, "confirmed", "passed", False, False, "auto_approve_candidates", 1.0, ["verify=confirmed", "ai_confidence=0.95", "quality_score=0.95", "no_incongruity"]),
        (0.95, 0.50, "confirmed", "passed", False, False, "needs_human_review", 0.5, ["default_to_human_review"]),
        (0.95, 0.95, "confirmed", "passed", False, True, "needs_human_review", 0.5, ["has_incongruity=True"]),
        (0.95, 0.95, None, "not_run", False, False, "needs_human_review", 0.5, ["verify_not_yet_run"]),
        (0.60, 0.60, None, "not_run", False, True, "needs_human_review", 0.5, ["has_incongruity=True", "verify_not_yet_run"]),
        (0.60, 0.60, None, "rejected", None, True, "needs_human_review", 0.5, ["default_to_human_review"]),
        (None, None, None, None, None, None, "auto_reject_candidates", 0.80, ["ai_confidence=0.00 < 0.40"]),
        (1.5, 0.9, " confirmed ", "passed", False, False, "auto_approve_candidates", 1.0, ["verify=confirmed", "ai_confidence=1.50", "quality_score=0.90", "no_incongruity"]),
    ]
    rows = rows_of(spark, "c double, q double, verdict string, status string, rejected boolean, incongruity boolean", [x[:6] for x in cases])
    got = scoring.review_route(*(c(x) for x in ("c", "q", "verdict", "status", "rejected", "incongruity")))
    found = rows.select(*(v.alias(k) for k, v in got.items()))
    assert [tuple(r) for r in found.collect()] == [x[6:] for x in cases]
    summary = dashboard.bucket_summary(found).first()
    assert (summary.total, summary.n_reject, summary.n_approve, summary.n_review) == (11, 4, 2, 5)
    assert tuple(dashboard.bucket_summary(found.limit(0)).first())[:1] == (0,) and dashboard.bucket_summary(found.limit(0)).first().approve_ratio == 0.0


def test_auto_decision_codes(spark):
    schema = "faces int, words int, duration double, snr double, frontal double, fq double, q double, emotion string, conf double, agreed string, inc boolean"
    rows = rows_of(spark, schema, [(0, 1, 1.0, 4.0, 0.2, 0.1, 0.9, None, 0.9, "3/3", False), (1, 3, 5.0, 15.0, 0.8, 0.6, 0.8, "happy", 0.7, "2/3", False), (1, 3, 5.0, None, None, None, 0.8, "happy", 0.7, "1/3", False), (2, 9, 5.0, 15.0, 0.8, 0.6, 0.8, "unknown", 0.7, "2/3", False)])
    status, reasons = scoring.auto_decision(*(c(x) for x in ("faces", "words", "duration", "snr", "frontal", "fq", "q", "emotion", "conf", "agreed", "inc")))
    assert [tuple(r) for r in rows.select(status, reasons).collect()] == [
        ("rejected", "no_face, transcript_too_short, duration_too_short, snr_too_low, head_pose_bad, face_quality_too_low, unknown_emotion"), ("approved", ""), ("needs_review", ""), ("rejected", "unknown_emotion"),
    ]


def test_costs_and_addresses(spark):
    assert spark.range(1).select(scoring.scan_cost(F.lit(60.0)), scoring.verify_cost(F.lit(7.0))).first()[0] == 0.12856
    urls = ["https://www.youtube.com/watch?v=abcdefghijk", "https://youtu.be/abcdefghijk", "", "not a url", None]
    assert [r[0] for r in rows_of(spark, "u string", [(u,) for u in urls]).select(text.is_video_url(c("u"))).collect()] == [True, True, False, False, False]


def test_cache_keys_are_hashes_of_json(spark):
    def key(path, stage, prompt, params):
        short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
        return hashlib.sha256(json.dumps([path, stage, short(prompt), short(params)], sort_keys=True).encode()).hexdigest()[:32]

    paths = ["/a/b.mp4", 'quote " and \\ back', "tiếng Việt.mp4", "a|b", "tab\tnew\nline\x01", "😀 face", "", "\x7f"]
    rows = rows_of(spark, "p string", [(p,) for p in paths])
    got = [r[0] for r in rows.select(text.cache_key(c("p"), F.lit("scan"), F.lit("nói gì"), F.lit("{}"))).collect()]
    assert got == [key(p, "scan", "nói gì", "{}") for p in paths]
    assert [r[0] for r in rows.select(text.json_string(c("p"))).collect()] == [json.dumps(p) for p in paths]


def test_lexicon(spark):
    rows = rows_of(spark, "t string", [("Hạnh phúc quá",), ("Tôi buồn, khóc",), ("nothing",), (None,), ("so lo ua ac",)])
    got = [r.asDict() for r in rows.select(*(v.alias(k) for k, v in text.lexicon_scores(c("t")).items())).collect()]
    assert got[0]["happy"] == pytest.approx(2.6 / 2.85) and got[0]["neutral"] == pytest.approx(0.25 / 2.85)
    assert got[1]["sad"] == pytest.approx(2.3 / 2.55) and sum(got[1].values()) == pytest.approx(1)
    assert all(v is None for i in (2, 3, 4) for v in got[i].values())


def test_sizes(spark):
    rows = rows_of(spark, "n long", [(0,), (1023,), (1024,), (1536 * 1024,), (3 * 1024**3,), (5 * 1024**5,), (None,)])
    assert [r[0] for r in rows.select(text.size_text(c("n"))).collect()] == ["0.0 KB", "1.0 KB", "1.0 KB", "1.5 MB", "3.0 GB", "5242880.0 GB", None]
