"""Scores, decisions and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import DEFAULT, CurationConf
from .numbers import fixed


# Why a clip is rejected at once, in the order of the checks.
REJECT_REASONS = ("no_face", "transcript_too_short", "duration_too_short", "snr_too_low", "head_pose_bad", "face_quality_too_low", "unknown_emotion")
# Votes that count as agreement.
AGREEMENTS = ("3/3", "2/3", "3/4", "4/4")


def rounded(c: Column, digits: int) -> Column:
    """Half up on the decimal value, so that engines agree on ties."""
    return F.round(c.cast("decimal(20,8)"), digits).cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c, F.lit(0.0))))


def agreement(c: Column) -> Column:
    """"x/y" as x / y; anything else, and y = 0, is 0."""
    parts = F.split(c, "/")
    x, y = (F.try_element_at(parts, F.lit(i)).try_cast("int").cast("double") for i in (1, 2))
    return F.coalesce(F.when(F.size(parts) == 2, F.try_divide(x, y)), F.lit(0.0))


def quality_score(confidence: Column, agreed: Column, frames: Column, faces: Column, clarity: Column) -> tuple[Column, Column]:
    """(score, status) from confidence, agreement text, sampled frames, faces found and clarity."""
    c, a = clamp(confidence), clamp(agreement(agreed))
    f, s = clamp(faces / F.greatest(F.lit(1), frames)), clamp(clarity * 18.0)
    q = clamp(c * 0.42 + a * 0.28 + f * 0.20 + s * 0.10)
    status = (
        F.when((q >= 0.80) & (c >= 0.72) & (a >= 0.67) & (f >= 0.20), "auto_approved").when((q >= 0.42) & (c >= 0.38), "needs_review").otherwise("failed")
    )
    return q, status


def auto_decision(faces, words, duration, snr, frontal, face_quality, quality, emotion, confidence, agreed, incongruity) -> tuple[Column, Column]:
    """(status, reject reasons): rejected if any of seven reasons holds, approved if all conditions do, else for review."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    snr, frontal, quality = F.coalesce(snr, F.lit(20.0)), F.coalesce(frontal, F.lit(1.0)), zero(quality)
    face_quality, duration, words = F.coalesce(face_quality, quality), zero(duration), zero(words)
    fails = (zero(faces) == 0, words < 2, duration < 2.0, snr < 5.0, frontal < 0.30, face_quality < 0.20, F.coalesce(emotion, F.lit("unknown")).isin("", "unknown"))
    reasons = F.array_compact(F.array(*(F.when(test, code) for test, code in zip(fails, REJECT_REASONS, strict=True))))
    good = (
        (quality >= 0.80) & (zero(confidence) >= 0.70) & F.coalesce(agreed, F.lit("")).isin(*AGREEMENTS) & ~F.coalesce(incongruity, F.lit(False))
        & (words >= 3) & duration.between(3.0, 15.0) & (snr >= 15.0) & (frontal >= 0.80) & (face_quality >= 0.60)
    )
    return F.when(F.size(reasons) > 0, "rejected").when(good, "approved").otherwise("needs_review"), F.array_join(reasons, ", ")


def snr_proxy(snr: Column, clarity: Column) -> Column:
    return F.coalesce(snr, clamp(clarity * 30.0, 0.0, 30.0))


def hard_filter(duration, intensity, face_coverage, frontal, people, speech, words, has_transcript, conf: CurationConf = DEFAULT) -> tuple[Column, Column, Column]:
    """(reason codes joined, reasons with values, quality of those that pass). Frontal, people, speech and words count only if present."""
    def reason(test: Column, code: str, text: Column) -> tuple[Column, Column]:
        return F.when(test, code), F.when(test, text)

    say = lambda name, value, limit: F.concat(F.lit(f"{name}("), value, F.lit(f"{limit})"))
    pct = lambda name, c, limit: say(name, fixed(c, 2), f"<{limit:.2f}")
    secs = lambda name, sign, limit: say(name, fixed(duration, 1), f"s{sign}{limit}s")
    intensity, face_coverage = F.coalesce(intensity, F.lit(0.0)), F.coalesce(face_coverage, F.lit(0.0))
    found = [
        reason(duration < conf.min_duration, "duration_too_short", secs("duration_too_short", "<", conf.min_duration)),
        reason(duration > conf.max_duration, "duration_too_long", secs("duration_too_long", ">", conf.max_duration)),
        reason(intensity < conf.min_intensity, "intensity_low", pct("intensity_low", intensity, conf.min_intensity)),
        reason(face_coverage < conf.min_face_coverage, "face_coverage_low", pct("face_coverage_low", face_coverage, conf.min_face_coverage)),
        reason((frontal > 0) & (frontal < conf.min_frontal), "frontal_ratio_low", pct("frontal_ratio_low", frontal, conf.min_frontal)),
        reason(people > conf.max_people, "too_many_people", F.format_string(f"too_many_people(%d>{conf.max_people})", people)),
        reason(F.lower(speech) == "none", "no_speech", F.lit("no_speech")),
        reason((words < conf.min_words) & has_transcript, "transcript_too_short", F.format_string(f"transcript_too_short(%d<{conf.min_words})", words)),
    ]
    codes, texts = (F.array_join(F.array_compact(F.array(*(x[i] for x in found))), ",") for i in (0, 1))
    share = lambda c, limit: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)) / limit)
    quality = share(face_coverage, conf.min_face_coverage) * 0.4 + share(intensity, conf.min_intensity) * 0.3 + share(frontal, conf.min_frontal) * 0.3
    return codes, texts, F.when(codes == "", rounded(F.least(F.lit(1.0), quality), 3))


def combine_verdicts(emotion, intensity, verdict, v_emotion, v_intensity, conf: CurationConf | None = DEFAULT) -> dict[str, Column]:
    """Final emotion, intensity, verify_status, rejected and reason of a segment and its second look; conf None: no emotion lock."""
    seen = F.coalesce(F.nullif(v_emotion, F.lit("")), emotion)
    v = F.coalesce(v_intensity, intensity)
    is_ = lambda *names: verdict.isin(*names)
    lock = F.lit(False)
    if conf:
        lock = F.coalesce((emotion != "") & (seen != "") & (emotion != seen) & (1.0 - F.abs(intensity - v) > conf.max_flip), F.lit(False))
    bad = is_("unstable", "low_quality")
    return {
        "emotion": F.when(is_("confirmed", "wrong_emotion"), seen).otherwise(emotion),
        "intensity": F.when(is_("confirmed"), rounded(F.least(F.lit(1.0), F.greatest(intensity, v) * 1.05), 3))
        .when(is_("wrong_emotion"), rounded(F.least(F.lit(1.0), v * 0.7), 3))
        .when(is_("stats_mismatch"), rounded((intensity + v) / 2, 3))
        .otherwise(intensity),
        "verify_status": F.when(F.coalesce(bad, F.lit(False)) | lock, "rejected").otherwise("passed"),
        "rejected_by_verify": F.coalesce(bad, F.lit(False)) | lock,
        "reject_reason": F.when(lock, "emotion_flip_detected").when(is_("unstable"), "emotion_unstable").when(is_("low_quality"), "low_quality_detected"),
    }


def review_route(confidence, quality, verdict, status, rejected, incongruity, conf: CurationConf = DEFAULT) -> dict[str, Column]:
    """Bucket, its confidence, and the reasons, which are never empty."""
    c, q = F.coalesce(confidence, F.lit(0.0)), F.coalesce(quality, F.lit(0.0))
    verdict, status = (F.trim(F.coalesce(x, F.lit(""))) for x in (verdict, status))
    no = lambda b: F.coalesce(b, F.lit(False))
    wrong, low = no(rejected) | (verdict == "wrong_emotion"), c < conf.reject_confidence
    fine = (status == "passed") & (verdict == "confirmed") & (c >= conf.approve_confidence) & (q >= conf.approve_quality) & ~no(incongruity)
    two = lambda x: fixed(x, 2)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    # The wording of reasons.
    for_review = F.array_compact(F.array(F.when(no(incongruity) & (status != "rejected"), "has_incongruity=True"), F.when(status == "not_run", "verify_not_yet_run")))
    return {
        "bucket": F.when(wrong | low, "auto_reject_candidates").when(fine, "auto_approve_candidates").otherwise("needs_human_review"),
        "bucket_confidence": F.when(wrong, 0.95).when(low, 0.80).when(fine, approve_confidence(c, q, verdict, incongruity, conf)).otherwise(0.5),
        "reasons": F.when(wrong, F.array(say("verify_verdict=", F.coalesce(F.nullif(verdict, F.lit("")), F.lit("rejected_by_verify=True")))))
        .when(low, F.array(say("ai_confidence=", two(c), f" < {conf.reject_confidence:.2f}")))
        .when(fine, F.array(say("verify=", verdict), say("ai_confidence=", two(c)), say("quality_score=", two(q)), F.lit("no_incongruity")))
        .when(F.size(for_review) > 0, for_review)
        .otherwise(F.array(F.lit("default_to_human_review"))),
    }


def approve_confidence(confidence, quality, verdict, incongruity, conf: CurationConf = DEFAULT) -> Column:
    near = lambda x, high: clamp(1.0 - (high - x) / high)
    yes = lambda b: F.when(F.coalesce(b, F.lit(False)), 1.0).otherwise(0.0)
    total = near(confidence, conf.approve_confidence) * 0.30 + near(quality, conf.approve_quality) * 0.20 + yes(verdict == "confirmed") * 0.40 + (1.0 - yes(incongruity)) * 0.10
    return rounded(clamp(total), 4)


def cost(tokens_in: Column, tokens_out: Column, per_m_in: float = 0.30, per_m_out: float = 2.50) -> Column:
    """Dollars, to six digits."""
    return F.round(tokens_in.cast("decimal(20,0)") * F.lit(f"{per_m_in}").cast("decimal(6,2)") / 1000000 + tokens_out.cast("decimal(20,0)") * F.lit(f"{per_m_out}").cast("decimal(6,2)") / 1000000, 6).cast("double")


def scan_cost(seconds: Column) -> Column:
    return cost(F.floor(seconds) * 7000, F.lit(1024))


def verify_cost(seconds: Column) -> Column:
    return cost(F.floor(seconds) * 7000 + 500, F.lit(256))


def frame_cost(frames: Column, most_out: int = 4096) -> Column:
    return cost(frames * 7000, F.least(F.lit(most_out), frames * 200))


def face_ratio(ratio: Column, track: Column, frames: Column) -> Column:
    """What the segment says of its faces, else the share of frames in the main track."""
    return F.coalesce(ratio, F.coalesce(track, F.lit(0)).cast("double") / F.greatest(F.coalesce(frames, F.lit(1)), F.lit(1)))


def frontal_ratio(ratio: Column, head_pose: Column) -> Column:
    """What the segment says of frontal faces, else of the head's pose, else 1."""
    return F.coalesce(ratio, head_pose, F.lit(1.0))


def face_quality(quality: Column, score: Column) -> Column:
    """What the segment says of its faces' quality, else the clip's quality, else 0."""
    return F.coalesce(quality, score, F.lit(0.0))


# Fixed value: dollars that a batch of videos may cost.
BUDGET = 1000


def estimated_cost(seconds: Column, clips: Column, clip_seconds: Column) -> dict[str, Column]:
    """scan_usd, verify_usd and total_usd of a video of so many seconds with so many clips, and videos_covered: how many such videos BUDGET pays for. A clip's cost is rounded before it is multiplied."""
    exact = lambda c: c.cast("decimal(18,6)")
    scan, verify = exact(scan_cost(seconds)), clips * exact(verify_cost(clip_seconds))
    total = (scan + verify).cast("double")
    return {"scan_usd": scan.cast("double"), "verify_usd": verify.cast("double"), "total_usd": total, "videos_covered": F.when(total > 0, F.floor(BUDGET / total)).otherwise(0)}
