"""Thresholds and vocabularies; they are part of the data's meaning and are passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# Labels in tie-break order, in export order, and their sentiment.
EMOTIONS = ("happy", "sad", "angry", "fear", "surprise", "disgust", "neutral")
EXPORT_EMOTIONS = ("happy", "sad", "angry", "surprise", "disgust", "fear")
SENTIMENT = {"happy": 2.0, "surprise": 1.0, "neutral": 0.0, "sad": -1.0, "fear": -1.5, "angry": -2.0, "disgust": -2.5}
QUOTA = {"happy": 600, "sad": 450, "angry": 450, "neutral": 450, "surprise": 450, "fear": 300, "disgust": 300}
VERDICTS = ("confirmed", "wrong_emotion", "unstable", "low_quality", "stats_mismatch")


# The thresholds below.
@dataclass(frozen=True)
class CurationConf:
    """Times are milliseconds where the name ends in _ms, else seconds."""

    scan_intensity: float = 0.55
    scan_min_ms: int = 3000
    scan_max_ms: int = 15000
    pad_ms: int = 500
    max_segments: int = 40
    overlap: float = 0.3
    min_face_coverage: float = 0.70
    min_intensity: float = 0.80
    min_frontal: float = 0.75
    min_duration: float = 3.0
    max_duration: float = 12.0
    max_people: int = 1
    min_words: int = 3
    max_flip: float = 0.3
    approve_confidence: float = 0.85
    approve_quality: float = 0.85
    reject_confidence: float = 0.40
    approve_target: float = 0.30
    reject_target: float = 0.20
    gap_ms: int = 1000
    frame_ms: int = 500
    merge_gap_ms: int = 350
    merge_min_ms: int = 250
    clip_min_ms: int = 2000
    clip_max_ms: int = 12000
    clip_target_ms: int = 6000
    dialogue_ms: int = 1500
    worker_idle_s: int = 300
    cache_ttl_s: int = 604800


DEFAULT = CurationConf()
