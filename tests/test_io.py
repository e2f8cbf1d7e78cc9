"""Readers, writers and streams over temporary folders, and splits and folds on small cases."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cutroom.operators import export, intervals, ranks, state
from cutroom.sources import sinks, tables
from cutroom.streaming import streams

c = F.col


def test_media_and_inbox(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "deep/c.mkv", "d"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"12345")
    found = tables.media(spark, str(tmp_path / "in")).collect()
    assert {(Path(r.path).name, r.bytes) for r in found} == {("a.MP4", 5), ("c.mkv", 5)} and all(r.modified_at for r in found)
    seen = []
    for _ in range(2):
        streams.run_available(streams.inbox(spark, str(tmp_path / "in")), lambda batch, n: seen.extend(Path(r.path).name for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == ["a.MP4", "c.mkv"]
    (tmp_path / "in" / "e.webm").write_bytes(b"1")
    streams.run_available(streams.inbox(spark, str(tmp_path / "in")), lambda batch, n: seen.extend(Path(r.path).name for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == ["a.MP4", "c.mkv", "e.webm"]


def test_feature_files(spark, tmp_path):
    (tmp_path / "au.csv").write_text("frame, AU01_r,AU02_r, AU02_c\n1,0.5,NaN,1\n2,x,2.5,0\n")
    got = [r.au for r in tables.action_units(spark, str(tmp_path / "au.csv"), 4).collect()]
    assert got == [[0.5, 0.0, 0.0, 0.0], [0.0, 2.5, 0.0, 0.0]]
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0, 2.0]]), (3, [[1.0], [2.0]]), (4, None)], "id int, m array<array<double>>")
    assert [r.id for r in tables.well_shaped(rows, "m", 2, 2).collect()] == [1]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "happy", 2.0, ["a", "b"]), (2, "val", "sad", 4.0, [])], "clip_id int, split string, final_emotion string, duration double, quality_flags array<string>")
    at = lambda name: str(tmp_path / name)
    sinks.write_labels_csv(rows, ["clip_id", "quality_flags"], at("labels"))
    lines = [line for f in Path(at("labels")).glob("*.csv") for line in csv.DictReader(f.open())]
    assert sorted((x["clip_id"], x["quality_flags"].strip('"')) for x in lines) == [("1", "a;b"), ("2", "")]
    sinks.write_splits(rows, at("splits"))
    assert {p.name for p in Path(at("splits")).glob("split=*")} == {"split=train", "split=val"} and spark.read.json(at("splits")).count() == 2
    for _ in range(2):
        sinks.append_log(rows.select("clip_id"), at("log"))
        sinks.append(rows, at("table"))
    assert spark.read.json(at("log")).count() == spark.read.parquet(at("table")).count() == 4
    card = sinks.dataset_card(rows, "Set")
    assert card.startswith("# Set") and "| happy | 1 |" in card and json.loads(card.split("```json")[1].split("```")[0])["avg_duration"] == 3.0
    for stamp, payload in ((1, "old"), (9, "new")):
        sinks.cache_put(spark.createDataFrame([("k", payload), (f"k{stamp}", "x")], "key string, payload string"), at("cache"), F.lit(stamp))
    got = tables.cached(spark.createDataFrame([("k",), ("k1",), ("none",)], "key string"), spark.read.parquet(at("cache")), "key", F.lit(10), 5)
    assert {r.key: r.payload for r in got.collect()} == {"k": "new", "k1": None, "none": None}
    features = spark.createDataFrame([(1, "text", [[1.0]]), (1, "audio", [[2.0]])], "clip_id int, modality string, values array<array<double>>")
    sinks.write_features(features, at("features"))
    assert {p.name for p in Path(at("features")).glob("modality=*")} == {"modality=text", "modality=audio"}
    sinks.write_tensors(spark.createDataFrame([(2, "train", 1.0, [0.5]), (1, "train", 0.0, [0.1]), (3, "val", 0.0, [0.2])], "clip_id int, split string, label double, text array<double>"), at("tensors"))
    assert [r.clip_id for r in spark.read.parquet(at("tensors") + "/split=train").collect()] == [1, 2]
    sinks.write_segments(spark.createDataFrame([("v", 5, 9, "sad"), ("v", 0, 4, "happy")], "video_id string, start int, end int, emotion string"), "video_id", at("segments"))
    (video,) = [json.loads(line) for f in Path(at("segments")).glob("*.json") for line in f.read_text().splitlines()]
    assert video == {"video_id": "v", "count": 2, "segments": [{"start": 0, "end": 4, "emotion": "happy"}, {"start": 5, "end": 9, "emotion": "sad"}]}


def test_copies_say_what_failed(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    rows = spark.createDataFrame([(1, str(tmp_path / "a"), str(tmp_path / "b")), (2, str(tmp_path / "none"), str(tmp_path / "c"))], "clip_id int, clip_path string, exported_clip_path string")
    import shutil

    got = {r.clip_id: r.error for r in sinks.copy_media(rows, lambda a, b: shutil.copyfile(a, b)).collect()}
    assert got["1"] is None and "none" in got["2"] and (tmp_path / "b").read_text() == "x"


def test_sessions_and_heartbeats(spark, tmp_path):
    import datetime

    at = lambda minute: datetime.datetime(2024, 1, 1, 10, minute)
    schema = "worker_id string, ts timestamp"
    for n, rows in enumerate(([("w", at(0)), ("w", at(2)), ("v", at(1))], [("v", at(30))], [("v", at(59))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out, seen = [], []
        streams.run_available(streams.sessions(read(), "worker_id"), lambda b, i: out.extend(tuple(r) for r in b.collect()), str(tmp_path / "s"))
        streams.run_available(streams.heartbeats(read()), lambda b, i: seen.extend((r.worker, r.state) for r in b.collect()), str(tmp_path / "h"), "update")
        if n == 0:
            assert sorted(seen) == [("v", "alive"), ("w", "alive")]
        else:
            assert ("v", "alive") in seen
        streams_out = out if n == 0 else streams_out + out  # noqa: F821
        states = seen if n == 0 else states + seen  # noqa: F821
    assert ("w", at(0), at(7), 2) in streams_out
    assert ("w", "gone") in states


def test_splits(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", None if i % 2 else "g") for i in range(60)], "id int, label string, g string")
    for group in ("label", "g"):
        placed = ranks.ranked_within(rows.repartition(7), group, [F.desc("id")]).collect()
        for key in {r[group] for r in placed}:
            mine = sorted((r for r in placed if r[group] == key), key=lambda r: -r.id)
            assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and {r.group_size for r in mine} == {len(mine)}
    names = [r.split for r in export.stratified_split(rows, "label", "id").collect()]
    assert {n: names.count(n) for n in set(names)} == {"train": 42, "val": 9, "test": 9}
    assert {r.split for r in export.plain_split(rows.limit(2), "id").collect()} == {"all"}
    assert sorted(r.split for r in export.plain_split(rows.limit(10), "id").collect()) == ["test"] * 2 + ["train"] * 7 + ["val"]
    with pytest.raises(ValueError, match="no segment"):
        export.strict(rows.limit(0))


def test_edits_and_moves(spark):
    rows = spark.createDataFrame([(1, "v", 0, 5, "x"), (2, "v", 6, 9, "x"), (3, "w", 1, 2, "x"), (4, "v", 20, 30, "x")], "id int, video_id string, start int, end int, status string")
    edits = spark.createDataFrame([(1, "merge", 2), (3, "merge", 4), (4, "reject", None), (9, "delete", None)], "id int, action string, other int")
    assert sorted(tuple(r) for r in intervals.edited(rows, edits).collect()) == [(1, "v", 0, 9, "x"), (3, "w", 1, 2, "x"), (4, "v", 20, 30, "rejected")]
    queue = spark.createDataFrame([(1, "queued", None, "start"), (2, "running", 5, "skip"), (3, "running", 5, "finish"), (4, "paused", None, "start")], "id int, status string, started_at int, e string")
    assert [tuple(r)[1:3] for r in state.moved(queue, c("e"), F.lit(7)).orderBy("id").collect()] == [("running", 7), ("queued", None), ("done", 5), ("paused", None)]
    spans = spark.createDataFrame([("v", i, i * 10, i * 10 + (25 if i % 4 else 8), float(i % 3)) for i in range(40)], "k string, id long, start long, end long, intensity double")
    kept = {r.id for r in intervals.overlap_nms(spans, "k").collect()}
    want = []
    for r in sorted(spans.collect(), key=lambda r: (-r.intensity, r.start, r.end, r.id)):
        if all(not (min(r.end, k.end) > max(r.start, k.start) and (min(r.end, k.end) - max(r.start, k.start)) / min(r.end - r.start, k.end - k.start) > 0.3) for k in want):
            want.append(r)
    assert kept == {r.id for r in want}
