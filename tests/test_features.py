"""Feature files, tensors, frames, percentiles, retries, and writes that are merged or taken once."""

import hashlib
import random
from datetime import datetime, timedelta
from functools import reduce
from operator import add
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutroom import plans
from cutroom.functions import scoring, vectors
from cutroom.functions.numbers import fixed
from cutroom.operators import frames, retries, scores, selection, state, tensors
from cutroom.sources import npy, sinks
from cutroom.streaming import streams


def test_matrix_files(spark, tmp_path):
    """Sound files in either order, of one row, and files that are too short, of another shape or type, or no matrices."""
    want = np.arange(6.0).reshape(2, 3)
    npy.written(f"{tmp_path}/a/7_text_aligned.npy", want.astype(np.float32))
    npy.written(f"{tmp_path}/a/8_text_aligned.npy", np.asfortranarray(want))
    npy.written(f"{tmp_path}/b/8_audio_aligned.npy", np.arange(4))
    npy.written(f"{tmp_path}/b/cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "b/objects.npy", np.array([{}]), allow_pickle=True)
    (tmp_path / "b/none.npy").write_bytes(b"nothing")
    (tmp_path / "b/short.npy").write_bytes((tmp_path / "a/8_text_aligned.npy").read_bytes()[:-1])
    (tmp_path / "b/empty.npy").write_bytes(b"")
    rows = {(r.clip_id, r.modality): r for r in npy.read(spark, npy.Matrices, str(tmp_path)).collect()}
    assert len(rows) == 8 and {k for k, r in rows.items() if r.error is None} == {("7", "text"), ("8", "text"), ("8", "audio")}
    assert rows["7", "text"].matrix == rows["8", "text"].matrix == want.tolist() and rows["8", "audio"].matrix == [[0, 1, 2, 3]]
    assert rows["short", None].error == "truncated" and rows["cube", None].shape == [2, 2, 2] and rows["none", None].shape is None
    shaped = npy.read(spark, npy.Matrices, f"file:{tmp_path}", shape__text="2x3", shape__audio="2x2", values="false").collect()
    assert {(r.clip_id, r.error) for r in shaped if r.modality} == {("7", None), ("8", None), ("8", "shape (4,)")} and all(r.matrix is None for r in shaped)


def test_files_are_chosen_by_name_and_dealt_by_size(spark, tmp_path):
    for i in range(30):
        npy.written(f"{tmp_path}/{i}_text_aligned.npy", np.zeros((2, 2)))
    reader = npy.NamedReader({"path": str(tmp_path), "group_bytes": "1000"})
    assert len(reader.partitions()) == 5  # of 160 bytes each, six to a group
    rest = list(reader.pushFilters([npy.EqualTo(("clip_id",), "3"), npy.In(("modality",), ("text", "audio"))]))
    assert not rest and [len(p.files) for p in reader.partitions()] == [1]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert npy.read(spark, npy.Matrices, str(tmp_path)).filter("clip_id = '3' AND shape[0] = 2").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert npy.read(spark, npy.Matrices, str(tmp_path)).filter("clip_id = '3' AND shape[0] = 2").count() == 1


def test_values_of_a_wrong_shape_are_not_read(tmp_path):
    class Counted:
        def __init__(self, file):
            self.file, self.n = file, 0

        def read(self, n):
            self.n += n
            return self.file.read(n)

        def seek(self, at):
            self.file.seek(at)

    npy.written(f"{tmp_path}/big.npy", np.zeros((2000, 100)))
    with open(tmp_path / "big.npy", "rb") as file:
        seen = Counted(file)
        assert npy.matrix(seen, (50, 100), True)[1:] == ("shape (2000, 100)", None) and seen.n == 4096


def test_action_units(spark, tmp_path):
    """Each file has its own columns, in any order and with blanks; no numbers are 0."""
    (tmp_path / "a.csv").write_text("frame, AU02_r, AU01_r, AU01_c\n1,0.5,1.5,1\n2,nan,x,0\n3,2\n")
    (tmp_path / "b.csv").write_text("AU04,AU4x,AU01\n3,9,1\n")
    (tmp_path / "c.csv").write_text("")
    rows = {(r.path.rsplit("/", 1)[1], r.frame): r.au for r in npy.read(spark, npy.ActionUnits, str(tmp_path), most=4).collect()}
    assert rows == {("a.csv", 0): [1.5, 0.5, 0, 0], ("a.csv", 1): [0, 0, 0, 0], ("a.csv", 2): [0, 2, 0, 0], ("b.csv", 0): [1, 3, 0, 0]}


def test_aligned(spark):
    """By hand: frames pooled by word, kept if as many as words, cut, filled up, and made finite."""
    at = lambda rows: spark.createDataFrame([(c, i, [float(x) for x in v]) for c, vs in rows.items() for i, v in enumerate(vs)], "clip_id string, at int, values array<double>").repartition(3)
    text = at({"a": [[1], [2], [3], [4]], "b": [[1, 2, 3]], "d": [[float("nan"), float("inf")]]})
    audio = at({"a": [[i] for i in range(10)], "b": [[5], [6]], "c": [[7]]})
    words = spark.createDataFrame([("a", 0, 0.0, 0.04), ("a", 1, 0.04, 9.0), ("a", 2, 0.5, 0.6), ("b", 0, None, 0.1), ("b", 1, 0.0, None)], "clip_id string, at int, start double, end double")
    got = {r.clip_id: r for r in tensors.aligned({"text": text, "audio": audio}, words, {"text": 2, "audio": 1}, 3).collect()}
    assert got["a"].text == [[1, 0], [2, 0], [3, 0]] and got["a"].audio == [[1.5], [6.5], [0]] and got["a"].n_words == 3
    assert got["b"].text == [[1, 2], [0, 0], [0, 0]] and got["b"].audio == [[5], [6], [0]]
    assert got["c"].text == [[0, 0]] * 3 and got["c"].audio == [[7], [0], [0]] and got["d"].text == [[0, 0]] * 3


def test_stacks(spark, tmp_path):
    """Parts hold about as many clips in any split; a second run gives the same files; the stack's rows are those of clip_id."""
    rng = np.random.default_rng(1)
    rows = [(i, "train" if i % 10 else "val", rng.random((2, 3)).tolist()) for i in range(1000)]
    clips = spark.createDataFrame(rows, "clip_id int, split string, vision array<array<double>>").repartition(5)
    digest = lambda: {p.relative_to(tmp_path): hashlib.md5(p.read_bytes()).hexdigest() for p in tmp_path.rglob("*.npy")}
    made = tensors.write_stacks(clips, str(tmp_path), modalities=("vision",), most=100).collect()
    sizes = [r.shape[0] for r in made if r.modality == "vision"]
    assert sum(sizes) == 1000 and len(sizes) == 10 and min(sizes) > 60 and max(sizes) < 150
    first = digest()
    assert tensors.write_stacks(clips.repartition(2), str(tmp_path), modalities=("vision",), most=100).count() == 20 and digest() == first
    by_id = {str(i): v for i, _, v in rows}
    for r in made:
        if r.modality == "vision":
            names = np.load(r.path.replace("vision-", "clip_id-"))
            assert np.load(r.path).tolist() == [by_id[n] for n in names] and r.total == pytest.approx(np.load(r.path).sum())
    assert tensors.write_stacks(clips.limit(0), str(tmp_path), modalities=("vision",)).count() == 0


def test_face_statistics():
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (40, 30)).astype(float)
    got = frames.describe(picture, (5, 4, 25, 37))
    face = picture[4:37, 5:25]
    assert got[0] == pytest.approx(face[:16].mean() / 255) and got[8] == pytest.approx(face[19:].var() / 255**2) and got[5] == 20 / 30
    inner = face[:, 2:] - face[:, :-2]
    smooth = inner[:-2] + 2 * inner[1:-1] + inner[2:]
    assert frames.slopes(face, 1)[1:-1, 1:-1] == pytest.approx(smooth) and (frames.slopes(face, 1)[:, 0] == 0).all()
    assert frames.slopes(face.T, 0) == pytest.approx(frames.slopes(face, 1).T)
    assert got[34] == pytest.approx((np.percentile(face, 75) - np.percentile(face, 25)) / 255)
    for box in (None, (3, 3, 3, 9), (9, 9, 3, 3), (90, 90, 99, 99)):
        assert not frames.describe(picture, box).any()
    assert np.isfinite(frames.describe(picture, (0, 0, 1, 1))).all()


def test_scenes_of_a_long_film(spark):
    """Frames over many blocks, with gaps and bursts of changes; against a loop over all frames."""
    rng = random.Random(5)
    at, level, rows = 0, 0.0, []
    for i in range(6000):
        at += 1 if rng.random() < 0.98 else 3000
        level = level + 50 if rng.random() < 0.05 else level
        rows.append(("f", at, [level + rng.random(), level]))
    rows += [("one", 5, [1.0, 1.0]), ("two", 5, [0.0, 0.0]), ("two", 9, [0.0, 0.0])]
    film = spark.createDataFrame(rows, "video string, at long, v array<double>").repartition(4)
    last, begins, changes = None, [rows[0][1]], {}
    for (_, _, a), (_, pos, b) in zip(rows, rows[1:6000]):
        changes[pos] = (abs(a[0] - b[0]) + abs(a[1] - b[1])) / 2
        if changes[pos] >= 20 and (last is None or pos - last >= 15):
            begins.append(last := pos)
    got = {r["at"]: r.change for r in frames.change(film, "video", "at", "v").filter("video = 'f'").collect()}
    assert got.pop(rows[0][1]) is None and got == pytest.approx(changes)
    scenes = frames.scenes(film, "video", "at", "v", 20.0, 15).orderBy("video", "scene_index").collect()
    assert [r.start for r in scenes if r.video == "f"] == begins[: len(begins) - (begins[-1] == rows[5999][1])]
    assert [(r.start, r.end) for r in scenes if r.video != "f"] == [(5, 9)]


def test_percentiles_by_ranges(spark):
    """Narrowed in ranges: even and skewed values, one value that most rows have, extremes, and keys that are null."""
    rng = np.random.default_rng(3)
    groups = {"even": rng.random(3000), "skewed": np.exp(rng.normal(0, 30, 3000)), "hot": np.where(rng.random(3000) < 0.9, 7.0, rng.random(3000)), "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0] * 30), "one": np.array([4.0] * 200), None: rng.normal(size=500), "few": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    shares = {"p0": 0.0, "p35": 0.35, "p50": 0.5, "p100": 1.0}
    got = {r.k: r for r in selection.percentiles(df, "x", shares, ["k"], small=100).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k].n == len(v)
        for name, p in shares.items():
            assert got[k][name] == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=0)
    (whole,) = selection.percentiles(df.filter("k = 'hot'"), "x", {"median": 0.5}, small=100).collect()
    assert (whole.n, whole.median) == (3000, 7.0)
    assert selection.percentiles(df.limit(0), "x", {"median": 0.5}).collect() == []


def plain_retries(events):
    out, errors, stopped = [], {}, set()
    for worker, at, tie, outcome in sorted(events):
        n = 0 if outcome == "job" else errors.get(worker, 0) + (outcome == "error")
        errors[worker] = n
        action = "stopped" if worker in stopped else "stop" if n >= 5 else "wait" if outcome == "error" else "go on"
        if n >= 5:
            stopped.add(worker)
        out.append((worker, at, tie, outcome, n, action, 0 if action in ("stop", "stopped") else 30 if outcome == "error" else 10))
    return out


def test_retries_over_spans(spark):
    """Counts are carried over any number of spans, with and without events that begin anew."""
    rng = random.Random(6)
    events = [(f"w{rng.randrange(9)}", rng.randrange(400), i, rng.choice(["error", "error", "idle", "idle", "job"] if i % 3 else ["error", "idle"])) for i in range(1500)]
    got = retries.decided(spark.createDataFrame(events, "worker string, ms long, id long, outcome string").repartition(3), "worker", "ms", "id", span=7)
    assert sorted(map(tuple, got.collect())) == plain_retries(events)


def test_retry_stream(spark, tmp_path):
    """Four errors and a job, then five errors: a stop, after which nothing is decided; an error alone waits, then may try again."""
    begin = datetime(2024, 1, 1)
    a = ["error"] * 4 + ["idle", "job"] + ["error"] * 5 + ["error", "job"]
    batches = [[("a", begin + timedelta(seconds=i), x) for i, x in enumerate(a[:7])], [("a", begin + timedelta(seconds=7 + i), x) for i, x in enumerate(a[7:])] + [("b", begin + timedelta(seconds=9), "error")], [("c", begin + timedelta(seconds=500), "idle")], [("c", begin + timedelta(seconds=900), "idle")]]
    schema, found = "worker_id string, ts timestamp, outcome string", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        decided = streams.retry_policy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        streams.run_available(decided, lambda batch, _: found.extend(batch.collect()), str(tmp_path / "checkpoint"))
    mine = [(r.outcome, r.consecutive_errors, r.action, r.wait_s) for r in found if r.worker == "a"]
    assert [x[2] for x in mine] == ["wait"] * 4 + ["go on"] * 2 + ["wait"] * 4 + ["stop"] and mine[-1] == ("error", 5, "stop", 0) and mine[4][1] == 4
    assert [(r.action, r["at"]) for r in found if r.worker == "b"] == [("wait", begin + timedelta(seconds=9)), ("retry", begin + timedelta(seconds=39))]


def files_of(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("part-*")}


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    sink = streams.append_once(path)
    rows = lambda a, b: spark.range(a, b).repartition(2)
    sink(rows(0, 10), 0)
    sink(rows(10, 15), 1)
    before = files_of(path)
    sink(rows(10, 15), 1)  # again, after a failure of the query's own commit
    sink(rows(0, 99), 0)
    assert files_of(path) == before
    rows(15, 18).write.parquet(f"{path}/batch_id=2")  # a batch that broke off before the ledger had it
    assert streams.appended(spark, path, "id long").count() == 15
    sink(rows(15, 20), 2)
    assert sorted(r.id for r in streams.appended(spark, path, "id long").collect()) == list(range(20))
    assert {(r.batch_id, r.n) for r in streams.ledger(spark, path).collect()} == {(0, 10), (1, 5), (2, 5)}
    sink(rows(0, 0), 3)
    assert streams.appended(spark, path, "id long").count() == 20 and streams.ledger(spark, path).count() == 4


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda ids, text: spark.createDataFrame([(i, i % 4, text, "keep") for i in ids], "id int, part int, path string, note string")
    assert sinks.upsert_partitions(rows(range(20), "old"), path, ["id", "part"], ["path"], "part") == [0, 1, 2, 3]
    before = files_of(path)
    assert sinks.upsert_partitions(rows([2, 6, 42], "new"), path, ["id", "part"], ["path"], "part") == [2]
    after = files_of(path)
    same = {name for name, text in after.items() if before.get(name) == text}
    assert {n.split("/")[0] for n in same} == {"part=0", "part=1", "part=3"} and same == {n for n in before if "part=2" not in n}
    got = {r.id: (r.part, r.path, r.note) for r in spark.read.parquet(path).collect()}
    assert got == {i: (i % 4, "new" if i in (2, 6, 42) else "old", "keep") for i in [*range(20), 42]}


def test_counts_move_with_changes(spark):
    clips = spark.createDataFrame([(i, f"v{i % 3}", ["approved", "pending", None][i % 4 % 3]) for i in range(40)], "clip_id int, video_id string, status string")
    videos = spark.createDataFrame([(f"v{i}",) for i in range(4)], "video_id string")
    after = clips.filter("clip_id <> 3 AND clip_id <> 8").withColumn("status", F.when(F.col("clip_id") % 5 == 0, "approved").otherwise(F.col("status"))).union(spark.createDataFrame([(99, "v3", "approved")], clips.schema))
    touched = "clip_id % 5 = 0 OR clip_id in (3, 8, 99)"
    changed = state.changes(clips.filter(touched), after.filter(touched))
    counted = state.adjusted(state.recounted(videos, clips), changed)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, state.recounted(videos, after).collect()))


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_numbers_are_written_as_they_are(spark, digits):
    """True ties go to the even digit, what only looks like one goes to its side."""
    rng = random.Random(digits)
    values = [0.125, 0.625, 0.375, 0.265, 0.145, 2.675, 380.25, 0.5, 1.5, -0.125, -2.5, 0.0, 0.04, -0.04, 999999.95, 1e12 + 0.5] + [rng.randrange(10**6) / 8 for _ in range(300)] + [rng.randrange(10**6) / 2000 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed(F.col("x"), digits).alias("s")).collect()
    assert [(r.x, r.s) for r in rows] == [(x, f"{x:.{digits}f}") for x in values]


def test_ties_in_reasons(spark):
    row = spark.createDataFrame([(0.125, 0.625)], "a double, b double")
    _, texts, _ = scoring.hard_filter(F.lit(5.0), F.col("a"), F.col("b"), F.lit(None).cast("double"), F.lit(1), F.lit("good"), F.lit(5), F.lit(True))
    assert row.select(texts.alias("t")).first().t == "intensity_low(0.12<0.80),face_coverage_low(0.62<0.70)"
    got = scoring.review_route(F.col("a"), F.col("b"), F.lit(""), F.lit("passed"), F.lit(False), F.lit(False))
    assert row.select(got["reasons"].alias("r")).first().r == ["ai_confidence=0.12 < 0.40"]


def test_ranked_scores(spark):
    """Equal scores stand in the order given; vectors without numbers score 0."""
    templates = {"x": [1.0, 0.0], "y": [0.0, 1.0, 5.0], "z": [0.0, 1.0]}
    rows = spark.createDataFrame([(1, [0.0, 3.0]), (2, None), (3, []), (4, [float("nan"), None]), (5, [3.0, 4.0, 0.0])], "id int, v array<double>").repartition(2)
    got = {r.id: [tuple(s) for s in r.scores] for r in scores.against_templates(rows, "v", templates).collect()}
    assert got[1] == [("y", 1.0), ("z", 1.0), ("x", 0.0)] and got[2] == got[3] == got[4] == [("x", 0.0), ("y", 0.0), ("z", 0.0)]
    assert got[5] == [("z", 0.8), ("x", 0.6), ("y", round(0.8 / 26**0.5, 4))]
    moved = scores.against_templates(rows.filter("id = 1"), "v", templates, means=[0.0, 3.0], deviations=[0.0, 2.0]).first()
    assert [s.score for s in moved.scores] == [0, 0, 0]
    mixed = vectors.blended(F.create_map(F.lit("a"), F.lit(0.5)), F.create_map(F.lit("b"), F.lit(0.5)), 0.5, ("a", "b", "c"))
    assert [tuple(x) for x in spark.range(1).select(vectors.ranked(mixed).alias("r")).first().r] == [("a", 0.5), ("b", 0.5), ("c", 0.0)]


def test_template_scores_are_sums_in_order_of_place():
    """Scores are, to the last digit, those of a loop over places, in a batch of any size: exact zeros and near ties rank alike."""
    draw = random.Random(5)
    rows = np.array([[round(draw.gauss(0, 0.12), 4) for _ in range(64)] for _ in range(300)])
    templates = [np.array([((i * (j + 2) + j) % 7 - 3) / 10 for i in range(n)]) for j, n in enumerate((74, 74, 40, 64))]

    def loop(x, y):
        n, total = min(len(x), len(y)), lambda values: reduce(add, values, 0.0)  # sum() of Python corrects its rounding
        whole, part, other = (total([v * v for v in z]) ** 0.5 for z in (x, x[:n], y[:n]))
        return max(0.0, total([a * b for a, b in zip(x[:n], y[:n], strict=True)]) / whole / (part / whole + 1e-8) / (other + 1e-8))

    got = scores.similarities(rows, templates)
    assert got.tolist() == [[loop(x.tolist(), y.tolist()) for y in templates] for x in rows]
    assert got[:3].tolist() == scores.similarities(rows[:3], templates).tolist()
    assert scores.similarities(np.zeros((2, 64)), templates).tolist() == [[0.0] * 4] * 2


def test_stacks_are_counted_without_aligning_twice(spark, monkeypatch):
    """tensor_stacks knows its splits' sizes from the ids, and clips are aligned in batches, not one call a clip."""
    written = tensors.write_stacks
    seen = {}

    def counted(clips, folder, **more):
        seen.update(more, plan=clips._jdf.queryExecution().optimizedPlan().toString())
        return written(clips, folder, **more)

    monkeypatch.setattr(tensors, "write_stacks", counted)
    assert plans.QUERIES["tensor_stacks"](spark, "/root/testdata/sf0.001").count() == 9
    assert {r.split: r["count"] for r in seen["sizes"].collect()}.keys() == {"train", "val", "test"}
    assert "FlatMapGroupsInArrow" not in seen["plan"] and "MapInArrow" in seen["plan"]
