"""Plans that must not grow a task with the data: what is shuffled, and what is not there."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cutroom import plans
from cutroom.operators import export, intervals, ranks, state


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_places_by_hash_blocks(spark):
    """Places in order of a hash, over all rows and within groups (null is one), equal to a sort; no window without a key, no sort of all rows."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g")).repartition(5)
    hash32 = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")
    for group in (None, "g"):
        placed = ranks.hashed(rows, hash32, "id", group)
        plan = plan_of(placed)
        assert "rangepartitioning" not in plan and plan.count("SinglePartition") == (group is None)  # then of block counts, 1,024 rows
        got = sorted((r.g is None, r.g, r.place, r.id, r.group_size) for r in placed.collect()) if group else sorted((r.place, r.id) for r in placed.collect())
        plain = [(r.g, r.h, r.id) for r in rows.select("g", hash32.alias("h"), "id").collect()]
        want = []
        for g in {x[0] for x in plain} if group else [None]:
            mine = sorted((h, i) for x, h, i in plain if not group or x == g)
            want += [(g is None, g, k, i, len(mine)) if group else (k, i) for k, (_, i) in enumerate(mine, 1)]
        assert got == sorted(want, key=lambda r: (r[0], r[1] or 0, *r[2:]) if group else r)


def test_splits_write_nothing_while_they_are_planned(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    rows = spark.range(500).select("id", (F.col("id") % 4).alias("label"), (F.col("id") % 50).alias("video"))
    before = jobs()
    split, grouped = export.stratified_split(rows, "label", "id"), export.group_split(rows, "video")
    assert jobs() == before
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert n == {"train": 4 * 87, "val": 4 * 18, "test": 4 * 20}
    assert grouped.groupBy("video").agg(F.count_distinct("split").alias("n")).filter("n <> 1").isEmpty()


def test_deltas_do_not_read_all_clips(spark, tmp_path):
    """The plan of moved counts has the videos and the changes, not the table of clips."""
    spark.range(100).select("id", (F.col("id") % 5).alias("video_id"), F.lit("pending").alias("status")).write.parquet(f"{tmp_path}/clips")
    clips = spark.read.parquet(f"{tmp_path}/clips").withColumnRenamed("id", "clip_id")
    assert clips.count() == 100
    videos = spark.createDataFrame([(i, 20, 0) for i in range(5)], "video_id long, total_clips long, approved_clips long")
    changed = spark.createDataFrame([(1, "pending", "approved", True, True), (2, "pending", None, True, False), (3, None, "approved", False, True)], "video_id long, old_status string, new_status string, had boolean, has boolean")
    moved = state.adjusted(videos, changed)
    assert "clips" not in plan_of(moved).replace("total_clips", "").replace("approved_clips", "")
    assert sorted(map(tuple, moved.collect())) == [(0, 20, 0), (1, 20, 1), (2, 19, 0), (3, 21, 1), (4, 20, 0)]


def test_steps_of_scores_are_worked_out_once_a_row(spark):
    """A blend's maps are made once for all labels, and a text is bared once for all phrases, not once for each place that names them."""
    of = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert of("blended_scores").count("map(happy") == 1
    assert of("lexicon_score").count("translate(") == 1


def test_tracks_are_no_interpreted_fold(spark):
    """Faces go to tracks clip by clip in batches, not in a fold that copies the list of what it found at each face."""
    frames = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 9.0, 9.0]), (1, 2, 0, [1.0, 0.0, 9.0, 9.0]), (1, 2, 1, None), (1, 6, 0, [0.0, 0.0, 9.0, 9.0]), (2, None, 0, [0.0, 0.0, 9.0, 9.0])], "clip long, frame long, face int, box array<double>")
    tracks = intervals.track_faces(frames, "clip")
    assert "aggregate(" not in plan_of(tracks)
    assert sorted((r.clip, r.frame or 0, r.face, r.track_id) for r in tracks.collect()) == [(1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 1, 1), (1, 6, 0, 2), (2, 0, 0, 0)]
