"""Queries over whole tables give every row, and places come without one window over all rows."""

import duckdb
from pyspark.sql import functions as F

from cutroom import plans
from cutroom.functions import text
from cutroom.operators import export, ranks

SF = "/root/testdata/sf0.001"


def _n(sql):
    return duckdb.sql(sql.replace("$", SF)).fetchall()[0][0]


def test_ranked_counts_over_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("x"))
    got = ranks.ranked(rows, [F.desc("x")])
    assert sorted((r.place, r.x) for r in got.collect()) == [(i + 1, 999 - i) for i in range(1000)]
    assert ranks.ranked(rows.limit(0), ["x"]).count() == 0


def test_quality_gate_sees_every_record(spark):
    n = _n("SELECT count(*) FROM '$/lineitem.parquet'")
    assert plans.QUERIES["quality_gate_all"](spark, SF).count() == n
    assert plans.QUERIES["quality_report_all"](spark, SF).count() == n
    rows = spark.createDataFrame([(1, "a", "x", 1.0, 2), (1, "a", "x", 1.0, 1), (2, "", None, 0.0, 1)], "clip_id int, final_emotion string, clip_path string, duration double, t int")
    got = {(r.clip_id, r.t): r.rejection_reasons for r in export.quality_gate(rows, ["t"]).collect()}
    assert got == {(1, 1): [], (1, 2): ["duplicate_clip_id"], (2, 1): ["missing_label", "missing_file", "invalid_duration"]}


def test_ordered_queries_keep_every_row(spark):
    clips, joined = _n("SELECT count(*) FROM '$/events.parquet'"), _n("SELECT count(*) FROM '$/events.parquet' JOIN '$/customer.parquet' ON user_id = c_custkey")
    queue = _n("SELECT count(*) FROM '$/orders.parquet' JOIN '$/customer.parquet' ON o_custkey = c_custkey")
    for name, n in (("multi_sort_all", clips), ("review_order_all", joined), ("queue_join_all", queue)):
        assert sorted(r.place for r in plans.QUERIES[name](spark, SF).collect()) == list(range(1, n + 1)), name
    assert len({r.status for r in plans.QUERIES["queue_join_all"](spark, SF).collect()}) == 3


def test_dedup_keeps_clips_of_other_ends_and_videos(spark):
    clips = [(1, "v", 1000, 4000, 0.5), (2, "v", 1040, 3960, 0.9), (3, "v", 1000, 4100, 0.1), (4, "w", 1000, 4000, 0.1), (5, "v", 3000, 4000, 0.1), (6, "v", 1010, 4010, 0.9)]
    rows = spark.createDataFrame(clips, "clip_id long, video_id string, start_ms long, end_ms long, intensity double").withColumns(export.same_span("start_ms", "end_ms"))
    got = export.best_of_key(rows, ["video_id", "start_ds", "end_ds"], "intensity", "clip_id").collect()
    assert sorted((r.clip_id, r.start_ms) for r in got) == [(2, 1040), (3, 1000), (4, 1000), (5, 3000)]
    assert {r.video_id for r in plans.QUERIES["dedup_max_key_all"](spark, SF).collect()} == {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}


def test_accents_go_in_every_language(spark):
    rows = spark.createDataFrame([("ÄÖÜß Straße",), ("naïve Åland āčēğ",), ("e\u0301 đ ø",), ("tiếng Việt",), (None,)], "text string")
    got = [r[0] for r in rows.select(text.strip_accents(F.col("text"))).collect()]
    assert got == ["aouß straße", "naive aland aceg", "e đ ø", "tieng viet", None]
    assert plans.QUERIES["strip_accents_all"](spark, SF).count() == _n("SELECT count(*) FROM '$/documents.parquet'")


def test_inbox_and_clean_vectors_are_whole(spark):
    unseen = "SELECT count(*) FROM '$/part.parquet' WHERE p_partkey NOT IN (SELECT l_partkey FROM '$/lineitem.parquet' WHERE l_quantity > 48)"
    assert plans.QUERIES["inbox_anti_all"](spark, SF).count() == _n(unseen)
    assert plans.QUERIES["nan_clean"](spark, SF).count() == _n("SELECT sum(len(embedding)) FROM '$/embeddings.parquet'")
