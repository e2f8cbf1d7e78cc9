"""Every registered query against DuckDB on the smallest tables; those without SQL against small cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cutroom import plans
from cutroom.operators import intervals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    wanted = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).collect() is not None


def test_enforced_keeps_lengths(spark):
    """Pieces are of allowed length, in order, inside their segment; short segments stay as they are."""
    rows = plans.QUERIES["enforce_duration"](spark, SF).collect()
    assert all(r.end - r.start <= 12000 for r in rows)
    by_clip = {}
    for r in sorted(rows, key=lambda r: (r.clip_id, r.start)):
        assert by_clip.get(r.clip_id, r.start) <= r.start
        by_clip[r.clip_id] = r.end


def test_tracks(spark):
    """A box that moves a little keeps its track; one elsewhere, or back after four frames, starts another."""
    boxes = [(1, 0, [0, 0, 10, 10]), (1, 1, [50, 50, 60, 60]), (2, 0, [1, 0, 11, 10]), (7, 0, [1, 0, 11, 10])]
    frames = spark.createDataFrame([("v", f, i, [float(x) for x in b]) for f, i, b in boxes], "video_id string, frame int, face int, box array<double>")
    got = {(r.frame, r.face): r.track_id for r in intervals.track_faces(frames, "video_id").collect()}
    assert got[(1, 0)] == got[(2, 0)] != got[(1, 1)]
    assert got[(7, 0)] not in {got[(1, 0)], got[(1, 1)]}


def test_long_intervals_meet_once(spark):
    """A pair that shares many buckets comes once; intervals of length 0 and other keys meet nothing."""
    a = spark.createDataFrame([("v", 1, 0, 500_000), ("w", 2, 0, 10), ("v", 3, 5, 5)], "k string, a_id int, a_start long, a_end long")
    b = spark.createDataFrame([("v", 10_000, 400_000)], "k string, b_start long, b_end long")
    got = intervals.overlap_join(a, b, "k").select("a_id", F.col("b_start")).collect()
    assert sorted((r.a_id, r.b_start) for r in got if r.b_start is not None) == [(1, 10_000)]
    assert sorted(r.a_id for r in got) == [1, 2, 3]
