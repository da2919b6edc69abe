"""Frames of a run that lie closer together than the tolerance of a pairing, and gaps of exactly the tolerance."""

import os

import duckdb
import pytest
from scenespark.operators import joins as J
from scenespark.plans import registry

from test_queries import SF, TABLES, _rows

registry.load()


@pytest.fixture(scope="module")
def close(tmp_path_factory):
    """The smallest tables with an event each 30 ms, those of a run 30 and 90 ms apart; a connection over them."""
    path = tmp_path_factory.mktemp("close")
    con = duckdb.connect()
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    con.execute(f"copy (select * replace (timestamp '2024-03-01' + to_milliseconds(30 * event_id) as ts, (event_id // 2) % 2 as user_id) from '{SF}/events.parquet') to '{path}/events.parquet' (format parquet)")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    return str(path), con


def _same_as_sql(spark, close, name):
    path, con = close
    want = con.execute(registry.ORACLES[name]).fetchdf()
    assert len(want) and _rows(registry.QUERIES[name](spark, path).toPandas()) == _rows(want)


def test_an_estimate_asks_where_both_are_as_long(spark, close):
    _same_as_sql(spark, close, "j2_associated")
    ref = spark.createDataFrame([(1, 10.0, 1), (1, 10.05, 2)], "run_id int, t double, frame_id long")
    est = spark.createDataFrame([(1, 10.04, 1), (1, 10.3, 2)], "run_id int, t double, frame_id long")
    pairs = lambda r, e: sorted((p.ref_id, p.est_id) for p in J.associate_trajectories(r, e).collect())
    assert pairs(ref, est) == [(2, 1)]
    assert pairs(ref.filter("frame_id = 1"), est) == [(1, 1)] and pairs(ref, est.filter("frame_id = 1")) == [(2, 1)]


def test_pose_errors_are_those_of_a_frame_and_its_own_estimate(spark, close):
    _same_as_sql(spark, close, "a9_pose_error")


def test_rotation_errors_are_those_of_a_frame_and_its_own_estimate(spark, close):
    _same_as_sql(spark, close, "a9_rotation_error")


def test_runs_are_evaluated_frame_by_frame(spark, close):
    _same_as_sql(spark, close, "z2_evaluated_runs")


def test_a_gap_of_exactly_the_slop_is_decided_by_the_times_as_given(spark, tmp_path):
    """Events ten seconds apart, each with one 10 to 130 ms before it: many a message has one other within reach, at just 50 ms."""
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (timestamp '2024-03-01' + to_milliseconds(10000 * (event_id // 2) + (event_id % 2) * (10 + 20 * ((event_id // 2) % 7))) as ts) from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    _same_as_sql(spark, (str(tmp_path), con), "t3_synced")
