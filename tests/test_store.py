"""Stored scenes and streams that are replayed, restarted and interrupted."""

import pytest
from pyspark.sql import functions as F
from scenespark import session
from scenespark.functions.geometry import with_chunk_id
from scenespark.operators import chunks as C
from scenespark.sources.store import FoldedTable, SceneStore
from scenespark.streaming import frames as S


@pytest.fixture
def scene(spark):
    points = with_chunk_id(spark.range(0, 5000, 1, 8).select(F.col("id").alias("gaussian_id"), (F.col("id") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") < 2000, 0.0).otherwise(F.col("id") % 7 * 10.0).alias("z")), 10.0)
    store = SceneStore(spark, session.new_path(spark, "scene"))
    store.create(points)
    return store


def test_moved_points_are_in_one_chunk_each(spark, scene):
    before = {r.gaussian_id: r.x for r in scene.points().collect()}
    some = F.col("gaussian_id") % 50 == 0
    moved = with_chunk_id(scene.points().drop("chunk_id").withColumn("x", F.when(some, F.col("x") + 25).otherwise(F.col("x"))), 10.0)
    n = scene.apply(moved)
    rows = scene.points().collect()
    assert len(rows) == 5000 == len({r.gaussian_id for r in rows}) and 0 < n <= scene.manifest().count()
    assert all(r.x == before[r.gaussian_id] + (25 if r.gaussian_id % 50 == 0 else 0) for r in rows)
    assert scene.points().exceptAll(with_chunk_id(scene.points().drop("chunk_id"), 10.0).select(scene.points().columns)).count() == 0
    counts = {r.chunk_id: r.n_points for r in scene.manifest().collect()}
    assert counts == {r.chunk_id: r.n_points for r in C.chunk_counts(scene.points()).collect()}
    assert scene.apply(scene.points()) == 0  # nothing differs, nothing is written


def test_a_change_rewrites_only_its_chunks_and_can_empty_them(spark, scene):
    version = scene.last().version
    gone = scene.points().filter("x >= 95").select("chunk_id").distinct().count()
    assert scene.apply(C.delete_where(scene.points(), F.col("x") >= 95)) == gone
    held = scene.manifest().filter(F.col("held_by") == version + 1).count()
    assert held <= gone < scene.manifest().count() and scene.points().filter("x >= 95").count() == 0
    assert scene.apply(scene.points().limit(0)) > 0 and scene.points().count() == 0 and scene.manifest().count() == 0


def test_files_without_a_commit_are_never_read(spark, scene):
    half = scene._data(scene.last().version + 1)
    scene.points().limit(7).write.parquet(half)  # a writer that died before its commit
    assert scene.points().count() == 5000
    scene.apply(C.delete_where(scene.points(), F.col("gaussian_id") < 10))
    assert scene.points().count() == 4990 and scene.points().agg(F.min("gaussian_id")).first()[0] == 10


def test_ids_are_given_out_once(spark, scene):
    new = with_chunk_id(spark.range(0, 300, 1, 4).select((F.col("id") % 90).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("id").cast("double").alias("z")), 10.0)
    assert scene.add(new, ["z"]) == 300
    scene.apply(C.delete_where(scene.points(), F.col("gaussian_id") >= 5200))
    assert scene.add(new, ["z"]) == 300 and scene.last().next_id == 5600
    ids = sorted(r.gaussian_id for r in scene.points().collect())
    assert len(ids) == len(set(ids)) and ids[-300:] == list(range(5300, 5600))


def _feed(spark, path, lo, hi):
    rows = [(i % 10, i, "LocalBA" if i % 3 else "LoopClosingBA", float(i)) for i in range(lo, hi)]
    df = spark.createDataFrame(rows, "fid long, op_id long, op_type string, tx double").withColumns({c: F.lit(0.0) for c in ("ty", "tz", "qx", "qy", "qz")} | {"qw": F.lit(1.0)})
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_a_repeated_batch_and_a_restart_change_nothing(spark):
    path, state = session.new_path(spark, "feed"), session.new_path(spark, "state")
    table = FoldedTable(spark, session.new_path(spark, "keyframes"))
    first = _feed(spark, path, 0, 20)
    table.create(first.select("fid", *S.POSE).limit(0))
    stream = spark.readStream.schema(first.schema).parquet(path)
    run = lambda: S.operations_stream(stream, table, state).trigger(availableNow=True).start().awaitTermination()
    run()
    want = {f: max(o for o in range(20) if o % 10 == f and o % 3 == 0) if any(o % 10 == f and o % 3 == 0 for o in range(20)) else max(o for o in range(20) if o % 10 == f) for f in range(10)}
    known = lambda: {r.fid: r.tx for r in table.read().collect()}
    assert known() == want
    version = table.last().version
    fold = lambda t, b: S.apply_operations(t, b).drop("state")
    assert not table.merge(_feed(spark, session.new_path(spark, "again"), 0, 20).withColumn("tx", F.lit(-1.0)), table.last().batch, fold) and known() == want
    run()  # restart from the checkpoint: nothing new
    assert table.last().version == version
    _feed(spark, path, 20, 25)
    run()
    assert {f: x for f, x in known().items() if f < 5} == {f: 20.0 + f for f in range(5)} and {f: x for f, x in known().items() if f > 4} == {f: x for f, x in want.items() if f > 4}


def test_admission_overwrites_its_own_batch(spark):
    path, state, out = (session.new_path(spark, n) for n in ("frames", "state", "admitted"))
    frames = spark.range(0, 100, 1, 4).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("frame_id"))
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    S.admitted_stream(stream, out, state, "run_id", "frame_id", 5).trigger(availableNow=True).start().awaitTermination()
    S.admit(frames, "run_id", "frame_id", 5).write.mode("overwrite").parquet(f"{out}/batch=0")  # the batch once more
    assert sorted(r.frame_id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_scratch_removes_its_tables(spark):
    with session.scratch(spark):
        kept = session.cut(spark.range(10), "scratch")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 10 and session.exists(spark, path)
    assert not session.exists(spark, path)
