"""Queries of stream operators in batch form, file names and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import frustum as V
from ..operators import joins as J
from ..operators import reports as R
from ..session import new_path
from ..sources import readers
from ..sources.store import FoldedTable
from ..streaming import frames as S
from .fixtures import fixture, r6, tables
from .geometry_queries import SIZE, chunked, r
from .join_queries import _SEEN, _TOPIC_A, _TOPIC_B, FOV_X, FOV_Y, ZFAR, ZNEAR, topics
from .registry import query


@query("t1_admitted", tables("SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY run_id ORDER BY frame_id) AS n FROM {poses}) WHERE n <= 20"))
def t1(spark, sf_dir):
    return S.admit(fixture(spark, sf_dir, "poses"), "run_id", "frame_id", 20).select("frame_id")


def slow(spark, sf_dir):
    return fixture(spark, sf_dir, "poses").withColumn("t", F.col("t") / 1e5)


_GATE = """(WITH RECURSIVE p AS (SELECT run_id, frame_id, t / 1e5 AS t, tx, ty, tz, qw, qz, row_number() OVER (PARTITION BY run_id ORDER BY t, frame_id) AS n FROM {poses}),
g AS (SELECT run_id, frame_id, n, true AS kept, t, tx, ty, tz, qw, qz FROM p WHERE n = 1 UNION ALL
SELECT run_id, frame_id, n, ok, CASE WHEN ok THEN t ELSE lt END, CASE WHEN ok THEN tx ELSE lx END, CASE WHEN ok THEN ty ELSE ly END, CASE WHEN ok THEN tz ELSE lz END, CASE WHEN ok THEN qw ELSE lw END, CASE WHEN ok THEN qz ELSE lq END
FROM (SELECT p.*, g.t AS lt, g.tx AS lx, g.ty AS ly, g.tz AS lz, g.qw AS lw, g.qz AS lq, p.t - g.t >= 5e-1 AND (sqrt((p.tx - g.tx) * (p.tx - g.tx) + (p.ty - g.ty) * (p.ty - g.ty) + (p.tz - g.tz) * (p.tz - g.tz)) > 4 OR 2 * acos(least(1e0, abs(p.qw * g.qw + p.qz * g.qz))) > 1) AS ok FROM g JOIN p ON p.run_id = g.run_id AND p.n = g.n + 1))
SELECT run_id, frame_id, tx, ty, tz FROM g WHERE kept)"""


@query("t2_keyframe_gate", tables(f"SELECT run_id, frame_id FROM {_GATE}"))
def t2(spark, sf_dir):
    return S.select_keyframes(slow(spark, sf_dir), min_trans=4.0, min_rot=1.0).select("run_id", "frame_id")


def as_stream(df: DataFrame, end: dict):
    """A stream over the rows of a table, and a last one far ahead in time (``end``: its other columns) that lets all others out."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream")
    last = df.agg(F.max("event_time").alias("m")).select(*[(F.col("m") + F.expr("interval 1000 days")).alias(c) if c == "event_time" else F.lit(end.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    df.unionByName(last).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, what: str) -> DataFrame:
    """What a stream gives out of all that is there."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, what)
    stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, f"{what}-state")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def in_files(df: DataFrame, turn) -> DataFrame:
    """A stream over the rows of a table in three batches, those of turn 0 first."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream-files")
    for i in range(3):
        df.filter(turn == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained_into(writer) -> None:
    """Runs a writer until all that is there has been taken in."""
    writer.trigger(availableNow=True).start().awaitTermination()


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))).drop("t")


@query("t3_synced", tables(f"SELECT a_id, b_id FROM (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY round(abs(a.t - b.t) * 1e6), b.id) AS n FROM ({_TOPIC_A}) a JOIN ({_TOPIC_B}) b ON b.t BETWEEN a.t - 5e-2 AND a.t + 5e-2) WHERE n = 1"))
def t3(spark, sf_dir):
    a, b = (as_stream(timed(x.withColumn("seconds", F.col("t"))), {"id": -1, "seconds": 0.0}) for x in topics(spark, sf_dir))
    return drained(S.sync_streams(a, b, 0.05, seconds="seconds"), "synced").select("a_id", "b_id")


@query("t4_interpolated_poses", tables("SELECT e.run_id, e.frame_id, round(a.tx + (b.tx - a.tx) * (e.t - a.t) / (b.t - a.t), 4) AS tx, round(a.tz + (b.tz - a.tz) * (e.t - a.t) / (b.t - a.t), 4) AS tz FROM {poses_est} e JOIN (SELECT *, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS t_next, lead(frame_id) OVER (PARTITION BY run_id ORDER BY t) AS next_id FROM {poses}) a ON a.run_id = e.run_id AND a.t <= e.t AND e.t < a.t_next JOIN {poses} b ON b.frame_id = a.next_id WHERE b.t - e.t <= 20000 AND e.t - a.t <= 20000"))
def t4(spark, sf_dir):
    frames = as_stream(timed(fixture(spark, sf_dir, "poses_est").select("run_id", "t", "frame_id")), {"run_id": -1})
    poses = as_stream(timed(fixture(spark, sf_dir, "poses").select("run_id", "t", *S.POSE)), {"run_id": -1})
    out = drained(S.interpolate_pose_stream(frames, poses, 20000), "interpolated")
    return out.select("run_id", "frame_id", F.round("tx", 4).alias("tx"), F.round("tz", 4).alias("tz"))


@query("t5_stream_stops", tables("SELECT run_id, count(*) AS frames FROM (SELECT run_id, sum(CASE WHEN gap IS NULL OR gap > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t) AS session FROM (SELECT run_id, t, t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS gap FROM {poses})) GROUP BY run_id, session"))
def t5(spark, sf_dir):
    frames = as_stream(timed(fixture(spark, sf_dir, "poses").select("run_id", "t")), {"run_id": -1})
    return drained(S.stream_stop(frames, "run_id", "20000 seconds"), "stops").select("run_id", "frames")


@query("t6_latest_frame", tables("SELECT run_id, max_by(frame_id, t) AS frame_id FROM {poses} GROUP BY run_id"))
def t6(spark, sf_dir):
    frames = fixture(spark, sf_dir, "poses").select("run_id", "t", "frame_id")
    latest = FoldedTable(spark, new_path(spark, "latest"))
    latest.create(frames.limit(0))
    drained_into(S.latest_frame_stream(in_files(frames, F.col("frame_id") % 3), latest, new_path(spark, "latest-state"), "run_id", "t", "frame_id"))
    return latest.read().select("run_id", "frame_id")


@query("t7_applied_operations", tables(f"SELECT fid, {r6('max_by(tx, op_id)')} AS tx FROM {{operations}} WHERE op_type = 'LoopClosingBA' GROUP BY fid"))
def t7(spark, sf_dir):
    return S.apply_operations(fixture(spark, sf_dir, "keyframes"), fixture(spark, sf_dir, "operations")).select("fid", r(F.col("tx"), "tx"))


@query("t7_operation_stream", tables(f"SELECT fid, {r6('max_by(tx, op_id)')} AS tx FROM {{operations}} WHERE op_type <> 'ScaleRefinement' GROUP BY fid"))
def t7_stream(spark, sf_dir):
    """The feed in three batches, one after the other, merged into a table of keyframes."""
    keyframes = FoldedTable(spark, new_path(spark, "keyframes"))
    keyframes.create(fixture(spark, sf_dir, "keyframes").select("fid", *S.POSE))
    operations = fixture(spark, sf_dir, "operations")
    drained_into(S.operations_stream(in_files(operations, F.col("op_id") - 3 * F.col("fid")), keyframes, new_path(spark, "operations-state")))
    return keyframes.read().select("fid", r(F.col("tx"), "tx"))


@query("t1_admitted_stream", tables("SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY run_id, frame_id % 3 ORDER BY frame_id) AS n FROM {poses}) WHERE n <= 20"))
def t1_stream(spark, sf_dir):
    """Admission batch after batch: twenty frames of each run in each of three batches."""
    path = new_path(spark, "admitted")
    frames = in_files(fixture(spark, sf_dir, "poses").select("run_id", "frame_id"), F.col("frame_id") % 3)
    drained_into(S.admitted_stream(frames, path, new_path(spark, "admitted-state"), "run_id", "frame_id", 20))
    return spark.read.parquet(path).select("frame_id")


@query("t8_snapshots", tables("SELECT kfid FROM {frame_metrics} WHERE kfid % 1000 = 0"))
def t8(spark, sf_dir):
    return drained(S.snapshot_metrics(in_files(fixture(spark, sf_dir, "frame_metrics").select("kfid"), F.col("kfid") % 3), "kfid"), "snapshots").select("kfid")


@query("z5_keyframe_chunks", tables(f"SELECT run_id, frame_id, (CAST(floor((tx + 5) / 10) AS BIGINT) + 1048576) * 4398046511104 + (CAST(floor((ty + 5) / 10) AS BIGINT) + 1048576) * 2097152 + (CAST(floor((tz + 5) / 10) AS BIGINT) + 1048576) AS chunk_id FROM {_GATE}"))
def z5(spark, sf_dir):
    return S.keyframe_stream(slow(spark, sf_dir), SIZE, min_trans=4.0, min_rot=1.0).select("run_id", "frame_id", "chunk_id")


_KEPT = _GATE.replace("SELECT run_id, frame_id, tx, ty, tz FROM g", "SELECT frame_id AS fid, tx, ty, tz, qw, qz FROM g")


@query("z5_keyframe_views", tables(f"SELECT fid, count(*) AS n_chunks, count(*) FILTER (state = 'INSIDE') AS n_inside FROM {_SEEN.replace('{keyframes}', _KEPT)} WHERE state <> 'OUTSIDE' GROUP BY fid"))
def z5_views(spark, sf_dir):
    """What the keyframes that the gate lets through see of the map."""
    kept = S.keyframe_stream(slow(spark, sf_dir), SIZE, min_trans=4.0, min_rot=1.0).withColumnRenamed("frame_id", "fid")
    seen = V.visible_chunks(kept, C.distinct_chunks(chunked(spark, sf_dir)), SIZE, ZFAR, FOV_X, FOV_Y, ZNEAR)
    return seen.groupBy("fid").agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("state") == "INSIDE", 1)).alias("n_inside"))


_NAMES = "CASE WHEN event_id % 50 = 0 THEN 'broken' WHEN event_id % 3 = 0 THEN event_id || '_' || regexp_extract(props, '([0-9]+)', 1) || '_' || event_type || '.jpg' ELSE event_id || '_' || regexp_extract(props, '([0-9]+)', 1) || '.jpg' END"


@query("s9_render_names", f"SELECT CAST(regexp_extract(n, '^([0-9]+)_([0-9]+)', 1) AS BIGINT) AS iteration, CAST(regexp_extract(n, '^([0-9]+)_([0-9]+)', 2) AS BIGINT) AS kfid, regexp_extract(n, '^[0-9]+_[0-9]+_([a-z]+)', 1) AS suffix FROM (SELECT {_NAMES} AS n FROM events) WHERE n <> 'broken'")
def s9(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{_NAMES} AS n")
    return names.select(readers.parse_render_name(F.col("n")).alias("p")).filter("p is not null").select("p.*")


@query("j6_paired_renders", "SELECT event_id AS iteration, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) >= 20 GROUP BY event_id")
def j6(spark, sf_dir):
    renders = s9(spark, sf_dir)
    return J.pair_renders(renders, renders.filter("kfid >= 20").distinct()).groupBy("iteration").agg(F.count("*").alias("n"))


@query("s14_manifest_json", tables("SELECT chunk_id, n_points FROM {manifest}"))
def s14(spark, sf_dir):
    m = fixture(spark, sf_dir, "manifest")
    docs = m.groupBy((F.xxhash64("chunk_id") % max(7, m.count() // 1000)).alias("part")).agg(F.collect_list("chunk_id").alias("chunks_on_disk"), F.collect_list("n_points").alias("chunk_gaussian_counts"))
    docs = docs.select(F.to_json(F.struct("chunks_on_disk", "chunk_gaussian_counts")).alias("doc"))
    return docs.select(F.explode(readers.manifest_rows(F.col("doc"))).alias("m")).select("m.*")


@query("s18_discovered_runs", tables("SELECT DISTINCT event_type AS dataset, 'cam' || (run_id % 3) AS camera, CAST(run_id % 5 AS VARCHAR) AS trial, 'scene' || (run_id % 4) AS scene FROM {frame_metrics} WHERE event_type <> 'error'"))
def s18(spark, sf_dir):
    m = fixture(spark, sf_dir, "frame_metrics")
    paths = m.selectExpr("'/data/' || upper(event_type) || '_cam' || (run_id % 3) || '_' || (run_id % 5) || '/scene' || (run_id % 4) || '/eval.txt' AS path")
    return readers.discover_runs(paths, m.filter("event_type <> 'error'").selectExpr("event_type AS dataset").distinct())


@query("j18_run_report", tables(f"SELECT run_id, {r6('avg(psnr)')} AS psnr, {r6('avg(ssim)')} AS ssim, CASE WHEN run_id % 4 = 0 THEN NULL ELSE {r6('avg(render_ms)')} END AS time FROM {{frame_metrics}} GROUP BY run_id"))
def j18(spark, sf_dir):
    m = fixture(spark, sf_dir, "frame_metrics")
    quality = m.groupBy("run_id").agg(r(F.avg("psnr"), "psnr"), r(F.avg("ssim"), "ssim"))
    time = m.filter("run_id % 4 <> 0").groupBy("run_id").agg(r(F.avg("render_ms"), "time"))
    return R.run_report(m.select("run_id").distinct(), [quality, time], ["run_id"])


@query("z2_evaluated_runs", tables(f"SELECT run_id, {r6('avg(psnr)')} AS psnr, {r6('1000 / avg(render_ms)')} AS fps, pairs, {r6('ape_rmse')} AS ape_rmse FROM {{frame_metrics}} m LEFT JOIN (SELECT e.run_id, count(*) AS pairs, sqrt(avg((e.tx - p.tx) * (e.tx - p.tx) + (e.ty - p.ty) * (e.ty - p.ty) + (e.tz - p.tz) * (e.tz - p.tz))) AS ape_rmse FROM {{poses_est}} e JOIN {{poses}} p ON p.frame_id = e.frame_id AND abs(e.t - p.t) <= 1e-1 GROUP BY e.run_id) a USING (run_id) GROUP BY run_id, pairs, ape_rmse"))
def z2(spark, sf_dir):
    out = R.evaluate_runs(fixture(spark, sf_dir, "poses"), fixture(spark, sf_dir, "poses_est"), fixture(spark, sf_dir, "frame_metrics"), align_to=None)
    return out.select("run_id", r(F.col("psnr"), "psnr"), r(F.col("fps"), "fps"), "pairs", r(F.col("ape_rmse"), "ape_rmse"))


@query("z8_keyframe_results", tables(f"SELECT kfid, {r6('render_ms')} AS render_ms, {r6('(1 - ssim) / 2')} AS dssim, {r6('psnr')} AS psnr FROM {{frame_metrics}}"))
def z8(spark, sf_dir):
    return R.keyframe_results(fixture(spark, sf_dir, "frame_metrics")).select("kfid", *[r(F.col(c), c) for c in ("render_ms", "dssim", "psnr")])


@query("k8_point_lines", tables("SELECT printf('%.6f %.6f %.6f %d %d %d', x, y, z, CAST(floor(opacity * 255) AS INTEGER), CAST(floor(opacity * 255) AS INTEGER), CAST(floor(opacity * 255) AS INTEGER)) AS value FROM {points}"))
def k8(spark, sf_dir):
    from ..sources.writers import point_lines

    return point_lines(fixture(spark, sf_dir, "points").withColumns({c: F.col("opacity") for c in "rgb"}))
