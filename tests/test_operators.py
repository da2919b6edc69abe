"""Closed-form cases of geometry, joins, files and streams."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenespark.functions import geometry as G
from scenespark.operators import chunks as C
from scenespark.operators import images, joins
from scenespark.operators import trajectory as T
from scenespark.sources import readers, writers
from scenespark.streaming import frames as S


def test_chunk_ids_round_trip_and_reject(spark):
    cells = [(0, 0, 0), (-1, 0, 0), (1048575, 1048575, 1048575), (-1048576, -1048576, -1048576)]
    df = spark.createDataFrame(cells, "cx long, cy long, cz long")
    back = df.select("cx", "cy", "cz", G.chunk_decode(G.chunk_encode(F.struct("cx", "cy", "cz"))).alias("d")).collect()
    assert all((r.cx, r.cy, r.cz) == tuple(r.d) for r in back)
    edge = spark.createDataFrame([(5.0, -5.0, 4.999)], "x double, y double, z double").select(G.chunk_coord("x", "y", "z", 10.0).alias("c")).first().c
    assert tuple(edge) == (1, 0, 0)
    with pytest.raises(ValueError):
        G.chunk_coord("x", "y", "z", 0)
    with pytest.raises(Exception, match="out of range"):
        df.select(G.chunk_encode(F.struct((F.col("cx") + 1).alias("cx"), "cy", "cz"))).collect()


def test_half_turns_about_each_axis(spark):
    for axis in "xyz":
        q = {"w": 0.0, "x": 0.0, "y": 0.0, "z": 0.0, axis: 1.0}
        m = G.quat_to_matrix(G.quat(*[F.lit(q[a]) for a in "wxyz"]))
        back = spark.range(1).select(G.matrix_to_quat(m).alias("q")).first().q
        assert abs(abs(back[axis]) - 1) < 1e-12


def test_alignment_recovers_a_similarity(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(10, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    r = 2.5 * e @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [1, 2, 3]
    pairs = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(r, e, strict=True)], "run_id long, rx double, ry double, rz double, ex double, ey double, ez double")
    assert abs(T.umeyama(pairs).first().scale - 2.5) < 1e-9
    assert T.ape(pairs, "translation", "similarity").first().rmse < 1e-9


def test_asof_tolerance_and_ties(spark):
    left = spark.createDataFrame([(0, 1.0)], "lid long, t double")
    right = spark.createDataFrame([(5, 0.5), (3, 1.5)], "rid long, t double")
    assert joins.asof_nearest(left, right, "t", 0.5).count() == 0
    assert joins.asof_nearest(left, right, "t", 0.5, strict=False).first().rid == 3


def test_lru_crossing_row(spark):
    chunks = spark.createDataFrame([(1, 10, 5.0), (2, 10, None), (3, 10, 1.0)], "chunk_id long, n_points long, last_access double")
    ids = lambda n: sorted(r.chunk_id for r in C.lru_evict(chunks, n).collect())
    assert ids(0) == [] and ids(10) == [2] and ids(11) == [2, 3] and ids(1000) == [1, 2, 3]


def test_image_measures(spark):
    rows = [(1, v, u, 0.5, 0.6) for v in range(12) for u in range(12)]
    pairs = spark.createDataFrame(rows, "frame_id long, v long, u long, a double, b double")
    assert abs(images.psnr(pairs).first().psnr - 20) < 1e-9
    assert abs(images.ssim(pairs.withColumn("b", F.col("a"))).first().ssim - 1) < 1e-9


def _tensor(values, kind: int, dtype: str, shape: tuple) -> bytes:
    data = np.asarray(values, dtype).tobytes()
    return struct.pack("<I8IIQ", len(shape), *shape, *[0] * (8 - len(shape)), kind, len(data)) + data


def _chunk(count=2, magic=0x43484E4B) -> bytes:
    shapes = [(2, 3), (2, 1, 3), (2, 15, 3), (2, 3), (2, 4), (2, 1)]
    out = struct.pack("<IIqI", magic, 1, 77, count)
    for s in shapes:
        out += _tensor(np.arange(np.prod(s)), 6, "<f4", s)
    return out + _tensor([1, 2], 3, "<i4", (2,)) + _tensor([0.5, 0.25], 6, "<f4", (2,)) + _tensor([10, 11], 4, "<i8", (2,))


def test_chunk_import(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(_chunk())
    rows = readers.import_chunks(spark, str(tmp_path / "*.bin")).orderBy("gaussian_id").collect()
    assert [(r.chunk_id, r.gaussian_id, r.exist_since, r.xyz) for r in rows] == [(77, 10, 1, [0.0, 1.0, 2.0]), (77, 11, 2, [3.0, 4.0, 5.0])]
    assert len(readers.parse_chunk(_chunk(count=3))) == 0
    with pytest.raises(ValueError):
        readers.parse_chunk(_chunk(magic=1))
    with pytest.raises(ValueError):
        readers.parse_chunk(_chunk(), expected=5)


def test_trajectory_files_round_trip(spark, tmp_path):
    poses = spark.createDataFrame([(float(i), i * 0.5, 1.0, -2.0, 0.0, 0.0, math.sin(i / 10), math.cos(i / 10)) for i in range(20)], "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    writers.write_tum(poses, str(tmp_path / "tum"))
    back = readers.read_tum(spark, str(tmp_path / "tum")).orderBy("ts").collect()
    assert len(back) == 20 and abs(back[7].qz - math.sin(0.7)) < 1e-8
    writers.write_kitti(poses.coalesce(1), str(tmp_path / "kitti"))
    parts = sorted((tmp_path / "kitti").glob("part-*"))
    (tmp_path / "all.txt").write_text("".join(p.read_text() for p in parts))
    rows = readers.read_kitti(spark, str(tmp_path / "all.txt")).orderBy("line").collect()
    assert len(rows) == 20 and abs(rows[7].qz - math.sin(0.7)) < 1e-8 and rows[3].tx == 1.5


def test_scene_round_trip(spark, tmp_path):
    cams = spark.createDataFrame([(1, "a.png", 10, 8, 5.0, 5.0, 5.0, 4.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.6, 0.0, 1.0, 2.0, 3.0)], "id long, img_name string, width int, height int, fx double, fy double, cx double, cy double, k1 double, k2 double, p1 double, p2 double, k3 double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "gaussian_id long, chunk_id long")
    writers.save_scene(points, cams, 2.5, str(tmp_path / "s"))
    got = readers.read_cameras_json(spark, str(tmp_path / "s/cameras")).first()
    assert abs(got.qw - 0.8) < 1e-9 and abs(got.tx - 1) < 1e-9 and got.k1 == 0.1
    assert readers.read_extent(spark, str(tmp_path / "s/cameras_extent")).first().extent == 2.5
    writers.save_chunks(spark.createDataFrame([(9, 6)], "gaussian_id long, chunk_id long"), str(tmp_path / "s/chunks"))
    assert sorted(r.gaussian_id for r in spark.read.parquet(str(tmp_path / "s/chunks")).collect()) == [1, 2, 9]


def test_logs_and_artifacts(spark, tmp_path):
    (tmp_path / "used.txt").write_text("## Iteration 100 times\n1 2 3\n4 5 6\n## Iteration 200 times\n1 3 2\n")
    assert [tuple(r) for r in readers.read_used_times(spark, str(tmp_path / "used.txt")).orderBy("iteration", "kfid").collect()] == [(100, 1, 2, 3), (100, 4, 5, 6), (200, 1, 3, 2)]
    run = tmp_path / "r" / "TUM_mono_0" / "desk"
    run.mkdir(parents=True)
    (run / "eval.txt").write_text("psnr: 20.5\nssim: 0.75\n")
    (run / "notes.txt").write_text("psnr: 1.0\n")
    rows = {r.key: r.value for r in readers.read_run_artifacts(spark, str(tmp_path / "r")).filter("dataset = 'tum' and scene = 'desk'").collect()}
    assert rows == {"psnr": 20.5, "ssim": 0.75}
    (tmp_path / "frames").mkdir()
    for n in ("frame000012.jpg", "1305031102.175304.png"):
        (tmp_path / "frames" / n).write_bytes(b"x")
    assert sorted(r.ts for r in readers.list_frames(spark, str(tmp_path / "frames"), "tum").collect()) == [12.0, 1305031102.175304]


def test_gate_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(r, i, i * 0.2, i * 0.1 * (r + 1), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for r in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id long, frame_id long, t double, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    want = sorted((r.run_id, r.frame_id) for r in S.select_keyframes(df).collect())
    for k in range(3):
        df.filter((F.col("frame_id") >= 10 * k) & (F.col("frame_id") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.select_keyframes_stream(source).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.run_id, r.frame_id) for r in spark.table("gate").collect()) == want


def _files(df, path, column, cuts):
    """The rows of a table in several files, one range of a column each."""
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        df.filter((F.col(column) >= lo) & (F.col(column) < hi)).coalesce(1).write.mode("append").parquet(path)


def _out_of(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


def test_two_streams_are_synced_as_tables_are(spark, tmp_path):
    rng = np.random.default_rng(6)
    times = np.sort(rng.uniform(0, 60, 200))
    schema = "id long, s double"
    stamp = F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("event_time")
    a = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], schema).select("id", "s", stamp)
    b = spark.createDataFrame([(i, float(t + rng.normal() * 0.08)) for i, t in enumerate(times)], schema).select("id", "s", stamp)
    want = sorted((r.a_id, r.b_id) for r in S.sync_streams(a, b, 0.1).collect())
    ta, tb = ({r.id: r.event_time.timestamp() for r in x.collect()} for x in (a, b))
    plain = []
    for i, t in ta.items():
        near = min((round(abs(t - u), 6), k) for k, u in tb.items())
        plain += [(i, near[1])] if near[0] <= 0.1 else []
    assert want == sorted(plain) and 100 < len(want) < 200
    end = spark.createDataFrame([(-1, 9e5)], schema).select("id", "s", stamp)
    streams = []
    for name, x in (("a", a), ("b", b)):
        _files(x, str(tmp_path / name), "s", [-10, 15, 30, 45, 100])
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name)).select("id", "event_time"))
    got = sorted((r.a_id, r.b_id) for r in _out_of(S.sync_streams(*streams, 0.1, "100 seconds"), "synced", str(tmp_path / "c")))
    assert got == want


def test_poses_are_interpolated_on_streams_as_in_tables(spark, tmp_path):
    pose = ", ".join(f"{c} double" for c in S.POSE)
    stamp = F.timestamp_micros(((F.col("t") + 1000) * 1e6).cast("long")).alias("event_time")  # a stream begins with its watermark at 0
    turn = lambda t: (math.cos(t / 8), 0.0, 0.0, math.sin(t / 8))
    poses = spark.createDataFrame([(run, t, t * 2.0, 1.0, -t, *turn(t)) for run in (1, 2) for t in (0.0, 1.0, 2.0, 5.0, 5.4)], f"run_id long, t double, {pose}")
    frames = spark.createDataFrame([(run, float(t), int(10 * t) + 1000 * run) for run in (1, 2, 3) for t in (0.3, 1.0, 1.7, 2.3, 4.8, 5.2, 6.0)], "run_id long, t double, frame_id long")
    names = ["run_id", "frame_id", *S.POSE]
    cells = lambda rows: sorted(tuple(round(float(r[c]), 6) for c in names) for r in rows)
    want = cells(joins.interpolate_pose(frames, poses, 1.0).collect())
    assert {r[1] for r in want} == {1003.0, 1010.0, 1017.0, 1048.0, 1052.0, 2003.0, 2010.0, 2017.0, 2048.0, 2052.0}
    table = S.interpolate_pose_stream(frames.withColumn("event_time", stamp), poses.withColumn("event_time", stamp), 1.0, 10.0).collect()
    assert cells(table) == want
    streams = []
    for name, x in (("f", frames), ("p", poses)):
        end = x.limit(1).withColumns({"run_id": F.lit(-1).cast("long"), "t": F.lit(9e5)})
        x, end = (y.withColumn("event_time", stamp) for y in (x, end))
        _files(x, str(tmp_path / name), "t", [-1, 1.5, 3, 100])
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = _out_of(S.interpolate_pose_stream(*streams, 1.0, 10.0, "100 seconds"), "interpolated", str(tmp_path / "c"))
    assert cells(got) == want


def test_structure_blur_and_loss_against_plain_sums(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random((9, 13)), rng.random((9, 13))
    pairs = spark.createDataFrame([(1, v, u, float(a[v, u]), float(b[v, u])) for v in range(9) for u in range(13)], "frame_id long, v long, u long, a double, b double")
    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    w = np.outer(g, g) / g.sum() ** 2

    def blur(m):
        padded = np.pad(m, 5)
        return np.array([[(w * padded[v : v + 11, u : u + 11]).sum() for u in range(13)] for v in range(9)])

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    want = (((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
    assert images.ssim(pairs).first().ssim == pytest.approx(want)
    depth = images.depth_errors(pairs.withColumns({"a": F.col("a") + 1, "b": F.col("b") + 1}))
    inverse = np.abs(1 / (a + 1) - 1 / (b + 1)).mean()
    assert images.frame_loss(pairs, depth).first().loss == pytest.approx(0.8 * np.abs(a - b).mean() + 0.2 * (1 - want) + 0.1 * inverse)
    even = a[:8, :12]
    half = even.reshape(4, 2, 6, 2).mean(axis=(1, 3))

    def read(v, u):
        v, u = min(max((v + 0.5) / 2 - 0.5, 0), 3), min(max((u + 0.5) / 2 - 0.5, 0), 5)
        v0, u0 = min(int(v), 2), min(int(u), 4)
        dv, du = v - v0, u - u0
        return (1 - dv) * ((1 - du) * half[v0, u0] + du * half[v0, u0 + 1]) + dv * ((1 - du) * half[v0 + 1, u0] + du * half[v0 + 1, u0 + 1])

    for r in images.blur_pool(pairs.filter("v < 8 and u < 12").select("frame_id", "v", "u", F.col("a").alias("x")), "x").collect():
        assert r.x == pytest.approx(read(r.v, r.u))


def test_every_camera_of_many_parts_comes_back(spark, tmp_path):
    names = "id long, img_name string, width int, height int, fx double, fy double, cx double, cy double, k1 double, k2 double, p1 double, p2 double, k3 double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
    cams = spark.createDataFrame([(i, "a\n}\n{b.png", 10, 8, 5.0, 5.0, 5.0, 4.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.6, 0.0, float(i), 2.0, 3.0) for i in range(23)], names).repartition(5)
    writers.save_scene(spark.createDataFrame([(1, 5)], "gaussian_id long, chunk_id long"), cams, 1.0, str(tmp_path / "s"))
    got = readers.read_cameras_json(spark, str(tmp_path / "s/cameras")).collect()
    assert sorted(r.id for r in got) == list(range(23)) and all(abs(r.tx - r.id) < 1e-9 for r in got)
    cams.select("id", "img_name").filter("id < 3").coalesce(1).write.json(str(tmp_path / "lines"))
    assert readers.read_cameras_json(spark, str(tmp_path / "lines")).count() == 3


def test_scans_carry_state_over_batches(spark):
    from scenespark.operators import schedule

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(r, i, float(i % 5)) for r in range(3) for i in range(50)], "run long, i long, x double").repartition(6)
        got = {(r.run, r.i): r.ema for r in schedule.ema(df, "run", "i", "x").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in range(3):
        now = 0.0
        for i in range(50):
            now = 0.4 * (i % 5) + 0.6 * now
            assert got[run, i] == pytest.approx(now)


def test_a_popular_point_is_split_into_blocks(spark):
    seen = spark.createDataFrame([(f, p) for f in range(40) for p in range(3)] + [(1, 9), (2, 9)], "fid long, point_id long")
    pairs = lambda block: sorted((r.a, r.b, r.weight) for r in joins.covisibility(seen, 3, block=block).collect())
    assert pairs(7) == pairs(1000) == sorted((a, b, 4 if (a, b) == (1, 2) else 3) for a in range(40) for b in range(a + 1, 40))
