"""Files written from the given tables into the shared folder and read back."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import reports as R
from ..operators import schedule
from ..operators.chunks import chunk_counts
from ..operators.ranges import numbered_within
from ..session import new_path
from ..sources import readers, writers
from .fixtures import fixture, r6, tables
from .geometry_queries import chunked, r
from .registry import query

LINES = 5000


def _poses(spark, sf_dir):
    return fixture(spark, sf_dir, "poses").withColumnRenamed("t", "ts")


@query("s1_tum_files", tables(f"SELECT run_id, {r6('t')} AS ts, {r6('tx')} AS tx, {r6('tz')} AS tz, {r6('qw')} AS qw, {r6('qz')} AS qz FROM {{poses}}"))
def s1(spark, sf_dir):
    path = new_path(spark, "tum")
    writers.write_tum(_poses(spark, sf_dir), path, "run_id")
    back = readers.read_tum(spark, path)
    return back.select(F.col("run_id").cast("long").alias("run_id"), *[r(F.col(c), c) for c in ("ts", "tx", "tz", "qw", "qz")])


@query("s2_kitti_files", tables(f"SELECT {r6('tx')} AS tx, {r6('ty')} AS ty, {r6('tz')} AS tz, {r6('abs(qw)')} AS qw, {r6('abs(qz)')} AS qz FROM {{poses}}"))
def s2(spark, sf_dir):
    path = new_path(spark, "kitti")
    writers.write_kitti(_poses(spark, sf_dir), path)
    back = readers.read_kitti(spark, path)
    return back.select(*[r(F.col(c), c) for c in ("tx", "ty", "tz")], *[r(F.abs(c), c) for c in ("qw", "qz")])


@query("s2_kitti_sequences", tables("SELECT run_id, count(*) AS n, count(DISTINCT line) AS lines, " + r6("sum(2e-1 * line + run_id)") + " AS sum_ts FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t, frame_id) - 1 AS line FROM {poses}) GROUP BY run_id"))
def s2_sequences(spark, sf_dir):
    """Each run a sequence of its own, poses in a file of its name and times in a folder of its name."""
    path = new_path(spark, "kitti-sequences")
    rows = numbered_within(_poses(spark, sf_dir).select("run_id", "ts", "frame_id"), ["run_id"], ["ts", "frame_id"], "line")
    line = F.concat(F.lit("1 0 0 "), F.col("line").cast("string"), F.lit(" 0 1 0 0 0 0 1 0"))
    time = F.format_string("%.6f", 0.2 * F.col("line") + F.col("run_id"))
    for name, value in (("poses", line), ("times", time)):
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", value.alias("v")))), lambda x: x["v"]), "\n")
        files = rows.groupBy("run_id").agg(text.cast("binary").alias("content"))
        run = F.col("run_id").cast("string")
        writers.write_files(files.select((F.concat(F.lit("poses/"), run, F.lit(".txt")) if name == "poses" else F.concat(F.lit("sequences/"), run, F.lit("/times.txt"))).alias("name"), "content"), path)
    times = readers.read_times(spark, readers.files_below(spark, f"{path}/sequences", "*", "times.txt"))
    back = readers.read_kitti(spark, readers.files_below(spark, f"{path}/poses", "*.txt"), times)
    return back.groupBy(F.col("sequence").cast("long").alias("run_id")).agg(F.count("*").alias("n"), F.countDistinct("tx").alias("lines"), r(F.sum("ts"), "sum_ts"))


_C, _S = "(1 - 2 * qz * qz)", "(2 * qw * qz)"


@query("s3_replica_files", tables(f"SELECT {r6('tx')} AS tx, {r6('ty')} AS ty, {r6('abs(qw)')} AS qx, {r6('abs(qz)')} AS qy FROM {{poses}}"))
def s3(spark, sf_dir):
    path = new_path(spark, "replica")
    cells = [_C, f"-{_S}", "0e0", "tx", _S, _C, "0e0", "ty", "0e0", "0e0", "1e0", "tz", "0e0", "0e0", "0e0", "1e0"]
    line = F.concat_ws(" ", *[F.format_string("%.12f", F.expr(c).cast("double")) for c in cells])
    writers.write_documents(writers.documents(_poses(spark, sf_dir), line, ["frame_id"], LINES), path)
    back = readers.read_replica(spark, path)
    return back.select(*[r(F.col(c), c) for c in ("tx", "ty")], *[r(F.abs(c), c) for c in ("qx", "qy")])


@query("s4_euroc_files", tables(f"SELECT {r6('CAST(round(t * 1e9) AS BIGINT) / 1e9')} AS ts, {r6(f'tx + 1e-1 * {_C} - 2e-1 * {_S}')} AS tx, {r6(f'ty + 1e-1 * {_S} + 2e-1 * {_C}')} AS ty, {r6('tz + 3e-1')} AS tz FROM {{poses}}"))
def s4(spark, sf_dir):
    path = new_path(spark, "euroc")
    line = F.concat_ws(",", F.round(F.col("ts") * 1e9).cast("long"), *[F.format_string("%.12f", c) for c in ("tx", "ty", "tz", "qw", "qx", "qy", "qz")])
    writers.write_documents(writers.documents(_poses(spark, sf_dir), line, ["frame_id"], LINES, "#timestamp,p,q\n"), path)
    back = readers.read_euroc(spark, path, [1, 0, 0, 0.1, 0, 1, 0, 0.2, 0, 0, 1, 0.3, 0, 0, 0, 1])
    return back.select(*[r(F.col(c), c) for c in ("ts", "tx", "ty", "tz")])


@query("s5_association_files", tables(f"SELECT {r6('t')} AS ts, 'rgb/' || frame_id || '.png' AS rgb, 'depth/' || frame_id || '.png' AS depth FROM {{poses}}"))
def s5(spark, sf_dir):
    path = new_path(spark, "associations")
    line = F.expr("concat_ws(' ', format_string('%.6f', ts), concat('rgb/', frame_id, '.png'), format_string('%.6f', ts + 0.01), concat('depth/', frame_id, '.png'))")
    writers.write_documents(writers.documents(_poses(spark, sf_dir), line, ["frame_id"], LINES), path)
    return readers.read_associations(spark, path).select(r(F.col("ts"), "ts"), "rgb", "depth")


@query("s6_rgb_lists", tables(f"SELECT {r6('t')} AS ts, 'rgb/' || frame_id || '.png' AS rgb FROM {{poses}}"))
def s6(spark, sf_dir):
    path = new_path(spark, "rgb")
    line = F.expr("concat(format_string('%.6f', ts), ' rgb/', frame_id, '.png')")
    writers.write_documents(writers.documents(_poses(spark, sf_dir), line, ["frame_id"], LINES, "colour images\nfile\n1.0 no/image.png\n"), path)
    return readers.read_rgb_list(spark, path).select(r(F.col("ts"), "ts"), "rgb")


@query("s7_frame_names", "SELECT CAST(s_suppkey AS DOUBLE) AS ts FROM supplier")
def s7(spark, sf_dir):
    path = new_path(spark, "frames")
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.format_string("frame%06d.jpg", "s_suppkey").alias("name"), F.lit(b"x").alias("content"))
    writers.write_files(names, path)
    return readers.list_frames(spark, path, "replica").select("ts")


def _png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@query("s8_images", tables(f"SELECT frame_id, v, u, {r6('floor(val * 255) / 255')} AS r, {r6('(255 - floor(val * 255)) / 255')} AS g, {r6('floor(val * 100) / 255')} AS b FROM {{pixels}}"))
def s8(spark, sf_dir):
    path = new_path(spark, "images")

    def draw(batches):
        for pdf in batches:
            rows = []
            for vec_id, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                val = (np.asarray(e[:64], float).reshape(8, 8) + 1) / 2
                red = np.floor(val * 255)
                rows.append((f"{vec_id}.png", _png(np.stack([red, 255 - red, np.floor(val * 100)], axis=2).astype(np.uint8))))
            yield pd.DataFrame(rows, columns=["name", "content"])

    writers.write_files(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(draw, "name string, content binary"), path)
    frame = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long")
    return readers.read_images(spark, path).select(frame.alias("frame_id"), "v", "u", *[r(F.col(c), c) for c in "rgb"])


@query("s10_keyframe_metrics", tables(f"SELECT kfid, {r6('psnr')} AS psnr FROM {{frame_metrics}}"))
def s10(spark, sf_dir):
    path = new_path(spark, "kf-metric")
    line = F.expr("concat(kfid, ' ', format_string('%.9f', psnr))")
    writers.write_documents(writers.documents(fixture(spark, sf_dir, "frame_metrics"), line, ["kfid"], LINES, "## psnr\n"), path)
    return readers.read_kf_metric(spark, path, "psnr").select("kfid", r(F.col("psnr"), "psnr"))


@query("s11_used_times", "SELECT i AS iteration, s_suppkey AS kfid, (s_suppkey % 7) + i AS used, s_suppkey % 3 AS remaining FROM supplier, (SELECT CAST(100 AS BIGINT) AS i UNION ALL SELECT 200)")
def s11(spark, sf_dir):
    path = new_path(spark, "used-times")
    for i in (100, 200):
        writers.write_used_times(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS kfid", f"(s_suppkey % 7) + {i} AS used", "s_suppkey % 3 AS remaining"), i, path)
    return readers.read_used_times(spark, path)


@query("s12_training_metrics", tables(f"SELECT CAST(kfid AS INTEGER) AS iteration, {r6('psnr')} AS elapsed, CAST(run_id AS INTEGER) AS active_count FROM {{frame_metrics}}"))
def s12(spark, sf_dir):
    path = new_path(spark, "training")
    rows = fixture(spark, sf_dir, "frame_metrics").selectExpr("kfid", "format_string('%.9f', psnr) AS elapsed", "run_id", "run_id + 1 AS total", "1.5 AS a", "2.5 AS b", "3.5 AS c", "4 AS d")
    rows.write.csv(path, header=True)
    back = readers.read_training_metrics(spark, path)
    return back.select("iteration", r(F.col("elapsed_time_seconds"), "elapsed"), "active_count")


def _cameras(spark, sf_dir):
    kf = fixture(spark, sf_dir, "keyframes")
    return kf.selectExpr("fid AS id", "concat('image ', fid) AS img_name", "1200 AS width", "680 AS height", "600e0 + fid AS fx", "600e0 AS fy", "600e0 AS cx", "340e0 AS cy", "1e-1 AS k1", "0e0 AS k2", "0e0 AS p1", "0e0 AS p2", "0e0 AS k3", "qw", "qx", "qy", "qz", "tx", "ty", "tz")


@query("s13_cameras", tables(f"SELECT fid AS id, 'image ' || fid AS img_name, {r6('600e0 + fid')} AS fx, {r6('abs(qw)')} AS qw, {r6('tx')} AS tx, {r6('ty')} AS ty, {r6('tz')} AS tz, 1e-1 AS k1 FROM {{keyframes}}"))
def s13(spark, sf_dir):
    path = new_path(spark, "cameras")
    writers.write_cameras(_cameras(spark, sf_dir), path)
    back = readers.read_cameras_json(spark, path)
    return back.select("id", "img_name", r(F.col("fx"), "fx"), r(F.abs("qw"), "qw"), *[r(F.col(c), c) for c in ("tx", "ty", "tz")], "k1")


@query("s14_saved_manifest", tables("SELECT chunk_id, count(*) AS n_points FROM {chunked} GROUP BY chunk_id"))
def s14(spark, sf_dir):
    path = new_path(spark, "manifest")
    writers.write_manifest(chunk_counts(chunked(spark, sf_dir)), path)
    return readers.read_manifest(spark, path)


_WIDE = "((CAST(floor((x + 25) / 50) AS BIGINT) + 1048576) * 4398046511104 + (CAST(floor((y + 25) / 50) AS BIGINT) + 1048576) * 2097152 + (CAST(floor((z + 25) / 50) AS BIGINT) + 1048576))"


def _wide(spark, sf_dir):
    return G.with_chunk_id(fixture(spark, sf_dir, "points"), 50.0).select("gaussian_id", "chunk_id")


@query("k3_saved_scene", tables(f"SELECT chunk_id, n_points, (SELECT count(*) FROM {{keyframes}}) AS n_cameras, 25e-1 AS extent FROM (SELECT {_WIDE} AS chunk_id, count(*) AS n_points FROM {{points}} GROUP BY 1)"))
def k3(spark, sf_dir):
    path = new_path(spark, "scene")
    writers.save_scene(_wide(spark, sf_dir), _cameras(spark, sf_dir), 2.5, path)
    points = spark.read.parquet(f"{path}/chunks").groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).count()
    same = points.join(readers.read_manifest(spark, f"{path}/chunk_manifest"), "chunk_id").filter(F.col("count") == F.col("n_points"))
    cameras = readers.read_cameras_json(spark, f"{path}/cameras").agg(F.count("*").alias("n_cameras"))
    return same.select("chunk_id", "n_points").crossJoin(cameras).crossJoin(readers.read_extent(spark, f"{path}/cameras_extent"))  # one row each


@query("s15_extent", "SELECT max(s_acctbal) AS extent FROM supplier")
def s15(spark, sf_dir):
    path = new_path(spark, "extent")
    extent = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.max("s_acctbal").alias("x"))
    extent.select(F.to_json(F.array("x")).alias("value")).write.text(path)
    return readers.read_extent(spark, path)


def _tensor(values, kind: int, dtype: str) -> bytes:
    data = np.ascontiguousarray(values, dtype)
    return readers.TENSOR_HEADER.pack(data.ndim, *data.shape, *[0] * (8 - data.ndim), kind, data.nbytes) + data.tobytes()


@query("s16_chunk_files", tables("SELECT gaussian_id, chunk_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(exist_since AS INTEGER) AS exist_since FROM {chunked}"))
def s16(spark, sf_dir):
    path = new_path(spark, "chunk-files")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n, chunk = len(pdf), int(pdf["chunk_id"].iloc[0])
        parts = [pdf[["x", "y", "z"]], np.zeros((n, 1, 3)), np.zeros((n, 15, 3)), np.zeros((n, 3)), np.zeros((n, 4)), pdf[["opacity"]]]
        raw = readers.CHUNK_HEADER.pack(readers.CHUNK_MAGIC, 1, chunk, n) + b"".join(_tensor(p, 6, "<f4") for p in parts)
        raw += _tensor(pdf["exist_since"], 3, "<i4") + _tensor(np.ones(n), 6, "<f4") + _tensor(pdf["gaussian_id"], 4, "<i8")
        return pd.DataFrame({"name": [f"{chunk}.bin"], "content": [raw]})

    writers.write_files(chunked(spark, sf_dir).groupBy("chunk_id").applyInPandas(build, "name string, content binary"), path)
    back = readers.import_chunks(spark, path)
    return back.select("gaussian_id", "chunk_id", F.get("xyz", F.lit(0)).alias("x"), "exist_since")


def _artifacts(spark, sf_dir):
    """The files of every run, written from its frame metrics."""
    path = new_path(spark, "runs")
    m = fixture(spark, sf_dir, "frame_metrics")
    runs = m.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("psnr", "ssim", "lpips", "render_ms")], F.count("*").alias("n"))
    line = lambda key, value: f"'{key}: ', format_string('%.9f', CAST({value} AS DOUBLE)), '\\n'"
    texts = {
        "eval.txt": "concat(" + ", ".join([line("psnr", "psnr"), line("ssim", "ssim"), line("lpips", "lpips"), line("time s", "n * 2"), line("rendering ms", "render_ms"), line("rendering FPS", "1000 / render_ms"), line("num gaussians", "n * 10")]) + ")",
        "metrics_traj.txt": "concat('APE translation\\nmax 9.0\\n rmse ', format_string('%.9f', psnr / 100), '\\nAPE rotation\\n rmse ', format_string('%.9f', ssim / 100), '\\n')",
        "GpuPeakUsageMB.txt": "concat('Peak reserved (MB): 9999.0\\nPeak allocated (MB): ', n, '.5\\n')",
        "TrackingTime.txt": "concat_ws('\\n', array_repeat('0.0200', CAST(n AS INT)))",
    }
    files = None
    for name, text in texts.items():
        # a third of the runs was never timed
        some = runs.filter("run_id % 3 <> 0") if name == "TrackingTime.txt" else runs
        one = some.selectExpr(f"concat('TUM_mono_', run_id, '/scene', run_id % 4, '/{name}') AS name", f"CAST({text} AS BINARY) AS content")
        files = one if files is None else files.unionByName(one)
    writers.write_files(files, path)
    return path


_RUNS = "(SELECT run_id, avg(psnr) AS psnr, avg(ssim) AS ssim, count(*) AS n, avg(render_ms) AS ms FROM {frame_metrics} GROUP BY run_id)"


@query("s17_run_artifacts", tables("SELECT kind, count(*) AS n_runs FROM (SELECT run_id, unnest(['eval', 'trajectory', 'peak_memory', 'tracking']) AS kind FROM (SELECT DISTINCT run_id FROM {frame_metrics})) WHERE kind <> 'tracking' OR run_id % 3 <> 0 GROUP BY kind"))
def s17(spark, sf_dir):
    found = readers.read_run_artifacts(spark, _artifacts(spark, sf_dir))
    return found.select(*readers.RUN, "kind").distinct().groupBy("kind").agg(F.count("*").alias("n_runs"))


@query("z3_all_runs", tables(f"SELECT 'tum' AS dataset, CAST(run_id AS VARCHAR) AS trial, 'scene' || (run_id % 4) AS scene, {r6('psnr')} AS psnr, {r6('psnr / 100')} AS ape_translation, {r6('ssim / 100')} AS ape_rotation, {r6('1000 / ms')} AS rendering_fps, n * 10 AS n_points, n + 5e-1 AS peak_mb, 1e0 AS slowdown, CASE WHEN run_id % 3 <> 0 THEN 50e0 END AS tracking_fps FROM {_RUNS}"))
def z3(spark, sf_dir):
    datasets = spark.range(1).select(F.lit("tum").alias("dataset"))
    out = R.evaluate_all(spark, _artifacts(spark, sf_dir), datasets)
    return out.select("dataset", "trial", "scene", *[r(F.col(c), c) for c in ("psnr", "ape_translation", "ape_rotation", "rendering_fps")], "n_points", "peak_mb", "slowdown", r(F.col("tracking_fps"), "tracking_fps"))


@query("k2_saved_chunks", tables(f"SELECT chunk_id, n * CASE WHEN n > 100 THEN 2 ELSE 1 END AS n_points FROM (SELECT {_WIDE} AS chunk_id, count(*) AS n FROM {{points}} GROUP BY 1)"))
def k2(spark, sf_dir):
    path, points = new_path(spark, "chunks"), _wide(spark, sf_dir)
    writers.save_chunks(points, path)
    dense = points.groupBy("chunk_id").count().filter("count > 100")
    writers.save_chunks(points.unionByName(points), path, dense)  # dense chunks again, with every point twice
    return spark.read.parquet(path).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n_points"))


@query("k5_metric_files", tables(f"SELECT kfid, {r6('psnr')} AS psnr, {r6('ssim')} AS ssim FROM {{frame_metrics}}"))
def k5(spark, sf_dir):
    path, m = new_path(spark, "metrics"), fixture(spark, sf_dir, "frame_metrics").select("kfid", "psnr", "ssim")
    writers.write_metrics(m, schedule.metric_summary(m, ["psnr", "ssim"]), path)
    return spark.read.csv(f"{path}/frames", header=True, schema="kfid long, psnr double, ssim double").select("kfid", r(F.col("psnr"), "psnr"), r(F.col("ssim"), "ssim"))


_EVAL = " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS mean FROM {{frame_metrics}}" for k, v in (("psnr", r6("avg(psnr)")), ("ssim", r6("avg(ssim)")), ("lpips", r6("avg(lpips)")), ("time s", "min(125e-1)"), ("rendering ms", r6("avg(render_ms)")), ("rendering FPS", r6("1000 / avg(render_ms)")), ("num gaussians", "count(*) + 0e0")))


@query("k6_eval_lines", tables(_EVAL))
def k6(spark, sf_dir):
    path, m = new_path(spark, "eval"), fixture(spark, sf_dir, "frame_metrics")
    writers.write_eval_txt(writers.eval_summary(m, 12.5, float(m.count())), path)
    parts = F.split("value", ": ")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("metric"), r(F.get(parts, F.lit(1)).cast("double"), "mean")).filter("metric is not null").dropDuplicates()


@query("k7_run_report_file", tables(f"SELECT run_id, {r6('avg(psnr)')} AS psnr, CASE WHEN run_id % 4 = 0 THEN NULL ELSE {r6('avg(render_ms)')} END AS time FROM {{frame_metrics}} GROUP BY run_id"))
def k7(spark, sf_dir):
    path, m = new_path(spark, "report"), fixture(spark, sf_dir, "frame_metrics")
    rows = m.groupBy("run_id").agg(F.avg("psnr").alias("psnr"), F.when(F.col("run_id") % 4 != 0, F.avg("render_ms")).alias("time"))
    writers.write_run_report(rows, path)
    back = spark.read.csv(path, header=True, nullValue="None", schema="run_id long, psnr double, time double")
    return back.select("run_id", r(F.col("psnr"), "psnr"), r(F.col("time"), "time"))


@query("k10_run_scalars", "SELECT 'tracking_' || s_suppkey AS name, printf('%.4f', s_acctbal / 7) AS value FROM supplier UNION ALL SELECT 'slowdown_factor', '6.870000' UNION ALL SELECT 'point_count', CAST(count(*) AS VARCHAR) FROM supplier")
def k10(spark, sf_dir):
    path, s = new_path(spark, "scalars"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = s.selectExpr("concat('tracking_', s_suppkey) AS name", "s_acctbal / 7 AS value").unionByName(s.selectExpr("'slowdown_factor' AS name", "6.87e0 AS value").distinct()).unionByName(s.agg(F.lit("point_count").alias("name"), F.count("*").cast("double").alias("value")))
    writers.write_run_scalars(rows, path)
    return readers.read_run_scalars(spark, path)
