"""Readers of trajectory, run and scene files."""

from __future__ import annotations

import fnmatch
import os
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import plain_path

POSE = "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
TRAINING = "iteration int, elapsed_time_seconds double, active_count int, total_count int, reserved_memory_mb float, allocated_memory_mb float, ram_usage_mb float, queue_keyframes int"
CHUNK_MAGIC = 0x43484E4B
#: Tensor header of 48 bytes: number of dimensions, eight sizes, type code, bytes of data.
TENSOR_HEADER, CHUNK_HEADER = struct.Struct("<I8IIQ"), struct.Struct("<IIqI")


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``ts tx ty tz qx qy qz qw``; # begins a comment."""
    return spark.read.csv(path, sep=" ", comment="#", schema=POSE)


def files_below(spark: SparkSession, root: str, *levels: str) -> DataFrame:
    """path of the files at ``root/level/level/...``, each level a pattern of names; hidden names are left out.

    Folders are listed in tasks, level by level, and names stream out of them: however many files there are, the
    driver holds none of them.
    """

    def step(pattern: str, last: bool):
        def run(batches):
            for batch in batches:
                for folder in batch.column("path").to_pylist():
                    for names in _entries(folder, pattern, last):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string())], names=["path"])

        return run

    found = spark.range(1).select(F.lit(root.rstrip("/")).alias("path"))
    for i, pattern in enumerate(levels):
        found = found.mapInArrow(step(pattern, i == len(levels) - 1), "path string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found


def _entries(folder: str, pattern: str, files: bool, size: int = 1000):
    """Names of the files (or folders) in a folder that fit a pattern, in lists of ``size``; none if it is missing."""
    from pyarrow import fs as pafs

    fs, at = plain_path(folder)
    fit = lambda n: n[0] not in "._" and fnmatch.fnmatchcase(n, pattern)
    names = []
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.isdir(at):
            with os.scandir(at) as entries:
                for e in entries:
                    if fit(e.name) and (e.is_file() if files else e.is_dir()):
                        names.append(e.name)
                        if len(names) == size:
                            yield names
                            names = []
    else:
        kind = pafs.FileType.File if files else pafs.FileType.Directory
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == kind and fit(f.base_name)]
    if names:
        yield names


def contents(files: DataFrame) -> DataFrame:
    """files(path) -> path, text: small text files, read in tasks."""

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for i in range(0, len(paths), 200):
                texts = []
                for path in paths[i : i + 200]:
                    fs, at = plain_path(path)
                    with fs.open_input_stream(at) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(paths[i : i + 200], pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path").mapInArrow(run, "path string, text string")


def numbered_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, line (from 0), value of text files whose line order matters; a file is one trajectory or log.

    A table of paths (see ``files_below``) takes any number of files; a path is listed by the driver.
    """
    files = contents(path) if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "value"))
    return lines.filter(F.trim("value") != "")


def _numbers(lines: DataFrame, n: int) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(parts) >= n).select("path", "line", F.transform(parts, lambda x: x.cast("double")).alias("m"))


def _pose_columns(rotation: list[Column], t: list[Column]) -> list[Column]:
    q = G.matrix_to_quat(rotation)
    return [*[c.alias(f"t{a}") for c, a in zip(t, "xyz", strict=True)], *[q[a].alias(f"q{a}") for a in "xyzw"]]


def sequence_of(path: Column) -> Column:
    """Name of the sequence that a file belongs to: its folder for a file called times, else the file's own name without ending."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(name == "times", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(name)


def read_kitti(spark: SparkSession, poses: str | DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Twelve numbers a line (3 x 4, row by row) of one or more sequences.

    times(sequence, line, ts) gives each pose the time of its line in its own sequence, times(line, ts) that of one
    sequence; a pose whose line has no time is dropped.  Without times the line number is the time.
    """
    m = _numbers(numbered_lines(spark, poses), 12)
    at = lambda i: F.get("m", F.lit(i))
    out = m.select("path", "line", sequence_of(F.col("path")).alias("sequence"), *_pose_columns([at(i) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)], [at(3), at(7), at(11)]))
    if times is None:
        return out.withColumn("ts", F.col("line").cast("double"))
    keys = [k for k in ("sequence", "line") if k in times.columns]
    return out.join(times.select(*keys, "ts"), keys)


def read_times(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One number a line -> sequence, line, ts; files are named by their sequence, or ``times`` in a folder of its name."""
    return numbered_lines(spark, path).select(sequence_of(F.col("path")).alias("sequence"), "line", F.trim("value").cast("double").alias("ts"))


def read_replica(spark: SparkSession, path: str) -> DataFrame:
    """Sixteen numbers a line (4 x 4 camera to world) with the second and third camera axis flipped; the line number is the time."""
    m = _numbers(numbered_lines(spark, path), 16)
    at = lambda i: F.get("m", F.lit(i))
    rotation = [at(i) * (-1 if i % 4 else 1) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]
    return m.select("path", F.col("line").cast("double").alias("ts"), *_pose_columns(rotation, [at(3), at(7), at(11)]))


def read_euroc(spark: SparkSession, path: str, extrinsic: list[float]) -> DataFrame:
    """Ground-truth CSV in nanoseconds, each pose multiplied from the right by a fixed 4 x 4."""
    raw = spark.read.csv(path, comment="#", schema="ns long, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    r, e = G.quat_to_matrix(G.quat_normalize(G.quat("qw", "qx", "qy", "qz"))), extrinsic
    rotation = G.matmul(r, [F.lit(float(e[4 * i + j])) for i in range(3) for j in range(3)])
    t = [sum((r[3 * i + k] * float(e[4 * k + 3]) for k in range(3)), F.col(f"t{a}")) for i, a in enumerate("xyz")]
    return raw.select((F.col("ns") / 1e9).alias("ts"), *_pose_columns(rotation, t))


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep=" ", comment="#", schema="ts double, rgb string, depth_ts double, depth string")
    return raw.select("ts", "rgb", "depth")


def read_rgb_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``t path`` after three lines of header, whatever these hold."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path).filter("line >= 3").filter(F.size(parts) >= 2)
    return lines.select(F.get(parts, F.lit(0)).try_cast("double").alias("ts"), F.get(parts, F.lit(1)).alias("rgb")).filter("ts is not null")


def frame_time(name: Column, layout: str) -> Column:
    """Time in a frame's file name: ``replica`` and ``tum`` (frame prefix and extension removed), ``kitti`` (its number), ``euroc`` (nanoseconds)."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z]+$", "")
    number = F.regexp_replace(stem, "^(?:frame|depth)", "").try_cast("double")
    return number / 1e9 if layout == "euroc" else number


def list_frames(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """path and ts of image files; their content is never read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.withColumn("ts", frame_time(F.col("path"), layout)).filter("ts is not null")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as pixel rows path, v, u, r, g, b in 0 .. 1 (stored blue first)."""

    def unpack(batches):
        for pdf in batches:
            for origin, h, w, channels, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                plane = np.frombuffer(data, np.uint8).reshape(h, w, channels).astype(float) / 255
                v, u = np.divmod(np.arange(h * w), w)
                rgb = plane[:, :, ::-1] if channels >= 3 else np.repeat(plane, 3, axis=2)
                rgb = rgb[:, :, -3:].reshape(-1, 3)
                yield pd.DataFrame({"path": origin, "v": v, "u": u, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return spark.read.format("image").load(path).select("image.*").select("origin", "height", "width", "nChannels", "data").mapInPandas(unpack, "path string, v long, u long, r double, g double, b double")


def parse_render_name(name: Column) -> Column:
    """struct(iteration, kfid, suffix) of ``iteration_kfid[_suffix].ext``; null if it does not parse."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")
    part = lambda i: F.regexp_extract(stem, r"^([0-9]{1,18})_([0-9]{1,18})(?:_(.*))?$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("long").alias("iteration"), part(2).cast("long").alias("kfid"), part(3).alias("suffix")))


def read_kf_metric(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", comment="#", schema=f"kfid long, {name} double")


def read_used_times(spark: SparkSession, path: str) -> DataFrame:
    """Log of sections ``##...Iteration N...`` and rows ``kfid used remaining`` -> iteration, kfid, used, remaining."""
    from pyspark.sql import Window

    lines = numbered_lines(spark, path)
    number = F.regexp_extract("value", r"^##.*?[Ii]teration\D*([0-9]+)", 1)
    lines = lines.withColumn("iteration", F.last(F.when(number != "", number.cast("long")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line")))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#")).filter(F.size(parts) >= 3)
    return rows.select("iteration", *[F.get(parts, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("kfid", "used", "remaining"))])


def read_training_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRAINING)


CAMERA = (
    "id: bigint, img_name: string, width: int, height: int, position: array<double>, rotation: array<array<double>>, fx: double, fy: double, cx: double, cy: double, "
    "k1: double, k2: double, p1: double, p2: double, k3: double"
)


def read_cameras_json(spark: SparkSession, path: str) -> DataFrame:
    """All cameras of array files (or of files with one object a line) with world-to-camera poses; missing distortion is 0, a missing centre the middle."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    array = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.regexp_replace("value", r"\}\s*\n\s*\{", "},{"), F.lit("]")))
    raw = text.select(F.explode(F.from_json(array, f"array<struct<{CAMERA}>>")).alias("c")).select("c.*")
    m = [F.get(F.get("rotation", F.lit(i)), F.lit(j)) for i in range(3) for j in range(3)]
    q = G.matrix_to_quat(m)
    raw = raw.withColumns({f"w_q{a}": q[a] for a in "wxyz"} | {f"w_t{a}": F.get("position", F.lit(i)) for i, a in enumerate("xyz")})
    inv = G.se3_inv(G.pose_of("w_"))
    keep = ["id", "img_name", "width", "height", "fx", "fy", F.coalesce("cx", F.col("width") / 2).alias("cx"), F.coalesce("cy", F.col("height") / 2).alias("cy")]
    return raw.select(*keep, *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("k1", "k2", "p1", "p2", "k3")], *[inv[a].alias(f"q{a}") for a in "wxyz"], *[inv[f"t{a}"].alias(f"t{a}") for a in "xyz"])


def manifest_rows(json: Column) -> Column:
    """Parallel arrays of a manifest document -> array<struct(chunk_id, n_points)> to explode."""
    d = F.from_json(json, "chunks_on_disk array<long>, chunk_gaussian_counts array<long>")
    return F.transform(F.arrays_zip(d["chunks_on_disk"].alias("c"), d["chunk_gaussian_counts"].alias("n")), lambda z: F.struct(z["c"].alias("chunk_id"), z["n"].alias("n_points")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(manifest_rows(F.col("value"))).alias("m")).select("m.*")


def read_extent(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.get(F.from_json("value", "array<double>"), F.lit(0)).alias("extent"))


CHUNK_COLUMNS = ("xyz", "features_dc", "features_rest", "scaling", "rotation", "opacity", "exist_since", "position_lr", "gaussian_id")
#: Type codes of stored tensors; fixed values.
TENSOR_TYPES = {0: "<u1", 1: "<i1", 2: "<i2", 3: "<i4", 4: "<i8", 6: "<f4", 7: "<f8", 11: "?"}


def parse_chunk(raw: bytes, expected: int | None = None) -> pd.DataFrame:
    """Rows of one chunk file.  A wrong magic number or id raises; tensors that disagree in length give no rows."""
    magic, _, chunk, count = CHUNK_HEADER.unpack_from(raw, 0)
    if magic != CHUNK_MAGIC:
        raise ValueError("not a chunk file")
    if expected is not None and chunk != expected:
        raise ValueError(f"chunk file holds {chunk}, not {expected}")
    at, columns = CHUNK_HEADER.size, {}
    for name in CHUNK_COLUMNS:
        dims, *rest = TENSOR_HEADER.unpack_from(raw, at)
        shape, kind, size = rest[:dims], rest[8], rest[9]
        at += TENSOR_HEADER.size
        columns[name] = np.frombuffer(raw, TENSOR_TYPES[kind], size // np.dtype(TENSOR_TYPES[kind]).itemsize, at).reshape(shape)
        at += size
    if any(len(c) != count for c in columns.values()):
        return pd.DataFrame({"chunk_id": [], **{n: [] for n in CHUNK_COLUMNS}})
    flat = {n: list(c.reshape(count, -1).astype(float)) for n, c in columns.items() if n not in ("exist_since", "position_lr", "gaussian_id")}
    return pd.DataFrame({"chunk_id": chunk, **flat, **{n: columns[n].reshape(count) for n in ("exist_since", "position_lr", "gaussian_id")}})


def import_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Points of binary chunk files, a file a row group; optimiser moments are left behind."""
    arrays = ", ".join(f"{n} array<double>" for n in CHUNK_COLUMNS[:6])
    schema = f"chunk_id long, {arrays}, exist_since int, position_lr double, gaussian_id long"

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                yield parse_chunk(bytes(raw))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def run_key(path: Column) -> Column:
    """struct(dataset, camera, trial, scene) of ``.../dataset_camera_trial/scene/...``."""
    run, scene = F.element_at(F.split(path, "/"), -3), F.element_at(F.split(path, "/"), -2)
    parts = F.split(run, "_")
    return F.struct(F.lower(F.get(parts, F.lit(0))).alias("dataset"), F.get(parts, F.lit(1)).alias("camera"), F.get(parts, F.lit(2)).alias("trial"), scene.alias("scene"))


#: Kind of each file of a run; the peak memory file is known by how its name begins.
ARTIFACTS = {"eval.txt": "eval", "metrics_traj.txt": "trajectory", "training_time.txt": "training_time", "slowdown_factor.txt": "slowdown", "TrackingTime.txt": "tracking", "gaussianCount.txt": "points"}
PEAK_MEMORY = "GpuPeakUsageMB"


def artifact_kind(file: Column) -> Column:
    """What a file of a run holds; null for other files."""
    names = F.create_map(*[F.lit(x) for pair in ARTIFACTS.items() for x in pair])
    return F.when(file.startswith(PEAK_MEMORY), "peak_memory").otherwise(F.element_at(names, file))


def read_run_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """The small text files under ``root/run/scene/``: run columns, file, kind, line, key, value.

    ``key: value`` lines give the key; lines of a number alone have none, and of tracking times each is a frame.
    """
    files = contents(files_below(spark, root, "*", "*", "*.txt")).select(F.col("text").alias("value"), "path")
    files = files.select(run_key(F.col("path")).alias("k"), F.substring_index("path", "/", -1).alias("file"), "value").select("k.*", "file", "value")
    lines = files.withColumn("kind", artifact_kind(F.col("file"))).filter("kind is not null")
    lines = lines.select("dataset", "camera", "trial", "scene", "file", "kind", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    key = F.lower(F.trim(F.regexp_extract("text", r"^\s*([A-Za-z_ ()]+?)\s*[:\s]\s*[-0-9.]", 1)))
    return lines.select("dataset", "camera", "trial", "scene", "file", "kind", "line", key.alias("key"), F.expr(r"try_cast(regexp_extract(text, '([-0-9.eE+]+)\\s*$', 1) as double)").alias("value")).filter("value is not null")


def read_run_scalars(spark: SparkSession, root: str) -> DataFrame:
    """name, value of what ``writers.write_run_scalars`` wrote."""
    lines = numbered_lines(spark, files_below(spark, root, "name=*", "*"))
    return lines.select(F.try_url_decode(F.replace(F.regexp_extract("path", r"/name=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B"))).alias("name"), "value")


RUN = ["dataset", "camera", "trial", "scene"]


def run_table(artifacts: DataFrame) -> DataFrame:
    """A row a run of what read_run_artifacts found; what is missing is null, a missing slowdown factor 1.

    The trajectory file has two blocks, translation first: the first and last rmse of it.  Tracking times give
    frames a second without the last three lines.
    """
    at = lambda kind, key=None: (F.col("kind") == kind) & (F.lit(True) if key is None else F.col("key") == key)
    one = lambda kind, key=None: F.max(F.when(at(kind, key), F.col("value")))
    rmse = at("trajectory", "rmse")
    columns = {"ape_translation": F.min_by(F.when(rmse, F.col("value")), F.when(rmse, F.col("line"))), "ape_rotation": F.max_by(F.when(rmse, F.col("value")), F.when(rmse, F.col("line")))}
    columns |= {n: one("eval", k) for n, k in (("psnr", "psnr"), ("ssim", "ssim"), ("lpips", "lpips"), ("seconds", "time s"), ("rendering_fps", "rendering fps"))}
    columns |= {"slowdown": F.coalesce(one("slowdown"), F.lit(1.0)), "n_points": F.coalesce(one("eval", "num gaussians"), one("points")).cast("long"), "peak_mb": one("peak_memory", "peak allocated (mb)")}
    columns["seconds"] = F.coalesce(columns["seconds"], one("training_time"))
    runs = artifacts.groupBy(*RUN).agg(*[c.alias(n) for n, c in columns.items()])
    times = artifacts.filter("kind = 'tracking'").withColumn("run", F.struct(*RUN))
    from ..operators.schedule import tracking_fps

    return runs.join(tracking_fps(times, "run", "line", "value").select("run.*", "tracking_fps"), RUN, "left")


def discover_runs(paths: DataFrame, datasets: DataFrame) -> DataFrame:
    """Distinct runs of known datasets among file paths; datasets(dataset) is a small dimension."""
    runs = paths.select(run_key(F.col("path")).alias("k")).select("k.*").distinct()
    return runs.join(datasets.select("dataset"), "dataset", "left_semi")

