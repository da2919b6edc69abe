"""Queries of chunk, pose, camera and point-attribute operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import points as P
from ..operators import chunks as C
from .fixtures import fixture, r6, tables
from .registry import query

SIZE = 10.0
#: A rigid transform used by the queries: 30 degrees about z, then a shift.
COS, SIN = 0.8660254037844387, 0.49999999999999994
T4 = [COS, -SIN, 0.0, 1.5, SIN, COS, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0, 1.0]
R3 = [COS, -SIN, 0.0, SIN, COS, 0.0, 0.0, 0.0, 1.0]
ID_SQL = "(cx + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576)"


def r(col, name: str):
    return (F.round(col, 6) + 0.0).alias(name)


def vec_out(v, prefix: str = "") -> list:
    return [r(v[a], prefix + a) for a in ("x", "y", "z")]


def chunked(spark, sf_dir) -> DataFrame:
    return G.with_chunk_id(fixture(spark, sf_dir, "points"), SIZE)


tcw = G.pose_of


@query("p1_chunk_coord", tables("SELECT gaussian_id, cx, cy, cz FROM {chunked}"))
def p1(spark, sf_dir):
    return fixture(spark, sf_dir, "points").select("gaussian_id", G.chunk_coord("x", "y", "z", SIZE).alias("c")).select("gaussian_id", "c.*")


@query("p2_chunk_encode", tables("SELECT gaussian_id, chunk_id FROM {chunked}"))
def p2(spark, sf_dir):
    return chunked(spark, sf_dir).select("gaussian_id", "chunk_id")


@query("p3_chunk_decode", tables("SELECT gaussian_id, chunk_id // 4398046511104 - 1048576 AS cx, (chunk_id // 2097152) % 2097152 - 1048576 AS cy, chunk_id % 2097152 - 1048576 AS cz FROM {chunked}"))
def p3(spark, sf_dir):
    return chunked(spark, sf_dir).select("gaussian_id", G.chunk_decode("chunk_id").alias("c")).select("gaussian_id", "c.*")


@query("p4_big_point_chunks", tables(f"SELECT chunk_id, count(*) AS n_points FROM (SELECT {ID_SQL} AS chunk_id FROM (SELECT CAST(floor((x + 5) / 10) AS BIGINT) AS cx, CAST(floor((y + 5) / 10) AS BIGINT) AS cy, CAST(floor((z + 5) / 10) AS BIGINT) AS cz FROM {{big_points}})) GROUP BY chunk_id"))
def p4(spark, sf_dir):
    return C.chunk_counts(G.with_chunk_id(fixture(spark, sf_dir, "big_points"), SIZE))


@query("p5_chunk_boxes", tables("SELECT DISTINCT cx, cy, cz, cx * 10.0::DOUBLE AS x, cy * 10.0::DOUBLE AS y, cz * 10.0::DOUBLE AS z, cx * 10.0::DOUBLE - 5 AS min_x, cy * 10.0::DOUBLE - 5 AS min_y, cz * 10.0::DOUBLE - 5 AS min_z, cx * 10.0::DOUBLE + 5 AS max_x, cy * 10.0::DOUBLE + 5 AS max_y, cz * 10.0::DOUBLE + 5 AS max_z FROM {chunked}"))
def p5(spark, sf_dir):
    c = C.distinct_chunks(chunked(spark, sf_dir)).select(G.chunk_decode("chunk_id").alias("c"))
    return c.select("c.*", G.chunk_center(F.col("c"), SIZE).alias("m"), G.chunk_aabb(F.col("c"), SIZE).alias("b")).select("cx", "cy", "cz", "m.*", "b.*")


@query("p5_region_box", tables("SELECT run_id, CAST(min(cx) AS DOUBLE) * 10 - 5 AS min_x, CAST(min(cy) AS DOUBLE) * 10 - 5 AS min_y, CAST(min(cz) AS DOUBLE) * 10 - 5 AS min_z, CAST(max(cx) AS DOUBLE) * 10 + 5 AS max_x, CAST(max(cy) AS DOUBLE) * 10 + 5 AS max_y, CAST(max(cz) AS DOUBLE) * 10 + 5 AS max_z FROM {kf_chunked} GROUP BY run_id"))
def p5_region(spark, sf_dir):
    kf = fixture(spark, sf_dir, "keyframes").withColumn("c", G.chunk_coord("tx", "ty", "tz", SIZE))
    corner = lambda f: F.struct(*[f(f"c.c{a}").alias(f"c{a}") for a in "xyz"])
    ends = kf.groupBy("run_id").agg(corner(F.min).alias("lo"), corner(F.max).alias("hi"))
    return ends.select("run_id", G.region_aabb(F.col("lo"), F.col("hi"), SIZE).alias("b")).select("run_id", "b.*")


@query("p6_chunk_order", tables("SELECT chunk_id, row_number() OVER (ORDER BY cx, cy, cz) - 1 AS place FROM (SELECT DISTINCT chunk_id, cx, cy, cz FROM {chunked})"))
def p6(spark, sf_dir):
    c = C.distinct_chunks(chunked(spark, sf_dir)).withColumn("c", G.chunk_decode("chunk_id")).select("chunk_id", "c.*")
    return C.assign_ids(c, ["cx", "cy", "cz"], 0, "place").select("chunk_id", "place")


_XYZ = f"{r6(f'{COS!r}::DOUBLE * x - {SIN!r}::DOUBLE * y + 1.5')} AS x, {r6(f'{SIN!r}::DOUBLE * x + {COS!r}::DOUBLE * y - 2')} AS y, {r6('z + 0.25')} AS z"


@query("p7_transform_points", tables(f"SELECT gaussian_id, {_XYZ} FROM {{points}}"))
def p7(spark, sf_dir):
    return G.transform_points(fixture(spark, sf_dir, "points"), T4).select("gaussian_id", r(F.col("x"), "x"), r(F.col("y"), "y"), r(F.col("z"), "z"))


@query("p8_scale_transform_points", tables(f"SELECT gaussian_id, {_XYZ} FROM (SELECT gaussian_id, 2.5::DOUBLE * x AS x, 2.5::DOUBLE * y AS y, 2.5::DOUBLE * z AS z FROM {{points}})"))
def p8(spark, sf_dir):
    return G.scale_transform_points(fixture(spark, sf_dir, "points"), T4, 2.5).select("gaussian_id", r(F.col("x"), "x"), r(F.col("y"), "y"), r(F.col("z"), "z"))


# yaw-only quaternions: the product with a yaw of 30 degrees, with the sign that makes w (else z) positive
@query("p9_rotate_quat", tables(f"SELECT frame_id, {r6('abs(w)')} AS abs_w, {r6('abs(z)')} AS abs_z, {r6('w * z')} AS wz FROM (SELECT frame_id, 0.9659258262890683::DOUBLE * qw - 0.25881904510252074::DOUBLE * qz AS w, 0.9659258262890683::DOUBLE * qz + 0.25881904510252074::DOUBLE * qw AS z FROM {{poses}})"))
def p9(spark, sf_dir):
    q = fixture(spark, sf_dir, "poses").select("frame_id", G.rotate_quat(R3, G.quat("qw", "qx", "qy", "qz")).alias("q"))
    return q.select("frame_id", r(F.abs("q.w"), "abs_w"), r(F.abs("q.z"), "abs_z"), r(F.col("q.w") * F.col("q.z"), "wz"))


_INV = "qw AS w, -qz AS z, -((1 - 2 * qz * qz) * tx + 2 * qw * qz * ty) AS ix, -(-2 * qw * qz * tx + (1 - 2 * qz * qz) * ty) AS iy, -tz AS iz"


@query("p10_se3_inverse", tables(f"SELECT frame_id, {r6('w')} AS w, {r6('z')} AS z, {r6('ix')} AS ix, {r6('iy')} AS iy, {r6('iz')} AS iz FROM (SELECT frame_id, {_INV} FROM {{poses}})"))
def p10(spark, sf_dir):
    i = fixture(spark, sf_dir, "poses").select("frame_id", G.se3_inv(tcw()).alias("i"))
    return i.select("frame_id", r(F.col("i.w"), "w"), r(F.col("i.z"), "z"), r(F.col("i.tx"), "ix"), r(F.col("i.ty"), "iy"), r(F.col("i.tz"), "iz"))


@query("p10_se3_identity", tables(f"SELECT frame_id, {r6('1e0')} AS w, {r6('0e0')} AS moved FROM {{poses}}"))
def p10_identity(spark, sf_dir):
    m = fixture(spark, sf_dir, "poses").select("frame_id", G.se3_mul(tcw(), G.se3_inv(tcw())).alias("m"))
    return m.select("frame_id", r(F.col("m.w"), "w"), r(G.norm3(F.col("m.tx"), F.col("m.ty"), F.col("m.tz")), "moved"))


@query("p11_camera_center", tables(f"SELECT frame_id, {r6('ix')} AS x, {r6('iy')} AS y, {r6('iz')} AS z FROM (SELECT frame_id, {_INV} FROM {{poses}})"))
def p11(spark, sf_dir):
    return fixture(spark, sf_dir, "poses").select("frame_id", G.camera_center(tcw()).alias("c")).select("frame_id", *vec_out(F.col("c")))


@query("p12_rot6d", tables(f"SELECT frame_id, {r6('ax / n')} AS m00, {r6('-ay / n')} AS m01, {r6('ay / n')} AS m10, {r6('ax / n')} AS m11, {r6('1e0')} AS m22 FROM (SELECT frame_id, tx + 1 AS ax, ty AS ay, sqrt((tx + 1) * (tx + 1) + ty * ty) AS n FROM {{poses}})"))
def p12(spark, sf_dir):
    p = fixture(spark, sf_dir, "poses").select("frame_id", G.vec(F.col("tx") + 1, "ty", 0.0).alias("a"), G.vec(-2 * F.col("ty"), 2 * (F.col("tx") + 1) + 0.0, 0.0).alias("b"))
    m = G.rot6d_to_matrix(F.col("a"), F.col("b"))
    return p.select("frame_id", r(m[0], "m00"), r(m[1], "m01"), r(m[3], "m10"), r(m[4], "m11"), r(m[8], "m22"))


@query("p13_world_to_view", tables(f"SELECT frame_id, {r6('1 - 2 * qz * qz')} AS m00, {r6('-((1 - 2 * qz * qz) * (ix + 1) * 2 - 2 * qw * qz * iy * 2)')} AS m03, {r6('-(iz * 2)')} AS m23 FROM (SELECT frame_id, qw, qz, {_INV} FROM {{poses}})"))
def p13(spark, sf_dir):
    m = G.world_to_view(tcw(), G.vec(1.0, 0.0, 0.0), 2.0)
    return fixture(spark, sf_dir, "poses").select("frame_id", r(m[0], "m00"), r(m[3], "m03"), r(m[11], "m23"))


_F, _N = 600.0, (0.01, 30.0)
_FX = "2 * atan(1200 / 1200e0)"


@query("p14_full_projection", tables(f"SELECT frame_id, {r6('(1 - 2 * qz * qz)')} AS m00, {r6('30 / 29.99::DOUBLE * tz - 0.3::DOUBLE / 29.99::DOUBLE')} AS m23, {r6('tz')} AS m33 FROM {{poses}}"))
def p14(spark, sf_dir):
    poses = fixture(spark, sf_dir, "poses")
    proj = G.projection_matrix(*_N, G.focal2fov(F.lit(_F), F.lit(1200)), G.focal2fov(F.lit(_F), F.lit(680)))
    full = G.full_projection(G.world_to_view(tcw()), proj)
    return poses.select("frame_id", r(full[0], "m00"), r(full[11], "m23"), r(full[15], "m33"))


@query("p15_fov", f"SELECT p_partkey, {r6('2 * atan(p_size / (2 * (p_retailprice + 0e0)))')} AS fov, {r6('p_retailprice + 0e0')} AS focal FROM part")
def p15(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", G.focal2fov("p_retailprice", "p_size").alias("fov"), "p_size")
    return part.select("p_partkey", r(F.col("fov"), "fov"), r(G.fov2focal("fov", "p_size"), "focal"))


@query("p16_quat_matrix", tables(f"SELECT frame_id, {r6('1 - 2 * qz * qz')} AS m00, {r6('2 * qw * qz')} AS m10, {r6('qw * qz')} AS wz FROM {{poses}}"))
def p16(spark, sf_dir):
    q = G.quat_normalize(G.quat(F.col("qw") * 3, F.col("qx") * 3, F.col("qy") * 3, F.col("qz") * 3))
    p = fixture(spark, sf_dir, "poses").select("frame_id", q.alias("q"))
    m = G.quat_to_matrix(F.col("q"))
    back = p.select("frame_id", m[0].alias("m00"), m[3].alias("m10"), G.matrix_to_quat(m).alias("b"))
    return back.select("frame_id", r(F.col("m00"), "m00"), r(F.col("m10"), "m10"), r(F.col("b.w") * F.col("b.z"), "wz"))


@query("p25_opacity", tables(f"SELECT gaussian_id, {r6('1 / (1 + exp(-opacity))')} AS sigmoid, {r6('CASE WHEN exist_since < 500 THEN ln(least(1 / (1 + exp(-opacity)), 5e-2) / (1 - least(1 / (1 + exp(-opacity)), 5e-2))) ELSE opacity END')} AS capped FROM {{points}}"))
def p25(spark, sf_dir):
    return fixture(spark, sf_dir, "points").select("gaussian_id", r(P.sigmoid("opacity"), "sigmoid"), r(P.cap_opacity("opacity", F.col("exist_since") < 500), "capped"))


_DIST = "sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3))"


@query("p26_initial_scale", tables(f"SELECT gaussian_id, {r6(f'ln(greatest(1e-6, least(greatest(1e0, least(1 / sqrt(opacity + 1e-8), 120e0)) / 600 * {_DIST}, 1e6)))')} AS log_scale FROM {{points}}"))
def p26(spark, sf_dir):
    return fixture(spark, sf_dir, "points").select("gaussian_id", r(P.initial_scale("opacity", F.lit(1200), F.lit(600.0), P.distance_to((1, 2, 3))), "log_scale"))


@query("p27_initial_opacity", tables("SELECT gaussian_id, CASE gaussian_id % 4 WHEN 0 THEN 7e-2 WHEN 1 THEN 2e-2 WHEN 2 THEN 2e-1 END AS start FROM {points}"))
def p27(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("accurate", "inaccurate", "keypoint", "other"))), (F.col("gaussian_id") % 4 + 1).cast("int"))
    return fixture(spark, sf_dir, "points").select("gaussian_id", P.initial_opacity(kind).alias("start"))


@query("p28_normalized_pixels", tables(f"SELECT keypoint_id, {r6('2 * u / 1199 - 1')} AS nu, {r6('2 * v / 679 - 1')} AS nv FROM {{keypoints}}"))
def p28(spark, sf_dir):
    return fixture(spark, sf_dir, "keypoints").select("keypoint_id", r(P.normalize_uv("u", F.lit(1200)), "nu"), r(P.normalize_uv("v", F.lit(680)), "nv"))


@query("p29_pyramid_levels", tables("SELECT fid, l AS level, CAST(floor(1200 * pow(5e-1, l)) AS BIGINT) AS level_width, CAST(floor(680 * pow(5e-1, l)) AS BIGINT) AS level_height FROM (SELECT fid, unnest(range(3)) AS l FROM {keyframes})"))
def p29(spark, sf_dir):
    levels = fixture(spark, sf_dir, "keyframes").select("fid", F.explode(P.pyramid_levels(F.lit(1200), F.lit(680), 3)).alias("l"))
    return levels.select("fid", F.col("l.level").cast("long").alias("level"), "l.level_width", "l.level_height")


@query("p31_rescaled_time", tables(f"SELECT frame_id, round(t0 + (t - t0) * 25e-1, 3) AS t_scaled, round(t / 25e-1, 3) AS t_unscaled FROM (SELECT *, min(t) OVER (PARTITION BY run_id) AS t0 FROM {{poses}})"))
def p31(spark, sf_dir):
    out = P.rescale_time(fixture(spark, sf_dir, "poses"), 2.5)
    return out.select("frame_id", F.round("t_scaled", 3).alias("t_scaled"), F.round(P.unscale_time("t", 2.5), 3).alias("t_unscaled"))


_SPEEDS = "(SELECT n_nationkey AS sequence, CAST(20 + n_nationkey AS DOUBLE) AS kmh FROM nation WHERE n_nationkey < 11)"


@query("p32_slowdown", tables(f"SELECT run_id, {r6('coalesce(kmh / 5, 687e-2)')} AS slowdown FROM (SELECT DISTINCT run_id FROM {{poses}}) p LEFT JOIN {_SPEEDS} s ON s.sequence = p.run_id"))
def p32(spark, sf_dir):
    runs = fixture(spark, sf_dir, "poses").select("run_id").distinct().withColumn("directory", F.concat(F.lit("data/sequences/"), F.lpad(F.col("run_id").cast("string"), 2, "0")))
    runs = runs.withColumn("directory", F.when(F.col("run_id") > 99, F.concat(F.lit("seq"), F.col("run_id").cast("string"))).otherwise(F.col("directory")))
    speeds = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 11").select(F.col("n_nationkey").alias("sequence"), (20.0 + F.col("n_nationkey")).alias("kmh"))
    return P.slowdown_factor(runs, "directory", speeds).select("run_id", r(F.col("slowdown"), "slowdown"))


_PAIRS = "(SELECT k.fid, k.tx, k.ty, k.tz, k.qw, k.qz, u.tx AS ux, u.ty AS uy, u.tz AS uz, u.qw AS uw, u.qz AS uq FROM {keyframes} k JOIN {pose_updates} u ON u.fid = k.fid)"


@query("p33_pose_divergent", tables(f"SELECT fid, 2 * sqrt(2) * abs(uw * qz - uq * qw) > 5e-2 * sqrt(3) OR sqrt((tx - ux) * (tx - ux) + (ty - uy) * (ty - uy) + (tz - uz) * (tz - uz)) > 1e-1 AS divergent FROM {_PAIRS}"))
def p33(spark, sf_dir):
    return _pairs(spark, sf_dir).select("fid", G.pose_divergent(tcw(), tcw("n_")).alias("divergent"))


def _pairs(spark, sf_dir):
    new = fixture(spark, sf_dir, "pose_updates")
    new = new.select("fid", *[F.col(c).alias("n_" + c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    return fixture(spark, sf_dir, "keyframes").join(new, "fid")


@query("p34_pose_near_equal", tables(f"SELECT fid, sqrt((tx - ux) * (tx - ux) + (ty - uy) * (ty - uy) + (tz - uz) * (tz - uz)) < 5e-2 * 10 AND 2 * acos(least(1e0, abs(qw * uw + qz * uq))) < 5e-2 AS near_equal FROM {_PAIRS}"))
def p34(spark, sf_dir):
    return _pairs(spark, sf_dir).select("fid", G.pose_near_equal(tcw(), tcw("n_"), SIZE).alias("near_equal"))


@query("p35_frustum_footprint", tables(f"SELECT fid, {r6('tx')} AS ax, {r6('tz')} AS az, {r6('tx + hx * 30 - hz * 30')} AS bx, {r6('tz + hz * 30 + hx * 30')} AS bz FROM (SELECT *, qw AS hx, qz AS hz FROM {{keyframes}})"))
def p35(spark, sf_dir):
    kf = fixture(spark, sf_dir, "keyframes").withColumn("f", G.frustum_footprint(G.vec("tx", "ty", "tz"), F.col("qw"), F.col("qz"), F.lit(1.5707963267948966), F.lit(30.0)))
    return kf.select("fid", r(F.col("f.ax"), "ax"), r(F.col("f.az"), "az"), r(F.col("f.bx"), "bx"), r(F.col("f.bz"), "bz"))


@query("p36_canvas", tables(f"SELECT frame_id, {r6('40 + (tx - x0) * s')} AS px, {r6('570 - (tz - z0) * s')} AS py FROM (SELECT *, least(720 / CASE WHEN x1 - x0 < 1e-3 THEN 1e0 ELSE x1 - x0 END, 540 / CASE WHEN z1 - z0 < 1e-3 THEN 1e0 ELSE z1 - z0 END) AS s FROM (SELECT *, min(tx) OVER w AS x0, max(tx) OVER w AS x1, min(tz) OVER w AS z0, max(tz) OVER w AS z1 FROM {{poses}} WINDOW w AS (PARTITION BY run_id)))"))
def p36(spark, sf_dir):
    return P.fit_to_canvas(fixture(spark, sf_dir, "poses"), "run_id", 800.0, 600.0).select("frame_id", r(F.col("px"), "px"), r(F.col("py"), "py"))


@query("p37_new_points", tables(f"SELECT row_number() OVER (ORDER BY gaussian_id) - 1 + 1000000 AS new_id, {r6('(opacity - 5e-1) / 28209479177387814e-17')} AS sh_r, 45 AS n_rest, 7 AS exist_since, chunk_id FROM {{chunked}}"))
def p37(spark, sf_dir):
    raw = fixture(spark, sf_dir, "points").select("gaussian_id", "x", "y", "z", F.col("opacity").alias("r"), F.col("opacity").alias("g"), F.col("opacity").alias("b"))
    new = C.assign_ids(P.init_points(raw, 7, SIZE, 1.0), ["gaussian_id"], 1_000_000, "new_id")
    return new.select("new_id", r(F.get("sh_dc", F.lit(0)), "sh_r"), F.size("sh_rest").alias("n_rest"), "exist_since", "chunk_id")


@query("p38_decayed_lr", tables(f"SELECT gaussian_id, {r6('greatest(CASE WHEN gaussian_id % 3 = 0 THEN max_scale * 9e-1 ELSE max_scale END, 1e-1)')} AS position_lr, CASE WHEN exist_since > 900 THEN 1e0 ELSE {r6('greatest(CASE WHEN gaussian_id % 3 = 0 THEN max_scale * 9e-1 ELSE max_scale END, 1e-1)')} END AS reset FROM {{points}}"))
def p38(spark, sf_dir):
    points = fixture(spark, sf_dir, "points").withColumn("position_lr", F.col("max_scale"))
    out = P.decay_lr(points, points.filter("gaussian_id % 3 = 0"), 0.9, 0.1).withColumn("position_lr", F.round("position_lr", 6) + 0.0)
    return out.select("gaussian_id", "position_lr", P.reset_lr(F.col("exist_since") > 900, 1.0).alias("reset"))


# --- chunk tables ---


@query("a1_chunk_counts", tables("SELECT chunk_id, count(*) AS n_points FROM {chunked} GROUP BY chunk_id"))
def a1(spark, sf_dir):
    return C.chunk_counts(chunked(spark, sf_dir))


@query("a2_distinct_chunks", tables("SELECT DISTINCT chunk_id FROM {chunked}"))
def a2(spark, sf_dir):
    return C.distinct_chunks(chunked(spark, sf_dir))


@query("a3_count_all", tables("SELECT (SELECT count(*) FROM {points}) AS in_memory, CAST((SELECT sum(n_points) FROM {manifest} WHERE on_disk AND NOT loaded) AS BIGINT) AS on_disk, CAST((SELECT count(*) FROM {points}) + (SELECT sum(n_points) FROM {manifest} WHERE on_disk AND NOT loaded) AS BIGINT) AS total"))
def a3(spark, sf_dir):
    return C.count_all(fixture(spark, sf_dir, "points"), fixture(spark, sf_dir, "manifest"))


@query("a4_count_to_load", tables("SELECT CAST(sum(n_points) AS BIGINT) AS to_load FROM {manifest} WHERE chunk_id % 5 = 0"))
def a4(spark, sf_dir):
    m = fixture(spark, sf_dir, "manifest")
    return C.count_to_load(m, m.filter("chunk_id % 5 = 0"))


@query("f5_recent_points", tables("SELECT gaussian_id FROM {points} WHERE abs(exist_since - 500) < 100"))
def f5(spark, sf_dir):
    return C.recent_points(fixture(spark, sf_dir, "points"), F.lit(500), 100).select("gaussian_id")


@query("f6_prune_points", tables(f"SELECT gaussian_id FROM {{points}} WHERE NOT (gaussian_id % 2 = 0 AND (opacity <= 5e-2 OR 600 * max_scale / {_DIST} >= 5e-1 * 40))"))
def f6(spark, sf_dir):
    points = fixture(spark, sf_dir, "points")
    return C.prune_points(points, points.filter("gaussian_id % 2 = 0"), 600.0, 40.0, (1, 2, 3)).select("gaussian_id")


@query("f7_drop_sparse_chunks", tables("SELECT m.chunk_id, m.n_points FROM {manifest} m WHERE n_points >= 20"))
def f7(spark, sf_dir):
    return C.drop_sparse_chunks(chunked(spark, sf_dir), fixture(spark, sf_dir, "manifest"), 20)[1].select("chunk_id", "n_points")


@query("f7_dense_points", tables("SELECT gaussian_id FROM {chunked} WHERE chunk_id IN (SELECT chunk_id FROM {manifest} WHERE n_points >= 20)"))
def f7_points(spark, sf_dir):
    return C.drop_sparse_chunks(chunked(spark, sf_dir), fixture(spark, sf_dir, "manifest"), 20)[0].select("gaussian_id")


@query("f8_density_filter", tables(f"SELECT chunk_id, count(*) AS n_points FROM (SELECT {ID_SQL} AS chunk_id FROM (SELECT CAST(floor((x + 5) / 10) AS BIGINT) AS cx, CAST(floor((y + 5) / 10) AS BIGINT) AS cy, CAST(floor((z + 5) / 10) AS BIGINT) AS cz FROM {{big_points}})) GROUP BY chunk_id HAVING count(*) >= 200"))
def f8(spark, sf_dir):
    return C.chunk_counts(C.filter_by_density(G.with_chunk_id(fixture(spark, sf_dir, "big_points"), SIZE), 200))


@query("f14_relevant_chunks", tables("SELECT DISTINCT chunk_id FROM {kf_chunked} WHERE chunk_id IN (SELECT chunk_id FROM {manifest} WHERE loaded OR on_disk) OR chunk_id IN (SELECT chunk_id FROM {chunked} WHERE opacity < 1e-1)"))
def f14(spark, sf_dir):
    kf = fixture(spark, sf_dir, "keyframes").select(G.chunk_id("tx", "ty", "tz", SIZE).alias("chunk_id")).distinct()
    return C.relevant_chunks(kf, fixture(spark, sf_dir, "manifest"), chunked(spark, sf_dir).filter("opacity < 1e-1"))


@query("f15_every_n", tables("SELECT kfid FROM {frame_metrics} WHERE kfid % 100 = 0"))
def f15(spark, sf_dir):
    from ..operators.schedule import every_n

    return every_n(fixture(spark, sf_dir, "frame_metrics"), "kfid", 100).select("kfid")


@query("j9_in_chunks", tables("SELECT gaussian_id, true AS inside FROM {chunked} WHERE chunk_id IN (SELECT chunk_id FROM {manifest} WHERE loaded) UNION ALL SELECT gaussian_id, false FROM {chunked} WHERE chunk_id NOT IN (SELECT chunk_id FROM {manifest} WHERE loaded)"))
def j9(spark, sf_dir):
    points, loaded = chunked(spark, sf_dir), fixture(spark, sf_dir, "manifest").filter("loaded")
    return C.in_chunks(points, loaded).select("gaussian_id", F.lit(True).alias("inside")).union(C.not_in_chunks(points, loaded).select("gaussian_id", F.lit(False)))


@query("k4_chunk_names", tables("SELECT DISTINCT chunk_id, CASE WHEN cx >= 0 THEN 'p' ELSE 'n' END || CAST(abs(cx) AS VARCHAR) || '_' || CASE WHEN cy >= 0 THEN 'p' ELSE 'n' END || CAST(abs(cy) AS VARCHAR) || '_' || CASE WHEN cz >= 0 THEN 'p' ELSE 'n' END || CAST(abs(cz) AS VARCHAR) AS name FROM {chunked}"))
def k4(spark, sf_dir):
    return C.distinct_chunks(chunked(spark, sf_dir)).select("chunk_id", C.chunk_filename(G.chunk_decode("chunk_id")).alias("name"))


@query("w6_assigned_ids", tables("SELECT o.gaussian_id, row_number() OVER (ORDER BY z, gaussian_id) - 1 + 500 AS new_id FROM {points} o"))
def w6(spark, sf_dir):
    return C.assign_ids(fixture(spark, sf_dir, "points"), ["z", "gaussian_id"], 500, "new_id").select("gaussian_id", "new_id")
