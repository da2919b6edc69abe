"""Queries of pixel tables and image quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import points as P
from ..operators import images as I
from .fixtures import fixture, r6, tables
from .geometry_queries import SIZE, r
from .registry import query

_VAL = "(SELECT a.frame_id, a.v, a.u, a.val AS a, b.val AS b FROM {pixels} a JOIN {pixels_gt} b USING (frame_id, v, u))"
_DEPTH = "(SELECT a.frame_id, 1 / a.inv_depth AS a, b.depth AS b FROM {pixels} a JOIN {pixels_gt} b USING (frame_id, v, u))"
INTR = {"fx": 600.0, "fy": 600.0, "cx": 4.0, "cy": 4.0, "width": 1200}


def px(spark, sf_dir, name="pixels"):
    return fixture(spark, sf_dir, name)


def val_pairs(spark, sf_dir):
    return I.frame_pairs(px(spark, sf_dir), px(spark, sf_dir, "pixels_gt"), "val")


def depth_pairs(spark, sf_dir):
    return I.frame_pairs(px(spark, sf_dir).withColumn("depth", 1 / F.col("inv_depth")), px(spark, sf_dir, "pixels_gt"), "depth")


@query("p17_unprojected", tables(f"SELECT frame_id, v, u, {r6('(u - 4) / inv_depth / 600')} AS x, {r6('(v - 4) / inv_depth / 600')} AS y, {r6('1 / inv_depth')} AS z FROM {{pixels}}"))
def p17(spark, sf_dir):
    flat = px(spark, sf_dir).select("frame_id", P.pixel_of(F.col("v") * 8 + F.col("u"), F.lit(8)).alias("p"), (1 / F.col("inv_depth")).alias("d")).select("frame_id", "p.*", "d")
    out = flat.select("frame_id", "v", "u", P.unproject("u", "v", "d", *[F.lit(INTR[k]) for k in ("fx", "fy", "cx", "cy")]).alias("q"))
    return out.select("frame_id", "v", "u", *[r(F.col(f"q.{a}"), a) for a in "xyz"])


@query("p18_stereo_depth", tables(f"SELECT frame_id, v, u, {r6('120 / (inv_depth * 1200 / 640)')} AS depth, {r6('(u - 4) / (inv_depth / 2e-1)')} AS x FROM {{pixels}}"))
def p18(spark, sf_dir):
    depth = P.disparity_to_depth("inv_depth", P.stereo_bf(F.lit(0.2), F.lit(600.0)), F.lit(1200), F.lit(640))
    return px(spark, sf_dir).select("frame_id", "v", "u", r(depth, "depth"), r(P.reproject_disparity("u", "v", "inv_depth", F.lit(600.0), F.lit(4.0), F.lit(4.0), F.lit(0.2))["x"], "x"))


@query("p19_depth_columns", tables(f"SELECT frame_id, v, u, {r6('1 / greatest(inv_depth, 1e-8)')} AS depth, {r6('inv_depth * 2 + 5e-1')} AS affine, CAST(CASE WHEN inv_depth - 2e-1 <= 0 THEN 0 ELSE least(round((inv_depth - 2e-1) * 1000), 65535) END AS INTEGER) AS mm FROM {{pixels}}"))
def p19(spark, sf_dir):
    d = F.col("inv_depth")
    return px(spark, sf_dir).select("frame_id", "v", "u", r(P.inverse_depth(d), "depth"), r(P.apply_depth_affine(d, F.lit(2.0), F.lit(0.5)), "affine"), P.depth_to_mm(d - 0.2).alias("mm"))


_GREY = "pow(2973e-4 * pow(abs(val), 22e-1) + 6274e-4 * pow(abs(val), 22e-1) + 753e-4 * pow(abs(val), 22e-1), 1 / 22e-1)"


@query("p22_colour_columns", tables(f"SELECT frame_id, v, u, {r6(_GREY)} AS grey, {r6('greatest(0e0, least(1e0, val * 12e-1 - 1e-1))')} AS red, {r6('(val - 5e-1) / 28209479177387814e-17')} AS sh FROM {{pixels}}"))
def p22(spark, sf_dir):
    c, k = F.abs("val"), F.col("val")
    red = P.apply_exposure(k, k, k, [1.2, 0.0, 0.0, -0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])[0]
    return px(spark, sf_dir).select("frame_id", "v", "u", r(P.rgb2gray(c, c, c), "grey"), r(red, "red"), r(F.get(P.rgb_to_sh(k, k, k), F.lit(0)), "sh"))


@query("p30_depth_bytes", tables("SELECT frame_id, v, u, CAST(floor((inv_depth - lo) / (hi - lo) * 255) AS INTEGER) AS byte FROM (SELECT *, min(inv_depth) OVER w AS lo, max(inv_depth) OVER w AS hi FROM {pixels} WINDOW w AS (PARTITION BY frame_id))"))
def p30(spark, sf_dir):
    return P.depth_to_u8(px(spark, sf_dir), "inv_depth", "frame_id").select("frame_id", "v", "u", "byte")


@query("f9_valid_keypoints", tables("SELECT keypoint_id FROM {keypoints} WHERE z > 0 AND u BETWEEN 0 AND 1199 AND v BETWEEN 0 AND 679"))
def f9(spark, sf_dir):
    return I.valid_keypoints(px(spark, sf_dir, "keypoints"), 1200, 680).select("keypoint_id")


@query("f10_valid_depth", tables("SELECT frame_id, v, u FROM {samples} WHERE 1 / inv_depth > 1e-6 AND conf > 5e-1"))
def f10(spark, sf_dir):
    return I.valid_depth(px(spark, sf_dir, "samples").withColumn("depth", 1 / F.col("inv_depth"))).select("frame_id", "v", "u")


@query("f11_unoccluded", tables("SELECT s.frame_id, s.v, s.u FROM {samples} s JOIN {pixels_gt} g USING (frame_id, v, u) WHERE g.depth <= 0 OR 2 * conf < g.depth"))
def f11(spark, sf_dir):
    s = px(spark, sf_dir, "samples").withColumn("depth", 2 * F.col("conf"))
    return I.unoccluded(s, px(spark, sf_dir, "pixels_gt")).select("frame_id", "v", "u")


@query("f12_over_hit", tables("SELECT main_id, count(*) AS hits FROM {samples} WHERE accurate AND main_id <> -1 GROUP BY main_id HAVING count(*) >= 10"))
def f12(spark, sf_dir):
    return I.over_hit_ids(px(spark, sf_dir, "samples"), 10)


@query("j13_bilinear", tables(f"SELECT p.frame_id, p.v AS pv, p.u AS pu, {r6('25e-2 * (p.val + coalesce(a.val, 0) + coalesce(b.val, 0) + coalesce(c.val, 0))')} AS val FROM {{pixels}} p LEFT JOIN {{pixels}} a ON a.frame_id = p.frame_id AND a.v = p.v AND a.u = p.u + 1 LEFT JOIN {{pixels}} b ON b.frame_id = p.frame_id AND b.v = p.v + 1 AND b.u = p.u LEFT JOIN {{pixels}} c ON c.frame_id = p.frame_id AND c.v = p.v + 1 AND c.u = p.u + 1"))
def j13(spark, sf_dir):
    pixels = px(spark, sf_dir)
    points = pixels.select("frame_id", F.col("v").alias("pv"), F.col("u").alias("pu"), (F.col("u") + 0.5).alias("u"), (F.col("v") + 0.5).alias("v"))
    return I.sample_bilinear(points, pixels, "val", ["pv", "pu"]).select("frame_id", "pv", "pu", r(F.col("val"), "val"))


@query("j14_gathered", tables("SELECT frame_id, v, u, main_id, depth FROM {samples} JOIN {pixels_gt} USING (frame_id, v, u)"))
def j14(spark, sf_dir):
    return I.gather_pixels(px(spark, sf_dir, "samples"), px(spark, sf_dir, "pixels_gt").select("frame_id", "v", "u", "depth")).select("frame_id", "v", "u", "main_id", "depth")


_X, _Y = "((u - 4) / 8e0)", "((v - 4) / 8e0)"
_RR = f"({_X} * {_X} + {_Y} * {_Y})"
_RADIAL = f"(1 + 5e-2 * {_RR} - 2e-2 * {_RR} * {_RR} + 1e-3 * {_RR} * {_RR} * {_RR})"
_DU = f"(8 * ({_X} * {_RADIAL} + 6e-3 * {_X} * {_Y} - 2e-3 * ({_RR} + 2 * {_X} * {_X})) + 4)"
_DV = f"(8 * ({_Y} * {_RADIAL} + 3e-3 * ({_RR} + 2 * {_Y} * {_Y}) - 4e-3 * {_X} * {_Y}) + 4)"
_READ = f"(SELECT frame_id, v AS pv, u AS pu, {_DU} AS du, {_DV} AS dv FROM {{pixels}})"


@query("j15_undistorted", tables(f"SELECT r.frame_id, pv AS v, pu AS u, {r6('sum(coalesce(val, 0) * (1 - abs(dv - v)) * (1 - abs(du - u)))')} AS val FROM {_READ} r LEFT JOIN {{pixels}} p ON p.frame_id = r.frame_id AND p.v BETWEEN floor(dv) AND floor(dv) + 1 AND p.u BETWEEN floor(du) AND floor(du) + 1 GROUP BY r.frame_id, pv, pu"))
def j15(spark, sf_dir):
    out = I.undistort_pixels(px(spark, sf_dir), "val", {"fx": 8.0, "fy": 8.0, "cx": 4.0, "cy": 4.0}, (0.05, -0.02, 0.003, -0.002, 0.001))
    return out.select("frame_id", "v", "u", r(F.col("val"), "val"))


@query("a13_psnr", tables(f"SELECT frame_id, {r6('10 * log10(1 / avg(pow(a - b, 2)))')} AS psnr FROM {_VAL} GROUP BY frame_id"))
def a13(spark, sf_dir):
    return I.psnr(val_pairs(spark, sf_dir)).select("frame_id", r(F.col("psnr"), "psnr"))


@query("a14_ssim")
def a14(spark, sf_dir):
    return I.ssim(val_pairs(spark, sf_dir))


@query("a15_l1", tables(f"SELECT frame_id, {r6('avg(abs(a - b))')} AS l1, {r6('avg(CASE WHEN abs(a - b) < 2e-2 THEN (a - b) * (a - b) / 4e-2 ELSE abs(a - b) - 1e-2 END)')} AS smooth_l1 FROM {_VAL} GROUP BY frame_id"))
def a15(spark, sf_dir):
    return I.smooth_l1(val_pairs(spark, sf_dir), 0.02).select("frame_id", r(F.col("l1"), "l1"), r(F.col("smooth_l1"), "smooth_l1"))


@query("a15_total_variation", tables(f"SELECT frame_id, {r6('avg(abs(dx)) + avg(abs(dy))')} AS tv FROM (SELECT frame_id, lead(val) OVER (PARTITION BY frame_id, v ORDER BY u) - val AS dx, lead(val) OVER (PARTITION BY frame_id, u ORDER BY v) - val AS dy FROM {{pixels}}) GROUP BY frame_id"))
def a15_tv(spark, sf_dir):
    return I.total_variation(px(spark, sf_dir), "val").select("frame_id", r(F.col("tv"), "tv"))


_LOGS = "CASE WHEN a > 0 AND b > 0 THEN ln(a) - ln(greatest(b, 1e-30)) END"


@query("a16_depth_errors", tables(f"SELECT frame_id, {r6('avg(CASE WHEN b = 0 THEN 0 ELSE abs(a - b) END)')} AS depth_l1, {r6(f'avg({_LOGS} * {_LOGS}) - avg({_LOGS}) * avg({_LOGS})')} AS silog FROM {_DEPTH} GROUP BY frame_id"))
def a16(spark, sf_dir):
    return I.depth_errors(depth_pairs(spark, sf_dir)).select("frame_id", r(F.col("depth_l1"), "depth_l1"), r(F.col("silog"), "silog"))


@query("a17_frame_loss")
def a17(spark, sf_dir):
    return I.frame_loss(val_pairs(spark, sf_dir), I.depth_errors(depth_pairs(spark, sf_dir)))


@query("a18_error_map", tables(f"SELECT frame_id, v, u, {r6('abs(a - b)')} AS error FROM {_VAL}"))
def a18(spark, sf_dir):
    return I.error_map(val_pairs(spark, sf_dir)).select("frame_id", "v", "u", r(F.col("error"), "error"))


@query("a19_pyramid", tables(" UNION ALL ".join(f"SELECT frame_id, v // {s} AS v, u // {s} AS u, {i} AS level, {r6('avg(val)')} AS val, {r6(f'max(CASE WHEN v % {s} = 0 AND u % {s} = 0 THEN inv_depth END)')} AS inv_depth FROM {{pixels}} GROUP BY frame_id, v // {s}, u // {s}" for i, s in enumerate((1, 2, 4)))))
def a19(spark, sf_dir):
    return I.pyramid(px(spark, sf_dir), "val", "inv_depth", 3).select("frame_id", "v", "u", "level", r(F.col("val"), "val"), r(F.col("inv_depth"), "inv_depth"))


@query("a20_blur_pool")
def a20(spark, sf_dir):
    return I.blur_pool(px(spark, sf_dir), "val")


_D = lambda dv, du: f"coalesce(max(n.inv_depth) FILTER (n.v = p.v + {dv} AND n.u = p.u + {du}), 0)"
_GX = f"({_D(-1, 1)} + 2 * {_D(0, 1)} + {_D(1, 1)} - {_D(-1, -1)} - 2 * {_D(0, -1)} - {_D(1, -1)})"
_GY = f"({_D(1, -1)} + 2 * {_D(1, 0)} + {_D(1, 1)} - {_D(-1, -1)} - 2 * {_D(-1, 0)} - {_D(-1, 1)})"


@query("a21_depth_confidence", tables(f"SELECT p.frame_id, p.v, p.u, {r6(f'exp(-({_GX} * {_GX} + {_GY} * {_GY}) / 2e-1)')} AS conf FROM {{pixels}} p JOIN {{pixels}} n ON n.frame_id = p.frame_id AND abs(n.v - p.v) <= 1 AND abs(n.u - p.u) <= 1 GROUP BY p.frame_id, p.v, p.u"))
def a21(spark, sf_dir):
    return I.depth_confidence(px(spark, sf_dir), "inv_depth").select("frame_id", "v", "u", r(F.col("conf"), "conf"))


@query("a22_normalized_depth", tables(f"SELECT frame_id, v, u, {r6('(inv_depth - m) / avg(abs(inv_depth - m)) OVER (PARTITION BY frame_id)')} AS normalized FROM (SELECT *, median(inv_depth) OVER (PARTITION BY frame_id) AS m FROM {{pixels}})"))
def a22(spark, sf_dir):
    return I.normalize_depth(px(spark, sf_dir), "inv_depth").select("frame_id", "v", "u", r(F.col("normalized"), "normalized"))


@query("a23_aligned_depth", tables(f"SELECT frame_id, {r6('regr_slope(b, a)')} AS scale, {r6('regr_intercept(b, a)')} AS bias FROM {_VAL} GROUP BY frame_id HAVING count(*) >= 5"))
def a23(spark, sf_dir):
    pairs = val_pairs(spark, sf_dir).select("frame_id", F.col("a").alias("predicted"), F.col("b").alias("target"))
    return I.align_depth(pairs).select("frame_id", r(F.col("scale"), "scale"), r(F.col("bias"), "bias"))
