"""Pixel tables (frame_id, v, u, ...): samples, gathers, filters, pyramids, quality measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_keypoints(keypoints: DataFrame, width: int, height: int, least: float = 0.0) -> DataFrame:
    """Keypoints inside the image with a finite depth above ``least``."""
    u, v, z = F.col("u"), F.col("v"), F.col("z")
    finite = ~F.isnan(z) & (F.abs(z) < float("inf"))
    return keypoints.filter(finite & (z > least) & (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1))


def valid_depth(samples: DataFrame, depth: str = "depth", conf: str = "conf") -> DataFrame:
    return samples.filter((F.col(depth) > 1e-6) & (F.col(conf) > 0.5))


def unoccluded(samples: DataFrame, existing: DataFrame, depth: str = "depth") -> DataFrame:
    """Samples nearer than what is known at their pixel; pixels without depth do not hide."""
    known = existing.select("frame_id", "v", "u", F.col(depth).alias("_known"))
    both = samples.join(known, ["frame_id", "v", "u"], "left")
    return both.filter(F.col("_known").isNull() | (F.col("_known") <= 0) | (F.col(depth) < F.col("_known"))).drop("_known")


def over_hit_ids(samples: DataFrame, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """Ids that ``least`` or more accurate samples hit (in each group of ``by``); -1 stands for none."""
    hits = samples.filter("accurate and main_id <> -1").groupBy(*(by or []), "main_id").agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= least)


def sample_bilinear(points: DataFrame, pixels: DataFrame, value: str, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """points(frame_id, keys, u, v) -> keys, value from the four pixels around; zero outside the image."""
    u0, v0 = F.floor(u), F.floor(v)
    corners = [F.struct((v0 + dv).cast("long").alias("v"), (u0 + du).cast("long").alias("u"), ((1 - F.abs(F.col(v) - v0 - dv)) * (1 - F.abs(F.col(u) - u0 - du))).alias("w")) for dv in (0, 1) for du in (0, 1)]
    asked = points.select("frame_id", *keys, F.explode(F.array(*corners)).alias("c")).select("frame_id", *keys, "c.*").filter("w > 0")
    met = asked.join(pixels.select("frame_id", "v", "u", F.col(value).alias("_val")), ["frame_id", "v", "u"], "left")
    return met.groupBy("frame_id", *keys).agg(F.sum(F.col("w") * F.coalesce("_val", F.lit(0.0))).alias(value))


def merge_samples(samples: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Samples and matched keypoints in one table, with their origin; a column that one of them lacks is null there."""
    return samples.withColumn("origin", F.lit("sample")).unionByName(keypoints.withColumn("origin", F.lit("keypoint")), allowMissingColumns=True)


def gather_pixels(samples: DataFrame, pixels: DataFrame) -> DataFrame:
    return samples.join(pixels, ["frame_id", "v", "u"])


def distort(u: Column, v: Column, camera: dict, k: tuple) -> tuple[Column, Column]:
    """Where an undistorted pixel lies in the distorted image (radial k1, k2, k3 and tangential p1, p2)."""
    k1, k2, p1, p2, k3 = k
    x, y = (u - camera["cx"]) / camera["fx"], (v - camera["cy"]) / camera["fy"]
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return xd * camera["fx"] + camera["cx"], yd * camera["fy"] + camera["cy"]


def undistort_pixels(pixels: DataFrame, value: str, camera: dict, k: tuple) -> DataFrame:
    """Every pixel of the undistorted frame, read linearly from the distorted one."""
    u, v = distort(F.col("u").cast("double"), F.col("v").cast("double"), camera, k)
    wanted = pixels.select("frame_id", F.col("v").alias("pv"), F.col("u").alias("pu"), u.alias("u"), v.alias("v"))
    out = sample_bilinear(wanted, pixels, value, ["pv", "pu"])
    return out.select("frame_id", F.col("pv").alias("v"), F.col("pu").alias("u"), value)


def frame_pairs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return a.select("frame_id", "v", "u", F.col(value).alias("a")).join(b.select("frame_id", "v", "u", F.col(value).alias("b")), ["frame_id", "v", "u"])


def psnr(pairs: DataFrame, peak: float | str = 1.0) -> DataFrame:
    """By frame.  ``peak``: the largest possible value, or 'target_max' for the range of b; identical frames give null."""
    top = F.max("b") - F.min("b") if peak == "target_max" else F.max(F.lit(float(peak)))
    agg = pairs.groupBy("frame_id").agg(F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("mse"), top.alias("top"))
    return agg.select("frame_id", (10 * F.log10(F.try_divide(F.col("top") * F.col("top"), F.col("mse")))).alias("psnr"))


def smooth_l1(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy("frame_id").agg(F.avg(d).alias("l1"), F.avg(F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2)).alias("smooth_l1"))


def total_variation(pixels: DataFrame, value: str) -> DataFrame:
    """Mean absolute step to the right plus that downward; neighbours meet by a join on shifted keys."""
    p = pixels.select("frame_id", "v", "u", F.col(value).alias("a"))
    right = p.join(p.select("frame_id", "v", (F.col("u") - 1).alias("u"), F.col("a").alias("b")), ["frame_id", "v", "u"]).select("frame_id", F.abs(F.col("b") - F.col("a")).alias("dx"), F.lit(None).cast("double").alias("dy"))
    down = p.join(p.select("frame_id", (F.col("v") - 1).alias("v"), "u", F.col("a").alias("b")), ["frame_id", "v", "u"]).select("frame_id", F.lit(None).cast("double").alias("dx"), F.abs(F.col("b") - F.col("a")).alias("dy"))
    return right.union(down).groupBy("frame_id").agg((F.avg("dx") + F.avg("dy")).alias("tv"))


def depth_errors(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """pairs(frame_id, a: predicted, b: true): L1 and smooth L1 with unknown truth (0) as no error but counted; scale-invariant log error over both positive, 0 if none."""
    d = F.when(F.col("b") == 0, 0.0).otherwise(F.abs(F.col("a") - F.col("b")))
    logs = F.when((F.col("a") > 0) & (F.col("b") > 0), F.log(F.greatest("a", F.lit(1e-30))) - F.log(F.greatest("b", F.lit(1e-30))))
    return pairs.groupBy("frame_id").agg(
        F.avg(d).alias("depth_l1"), F.avg(F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2)).alias("depth_smooth_l1"),
        F.coalesce(F.avg(logs * logs) - F.avg(logs) * F.avg(logs), F.lit(0.0)).alias("silog"),
        F.avg(F.abs(1 / F.greatest("a", F.lit(1e-8)) - 1 / F.greatest("b", F.lit(1e-8)))).alias("inv_depth_l1"),
    )


def error_map(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("error", F.abs(F.col("a") - F.col("b")))


def pyramid(pixels: DataFrame, value: str, inverse_depth: str, levels: int) -> DataFrame:
    """Each level by 2^level: means of colour, every 2^level-th inverse depth."""
    out = None
    for level in range(levels):
        side = 1 << level
        at = [F.floor(F.col(c) / side).cast("long").alias(c) for c in ("v", "u")]
        own = F.when((F.col("u") % side == 0) & (F.col("v") % side == 0), F.col(inverse_depth))
        one = pixels.select("frame_id", *at, F.col(value), own.alias(inverse_depth)).groupBy("frame_id", "v", "u").agg(F.avg(value).alias(value), F.max(inverse_depth).alias(inverse_depth))
        one = one.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def blur_pool(pixels: DataFrame, value: str) -> DataFrame:
    """2 x 2 means, read back linearly at the full size (pixel centres aligned, edges held)."""
    half = pyramid(pixels.withColumn("_d", F.lit(0.0)), value, "_d", 2).filter("level = 1")
    ends = half.groupBy("frame_id").agg(F.max("v").alias("_mv"), F.max("u").alias("_mu"))
    at = lambda c, m: F.least(F.greatest((F.col(c) + 0.5) / 2 - 0.5, F.lit(0.0)), F.col(m).cast("double"))
    wanted = pixels.join(ends, "frame_id").select("frame_id", F.col("v").alias("pv"), F.col("u").alias("pu"), at("v", "_mv").alias("v"), at("u", "_mu").alias("u"))
    return sample_bilinear(wanted, half.select("frame_id", "v", "u", value), value, ["pv", "pu"]).select("frame_id", F.col("pv").alias("v"), F.col("pu").alias("u"), value)


def depth_confidence(pixels: DataFrame, depth: str) -> DataFrame:
    """exp(-(gx^2 + gy^2) / 0.2) of 3 x 3 Sobel steps with zeros outside; each pixel sends its share to nine neighbours."""
    weights = [(dv, du, float(-du * (2 - abs(dv))), float(-dv * (2 - abs(du)))) for dv in (-1, 0, 1) for du in (-1, 0, 1)]
    sent = F.array(*[F.struct((F.col("v") + dv).alias("v"), (F.col("u") + du).alias("u"), (F.lit(wx) * F.col(depth)).alias("gx"), (F.lit(wy) * F.col(depth)).alias("gy"), F.lit(dv == 0 and du == 0).alias("own")) for dv, du, wx, wy in weights])
    parts = pixels.select("frame_id", F.explode(sent).alias("s")).select("frame_id", "s.*")
    g = parts.groupBy("frame_id", "v", "u").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.max("own").alias("own")).filter("own")
    return g.select("frame_id", "v", "u", F.exp(-(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 0.2).alias("conf"))


def normalize_depth(pixels: DataFrame, depth: str) -> DataFrame:
    """(d - median) / mean absolute deviation, by frame."""
    mid = pixels.groupBy("frame_id").agg(F.median(depth).alias("_t"))
    both = pixels.join(mid, "frame_id")
    dev = both.groupBy("frame_id").agg(F.avg(F.abs(F.col(depth) - F.col("_t"))).alias("_s"))
    return both.join(dev, "frame_id").withColumn("normalized", F.try_divide(F.col(depth) - F.col("_t"), F.col("_s"))).drop("_t", "_s")


def align_depth(pairs: DataFrame, least: int = 5) -> DataFrame:
    """pairs(frame_id, predicted, target) of inverse depths -> least-squares scale and bias of frames with at least ``least`` pairs."""
    agg = pairs.groupBy("frame_id").agg(F.count("*").alias("n"), F.regr_slope("target", "predicted").alias("scale"), F.regr_intercept("target", "predicted").alias("bias"))
    return agg.filter(F.col("n") >= least)


def _ssim(a: np.ndarray, b: np.ndarray, peak: float = 1.0, size: int = 11, sigma: float = 1.5) -> float:
    x = np.arange(size) - size // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()

    def blur(m):
        m = np.pad(m, size // 2)
        m = sum(w * m[i : m.shape[0] - size + 1 + i] for i, w in enumerate(g))
        return sum(w * m[:, i : m.shape[1] - size + 1 + i] for i, w in enumerate(g))

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def ssim(pairs: DataFrame) -> DataFrame:
    """pairs(frame_id, v, u, a, b) -> frame_id, ssim with an 11 x 11 Gaussian window; one frame at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf["v"].max()) + 1, int(pdf["u"].max()) + 1
        planes = []
        for c in "ab":
            plane = np.zeros(shape)
            plane[pdf["v"].astype(int), pdf["u"].astype(int)] = pdf[c]
            planes.append(plane)
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "ssim": [_ssim(*planes)]})

    return pairs.groupBy("frame_id").applyInPandas(run, "frame_id long, ssim double")


def frame_loss(pairs: DataFrame, depth: DataFrame, share: float = 0.2, depth_weight: float = 0.1) -> DataFrame:
    """(1 - share) L1 + share (1 - SSIM) + depth_weight x inverse-depth error."""
    both = smooth_l1(pairs).join(ssim(pairs), "frame_id").join(depth.select("frame_id", "inv_depth_l1"), "frame_id")
    return both.select("frame_id", ((1 - share) * F.col("l1") + share * (1 - F.col("ssim")) + depth_weight * F.col("inv_depth_l1")).alias("loss"))
