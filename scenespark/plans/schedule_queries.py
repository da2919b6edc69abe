"""Queries of schedules, rankings and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import schedule as S
from .fixtures import fixture, r6, tables
from .geometry_queries import SIZE, r
from .registry import query


def kf(spark, sf_dir):
    return fixture(spark, sf_dir, "keyframes").withColumn("chunk_id", G.chunk_id("tx", "ty", "tz", SIZE))


_TOP = "(SELECT fid, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY loss DESC, fid) AS n, greatest(1, count(*) OVER (PARTITION BY chunk_id) // 4) AS k FROM {kf_chunked})"
_REFILL = f"(SELECT c.fid, c.chunk_id, remaining + CASE WHEN max(remaining) OVER (PARTITION BY c.chunk_id) <= 0 THEN 1 + CASE WHEN t.n <= t.k THEN 1 ELSE 0 END ELSE 0 END AS remaining FROM {{kf_chunked}} c JOIN {_TOP} t ON t.fid = c.fid)"


@query("w2_top_loss", tables(f"SELECT fid, chunk_id FROM {_TOP} WHERE n <= k"))
def w2(spark, sf_dir):
    return S.top_loss(kf(spark, sf_dir)).select("fid", "chunk_id")


@query("w3_refilled_uses", tables(f"SELECT fid, remaining FROM {_REFILL}"))
def w3(spark, sf_dir):
    return S.refill_uses(kf(spark, sf_dir)).select("fid", "remaining")


# two measurements of a loss, none for every fifth keyframe
_LOSSES = "(SELECT fid, CASE WHEN fid % 5 = 0 THEN 0e0 ELSE loss + 2e-1 END AS loss FROM {keyframes})"
_LOOKED_UP = f"(SELECT c.fid, c.chunk_id, remaining, row_number() OVER (PARTITION BY c.chunk_id ORDER BY l.loss DESC, c.fid) AS n, greatest(1, count(*) OVER (PARTITION BY c.chunk_id) // 4) AS k, max(remaining) OVER (PARTITION BY c.chunk_id) AS most FROM {{kf_chunked}} c JOIN {_LOSSES} l ON l.fid = c.fid)"


def _losses(spark, sf_dir):
    """A loss table of its own: measured more than once, missing for every fifth keyframe."""
    keyframes = fixture(spark, sf_dir, "keyframes")
    return keyframes.filter("fid % 5 <> 0").select("fid", F.explode(F.array(F.col("loss"), F.col("loss") + 0.1, F.col("loss") + 0.2, F.lit(None))).alias("loss"))


@query("j17_refilled_by_lookup", tables(f"SELECT fid, remaining + CASE WHEN most <= 0 THEN 1 + CASE WHEN n <= k THEN 1 ELSE 0 END ELSE 0 END AS remaining FROM {_LOOKED_UP}"))
def j17(spark, sf_dir):
    return S.refill_uses(kf(spark, sf_dir).drop("loss"), losses=_losses(spark, sf_dir)).select("fid", "remaining")


@query("j17_top_by_lookup", tables(f"SELECT fid, chunk_id FROM {_LOOKED_UP} WHERE n <= k"))
def j17_top(spark, sf_dir):
    return S.top_loss(kf(spark, sf_dir).drop("loss"), losses=_losses(spark, sf_dir)).select("fid", "chunk_id")


@query("w4_weighted_pick")
def w4(spark, sf_dir):
    return S.weighted_pick(kf(spark, sf_dir), 42)


@query("w5_recent_distinct", tables("SELECT run_id, round(max(t), 3) AS last_used FROM {poses} GROUP BY run_id ORDER BY max(t) DESC, run_id DESC LIMIT 20"))
def w5(spark, sf_dir):
    return S.recent_distinct(fixture(spark, sf_dir, "poses"), "run_id", "t", 20).select("run_id", F.round("last_used", 3).alias("last_used"))


_EMA = "WITH RECURSIVE m AS (SELECT run_id, kfid, psnr, row_number() OVER (PARTITION BY run_id ORDER BY kfid) AS n FROM {frame_metrics}), e AS (SELECT run_id, kfid, n, 4e-1 * psnr AS ema FROM m WHERE n = 1 UNION ALL SELECT m.run_id, m.kfid, m.n, 4e-1 * m.psnr + 6e-1 * e.ema FROM e JOIN m ON m.run_id = e.run_id AND m.n = e.n + 1) "


@query("w8_ema", tables(f"{_EMA} SELECT kfid, {r6('ema')} AS ema FROM e"))
def w8(spark, sf_dir):
    return S.ema(fixture(spark, sf_dir, "frame_metrics"), "run_id", "kfid", "psnr").select("kfid", r(F.col("ema"), "ema"))


@query("w8_ema_window", tables(f"{_EMA} SELECT kfid, {r6('ema')} AS ema FROM e"))
def w8_window(spark, sf_dir):
    return S.ema_window(fixture(spark, sf_dir, "frame_metrics"), "run_id", "kfid", "psnr").select("kfid", r(F.col("ema"), "ema"))


@query("w9_last_n", tables("SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY run_id ORDER BY t DESC, frame_id DESC) AS n FROM {poses}) WHERE n <= 5"))
def w9(spark, sf_dir):
    return S.last_n(fixture(spark, sf_dir, "poses"), "run_id", "t", "frame_id", 5).select("frame_id")


@query("w12_pyramid_schedule", tables("SELECT kfid, CAST(greatest(0, 2 - (row_number() OVER (PARTITION BY run_id ORDER BY kfid) - 1) // 4) AS INTEGER) AS level FROM {frame_metrics}"))
def w12(spark, sf_dir):
    return S.pyramid_schedule(fixture(spark, sf_dir, "frame_metrics"), 3, 4, "run_id", "kfid").select("kfid", "level")


@query("o1_nearest_points", tables(f"SELECT gaussian_id, {r6('sqrt(x * x + y * y + z * z)')} AS dist FROM {{points}} ORDER BY sqrt(x * x + y * y + z * z), gaussian_id LIMIT 25"))
def o1(spark, sf_dir):
    return S.nearest_n(fixture(spark, sf_dir, "points"), (0, 0, 0), 25, "gaussian_id").select("gaussian_id", r(F.col("dist"), "dist"))


@query("o2_top_k", tables("SELECT gaussian_id FROM {points} ORDER BY max_scale DESC, gaussian_id LIMIT 25"))
def o2(spark, sf_dir):
    return S.top_k(fixture(spark, sf_dir, "points"), "max_scale", 25, "gaussian_id").select("gaussian_id")


@query("o3_frame_order", "SELECT url AS path, row_number() OVER (ORDER BY url) - 1 AS frame_index FROM (SELECT DISTINCT url FROM pages)")
def o3(spark, sf_dir):
    return S.frame_order(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")).distinct())


@query("o4_oldest_chunks", tables("SELECT chunk_id FROM {manifest} ORDER BY coalesce(last_access, 0), chunk_id"))
def o4(spark, sf_dir):
    return S.oldest_first(fixture(spark, sf_dir, "manifest")).select("chunk_id")


_METRICS = ("psnr", "ssim", "lpips")


@query("a5_metric_summary", tables(" UNION ALL ".join(f"SELECT '{m}' AS metric, {r6(f'avg({m})')} AS mean, {r6(f'stddev_pop({m})')} AS std, {r6(f'min({m})')} AS min, {r6(f'max({m})')} AS max, {r6(f'median({m})')} AS median FROM {{frame_metrics}}" for m in _METRICS)))
def a5(spark, sf_dir):
    out = S.metric_summary(fixture(spark, sf_dir, "frame_metrics"), list(_METRICS))
    return out.select("metric", *[r(F.col(c), c) for c in ("mean", "std", "min", "max", "median")])


@query("a6_render_fps", tables(f"SELECT run_id, {r6('avg(render_ms)')} AS mean_ms, {r6('1000 / avg(render_ms)')} AS fps FROM {{frame_metrics}} GROUP BY run_id"))
def a6(spark, sf_dir):
    return S.render_fps(fixture(spark, sf_dir, "frame_metrics"), "run_id", "render_ms").select("run_id", r(F.col("mean_ms"), "mean_ms"), r(F.col("fps"), "fps"))


@query("a7_tracking_fps", tables(f"SELECT run_id, {r6('coalesce(1 / avg(render_ms) FILTER (n > 3), 0e0)')} AS tracking_fps FROM (SELECT run_id, render_ms, row_number() OVER (PARTITION BY run_id ORDER BY kfid DESC) AS n FROM {{frame_metrics}}) GROUP BY run_id"))
def a7(spark, sf_dir):
    return S.tracking_fps(fixture(spark, sf_dir, "frame_metrics"), "run_id", "kfid", "render_ms").select("run_id", r(F.col("tracking_fps"), "tracking_fps"))


@query("a12_timing_stats", tables(f"SELECT event_type, {r6('avg(render_ms)')} AS avg_ms, {r6('min(render_ms)')} AS min_ms, {r6('max(render_ms)')} AS max_ms, {r6('sum(render_ms)')} AS total_ms, count(*) AS calls FROM {{frame_metrics}} GROUP BY event_type"))
def a12(spark, sf_dir):
    out = S.timing_stats(fixture(spark, sf_dir, "frame_metrics"), "event_type", "render_ms")
    return out.select("event_type", *[r(F.col(c), c) for c in ("avg_ms", "min_ms", "max_ms", "total_ms")], "calls")


@query("a24_training_rate", tables(f"SELECT kfid, {r6('(kfid - lag(kfid) OVER w) / (t - lag(t) OVER w) * 1000')} AS rate FROM {{frame_metrics}} WINDOW w AS (PARTITION BY run_id ORDER BY kfid)"))
def a24(spark, sf_dir):
    return S.training_rate(fixture(spark, sf_dir, "frame_metrics"), "run_id", "kfid", "t").select("kfid", r(F.col("rate") * 1000, "rate"))


@query("a25_used_counts", tables("SELECT fid, count(*) AS used FROM {observations} GROUP BY fid"))
def a25(spark, sf_dir):
    return S.used_counts(fixture(spark, sf_dir, "observations"))


@query("z7_training_schedule")
def z7(spark, sf_dir):
    return S.training_schedule(kf(spark, sf_dir), 7).select("fid", "chunk_id", "picked", "remaining")


@query("f13_sampled_points")
def f13(spark, sf_dir):
    return S.sample_by_probability(fixture(spark, sf_dir, "points"), F.col("opacity"), F.lit(0.1), 1.0, ["gaussian_id"]).select("gaussian_id")
