"""Column expressions of point attributes: colour, opacity, scale, depth, clocks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import _c, chunk_id, norm3

SH_C0 = 0.28209479177387814
#: Grey weights of red, green, blue and the exponent of the gamma curve.
GREY, GAMMA = (0.2973, 0.6274, 0.0753), 2.2
#: Opacity of new points by where they come from.
START_OPACITY = {"accurate": 0.07, "inaccurate": 0.02, "keypoint": 0.2}
#: Replay speeds of the driving sequences in km/h; fixed values.  Default factor where a sequence is unknown.
SLOWDOWN_DEFAULT = 6.87


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def logit(p) -> Column:
    return F.log(_c(p) / (1 - _c(p)))


def cap_opacity(raw, mask: Column, most: float = 0.05) -> Column:
    return F.when(mask, logit(F.least(sigmoid(raw), F.lit(most)))).otherwise(_c(raw))


def rgb_to_sh(r, g, b) -> Column:
    return F.array(*[(_c(x) - 0.5) / SH_C0 for x in (r, g, b)])


def rgb2gray(r, g, b) -> Column:
    return F.pow(sum(w * F.pow(_c(x), GAMMA) for w, x in zip(GREY, (r, g, b), strict=True)), 1 / GAMMA)


def apply_exposure(r, g, b, exposure: list) -> list[Column]:
    """3x4 affine of a colour, clamped to 0 .. 1."""
    rows = [sum((_c(exposure[4 * i + k]) * _c(x) for k, x in enumerate((r, g, b))), _c(exposure[4 * i + 3])) for i in range(3)]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in rows]


def initial_scale(p, width, fx, distance) -> Column:
    """Log scale of a new point from its sampling probability and distance; repeated on three axes by the caller."""
    s = F.greatest(F.lit(1.0), F.least(1 / F.sqrt(_c(p) + 1e-8), _c(width) / 10)) / _c(fx) * _c(distance)
    return F.log(F.greatest(F.lit(1e-6), F.least(s, F.lit(1e6))))


def initial_opacity(provenance) -> Column:
    out = F.lit(None).cast("double")
    for name, value in START_OPACITY.items():
        out = F.when(_c(provenance) == name, F.lit(value)).otherwise(out)
    return out


def normalize_uv(u, size) -> Column:
    return 2 * _c(u) / (_c(size) - 1) - 1


def pyramid_levels(width, height, levels: int) -> Column:
    """Rows (level, width, height) to explode; a level halves the one before."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(
        i.alias("level"), F.floor(_c(width) * F.pow(F.lit(0.5), i)).cast("long").alias("level_width"), F.floor(_c(height) * F.pow(F.lit(0.5), i)).cast("long").alias("level_height")
    ))


def unproject(u, v, d, fx, fy, cx, cy) -> Column:
    return F.struct(((_c(u) - _c(cx)) * _c(d) / _c(fx)).alias("x"), ((_c(v) - _c(cy)) * _c(d) / _c(fy)).alias("y"), _c(d).cast("double").alias("z"))


def pixel_of(index, width) -> Column:
    """(v, u) of a flat pixel index."""
    return F.struct(F.floor(_c(index) / _c(width)).cast("long").alias("v"), (_c(index) % _c(width)).cast("long").alias("u"))


def disparity_to_depth(disparity, bf, image_width, model_width) -> Column:
    """Metric depth of a disparity predicted at another width; null where it is 0."""
    return F.try_divide(_c(bf), _c(disparity) * _c(image_width) / _c(model_width))


def stereo_bf(baseline, fx) -> Column:
    return _c(baseline) * _c(fx)


def reproject_disparity(u, v, disparity, fx, cx, cy, baseline) -> Column:
    """Point of a pixel and disparity (the usual 4x4 matrix, written out); null where the disparity is 0."""
    w = F.try_divide(_c(disparity), _c(baseline))
    return F.struct(F.try_divide(_c(u) - _c(cx), w).alias("x"), F.try_divide(_c(v) - _c(cy), w).alias("y"), F.try_divide(_c(fx).cast("double"), w).alias("z"))


def inverse_depth(d) -> Column:
    return 1 / F.greatest(_c(d), F.lit(1e-8))


def apply_depth_affine(d, scale, bias) -> Column:
    return _c(d) * _c(scale) + _c(bias)


def depth_to_mm(d) -> Column:
    """Metres to 16-bit millimetres; nothing or less gives 0."""
    return F.when(_c(d) <= 0, 0).otherwise(F.least(F.round(_c(d) * 1000), F.lit(65535.0))).cast("int")


def depth_to_u8(df: DataFrame, value: str, frame: str, mode: str = "linear", far: float = 100.0) -> DataFrame:
    """df with byte: ``linear`` (min to max of the frame), ``inverted`` (flat frames at one half first) or ``far`` (0 .. far metres)."""
    if mode == "far":
        share = F.least(F.greatest(F.col(value) / far, F.lit(0.0)), F.lit(1.0))
        return df.withColumn("byte", F.floor(share * 255).cast("int"))
    # the extremes of each frame are joined: a frame is never gathered in one task
    ends = df.groupBy(frame).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5 if mode == "inverted" else 0.0))
    share = 1 - share if mode == "inverted" else share
    return df.join(ends, frame).withColumn("byte", F.floor(share * 255).cast("int")).drop("_lo", "_hi")


def rescale_time(df: DataFrame, factor: float, run: str = "run_id", t: str = "t") -> DataFrame:
    """Clock of each run stretched about its first time: t0 + (t - t0) factor."""
    first = df.groupBy(run).agg(F.min(t).alias("_t0"))
    return df.join(first, run).withColumn("t_scaled", F.col("_t0") + (F.col(t) - F.col("_t0")) * factor).drop("_t0")


def unscale_time(t, factor: float) -> Column:
    """t / factor, as at evaluation: exact only for clocks that begin at 0."""
    return _c(t) / factor


def slowdown_factor(df: DataFrame, directory: str, speeds: DataFrame, replay_kmh: float = 5.0) -> DataFrame:
    """df with slowdown: recorded speed / replay speed of the sequence that the directory's trailing digits name."""
    found = df.withColumn("_seq", F.expr(f"try_cast(regexp_extract({directory}, '([0-9]+)$', 1) AS INT)"))
    out = found.join(F.broadcast(speeds.select(F.col("sequence").alias("_seq"), "kmh")), "_seq", "left")  # a row a sequence
    return out.withColumn("slowdown", F.coalesce(F.col("kmh") / replay_kmh, F.lit(SLOWDOWN_DEFAULT))).drop("_seq", "kmh")


def speed_kmh(moved, seconds) -> Column:
    return F.try_divide(_c(moved), _c(seconds)) * 3.6


def fit_to_canvas(df: DataFrame, run: str, width: float, height: float, margin: float = 0.05) -> DataFrame:
    """df(run, tx, tz) with canvas columns px, py: one scale for both axes, bounds under 0.001 count as 1."""
    b = df.groupBy(run).agg(F.min("tx").alias("_x0"), F.max("tx").alias("_x1"), F.min("tz").alias("_z0"), F.max("tz").alias("_z1"))
    span = lambda lo, hi: F.when(F.col(hi) - F.col(lo) < 0.001, 1.0).otherwise(F.col(hi) - F.col(lo))
    scale = F.least(width * (1 - 2 * margin) / span("_x0", "_x1"), height * (1 - 2 * margin) / span("_z0", "_z1"))
    out = df.join(b, run).withColumns({"px": width * margin + (F.col("tx") - F.col("_x0")) * scale, "py": height * (1 - margin) - (F.col("tz") - F.col("_z0")) * scale})
    return out.drop("_x0", "_x1", "_z0", "_z1")


def decay_lr(points: DataFrame, visible: DataFrame, decay: float, least: float) -> DataFrame:
    """position_lr of visible points times ``decay``, then all raised to ``least``."""
    seen = visible.select("gaussian_id").distinct().withColumn("_seen", F.lit(True))
    lr = F.when(F.coalesce("_seen", F.lit(False)), F.col("position_lr") * decay).otherwise(F.col("position_lr"))
    return points.join(seen, "gaussian_id", "left").withColumn("position_lr", F.greatest(lr, F.lit(least))).drop("_seen")


def reset_lr(mask: Column, initial: float) -> Column:
    return F.when(mask, F.lit(initial)).otherwise(F.col("position_lr"))


def init_points(df: DataFrame, iteration: int, size: float, first_lr: float) -> DataFrame:
    """df(x, y, z, r, g, b) -> columns of new points but their ids (see assign_ids)."""
    rest = F.array_repeat(F.lit(0.0), 45)
    unit = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return df.select("*", rgb_to_sh("r", "g", "b").alias("sh_dc"), rest.alias("sh_rest"), unit.alias("rot"), F.lit(iteration).alias("exist_since"), F.lit(first_lr).alias("position_lr"), chunk_id("x", "y", "z", size).alias("chunk_id"))


def distance_to(center: tuple[float, float, float]) -> Column:
    return norm3(*[F.col(a) - c for a, c in zip("xyz", center, strict=True)])


def nth_of_run(run: str, t: str, key: str) -> Column:
    return F.row_number().over(Window.partitionBy(run).orderBy(t, key))


