"""Keyframe schedules, rankings and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import MEDIAN_ROWS, affine_scan, exact_median, largest_group, meet, numbered, numbered_within, with_neighbours


def every_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows at multiples of ``n``; none for 0."""
    return df.filter(F.col(column) % n == 0) if n else df.limit(0)


def with_loss(keyframes: DataFrame, losses: DataFrame, default: float = 0.0) -> DataFrame:
    """Keyframes with the loss of the table losses(fid, loss); one without a loss, or with a null one, has ``default``.

    Of several losses of a keyframe the largest counts; a loss column of the keyframes is replaced.
    """
    known = losses.groupBy("fid").agg(F.max("loss").alias("_loss"))
    return keyframes.drop("loss").join(known, "fid", "left").withColumn("loss", F.coalesce("_loss", F.lit(float(default)))).drop("_loss")


def top_loss(keyframes: DataFrame, divisor: int = 4, losses: DataFrame | None = None) -> DataFrame:
    """Keyframes with the highest losses of each chunk: max(1, count div divisor) of them; ties to the smaller id.

    ``losses`` is looked up if given (see ``with_loss``).  Places come from ranges, so a chunk that holds most
    keyframes is spread over all tasks.
    """
    if losses is not None:
        keyframes = with_loss(keyframes, losses)
    places = numbered_within(keyframes, ["chunk_id"], [F.desc("loss"), F.col("fid")], "_r", "_n")
    return places.filter(F.col("_r") < F.greatest(F.lit(1), F.floor(F.col("_n") / divisor))).select(keyframes.columns)


def refill_uses(keyframes: DataFrame, divisor: int = 4, losses: DataFrame | None = None) -> DataFrame:
    """Where no keyframe of a chunk has uses left, each gets one more, and the high-loss ones another; losses as in ``top_loss``."""
    left = keyframes.groupBy("chunk_id").agg(F.max("remaining").alias("_left"))
    high = top_loss(keyframes, divisor, losses).select("fid", F.lit(1).alias("_high"))
    both = keyframes.join(left, "chunk_id").join(high, "fid", "left")
    more = F.when(F.col("_left") <= 0, 1 + F.coalesce("_high", F.lit(0))).otherwise(0)
    return both.withColumn("remaining", F.col("remaining") + more).drop("_left", "_high")


def weighted_pick(keyframes: DataFrame, seed: int) -> DataFrame:
    """One keyframe a chunk, drawn with weight max(1, remaining): the smallest of -ln(u) / weight, u from a hash of id and seed."""
    u = (F.pmod(F.xxhash64("fid", F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    key = -F.log(u) / F.greatest(F.lit(1), F.col("remaining"))
    return keyframes.groupBy("chunk_id").agg(F.min_by("fid", F.struct(key, "fid")).alias("fid"))


def recent_distinct(log: DataFrame, key: str, t: str, k: int) -> DataFrame:
    """The k ids used last, with their last time; ties to the larger id."""
    return log.groupBy(key).agg(F.max(t).alias("last_used")).orderBy(F.desc("last_used"), F.desc(key)).limit(k)


def last_n(df: DataFrame, run: str, t: str, key: str, n: int) -> DataFrame:
    """The last n rows of each run; a run's rows are numbered from its end over ranges."""
    return numbered_within(df, [run], [F.desc(t), F.desc(key)], "_r").filter(F.col("_r") < n).select(df.columns)


def top_k(df: DataFrame, column: str, k: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(column), key).limit(k)


def nearest_n(df: DataFrame, point: tuple[float, float, float], n: int, key: str) -> DataFrame:
    dist = F.sqrt(sum((F.col(a) - p) * (F.col(a) - p) for a, p in zip("xyz", point, strict=True)))
    return df.withColumn("dist", dist).orderBy("dist", key).limit(n)


def frame_order(df: DataFrame, path: str = "path") -> DataFrame:
    """Frame index by name, from 0."""
    return numbered(df, [path], "frame_index")


def oldest_first(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy(F.coalesce("last_access", F.lit(0.0)), "chunk_id")


def ema(df: DataFrame, run: str, order: str, value: str, alpha: float = 0.4) -> DataFrame:
    """Exponential moving average of each run, from 0: out = alpha x + (1 - alpha) out; a null value leaves it as it is.

    A step is an affine map, and maps compose: a run is scanned by all tasks, without Python.  Rows of a run that
    agree in ``order`` come by value.
    """
    known = F.col(value).isNotNull()
    rows = numbered_within(df.select(run, order, value), [run], [order, value], "_n")
    a, b = F.when(known, 1 - alpha).otherwise(1.0), F.when(known, alpha * F.col(value)).otherwise(0.0)
    return affine_scan(rows, [run], "_n", a, b, "ema").drop("_n")


def ema_window(df: DataFrame, run: str, order: str, value: str, alpha: float = 0.4, horizon: int = 80) -> DataFrame:
    """The same within (1 - alpha)^horizon, as a weighted sum over the last rows: no Python."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(-horizon, 0)
    seen = F.collect_list(F.col(value).cast("double")).over(w)
    total = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc * (1 - alpha) + alpha * x)
    return df.select(run, order, value, total.alias("ema"))


def pyramid_level(use_no: Column, levels: int, budget: int) -> Column:
    """Level trained at the n-th use of a keyframe: the coarsest with budget left, then 0."""
    return F.greatest(F.lit(0), F.lit(levels - 1) - F.floor((use_no - 1) / budget)).cast("int")


def pyramid_schedule(log: DataFrame, levels: int, budget: int, key: str = "fid", t: str = "t") -> DataFrame:
    uses = numbered_within(log, [key], [t], "_n")
    return uses.withColumn("level", pyramid_level(F.col("_n") + 1, levels, budget)).drop("_n")


def used_counts(log: DataFrame, key: str = "fid") -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("used"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a metric: mean, population deviation, min, max, exact median (in bounded memory, see ``exact_median``)."""
    long = df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return summarised(long, ["metric"], "value", [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")])


def summarised(df: DataFrame, by: list[str], value: str, aggregates: list[Column]) -> DataFrame:
    """``aggregates`` and the median of each group: in one aggregate where the largest group is small, else by nested histograms."""
    if largest_group(df, by) <= MEDIAN_ROWS:
        return df.groupBy(*by).agg(*aggregates, F.median(value).alias("median"))
    return meet(df.groupBy(*by).agg(*aggregates), exact_median(df, by, value, MEDIAN_ROWS), by, "left")


def render_fps(df: DataFrame, run: str, ms: str) -> DataFrame:
    return df.groupBy(run).agg(F.avg(ms).alias("mean_ms")).withColumn("fps", F.try_divide(F.lit(1000.0), F.col("mean_ms")))


def tracking_fps(lines: DataFrame, run: str, line: str, seconds: str) -> DataFrame:
    """1 / mean of all but the last three lines; 0 for three lines or fewer, or a mean of 0."""
    ends = lines.groupBy(run).agg(F.count("*").alias("_n"))
    kept = numbered_within(lines, [run], [F.desc(line)], "_r").filter("_r >= 3").groupBy(run).agg(F.avg(seconds).alias("_mean"))
    return ends.join(kept, run, "left").select(run, F.coalesce(F.try_divide(F.lit(1.0), F.col("_mean")), F.lit(0.0)).alias("tracking_fps"))


def timing_stats(df: DataFrame, name: str, ms: str) -> DataFrame:
    return df.groupBy(name).agg(F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"), F.count("*").alias("calls"))


def training_rate(df: DataFrame, run: str, iteration: str, seconds: str) -> DataFrame:
    """Iterations a second since the snapshot before."""
    near = with_neighbours(df, [run], [iteration, seconds], [iteration, seconds])
    rate = F.try_divide((F.col(iteration) - F.col(f"prev.{iteration}")).cast("double"), F.col(seconds) - F.col(f"prev.{seconds}"))
    return near.withColumn("rate", rate).drop("prev", "next")


def training_schedule(keyframes: DataFrame, seed: int, divisor: int = 4) -> DataFrame:
    """Refilled budgets, a pick a chunk and its remaining uses after it: the schedule of every chunk."""
    full = refill_uses(keyframes, divisor)
    pick = weighted_pick(full, seed).withColumnRenamed("fid", "picked")
    return full.join(pick, "chunk_id").withColumn("remaining", F.col("remaining") - F.when((F.col("fid") == F.col("picked")) & (F.col("remaining") > 0), 1).otherwise(0))


def sample_by_probability(df: DataFrame, p: Column, penalty: Column, k: float, key: list[str], seed: int = 0, uniform: Column | None = None) -> DataFrame:
    """Rows kept where a uniform below k (p - penalty); the uniform is a hash of the key and seed unless given, so reruns agree."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) if uniform is None else uniform
    return df.filter(u < k * (p - penalty))
