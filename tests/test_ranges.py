"""Order-dependent operators on inputs of several partitions, with and without adaptive execution."""

import math
import statistics

import pytest
from pyspark.sql import functions as F
from scenespark.operators import chunks as C
from scenespark.operators import ranges as R


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ids_are_dense_on_three_million_rows(adaptive):
    rows = adaptive.range(0, 3_000_000, 1, 8).select(F.xxhash64("id").alias("key"), F.lit("x").alias("extra"))
    got = C.assign_ids(rows, ["key"], 5).agg(F.count("*"), F.countDistinct("gaussian_id"), F.min("gaussian_id"), F.max("gaussian_id"), F.countDistinct("key")).first()
    assert tuple(got) == (3_000_000, 3_000_000, 5, 3_000_004, 3_000_000)
    small = C.assign_ids(adaptive.range(0, 60_000, 1, 4).withColumn("extra", -F.col("id")), ["extra"])
    assert small.filter("gaussian_id <> 59999 - id").count() == 0 and small.count() == 60_000


def test_eviction_keeps_every_row_it_needs(adaptive):
    chunks = adaptive.range(0, 60_000, 1, 8).select(F.col("id").alias("chunk_id"), F.lit(1).alias("n_points"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("last_access"))
    got = C.lru_evict(chunks, 30_000)
    assert got.count() == 30_000 and got.select("points_before").distinct().count() == 30_000
    assert C.lru_evict(chunks, 10**9).count() == 60_000 and C.lru_evict(chunks.limit(0), 5).count() == 0


def _runs(spark, n=40_000):
    """A hot run with nearly all rows, some short ones and one without a name."""
    run = F.when(F.col("id") % 100 < 95, 0).when(F.col("id") % 100 < 98, F.col("id") % 7 + 1)
    value = F.when(F.col("id") % 11 > 0, (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0))
    return spark.range(0, n, 1, 8).select(run.cast("long").alias("run"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("t"), value.alias("v"))


def _plain(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        out.setdefault(r.run, []).append((r.t, r.v))
    return out


def test_numbers_and_neighbours_within_groups(adaptive):
    df = _runs(adaptive)
    want = {(run, t): (i, len(rows), rows[i - 1][0] if i else None, rows[i + 1][0] if i + 1 < len(rows) else None) for run, rows in _plain(df).items() for i, (t, _) in enumerate(rows)}
    n = {(r.run, r.t): (r.n, r.size) for r in R.numbered_within(df, ["run"], ["t"], "n", "size").collect()}
    assert n == {k: v[:2] for k, v in want.items()}
    near = R.with_neighbours(df, ["run"], ["t"], ["t"]).select("run", "t", F.col("prev.t").alias("p"), F.col("next.t").alias("q")).collect()
    assert {(r.run, r.t): (r.p, r.q) for r in near} == {k: v[2:] for k, v in want.items()} and len(near) == len(want)


def test_brackets_cross_ranges(adaptive):
    df = _runs(adaptive).withColumn("v", F.when(F.col("t") % 9000 == 17, F.col("v")))  # ranges without any known row
    got = {(r.run, r.t): (r.a, r.b) for r in R.with_bracket(df, ["run"], ["t"], F.col("v").isNotNull(), ["t"]).select("run", "t", F.col("last.t").alias("a"), F.col("following.t").alias("b")).collect()}
    for run, rows in _plain(df).items():
        known = [t for t, v in rows if v is not None]
        for t, _ in rows[:: max(1, len(rows) // 500)]:
            assert got[run, t] == (max((k for k in known if k <= t), default=None), min((k for k in known if k > t), default=None))


def test_scan_over_several_levels(adaptive):
    df = R.numbered_within(_runs(adaptive, 80_000), ["run"], ["t"], "n")
    known = F.col("v").isNotNull()
    out = R.affine_scan(df, ["run"], "n", F.when(known, 0.6).otherwise(1.0), F.when(known, 0.4 * F.col("v")).otherwise(0.0), "y")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.run, r.t): r.y for r in out.collect()}
    assert len(got) == 80_000
    for run, rows in _plain(df).items():
        y = 0.0
        for t, v in rows:
            y = y if v is None else 0.6 * y + 0.4 * v
            assert math.isclose(got[run, t], y, rel_tol=1e-9, abs_tol=1e-9)


def test_medians_by_nested_histograms(adaptive):
    df = _runs(adaptive).withColumn("v", F.when(F.col("t") % 1000 == 3, F.lit(1e300)).when(F.col("t") % 1000 == 4, F.lit(-1e-300)).otherwise(F.col("v")))
    want = {run: statistics.median(v for _, v in rows if v is not None) for run, rows in _plain(df).items()}
    for most in (10**6, 50):
        assert {r.run: r.median for r in R.exact_median(df, ["run"], "v", most).collect()} == pytest.approx(want)
    odd = adaptive.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", 1.0), ("b", float("-inf")), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, v double")
    assert {r.g: r.median for r in R.exact_median(odd, ["g"], "v", 1).collect()} == {"a": float("inf"), "b": 2.0}
    assert R.exact_median(odd.limit(0), ["g"], "v").count() == 0


def test_summaries_of_large_groups_take_the_other_way(spark, monkeypatch):
    from scenespark.operators import schedule
    from scenespark.operators import trajectory as T

    df = _runs(spark, 5000).select(F.coalesce("v", F.lit(0.5)).alias("a"), (F.col("t") % 17).alias("b"))
    pairs = _runs(spark, 5000).select("run", *[(F.col("t") % n).cast("double").alias(f"{k}{a}") for k in "re" for a, n in zip("xyz", (3, 5, 7 if k == "r" else 11))])
    cells = lambda rows: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r.asDict().values()) for r in rows)
    whole = [cells(schedule.metric_summary(df, ["a", "b"]).collect()), cells(T.ape(pairs, run="run").select("run", "median").filter("run is not null").collect())]
    monkeypatch.setattr(schedule, "MEDIAN_ROWS", 100)
    columns = schedule.metric_summary(df, ["a", "b"]).columns
    assert columns == ["metric", "mean", "std", "min", "max", "median"]
    assert [cells(schedule.metric_summary(df, ["a", "b"]).collect()), cells(T.ape(pairs, run="run").select("run", "median").filter("run is not null").collect())] == whole
