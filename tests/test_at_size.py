"""What queries move, hold and compare on inputs whose plain way would be too large."""

import math

import pytest
from pyspark.sql import functions as F
from scenespark.operators import frustum as V
from scenespark.operators import joins as J
from scenespark.operators import scenes
from scenespark.plans import registry
from scenespark.sources import readers, writers

registry.load()
SF = "/root/testdata/sf0.001"


def _moved(spark) -> int:
    """Bytes written by shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture
def shuffled(spark):
    """No side of a join is small enough to be sent to every task."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_covisibility_moves_observations_and_not_pairs(shuffled):
    """400 keyframes, every two of which share points: their sets went to each of 79,800 pairs before."""
    spark = shuffled
    rows = spark.range(0, 400 * 300, 1, 8).select((F.col("id") / 300).cast("long").alias("fid"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("point_id")).distinct()
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.fid, set()).add(r.point_id)
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 20}
    before = _moved(spark)
    got = {(r.a, r.b, r.weight) for r in J.covisibility(rows, 20, block=150).collect()}
    assert got == want and len(got) > 60_000
    moved = _moved(spark) - before
    assert moved < 10_000_000, moved  # 120,000 observations a few times; 17 million where sets went to pairs


def test_nearest_keyframes_of_one_place_and_of_places_far_off(shuffled):
    """Half of 6,000 keyframes stand at one place: each was compared with all of them before."""
    spark = shuffled
    at = lambda a, n: F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(n)) / 10).alias(f"t{a}")
    rows = spark.range(0, 6000, 1, 8).select(F.col("id").alias("fid"), at("x", 500), at("y", 90), at("z", 40)).union(spark.createDataFrame([(10**6 + i, 1e4 * i, 0.0, -1e3) for i in range(5)], "fid long, tx double, ty double, tz double"))
    before = _moved(spark)
    got = {(r.fid, r.pick): r.neighbour for r in J.closest_keyframes(rows, rows, 10, 1).collect()}
    moved = _moved(spark) - before
    plain = [tuple(r) for r in rows.collect()]
    for q in plain:
        if q[0] % 100 < 2 or q[0] >= 10**6:
            want = sorted((math.sqrt((q[1] - o[1]) * (q[1] - o[1]) + (q[2] - o[2]) * (q[2] - o[2]) + (q[3] - o[3]) * (q[3] - o[3])), o[0]) for o in plain if o[0] != q[0])[:10]
            assert [got[(q[0], i + 1)] for i in range(10)] == [o for _, o in want]
    assert len(got) == 6005 * 10
    assert moved < 40_000_000, moved


def _rows_out_of_joins(spark, df) -> int:
    """Most rows that a join of the plan of df gave."""
    found = 0
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, todo = store.executionMetrics(last), store.planGraph(last).allNodes()
    for i in range(todo.size()):
        node = todo.apply(i)
        if "Join" in node.name():
            for k in range(node.metrics().size()):
                m = node.metrics().apply(k)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found = max(found, int(values.apply(m.accumulatorId()).replace(",", "")))
    return found


def test_pruning_meets_only_views_that_come_near(spark):
    """50 views see a chunk of 4,000 points, and each pair of them was made before."""
    at = lambda a: (F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1000)) / 100 - 5).alias(a)
    points = spark.range(0, 4000, 1, 4).select(F.col("id").alias("gaussian_id"), F.lit(7).cast("long").alias("chunk_id"), at("x"), at("y"), at("z"), (F.col("id") % 41 / 40.0).alias("opacity"), (F.col("id") % 50 / 50.0).alias("max_scale"))
    points = points.unionByName(points.limit(1).selectExpr("gaussian_id + 9000 as gaussian_id", "8L as chunk_id", "x", "y", "z", "0.0D as opacity", "9.0D as max_scale"))
    keyframes = spark.range(0, 50, 1, 2).selectExpr("id as fid", "1.0D as qw", "0.0D as qx", "0.0D as qy", "0.0D as qz", "id * 2.0D as tx", "0.0D as ty", "1.5D as tz")
    seen = keyframes.selectExpr("fid", "7L as chunk_id")
    pruned = scenes.prune_seen(points, seen, keyframes, 6.0, 8)
    want = set()
    for p in points.collect():
        near = min(math.sqrt((p.x + 2.0 * i) ** 2 + p.y**2 + (p.z + 1.5) ** 2) for i in range(50))
        if p.chunk_id == 8 or not (p.opacity <= 0.05 or near == 0 or 6.0 * p.max_scale / near >= 4):
            want.add(p.gaussian_id)
    assert {r.gaussian_id for r in pruned.collect()} == want and 9000 in want and 500 < len(want) < 3900
    assert _rows_out_of_joins(spark, pruned) < 50 * 4000 / 4


def test_points_of_visible_chunks_are_counted_once_a_chunk(spark):
    pairs = registry.QUERIES["j8_visible_points"](spark, SF)
    assert _rows_out_of_joins(spark, pairs) < pairs.agg(F.sum("n_points")).first()[0]


def test_points_before_views_without_a_pair_each(spark):
    """Turned views and one direction of many; depths that equal the limit."""
    at = lambda a, n: (F.pmod(F.xxhash64("id", F.lit(a)), F.lit(n)) / 10 - 5).alias(a)
    points = spark.range(0, 3000, 1, 4).select(F.pmod(F.col("id"), F.lit(3)).alias("chunk_id"), at("x", 100), at("y", 100), (at("z", 100) + F.pmod(F.col("id"), F.lit(3)) * 10).alias("z"))
    keyframes = spark.range(0, 200, 1, 4).selectExpr("id as fid", *[c + " as " + n for c, n in (("cos(if(id % 10 = 0, id / 50.0D, 0.0D))", "qw"), ("sin(if(id % 10 = 0, id / 50.0D, 0.0D))", "qx"), ("0.0D", "qy"), ("0.0D", "qz"), ("0.0D", "tx"), ("0.0D", "ty"), ("id % 31 - 15.0D + 0.2D", "tz"))])
    seen = keyframes.select("fid", F.explode(F.array(*[F.lit(c).cast("long") for c in (0, 1, 2, 9)])).alias("chunk_id"))
    pairs = V.visible_points(points, seen).join(keyframes, "fid").filter(V.point_visible(V.G.pose_of(), "x", "y", "z"))
    want = {r.fid: r.n for r in pairs.groupBy("fid").agg(F.count("*").alias("n")).collect()}
    front = V.points_in_front(points, keyframes, seen)
    assert {r.fid: r.n for r in front.collect()} == want and len(want) > 150
    assert _rows_out_of_joins(spark, registry.QUERIES["f4_points_in_front"](spark, SF)) < 20_000


def test_small_files_are_listed_in_tasks(spark, tmp_path):
    for run in ("TUM_mono_1", "TUM_mono_2", "_hidden"):
        (tmp_path / "runs" / run / "desk").mkdir(parents=True)
        (tmp_path / "runs" / run / "desk" / "eval.txt").write_text("psnr: 20.5\n")
        (tmp_path / "runs" / run / "desk" / "other.log").write_text("psnr: 1\n")
    found = readers.read_run_artifacts(spark, f"file://{tmp_path}/runs")
    assert not found.inputFiles() and sorted((r.trial, r.key, r.value) for r in found.collect()) == [("1", "psnr", 20.5), ("2", "psnr", 20.5)]
    assert readers.files_below(spark, str(tmp_path / "none"), "*", "*.txt").count() == 0


def test_sequences_are_read_without_a_list_of_files(spark):
    assert not registry.QUERIES["s2_kitti_sequences"](spark, SF).inputFiles()


def test_scalars_of_any_name_come_back(spark, tmp_path):
    names = ["slowdown_factor", "a b+c/d=%41", "x_count", "é"]
    path = f"file://{tmp_path}/scalars"
    for value in (1.25, 2.5):
        writers.write_run_scalars(spark.createDataFrame([(n, value) for n in names], "name string, value double"), path)
    back = readers.read_run_scalars(spark, path)
    assert {r.name: r.value for r in back.collect()} == {"slowdown_factor": "2.500000", "a b+c/d=%41": "2.5000", "x_count": "3", "é": "2.5000"} and not back.inputFiles()
