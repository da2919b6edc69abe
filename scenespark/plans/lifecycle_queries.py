"""Queries of chunk table changes and the chunk lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import with_chunk_id
from ..operators import chunks as C
from ..operators import images as I
from ..operators import lifecycle as L
from ..session import new_path
from ..sources.store import SceneStore
from .fixtures import fixture, tables
from .geometry_queries import SIZE, chunked
from .join_queries import _SEEN, seen
from .registry import query

_BEFORE = "coalesce(sum(n_points) OVER (ORDER BY coalesce(last_access, 0), chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("w1_lru_evict", tables(f"SELECT chunk_id, n_points FROM (SELECT *, {_BEFORE} AS b FROM {{manifest}}) WHERE b < 300"))
def w1(spark, sf_dir):
    return C.lru_evict(fixture(spark, sf_dir, "manifest"), 300).select("chunk_id", "n_points")


@query("u1_appended_points", tables("SELECT gaussian_id, x FROM {points} UNION ALL SELECT gaussian_id + 100000000, x FROM {points}"))
def u1(spark, sf_dir):
    p = fixture(spark, sf_dir, "points").select("gaussian_id", "x")
    return C.append_points(p, p.withColumn("gaussian_id", F.col("gaussian_id") + 100_000_000))


# as many new points as there are, a little aside: some fall into chunks that hold points already
_NEW = "(SELECT (CAST(floor((x + 8) / 10) AS BIGINT) + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576) AS chunk_id FROM {chunked})"
_ADMITTED = f"(SELECT chunk_id, count(*) AS n FROM {_NEW} GROUP BY chunk_id HAVING count(*) >= 10)"


@query("u2_added_points", tables(f"SELECT chunk_id, CAST(sum(n) AS BIGINT) AS n_points, bool_or(fresh) AND chunk_id IN (SELECT chunk_id FROM {{manifest}} WHERE on_disk AND NOT loaded) AS must_load FROM (SELECT chunk_id, count(*) AS n, false AS fresh FROM {{chunked}} GROUP BY chunk_id UNION ALL SELECT chunk_id, n, true FROM {_ADMITTED}) GROUP BY chunk_id"))
def u2(spark, sf_dir):
    new = fixture(spark, sf_dir, "points").withColumns({"gaussian_id": F.col("gaussian_id") + 100_000_000, "x": F.col("x") + 3})
    added, touched = C.add_points(chunked(spark, sf_dir), new, fixture(spark, sf_dir, "manifest"), SIZE, 10)
    counts = C.chunk_counts(added).join(touched.withColumn("must_load", F.lit(True)), "chunk_id", "left")
    return counts.withColumn("must_load", F.coalesce("must_load", F.lit(False)))


@query("u3_deleted_points", tables("SELECT gaussian_id FROM {points} WHERE NOT (opacity < 2e-1)"))
def u3(spark, sf_dir):
    return C.delete_where(fixture(spark, sf_dir, "points"), F.col("opacity") < 0.2).select("gaussian_id")


@query("u4_chunk_states", tables("SELECT chunk_id, CASE WHEN loaded THEN 'loaded' WHEN on_disk THEN 'spillover' WHEN here THEN 'new' ELSE 'empty' END AS state FROM (SELECT m.*, chunk_id IN (SELECT chunk_id FROM {chunked} WHERE opacity >= 9e-1) AS here FROM {manifest} m)"))
def u4(spark, sf_dir):
    return C.classify_chunks(fixture(spark, sf_dir, "manifest"), chunked(spark, sf_dir).filter("opacity >= 9e-1")).select("chunk_id", "state")


_ASK = "n_points > 20"
_PLAN = f"""WITH m AS (SELECT * FROM {{manifest}}), l AS (SELECT * FROM m WHERE on_disk AND NOT loaded AND {_ASK}),
x AS (SELECT (SELECT sum(n_points) FROM m WHERE loaded) + coalesce((SELECT sum(n_points) FROM l), 0) - 200 AS excess),
e AS (SELECT chunk_id, n_points, {_BEFORE} AS b FROM m WHERE loaded AND NOT ({_ASK}))
SELECT chunk_id, n_points, 'load' AS action FROM l UNION ALL SELECT chunk_id, n_points, 'evict' FROM e, x WHERE excess > 0 AND b < CAST(floor(excess + 10) AS BIGINT)"""


@query("u5_load_plan", tables(_PLAN))
def u5(spark, sf_dir):
    m = fixture(spark, sf_dir, "manifest")
    return C.plan_load(m.filter(_ASK), m, 200)


_MOVED = "(SELECT gaussian_id, (CAST(floor((x + 3 + 5) / 10) AS BIGINT) + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576) AS chunk_id, opacity FROM {chunked} WHERE opacity > 3e-1)"


@query("u6_written_back", tables(f"SELECT chunk_id, count(*) AS n_points, count(DISTINCT gaussian_id) AS n_ids, CAST(sum(gaussian_id) AS BIGINT) AS sum_ids FROM {_MOVED} GROUP BY chunk_id"))
def u6_written(spark, sf_dir):
    """Points of a stored map moved to their chunks, then the faint ones deleted, and the map read again."""
    store = SceneStore(spark, new_path(spark, "scene"))
    points = chunked(spark, sf_dir).select("gaussian_id", "chunk_id", "x", "y", "z", "opacity")
    store.create(points)
    store.apply(with_chunk_id(store.points().drop("chunk_id").withColumn("x", F.col("x") + 3), SIZE))
    store.apply(C.delete_where(store.points(), F.col("opacity") <= 0.3))
    back = store.points()
    counts = back.groupBy("chunk_id").agg(F.countDistinct("gaussian_id").alias("n_ids"), F.sum("gaussian_id").alias("sum_ids"))
    return counts.join(store.manifest().select("chunk_id", "n_points"), "chunk_id", "full").select("chunk_id", "n_points", "n_ids", "sum_ids")


@query("u6_redistributed", tables("SELECT gaussian_id, old_chunk_id, chunk_id FROM (SELECT c.gaussian_id, c.chunk_id AS old_chunk_id, (CAST(floor((x + 3 + 5) / 10) AS BIGINT) + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576) AS chunk_id FROM {chunked} c) WHERE chunk_id <> old_chunk_id"))
def u6(spark, sf_dir):
    moved = chunked(spark, sf_dir).withColumn("x", F.col("x") + 3)
    return C.redistribute(moved, SIZE).select("gaussian_id", "old_chunk_id", "chunk_id")


@query("u7_merged_samples", tables("SELECT gaussian_id AS id, 'sample' AS origin FROM {points} UNION ALL SELECT keypoint_id, 'keypoint' FROM {keypoints}"))
def u7(spark, sf_dir):
    a = fixture(spark, sf_dir, "points").selectExpr("gaussian_id AS id")
    return I.merge_samples(a, fixture(spark, sf_dir, "keypoints").selectExpr("keypoint_id AS id"))


@query("u8_union_chunks", tables("SELECT chunk_id FROM {kf_chunked} UNION SELECT chunk_id FROM {manifest} WHERE loaded"))
def u8(spark, sf_dir):
    kf = fixture(spark, sf_dir, "keyframes").select(G.chunk_id("tx", "ty", "tz", SIZE).alias("chunk_id"))
    return C.union_chunks(kf, fixture(spark, sf_dir, "manifest").filter("loaded"))


@query("u9_touched_chunks", tables("SELECT chunk_id, CASE WHEN n_points > 20 THEN greatest(coalesce(last_access, 0), 500e0) ELSE last_access END AS last_access FROM {manifest}"))
def u9(spark, sf_dir):
    m = fixture(spark, sf_dir, "manifest")
    return C.touch_chunks(m, m.filter("n_points > 20"), 500.0).select("chunk_id", "last_access")


@query("a26_load_estimate", tables(f"SELECT (SELECT count(DISTINCT chunk_id) FROM {_SEEN} WHERE state <> 'OUTSIDE') AS n_chunks, CAST((SELECT sum(n_points) FROM {{manifest}} WHERE on_disk AND NOT loaded AND chunk_id IN (SELECT chunk_id FROM {_SEEN} WHERE state <> 'OUTSIDE')) AS BIGINT) AS to_load, CAST((SELECT sum(n_points) FROM {{manifest}} WHERE loaded OR (on_disk AND chunk_id IN (SELECT chunk_id FROM {_SEEN} WHERE state <> 'OUTSIDE'))) AS BIGINT) AS projected"))
def a26(spark, sf_dir):
    return L.load_estimate(seen(spark, sf_dir), fixture(spark, sf_dir, "manifest"))


@query("z6_chunk_lifecycle")
def z6(spark, sf_dir):
    return L.chunk_lifecycle(seen(spark, sf_dir), fixture(spark, sf_dir, "manifest"), 200, 5000.0)
