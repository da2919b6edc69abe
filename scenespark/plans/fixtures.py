"""Scene, trajectory and pixel tables derived from the given tables, once as Spark and once as SQL.

Each table is a list of (column, expression) over a source; the expressions are read alike by Spark and
by the SQL engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_S = "((s_suppkey * 37) % 100)"
_SPARK_T = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6"
_SQL_T = "epoch_us(ts) / 1e6"

TABLES = {
    "points": ("orders", {
        "gaussian_id": "o_orderkey", "x": "(o_totalprice % 1000) / 10 - 50", "y": "CAST((o_custkey % 41) - 20 AS DOUBLE)", "z": "((o_orderkey * 7919) % 1000) / 10 - 50",
        "opacity": "((o_orderkey * 31) % 100) / 100", "max_scale": "1e-2 + ((o_orderkey * 17) % 50) / 100", "exist_since": "o_orderkey % 1000",
    }),
    "big_points": ("lineitem", {"x": "l_quantity + 0e0", "y": "l_discount * 100 + 0e0", "z": "l_extendedprice / 1000"}),
    "poses": ("events", {
        "run_id": "user_id", "frame_id": "event_id", "t": "{T}", "tx": "value / 10", "ty": "(event_id % 97) / 10", "tz": f"{_K} / 10",
        "qw": f"cos(pi() * {_K} / 100)", "qx": "0e0", "qy": "0e0", "qz": f"sin(pi() * {_K} / 100)", "k": _K,
    }),
    "frame_metrics": ("events", {"run_id": "user_id", "kfid": "event_id", "psnr": "20 + value / 50", "ssim": f"({_K} % 100) / 100", "lpips": f"({_K} % 37) / 100", "render_ms": f"1 + {_K} / 10", "event_type": "event_type", "t": "{T}"}),
    "frame_poses": ("embeddings", {"fid": "CAST(vec_id AS BIGINT)", "tx": "(vec_id % 50) / 1e0", "ty": "(vec_id % 7) / 1e1", "tz": "(vec_id % 11) / 1e0", "qw": "cos(pi() * (vec_id % 100) / 100)", "qx": "0e0", "qy": "0e0", "qz": "sin(pi() * (vec_id % 100) / 100)"}),
    "frame_keypoints": ("embeddings", {"frame_id": "CAST(vec_id AS BIGINT)", "keypoint_id": "CAST(vec_id + 1000 AS BIGINT)", "u": "(vec_id % 9) * 75e-2", "v": "(vec_id % 5) * 15e-1", "z": "(vec_id % 4) - 5e-1"}),
    "observations": ("lineitem", {"fid": "l_suppkey", "point_id": "l_partkey"}),
    "keypoints": ("part", {"frame_id": "CAST(p_size AS BIGINT)", "keypoint_id": "p_partkey", "u": "CAST((p_partkey * 37) % 1300 - 20 AS DOUBLE)", "v": "CAST((p_partkey * 53) % 720 - 20 AS DOUBLE)", "z": "p_retailprice / 100 - 93e-1"}),
    "keyframes": ("supplier", {
        "fid": "s_suppkey", "run_id": "CAST(s_nationkey AS BIGINT)", "t": "s_suppkey * 1e1", "tx": "s_acctbal / 200", "ty": "(s_suppkey % 97) / 10", "tz": f"{_S} / 10",
        "qw": f"cos(pi() * {_S} / 100)", "qx": "0e0", "qy": "0e0", "qz": f"sin(pi() * {_S} / 100)",
        "seq": "s_suppkey", "creation_iter": "s_suppkey % 1000", "remaining": "s_suppkey % 3", "loss": f"({_S} % 17) / 10",
    }),
}

#: Tables made from those above; {name} in FROM stands for the parenthesised SQL of another one.
DERIVED = {
    "poses_est": "SELECT run_id, frame_id, t + CASE WHEN frame_id % 10 = 0 THEN 3e-1 ELSE 37e-3 END AS t, tx + ((frame_id % 7) - 3) * 1e-2 AS tx, ty - ((frame_id % 5) - 2) * 1e-2 AS ty, tz, qw, qx, qy, qz FROM {poses}",
    "manifest": "SELECT chunk_id, n_points, CASE WHEN chunk_id % 11 = 0 THEN NULL ELSE CAST(chunk_id % 1009 AS DOUBLE) END AS last_access, chunk_id % 3 = 0 AS loaded, chunk_id % 3 <> 2 AS on_disk FROM (SELECT chunk_id, count(*) AS n_points FROM {chunked} GROUP BY chunk_id)",
    "chunked": "SELECT *, (cx + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576) AS chunk_id FROM (SELECT *, CAST(floor((x + 5) / 10) AS BIGINT) AS cx, CAST(floor((y + 5) / 10) AS BIGINT) AS cy, CAST(floor((z + 5) / 10) AS BIGINT) AS cz FROM {points})",
    "kf_chunked": "SELECT *, (cx + 1048576) * 4398046511104 + (cy + 1048576) * 2097152 + (cz + 1048576) AS chunk_id FROM (SELECT *, CAST(floor((tx + 5) / 10) AS BIGINT) AS cx, CAST(floor((ty + 5) / 10) AS BIGINT) AS cy, CAST(floor((tz + 5) / 10) AS BIGINT) AS cz FROM {keyframes})",
    # keyframes of some loss move, every fourth hardly; those of the highest loss come again under ids of their own
    "pose_updates": "SELECT fid, op_id, op_type, is_loop, tx + far * 3e-1 AS tx, ty, tz, qw * cos(far * 1e-1) - qz * sin(far * 1e-1) AS qw, 0e0 AS qx, 0e0 AS qy, qz * cos(far * 1e-1) + qw * sin(far * 1e-1) AS qz FROM (SELECT fid, seq AS op_id, CASE fid % 3 WHEN 1 THEN 'LoopClosingBA' ELSE 'LocalBA' END AS op_type, fid % 4 = 2 AS is_loop, CASE WHEN fid % 4 = 0 THEN 1e-3 ELSE 1e0 END AS far, tx, ty, tz, qw, qz FROM {keyframes} WHERE loss > 2e-1 UNION ALL SELECT fid + 1000000, seq + 1000000, 'LoopClosingBA', false, 1e0, tx, ty, tz, qw, qz FROM {keyframes} WHERE loss > 14e-1)",
    # three operations a keyframe; loop closures come after local adjustments whatever their ids, other kinds are errors
    "operations": "SELECT fid, 3 * fid + n AS op_id, CASE (fid + n) % 3 WHEN 0 THEN 'LocalBA' WHEN 1 THEN 'LoopClosingBA' ELSE 'ScaleRefinement' END AS op_type, tx + n + 1 AS tx, ty, tz, qw, qx, qy, qz FROM {keyframes}, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2)",
    "pixels": "{PIXELS}",
    "pixels_gt": "SELECT frame_id, v, u, round(val, 1) AS val, CASE WHEN (u + v + frame_id) % 13 = 0 THEN 0e0 ELSE 1 / inv_depth END AS depth FROM {pixels}",
    "samples": "SELECT frame_id, v, u, inv_depth, val AS conf, CASE WHEN (8 * v + u) % 9 = 0 THEN -1 ELSE frame_id * 3 + (8 * v + u) % 4 END AS main_id, (8 * v + u) % 2 = 0 AS accurate FROM {pixels}",
}
#: An embedding of 64 values is one plane of 8 x 8 pixels.
_SPARK_PIXELS = "SELECT vec_id AS frame_id, CAST(floor(pos / 8) AS BIGINT) AS v, CAST(pos % 8 AS BIGINT) AS u, (CAST(e AS DOUBLE) + 1) / 2 AS val, 5e-2 + abs(CAST(e AS DOUBLE)) AS inv_depth FROM (SELECT vec_id, posexplode(embedding) AS (pos, e) FROM {embeddings}) WHERE pos < 64"
_SQL_PIXELS = "SELECT vec_id AS frame_id, CAST(floor(pos / 8) AS BIGINT) AS v, CAST(pos % 8 AS BIGINT) AS u, (CAST(e AS DOUBLE) + 1) / 2 AS val, 5e-2 + abs(CAST(e AS DOUBLE)) AS inv_depth FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings) WHERE pos < 64"


def _expressions(name: str, t: str) -> tuple[str, dict[str, str]]:
    source, columns = TABLES[name]
    return source, {c: e.replace("{T}", t) for c, e in columns.items()}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark form of a derived table."""
    if name in TABLES:
        source, columns = _expressions(name, _SPARK_T)
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
        return df.distinct() if name == "observations" else df
    text = _SPARK_PIXELS if name == "pixels" else DERIVED[name]
    needed = {n: fixture(spark, sf_dir, n) if n != "embeddings" else spark.read.parquet(f"{sf_dir}/embeddings.parquet") for n in (*TABLES, *DERIVED, "embeddings") if "{" + n + "}" in text}
    return spark.sql(text, **needed)


def sql(name: str) -> str:
    """The SQL form, parenthesised."""
    if name in TABLES:
        source, columns = _expressions(name, _SQL_T)
        distinct = "DISTINCT " if name == "observations" else ""
        return f"(SELECT {distinct}{', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"
    text = _SQL_PIXELS if name == "pixels" else DERIVED[name]
    for n in (*TABLES, *DERIVED):
        if "{" + n + "}" in text:
            text = text.replace("{" + n + "}", sql(n))
    return f"({text})"


def tables(text: str) -> str:
    """SQL with {name} of derived tables filled in; doubled braces stay braces."""
    for n in (*TABLES, *DERIVED):
        text = text.replace("{" + n + "}", sql(n))
    return text


def r6(expr: str) -> str:
    """Six decimals, and no negative zero."""
    return f"round({expr}, 6) + 0e0"
