"""Chunk lifecycle: what a view needs, what is loaded, what is evicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C


def load_estimate(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """Unique chunks that views need, points to load for them, and the total after loading."""
    need = C.union_chunks(seen)
    held = manifest.filter("loaded").agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("held"))
    load = manifest.filter("on_disk and not loaded").join(need, "chunk_id", "left_semi").agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("to_load"))
    return need.agg(F.count("*").alias("n_chunks")).crossJoin(load).crossJoin(held).select("n_chunks", "to_load", (F.col("to_load") + F.col("held")).alias("projected"))  # one row each


def chunk_lifecycle(seen: DataFrame, manifest: DataFrame, limit: int, now: float) -> DataFrame:
    """The manifest after serving a view: loads and evictions applied, visible chunks touched."""
    plan = C.plan_load(seen, manifest, limit).select("chunk_id", "action")
    touched = C.touch_chunks(manifest, seen, now).join(plan, "chunk_id", "left")
    loaded = F.when(F.col("action") == "load", True).when(F.col("action") == "evict", False).otherwise(F.col("loaded"))
    return touched.withColumn("loaded", loaded)
