"""Points and their spatial chunks: counts, filters, appends, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_chunk_id
from .ranges import numbered, running_before


def chunk_counts(points: DataFrame) -> DataFrame:
    """Points per chunk: the manifest."""
    return points.groupBy("chunk_id").agg(F.count("*").alias("n_points"))


def distinct_chunks(points: DataFrame) -> DataFrame:
    return points.select("chunk_id").distinct()


def count_all(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """Points in memory and points on disk whose chunk is not loaded."""
    memory = points.agg(F.count("*").alias("in_memory"))
    disk = manifest.filter("on_disk and not loaded").agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("on_disk"))
    return memory.crossJoin(disk).select("in_memory", "on_disk", (F.col("in_memory") + F.col("on_disk")).alias("total"))  # one row each


def count_to_load(manifest: DataFrame, requested: DataFrame) -> DataFrame:
    """Points of the requested chunks, by the manifest's first row of each."""
    first = manifest.groupBy("chunk_id").agg(F.min("n_points").alias("n_points"))
    return first.join(requested.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("to_load"))


def in_chunks(points: DataFrame, chunks: DataFrame) -> DataFrame:
    return points.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def not_in_chunks(points: DataFrame, chunks: DataFrame) -> DataFrame:
    return points.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def drop_sparse_chunks(points: DataFrame, manifest: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Points and manifest without the chunks of fewer than ``least`` points.

    Counts are small beside the points, so they are joined instead of windowing over whole chunks: a
    dense chunk is never gathered in one task.
    """
    dense = chunk_counts(points).filter(F.col("n_points") >= least).select("chunk_id")
    sparse = chunk_counts(points).filter(F.col("n_points") < least).select("chunk_id")
    return in_chunks(points, dense), not_in_chunks(manifest, sparse)


def filter_by_density(new_points: DataFrame, least: int = 100) -> DataFrame:
    """New points in chunks that get at least ``least`` new points; everything when ``least`` is 1 or less."""
    if least <= 1:
        return new_points
    return in_chunks(new_points, chunk_counts(new_points).filter(F.col("n_points") >= least))


def recent_points(points: DataFrame, creation_iter: Column, n: int) -> DataFrame:
    return points.filter(F.abs(F.col("exist_since") - creation_iter) < n)


def prune_points(points: DataFrame, visible: DataFrame, fx: float, width: float, center: tuple[float, float, float], min_opacity: float = 0.05, max_share: float = 0.5) -> DataFrame:
    """Points without the visible ones that are too faint or too large on the screen."""
    dist = F.sqrt(sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", center, strict=True)))
    flagged = points.join(visible.select("gaussian_id").distinct().withColumn("_seen", F.lit(True)), "gaussian_id", "left")
    too_large = F.try_divide(F.lit(fx) * F.col("max_scale"), dist) >= max_share * width
    gone = F.coalesce(F.col("_seen"), F.lit(False)) & ((F.col("opacity") <= min_opacity) | F.coalesce(too_large, F.lit(True)))
    return flagged.filter(~gone).drop("_seen")


def relevant_chunks(candidates: DataFrame, manifest: DataFrame, populated: DataFrame) -> DataFrame:
    """Candidate chunks that are loaded, on disk, or hold points."""
    known = manifest.filter("loaded or on_disk").select("chunk_id").union(populated.select("chunk_id"))
    return candidates.join(known.distinct(), "chunk_id", "left_semi")


def append_points(points: DataFrame, more: DataFrame) -> DataFrame:
    return points.unionByName(more, allowMissingColumns=True)


def add_points(points: DataFrame, new_points: DataFrame, manifest: DataFrame, size: float, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Points after admission of new ones, and the touched chunks that must be loaded first."""
    admitted = filter_by_density(with_chunk_id(new_points, size), least)
    touched = in_chunks(manifest.filter("on_disk and not loaded"), admitted).select("chunk_id")
    return append_points(points, admitted), touched


def delete_where(points: DataFrame, mask: Column) -> DataFrame:
    """Rows for which the mask is not true."""
    return points.filter(~F.coalesce(mask, F.lit(False)))


def classify_chunks(manifest: DataFrame, populated: DataFrame) -> DataFrame:
    """loaded, spillover (on disk, not loaded; dropped when saving) or new, for every known chunk."""
    both = manifest.select("chunk_id", "loaded", "on_disk").join(populated.select("chunk_id").distinct().withColumn("here", F.lit(True)), "chunk_id", "full")
    state = F.when(F.coalesce("loaded", F.lit(False)), "loaded").when(F.coalesce("on_disk", F.lit(False)), "spillover").when(F.col("here"), "new").otherwise("empty")
    return both.select("chunk_id", state.alias("state"), (state != "spillover").alias("saved"))


def redistribute(points: DataFrame, size: float) -> DataFrame:
    """Rows whose position left their chunk, with old and new chunk; write back only those chunks."""
    moved = with_chunk_id(points.withColumnRenamed("chunk_id", "old_chunk_id"), size)
    return moved.filter("chunk_id <> old_chunk_id")


def union_chunks(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("chunk_id")
    for t in tables[1:]:
        out = out.union(t.select("chunk_id"))
    return out.distinct()


def touch_chunks(manifest: DataFrame, visible: DataFrame, now: float) -> DataFrame:
    """Manifest whose visible chunks were accessed now."""
    seen = visible.select("chunk_id").distinct().withColumn("_seen", F.lit(float(now)))
    out = manifest.join(seen, "chunk_id", "left")
    return out.withColumn("last_access", F.coalesce(F.greatest("last_access", "_seen"), F.col("last_access"), F.col("_seen"))).drop("_seen")


def lru_evict(chunks: DataFrame, target: int) -> DataFrame:
    """Least recently used chunks until their points reach ``target``, the crossing one included.

    Chunks never accessed come first; ties go to the smaller id.  A running sum over ranges: no task holds
    the whole manifest.
    """
    if target <= 0:
        return chunks.limit(0)
    rows = chunks.withColumn("_access", F.coalesce("last_access", F.lit(0.0)))
    return running_before(rows, ["_access", "chunk_id"], "n_points", "points_before").filter(F.col("points_before") < target).drop("_access")


def plan_load(requested: DataFrame, manifest: DataFrame, limit: int, protect: str = "requested") -> DataFrame:
    """Actions for a request: ``load`` missing chunks and ``evict`` old ones so that the total stays in ``limit``.

    The eviction target is the excess plus 5 % of the limit.  Requested chunks are protected; with
    ``protect='missing'`` only those still to be loaded are.  If nothing can be evicted though something
    must be, no row of kind ``evict`` comes back, which the caller treats as an error.
    """
    requested = requested.select("chunk_id").distinct()
    load = manifest.filter("on_disk and not loaded").join(requested, "chunk_id", "left_semi")
    held = manifest.filter("loaded").agg(F.coalesce(F.sum("n_points"), F.lit(0))).first()[0]
    more = load.agg(F.coalesce(F.sum("n_points"), F.lit(0))).first()[0]
    excess = held + more - limit
    target = int(excess + 0.05 * limit) if excess > 0 else 0
    shielded = load.select("chunk_id") if protect == "missing" else requested
    evict = lru_evict(manifest.filter("loaded").join(shielded, "chunk_id", "left_anti"), target)
    return load.select("chunk_id", "n_points", F.lit("load").alias("action")).union(evict.select("chunk_id", "n_points", F.lit("evict")))


def chunk_filename(c: Column) -> Column:
    """Name part of a chunk: p or n and the absolute value for each axis."""
    return F.concat_ws("_", *[F.concat(F.when(c[f"c{a}"] >= 0, "p").otherwise("n"), F.abs(c[f"c{a}"]).cast("string")) for a in "xyz"])


def assign_ids(df: DataFrame, order: list[str], start: int = 0, column: str = "gaussian_id") -> DataFrame:
    """Dense new ids from ``start`` in a declared order."""
    return numbered(df, order, column, start)
