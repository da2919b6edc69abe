"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash of its id.  A source that must give ``r`` words beyond its whole
repeats gives the documents whose hash lies below a threshold.  The threshold is found without a
sort: words are summed by (source, leading hash bits), the bucket in which the running sum passes
``r`` is kept, and only that bucket is summed again by the next bits, until all 60 bits are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, quoted, table

HASH_BITS, LEVEL_BITS = 60, 12
#: Per-source rows are broadcast up to this many sources; beyond it Spark's skew-splitting join is used.
BROADCAST_SOURCES = 10_000


def id_hash(key: Column) -> Column:
    """60 bits of md5, so that any SQL engine can repeat the choice; null ids hash as empty text."""
    hexa = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(hexa, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """Water-filling over the sources.

    Sources by code point, null last, take the weights in turn.  A target stops at ``max_repeat`` times
    the source's size and the excess is shared again by weight.  In the order of cap / weight the level
    is the first ``(total - caps before) / (weights from here)`` that leaves its own source uncapped.
    The windows without a key run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn % len(weights) + 1))
    src = src.withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    src = (
        src.withColumn("place", F.row_number().over(order))
        .withColumn("level", (total - before).cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("place"))).over(whole)
    src = src.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return src.withColumn("repeats", repeats).select("source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"))


def per_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def thresholds(sizes: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """Per source the largest hash taken (-1: none), from nested histograms.

    The last bucket is one hash value; it is taken if that brings the sum nearer to the budget.
    """
    level = targets.filter("budget > 0").select("source", F.col("budget").alias("need"), F.lit(0).cast("long").alias("prefix"))
    inside = sizes.select("source", "size", "hash")
    for done in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - done - LEVEL_BITS
        if done:
            inside = inside.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS))
            inside = inside.join(level.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("prefix") == F.col("_p"))).select("source", "size", "hash")
            inside = cut(inside, "mix-bucket")
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = per_source(hist, level.select("source", "need"), n_sources).filter("need is not null")
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("before", before).filter("before < need and need <= before + words")
        level = cut(hist.select("source", (F.col("need") - F.col("before")).alias("need"), F.col("bucket").alias("prefix"), "words"), "mix-level")
    return level.select("source", F.when(F.col("words") - F.col("need") <= F.col("need"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last_hash"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, size: Column | None = None) -> DataFrame:
    """docs(doc_id, source, text, ...) -> the same rows with source_size, target and times (how often the mix takes the row).

    ``size`` defaults to the number of words.  Together a source's documents come within one document of
    its target, and none is taken more than ``max_repeat`` times.  Null texts have size 0, null sources
    form a source of their own (last), rows with equal ids are taken together.  An empty table gives an
    empty result; further columns are kept whatever their names, and columns named like the new ones are replaced.
    """
    docs = docs.drop("source_size", "target", "times")
    sizes = cut(docs.select("source", _size(size).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "mix-sizes")
    targets = cut(source_targets(sizes, weights, max_repeat), "mix-targets")
    n_sources = targets.count()
    last = thresholds(sizes, targets, n_sources).withColumnRenamed("source", "_s")
    targets = targets.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "budget")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "source", id_hash(F.col("doc_id")).alias("hash"))
    out = per_source(rows, targets, n_sources)
    times = F.col("repeats") + F.when(F.col("hash") <= F.coalesce(F.col("last_hash"), F.lit(-1)), 1).otherwise(0)
    return out.select("row.*", "source_size", "target", times.alias("times"))


def _size(size: Column | None = None) -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size


def op5_mix(spark, sf_dir):
    """What the mix takes of every document; see ``mixed`` for nulls, ties, repeated rows and empty tables."""
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("size", _size())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
b AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
        CAST((SELECT sum(source_size) FROM b) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM b),
d AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT min_by(level, place) FROM c WHERE level * w <= cap) * w) AS target FROM c),
e AS (SELECT source, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS k FROM d),
f AS (SELECT source, h, sum(size) AS words FROM s GROUP BY source, h),
g AS (SELECT f.*, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
t AS (SELECT g.source, max(CASE WHEN 2 * (e.target - e.k * e.source_size - before) >= words THEN h ELSE h - 1 END) AS last_hash
      FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source
      WHERE before < e.target - e.k * e.source_size AND e.target - e.k * e.source_size <= before + words GROUP BY g.source)
SELECT s.doc_id, s.size, e.source_size, e.target,
       CAST(s.size * (e.k + CASE WHEN s.h <= coalesce(t.last_hash, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.source
"""
