"""Order-dependent work on tables of any length: numbers, sums, neighbours and scans over range partitions.

A table is range partitioned and sorted once and written with the number of its range and the place of each
row there.  Everything else reads that one copy: what ranges need of each other is a row for each range (and
group in it), and only those rows go through a window along the ranges.  A hot group is spread over all the
ranges it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PART, ROW = "_part", "_row"
#: Rows of a scan folded in one go; larger groups of rows are folded level by level.
BLOCK = 256
#: Largest group whose values Spark's own median may hold in one buffer, and buckets of a level beyond it.
MEDIAN_ROWS, BUCKETS = 100_000, 4096
#: Tables of one row a group are sent to every task up to this many rows.
BROADCAST_ROWS = 10_000


def ranged(df: DataFrame, order: list, what: str = "ranges") -> DataFrame:
    """df in ``order``, written once, with the number of its range and the row's place in it (both from 0).

    Reading it again can't deal rows out differently, as a second evaluation of a range partitioning can.
    """
    at = F.col("_at")
    # the id counts rows of a sorted partition in its low 33 bits, the partition above them
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(rows.withColumns({PART: F.shiftright(at, 33).cast("int"), ROW: at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), what)


def _before(value: Column, by: list[str]) -> Column:
    """Sum of what earlier ranges hold, in a table of one row for each range (and group)."""
    along = Window.partitionBy(*by).orderBy(PART) if by else Window.orderBy(PART)  # a row a range
    return F.coalesce(F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def meet(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes null for a value like any other; the columns of ``rows`` and the others of ``small``."""
    renamed = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    condition = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        condition = same if condition is None else condition & same
    return rows.join(renamed, condition, how).drop(*[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: list, column: str, start: int = 0) -> DataFrame:
    """Dense long numbers from ``start`` in ``order``; rows that agree in all of it are numbered in any order."""
    rows = ranged(df, order, "numbered")
    sums = rows.groupBy(PART).agg(F.count("*").alias("_n")).select(PART, _before(F.col("_n"), []).alias("_base"))
    return rows.join(F.broadcast(sums), PART).withColumn(column, F.col(ROW) + F.col("_base") + start).drop(PART, ROW, "_base")


def running_before(df: DataFrame, order: list, value: str, column: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row in ``order``."""
    rows = ranged(df, order, "running-sums")
    sums = rows.groupBy(PART).agg(F.sum(value).alias("_n")).select(PART, _before(F.col("_n"), []).alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(column, inside).join(F.broadcast(sums), PART).withColumn(column, F.col(column) + F.col("_base")).drop(PART, ROW, "_base")


def numbered_within(df: DataFrame, by: list[str], order: list, column: str, size: str | None = None) -> DataFrame:
    """Dense long numbers from 0 in each group, and with ``size`` the rows of the group; null groups are groups."""
    rows = ranged(df, [*by, *order], "numbered-within")
    ends = rows.groupBy(PART, *by).agg(F.count("*").alias("_n"), F.min(ROW).alias("_first"))
    whole = Window.partitionBy(*by)
    ends = ends.select(PART, *by, (_before(F.col("_n"), by) - F.col("_first")).alias("_base"), *([F.sum("_n").over(whole).alias(size)] if size else []))
    return meet(rows, ends, [PART, *by]).withColumn(column, F.col(ROW) + F.col("_base")).drop(PART, ROW, "_base")


def with_neighbours(df: DataFrame, by: list[str], order: list, columns: list[str]) -> DataFrame:
    """df with ``prev`` and ``next``: structs of ``columns`` of the row before and after in the group, null at its ends.

    Windows run inside ranges; the first and last row of a range take the border rows of their neighbours.
    """
    rows = ranged(df, [*by, *order], "neighbours")
    pick = lambda f, name: F.struct(*[f(c, ROW).alias(c) for c in columns]).alias(name)
    ends = rows.groupBy(PART, *by).agg(pick(F.min_by, "_first"), pick(F.max_by, "_last"))
    along = Window.partitionBy(*by).orderBy(PART)
    ends = ends.select(PART, *by, F.lag("_last").over(along).alias("_prev"), F.lead("_first").over(along).alias("_next"))
    inside, held = Window.partitionBy(PART, *by).orderBy(ROW), F.struct(*columns)
    both = meet(rows, ends, [PART, *by])
    return both.withColumns({"prev": F.coalesce(F.lag(held).over(inside), F.col("_prev")), "next": F.coalesce(F.lead(held).over(inside), F.col("_next"))}).drop(PART, ROW, "_prev", "_next")


def with_bracket(df: DataFrame, by: list[str], order: list, known: Column, columns: list[str]) -> DataFrame:
    """df with ``last`` and ``following``: structs of ``columns`` of the nearest row for which ``known`` holds, at or before and after.

    One running frame forward and one backward inside each range; what a range knows of the others comes from
    their last and first known rows.
    """
    rows = ranged(df.withColumn("_known", known), [*by, *order], "brackets")
    place = F.when(F.col("_known"), F.col(ROW))
    pick = lambda f, name: F.when(F.max(place).isNotNull(), F.struct(*[f(c, place).alias(c) for c in columns])).alias(name)
    ends = rows.groupBy(PART, *by).agg(pick(F.min_by, "_first"), pick(F.max_by, "_last"))
    seen = lambda c, along: F.last(c, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    group = Window.partitionBy(*by)
    ends = ends.select(PART, *by, seen("_last", group.orderBy(PART)).alias("_before"), seen("_first", group.orderBy(F.desc(PART))).alias("_after"))
    held, inside = F.when(F.col("_known"), F.struct(*columns)), Window.partitionBy(PART, *by)
    here = F.last(held, ignorenulls=True).over(inside.orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    both = meet(rows, ends, [PART, *by])
    both = both.withColumns({"last": F.coalesce(here, F.col("_before")), "following": F.coalesce(seen(held, inside.orderBy(F.desc(ROW))), F.col("_after"))})
    return both.drop(PART, ROW, "_before", "_after", "_known")


def affine_scan(df: DataFrame, by: list[str], number: str, a: Column, b: Column, column: str) -> DataFrame:
    """y = a y_before + b along each group, from 0; ``number`` is dense from 0 in its group.

    Affine maps compose, so rows are folded in blocks of BLOCK, the maps of blocks are scanned the same way, and
    each block is folded again from its start: a group of n rows takes log(n) / log(BLOCK) levels and no task
    holds more than its blocks.
    """
    rest = [c for c in df.columns if c not in (*by, number)]
    item = F.struct(F.col(number).alias("n"), a.cast("double").alias("a"), b.cast("double").alias("b"), F.struct(*rest).alias("row"))
    blocks = df.groupBy(*by, F.floor(F.col(number) / BLOCK).cast("long").alias("_block")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    blocks = cut(blocks, "scan-blocks")
    if blocks.filter("_block > 0").limit(1).count():
        last = F.aggregate("_items", F.lit(0.0), lambda y, x: y * x["a"] + x["b"])
        scale = F.aggregate("_items", F.lit(1.0), lambda y, x: y * x["a"])
        maps = blocks.select(*by, "_block", scale.alias("_a"), last.alias("_b"))
        ends = affine_scan(maps, by, "_block", F.col("_a"), F.col("_b"), "_start").select(*by, (F.col("_block") + 1).alias("_block"), "_start")
        blocks = meet(blocks, ends, [*by, "_block"], "left")
    else:
        blocks = blocks.withColumn("_start", F.lit(0.0))
    begin = F.struct(F.coalesce("_start", F.lit(0.0)).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        y = state["y"] * x["a"] + x["b"]
        return F.struct(y.alias("y"), F.concat(state["out"], F.array(y)).alias("out"))

    outs = F.aggregate("_items", begin, step, lambda s: s["out"])
    pairs = blocks.select(*by, F.explode(F.arrays_zip(F.col("_items").alias("item"), outs.alias("y"))).alias("z"))
    return pairs.select(*by, F.col("z.item.n").alias(number), "z.item.row.*", F.col("z.y").alias(column))


def largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def exact_median(df: DataFrame, by: list[str], value: str, most: int = MEDIAN_ROWS) -> DataFrame:
    """by, median: exact, also for groups whose values no task could hold.  Nulls don't count, NaN is the largest.

    The middle ranks are cornered by nested histograms: the bucket that holds a rank is cut into BUCKETS again
    between its own least and largest value, until it has at most ``most`` rows or one value.  Each level is one
    pass for all groups.
    """
    v = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if largest_group(v, by) <= most:
        return v.groupBy(*by).agg(F.median("_v").alias("median"))
    v = cut(v, "median-values")
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))), F.col("_v"))
    spans = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(finite).alias("_flo"), F.max(finite).alias("_fhi")]
    sizes = v.groupBy(*by).agg(*spans)
    half = F.floor(F.col("_n") / 2)
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), half))
    targets = cut(sizes.select("*", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_base")), "median-targets")
    few = targets.count() <= BROADCAST_ROWS

    def inside() -> DataFrame:
        t = targets.drop("_n")
        return meet(v, F.broadcast(t) if few else t, by).filter("_v >= _lo and _v <= _hi")

    def hold(counts: DataFrame, order: str) -> DataFrame:
        """The row of each rank, with the values below it."""
        along = Window.partitionBy(*by, "_rank").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("_base") + F.coalesce(F.sum("_n").over(along), F.lit(0))
        return counts.withColumn("_below", below).filter((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))

    while targets.filter((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        share = (F.col("_v") / 2 - F.col("_flo") / 2) / (F.col("_fhi") / 2 - F.col("_flo") / 2)
        place = F.when(F.isnan("_v"), BUCKETS + 1).when(F.col("_v") == float("inf"), BUCKETS).when(F.col("_v") == float("-inf"), -1)
        place = place.when(F.col("_flo") == F.col("_fhi"), 0).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).cast("int")
        hist = inside().groupBy(*by, "_rank", "_base", place.alias("_bucket")).agg(*spans)
        found = hold(hist, "_bucket").withColumn("_base", F.col("_below"))
        targets = cut(found.select(*by, "_n", "_lo", "_hi", "_flo", "_fhi", "_rank", "_base"), "median-targets")
    values = inside().groupBy(*by, "_rank", "_base", "_v").agg(F.count("*").alias("_n"))
    return hold(values, "_v").groupBy(*by).agg(F.avg("_v").alias("median"))
