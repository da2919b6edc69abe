"""Quality rules: text statistics, base rules and robust multivariate outliers (DataFrame functions only).

Every document gets counts of its whole text.  Documents that pass the base rules become vectors of transformed
shares, rounded to whole thousandths.  Per language and source the minimum-covariance-determinant estimate is
found by concentration steps: from medians and median deviations, distances pick the nearest part of the group,
whose mean and covariance give the next distances.  A last step takes all that lie near enough.  Documents at a
larger Mahalanobis distance than a chi-square quantile are rejected.

Nothing is sorted or gathered by group: medians come from counts of the rounded values, the nearest part from
counts of distances in buckets, moments from sums of integers, which come out the same however rows are dealt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import BROADCAST_ROWS, meet
from .common import WORD, cut, table

#: Base rules: fewest words, largest percentage of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Part of a group that concentration steps keep, their number, and the shares of a normal group that the last step and the verdict take in.
PART, STEPS, NEAR, KEEP = 0.75, 4, 0.975, 1 - 1e-5
#: A group of fewer documents is judged by its language, a language of fewer by all documents.
LEAST_ROWS = 50
UNIT, BUCKETS = 1000, 32
#: Transformed statistics and the deviation that is always allowed; a statistic that hardly varies in a group decides nothing below it.
VECTOR = {
    "word_length": ("ln(try_divide(word_chars, n_words))", 0.05),
    "symbols": ("sqrt(try_divide(n_symbols, word_chars))", 0.04),
    "capitals": ("sqrt(try_divide(n_capitals, word_chars))", 0.04),
    "digits": ("sqrt(try_divide(n_digits, word_chars))", 0.15),
    "marks": ("sqrt(try_divide(n_marks, n_words))", 0.15),
    "twice": ("sqrt(try_divide(n_twice, n_words))", 0.08),
    "repeated": ("sqrt(try_divide(n_repeat_words, n_words))", 0.2),
    "lines": ("sqrt(try_divide(n_dup_lines, n_lines))", 0.2),
}
X = [f"x{i}" for i in range(len(VECTOR))]
CELLS = [(i, j) for i in range(len(X)) for j in range(i + 1)]


def _let(value: Column, body) -> Column:
    """Bind a costly expression once, so that lambdas below it do not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in some window of ``window`` words found twice or more (windows are compared by 64-bit hashes)."""

    def covered(starts: Column) -> Column:
        gap = lambda at, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - at, F.lit(window)))
        return F.aggregate(F.transform(starts, gap), F.lit(0), lambda a, x: a + x)

    def twins(rows: Column) -> Column:
        at = lambda k: F.get(rows, k)["h"]
        same = lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, same), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(rows, lambda r: _let(twins(r), covered)))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    return _let(words, lambda w: F.when(F.size(w) > window, _let(windows(w), count)).otherwise(F.lit(0))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, source, text) -> doc_id, lang, source and the counts of each whole text, with base_failed.

    Null texts have no words.  A line counts as repeated if it has a word and equals an earlier one.
    """
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({
        "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)),
    })
    before = lambda w: F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), count(r"\p{Lu}").alias("n_capitals"), count(r"[0-9]").alias("n_digits"), count(r"[!?;:]").alias("n_marks"),
        F.size(before(F.col("words"))).cast("long").alias("n_twice"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def chi_square(x: float, k: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return high


def _sent(small: DataFrame, rows: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A row a group goes to every task up to a checked number of them; beyond it Spark splits skewed joins."""
    return meet(rows, F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, keys, how)


def _inverse(matrix: Column) -> Column:
    """Inverse of a positive definite matrix, an array row by row, by sweeping one pivot after the other."""
    p = len(X)

    def sweep(m: Column, k: Column) -> Column:
        pivot = F.get(m, k * p + k)

        def cell(value: Column, at: Column) -> Column:
            i, j = F.floor(at / p).cast("int"), at % p
            rest = value - F.get(m, i * p + k) * F.get(m, k * p + j) / pivot
            return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), value / pivot).otherwise(rest)

        return F.transform(m, cell)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), matrix, sweep), lambda v: -v)


def _estimate(pool: DataFrame, mean: list[Column], covariance: dict, share: float) -> DataFrame:
    """pool with the moments of the nearest ``share`` of a group -> pool, m (mean), w (inverse covariance, row by row).

    Covariances of a trimmed group are raised to those of a whole normal one; the allowed deviations are added.
    """
    p = len(X)
    whole = share / chi_square(chi_square_quantile(share, p), p + 2) if share < 1 else 1.0
    floors = [(UNIT * floor) ** 2 for _, floor in VECTOR.values()]
    cells = [covariance[max(i, j), min(i, j)] * whole + (floors[i] if i == j else 0.0) for i in range(p) for j in range(p)]
    return cut(pool.select("pool", F.array(*mean).alias("m"), F.array(*cells).alias("a")).select("pool", "m", _inverse(F.col("a")).alias("w")), "mcd-estimates")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m under w."""
    v = [F.col(x) - F.get("m", F.lit(i)) for i, x in enumerate(X)]
    total = sum((v[i] * v[j] * F.get("w", F.lit(i * len(X) + j)) * (1 if i == j else 2) for i, j in CELLS), F.lit(0.0))
    return F.when(total < 0, 0.0).otherwise(total)  # null without an estimate


def _middles(counts: DataFrame) -> DataFrame:
    """counts(pool, axis, x, n) -> pool, axis, the lower median of x."""
    along = Window.partitionBy("pool", "axis")
    upto = F.sum("n").over(along.orderBy("x"))
    return counts.withColumns({"_upto": upto, "_all": F.sum("n").over(along)}).filter(2 * F.col("_upto") >= F.col("_all")).groupBy("pool", "axis").agg(F.min("x").alias("middle"))


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows(pool, x0, x1, ...: whole numbers) -> pool, m, w: robust centre and inverse covariance of each pool.

    A row a pool and, for the first centre, a row for each value of an axis: both small beside the rows.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(x).alias("x")) for i, x in enumerate(X)])).alias("z")
    counts = cut(rows.select("pool", axes).groupBy("pool", "z.axis", "z.x").agg(F.count("*").alias("n")), "mcd-values")
    centre = _middles(counts)
    off = counts.join(centre, ["pool", "axis"]).groupBy("pool", "axis", F.abs(F.col("x") - F.col("middle")).alias("x")).agg(F.sum("n").alias("n"))
    spread = _middles(off).withColumnRenamed("middle", "spread")
    on = lambda c, i: F.max(F.when(F.col("axis") == i, F.col(c))).cast("double")
    start = centre.join(spread, ["pool", "axis"]).groupBy("pool").agg(*[on("middle", i).alias(x) for i, x in enumerate(X)], *[F.pow(1.4826 * on("spread", i), 2).alias(f"a_{i}") for i in range(len(X))])
    found = _estimate(start, [F.col(x) for x in X], {(i, j): F.col(f"a_{i}") if i == j else F.lit(0.0) for i, j in CELLS}, 1.0)
    middle = found.select("pool", F.transform("m", lambda v: v.cast("long")).alias("c"))
    for step in range(steps + 1):
        far = _sent(found, rows, ["pool"]).withColumn("_d", _distance())
        if step < steps:
            # bucket by bucket of the distance until PART of the pool is in
            far = far.withColumn("_b", F.floor(F.log2(F.col("_d") + 1e-6) * BUCKETS).cast("int"))
            hist = far.groupBy("pool", "_b").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("pool").orderBy("_b"))
            limit = hist.withColumns({"_upto": upto, "_all": F.sum("n").over(Window.partitionBy("pool"))}).filter(F.col("_upto") >= F.ceil(PART * F.col("_all"))).groupBy("pool").agg(F.min("_b").alias("_limit"))
            near, share = _sent(cut(limit, "mcd-limits"), far, ["pool"]).filter("_b <= _limit"), PART
        else:
            near, share = far.filter(F.col("_d") <= chi_square_quantile(NEAR, len(X))), NEAR
        near = _sent(middle, near, ["pool"])
        v = [F.col(x) - F.get("c", F.lit(i)) for i, x in enumerate(X)]
        sums = near.groupBy("pool").agg(F.count("*").alias("n"), *[F.sum(v[i]).alias(f"s_{i}") for i in range(len(X))], *[F.sum(v[i] * v[j]).alias(f"q_{i}_{j}") for i, j in CELLS])
        sums = _sent(middle, sums, ["pool"])
        mean = [F.col(f"s_{i}") / F.col("n") for i in range(len(X))]
        covariance = {(i, j): F.col(f"q_{i}_{j}") / F.col("n") - mean[i] * mean[j] for i, j in CELLS}
        found = _estimate(sums, [F.get("c", F.lit(i)) + mean[i] for i in range(len(X))], covariance, share)
    return found


def _named(level: int, *names: str) -> Column:
    """A key for a pool; null is a name of its own."""
    said = [F.coalesce(F.concat(F.char_length(n).cast("string"), F.lit(":"), F.col(n)), F.lit("-")) for n in names]
    return F.concat_ws("/", F.lit(str(level)), *said)


def screen(docs: DataFrame, least_rows: int = LEAST_ROWS, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """docs(doc_id, lang, source, text) -> a row a document: doc_id, lang, source, its counts, base_failed, distance, kept.

    ``distance`` is squared, and null for documents that fail the base rules (those are never kept) or if fewer
    than ``least_rows`` documents pass them at all (then every one of those is kept).  Null texts have no words and
    fail; null languages and sources are groups; repeated rows and equal ids count each; an empty table gives an
    empty result; further columns are left behind.
    """
    stats = cut(with_statistics(docs), "text-statistics")
    vector = [F.round(F.expr(value) * UNIT).cast("long").alias(x) for x, (value, _) in zip(X, VECTOR.values(), strict=True)]
    fit = stats.filter(~F.col("base_failed")).select("lang", "source", *vector)
    groups = cut(fit.groupBy("lang", "source").agg(F.count("*").alias("n")), "mcd-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    whole = langs.agg(F.sum("n_lang").alias("n_all"), F.min("n_lang").alias("least_lang"))
    groups = meet(groups, langs, ["lang"]).crossJoin(F.broadcast(whole))  # one row
    enough = lambda c: F.col(c) >= least_rows
    pools = [
        F.when(enough("n"), _named(0, "lang", "source")),
        F.when(enough("n_lang") & ~enough("least"), _named(1, "lang")),
        F.when(enough("n_all") & ~enough("least_lang"), _named(2)),
    ]
    own = F.when(enough("n"), _named(0, "lang", "source")).when(enough("n_lang"), _named(1, "lang")).when(enough("n_all"), _named(2))
    groups = cut(groups.select("lang", "source", F.array_compact(F.array(*pools)).alias("pools"), own.alias("pool")), "mcd-pools")
    rows = _sent(groups.select("lang", "source", "pools"), fit, ["lang", "source"]).select(F.explode("pools").alias("pool"), *X)
    found = estimates(cut(rows, "mcd-rows"), steps)
    known = cut(groups.select("lang", "source", "pool").join(found, "pool"), "mcd-known")
    judged = _sent(known, stats.select("*", *vector), ["lang", "source"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    out = judged.withColumn("distance", distance).drop("pool", "m", "w", *X)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(keep, len(X)), F.lit(True)))


def op13_outliers(spark, sf_dir):
    """The verdict on all documents; see ``screen`` for nulls, repeated rows and empty tables."""
    out = screen(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
