"""Threshold-scaled document sketches (DataFrame functions only).

A sketch keeps every distinct shingle hash in the lowest ``1/scale`` of the hash range, so its size
follows the text, sketches merge by union, and the share of a small text that a much larger one
contains can be estimated without bias.  A text whose hashes all lie above the threshold keeps its
smallest one, so only a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, table

NGRAM, SCALE = 5, 8
#: Stands for a null id while rows are joined.
NO_ID = -(2**63)


def _let(value: Column, body) -> Column:
    """Bind a costly expression once, so that lambdas below it do not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, ngram: int = NGRAM, scale: int = SCALE) -> Column:
    """Sorted array<long> of the retained shingle hashes; fewer than ``ngram`` words make one shingle."""
    threshold = -(2**63) + 2**64 // scale
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (ngram - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, ngram)))

    def keep(h: Column) -> Column:
        return _let(F.array_min(h), lambda least: F.array_sort(F.array_distinct(F.filter(h, lambda x: (x < threshold) | (x == least)))))

    return _let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_let(hashes(w), keep)))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's shingles that the other holds; two empty sketches: 1."""
    small = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def neighbours(keys: DataFrame) -> DataFrame:
    """keys(key, tie, n, copies), one row per key -> the same with next_* and prev_* in (key, tie) order, as a ring.

    Range partitions are ordered on their own; only the first and last key of each goes through the
    windows without a key (as many rows as there are partitions).
    """
    keys = cut(keys.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id()), "ring")
    key, inside = F.struct("key", "tie", "n"), Window.partitionBy("part").orderBy("key", "tie")
    ends = keys.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(along), F.last("last").over(whole)).alias("before"),
    )
    keys = keys.join(ends, "part")
    nxt = F.coalesce(F.lead(key).over(inside), F.col("after"))
    prev = F.coalesce(F.lag(key).over(inside), F.col("before"))
    return keys.select("key", "tie", "copies", nxt.alias("next"), prev.alias("prev"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n_chars, sketch, head (the first floor(n_chars/2) code points of the next text), next_sketch.

    Rows that agree in id and text are each other's next, and the last of them has the following row.
    Null texts are empty; null ids come first; an empty table gives an empty result; further columns are left
    behind.  A text is sketched once, before it is sent.
    """
    # Plain equality on keys without nulls, and no column that only one branch needs: the join, the
    # window, the second join and what is sent share one shuffle of the texts.
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce("text", F.lit(""))
    rows = docs.select(key.alias("key"), text.alias("text")).withColumns({"tie": F.xxhash64("text"), "own": sketch(F.col("text"))})
    keys = rows.select("key", "tie", F.char_length("text").cast("long").alias("n")).groupBy("key", "tie").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    ring = cut(neighbours(keys).select("key", "tie", "copies", "prev"), "ring-next")
    rows = rows.join(ring, ["key", "tie"])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key", "tie").orderBy(F.lit(1))))
    sent = rows.filter("copy = 1").select(
        F.col("prev.key").alias("key"), F.col("prev.tie").alias("tie"),
        F.expr("substring(text, 1, cast(prev.n div 2 as int))").alias("next_head"), F.col("own").alias("sent_sketch"),
    )
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).drop("prev")
    rows = rows.join(sent, ["key", "tie"], "left")
    last = F.col("copy") == F.col("copies")
    own_head = F.expr("substring(text, 1, cast(n_chars div 2 as int))")
    return rows.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", "n_chars", F.col("own").alias("sketch"), F.when(last, F.col("next_head")).otherwise(own_head).alias("head"), F.when(last, F.col("sent_sketch")).alias("next_sketch"))


def document_sketches(docs: DataFrame, ngram: int = NGRAM, scale: int = SCALE) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with sketch array<long>.

    Null and empty texts have an empty sketch, long ones are read whole; rows are sketched one by one, so null
    ids and repeated rows are like any other; a column named sketch is replaced, others are kept; an empty table
    gives an empty result.
    """
    return docs.withColumn("sketch", sketch(F.col("text"), ngram, scale))


def op10_sketch(spark, sf_dir):
    """Sketches of all documents and of their edited texts; see ``with_next`` for nulls, repeated rows and empty tables."""
    docs = with_next(table(spark, sf_dir, "documents"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.coalesce("head", F.lit("")))
    docs = docs.withColumn("edited", edited)
    docs = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("sketch").alias("own"), sketch(F.col("edited")).alias("changed"), "next_sketch")
    return docs.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).cast("double").alias("near_edited"),
        F.when(F.col("next_sketch").isNull(), F.lit(1.0)).otherwise(containment(F.col("own"), F.col("next_sketch"))).cast("double").alias("near_next"),
    )
