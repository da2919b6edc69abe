"""Exact top-k by inner product over a bit-sliced index.

Rows are dealt into blocks.  A block keeps its attributes, quantised to integers, as bitmaps ("slices": one
bit of every row each); it holds no other copy of them.  For a query the slices are added with bitmap
arithmetic: every non-zero signed digit of a query component puts the attribute's slices into the columns
of their weights, and carry-save adders thin each column to one bitmap.  The k-th best sum is found from the
most significant bitmap downward; only rows at or above it leave the index, and their sums are read off the
bitmaps, so the scores are exact and rows at the boundary are settled by score and id.

Blocks are files in the shared folder.  Queries travel to the blocks, in chunks; a task opens a block once
and lets its queries stream past.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, table
from .token_files import _read, _write

BLOCK_ROWS, QUERY_ROWS = 16_384, 64
#: Tasks a core of the session gets at most, and the range of a score.
TASKS, LEAST, MOST = 64, -(2**63), 2**63 - 1


def packed(bits: np.ndarray) -> np.ndarray:
    """(..., rows) of 0 and 1 -> (..., words) of 64 rows each."""
    width = [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 64)]
    return np.packbits(np.pad(bits.astype(np.uint8), width), axis=-1, bitorder="little").view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little", count=n)


def build_block(vec_ids: np.ndarray, values: np.ndarray, copies: np.ndarray) -> list[bytes]:
    """Parts of a block's file.  values: int64 (rows, attributes)."""
    low = values.min(axis=0)
    raised = values.astype(np.uint64) - low.astype(np.uint64)  # exact for all of int64
    depths = [int(x).bit_length() for x in raised.max(axis=0)]
    head = json.dumps({"n": len(values), "low": low.tolist(), "depths": depths}).encode()
    slices = [packed((raised[None, :, d] >> np.arange(depth, dtype=np.uint64)[:, None]) & np.uint64(1)).tobytes() for d, depth in enumerate(depths) if depth]
    return [len(head).to_bytes(8, "little"), head, vec_ids.astype("<i8").tobytes(), copies.astype("<i8").tobytes(), *slices]


def digits(number: int) -> list[tuple[int, int]]:
    """(weight, sign) of the non-adjacent form: on average every third digit is not zero."""
    out, sign, number = [], 1 if number >= 0 else -1, abs(number)
    at = 0
    while number:
        if number & 1:
            digit = 2 - (number & 3)
            out.append((at, sign * digit))
            number -= digit
        number >>= 1
        at += 1
    return out


def add_columns(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight, several a weight -> the bits of their sum, least significant first."""
    total, weight = [], 0
    while columns:
        held = columns.pop(weight, None)
        if held is None:
            total.append(None)
            weight += 1
            continue
        planes, carries = np.concatenate(held), columns.setdefault(weight + 1, [])
        while len(planes) > 2:
            third = len(planes) // 3
            a, b, c = planes[:third], planes[third : 2 * third], planes[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            planes = np.concatenate([half ^ c, planes[3 * third :]])
        if len(planes) == 2:
            carries.append(planes[:1] & planes[1:])
            planes = planes[:1] ^ planes[1:]
        if not carries:
            del columns[weight + 1]
        total.append(planes[0])
        weight += 1
    zero = next((np.zeros_like(x) for x in total if x is not None), None)
    return [zero if x is None else x for x in total]


def top_rows(total: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows whose sum is at least the k-th best, decided from the most significant bit downward."""
    sure, same = np.zeros_like(rows), rows
    for bits in reversed(total):
        ones = same & bits
        count = int(np.bitwise_count(ones).sum())
        if count >= k:
            same = ones
        else:
            k, sure, same = k - count, sure | ones, same & ~bits
    return sure | same


class Block:
    """A block ready to be searched."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:8], "little")
        head, at = json.loads(raw[8 : 8 + size]), 8 + size
        self.n, self.low, self.depths = head["n"], head["low"], head["depths"]
        self.ids, self.copies = np.frombuffer(raw, "<i8", self.n, at), np.frombuffer(raw, "<i8", self.n, at + 8 * self.n)
        at, words = at + 16 * self.n, -(-self.n // 64)
        self.slices = []
        for depth in self.depths:
            self.slices.append(np.frombuffer(raw, np.uint64, depth * words, at).reshape(depth, words))
            at += 8 * depth * words
        self.every = packed(np.ones(self.n, np.uint8))
        self.order = np.argsort(self.ids, kind="stable")

    def rows_without(self, vec_id: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, [vec_id, vec_id + 1], sorter=self.order)
        gone = np.zeros(self.n, np.uint8)
        gone[self.order[lo:hi]] = 1
        return self.every & ~packed(gone)

    def search(self, vec_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own, ties to the smaller id; repeated rows count each."""
        rows, columns, constant = self.rows_without(vec_id), {}, 0
        for q, low, depth, slices in zip(query, self.low, self.depths, self.slices, strict=False):
            constant += q * low
            for weight, sign in digits(q) if depth else ():
                if sign < 0:  # -x is the complement of x less a constant
                    constant -= ((1 << depth) - 1) << weight
                for s in range(depth):
                    columns.setdefault(weight + s, []).append(slices[s : s + 1] if sign > 0 else ~slices[s : s + 1])
        total = add_columns(columns)
        # where a score may leave the range of a long, rows that meet at its end are told apart by id alone
        inside = LEAST <= constant and constant + (1 << len(total)) <= MOST
        at = np.flatnonzero(unpacked(top_rows(total, rows, k) if inside else rows, self.n))
        sums = [constant] * len(at)
        for weight, bits in enumerate(total):
            own = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            sums = [x + (int(b) << weight) for x, b in zip(sums, own, strict=True)]
        found = sorted((-min(max(x, LEAST), MOST), int(i), int(c)) for x, i, c in zip(sums, self.ids[at], self.copies[at], strict=True))
        return [(-minus, i) for minus, i, c in found for _ in range(min(c, k))][:k]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, value array<long> = floor(256 x); vectors that are null or hold a null or non-finite component go.

    Components beyond the range of a long take its end.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null and vec_id is not null").filter(~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x * 256).cast("long")).alias("value"))


def build_index(vectors: DataFrame, block_rows: int | None = None) -> tuple[str, dict[int, str]]:
    """Writes the index of vectors(vec_id, value) -> folder and the file of each block; shorter vectors are padded with zeros.

    Equal rows are counted before they are dealt, so that no block grows with their number.
    """
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession, "bit-index")
    rows = cut(vectors.groupBy("vec_id", "value").agg(F.count("*").alias("copies")), "bit-rows")
    blocks = max(1, -(-rows.count() // (block_rows or BLOCK_ROWS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "value"), F.lit(blocks)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((len(pdf), max(map(len, pdf["value"]))), np.int64)
        for i, v in enumerate(pdf["value"]):
            values[i, : len(v)] = v
        block = int(pdf["block"].iloc[0])
        name = f"block-{block:06d}-{np.random.bytes(8).hex()}"  # a task that runs twice writes twice; one name is kept
        _write(f"{path}/{name}", build_block(pdf["vec_id"].to_numpy(np.int64), values, pdf["copies"].to_numpy(np.int64)))
        return pd.DataFrame({"block": [block], "file": [name]})

    files = cut(dealt.groupBy("block").applyInPandas(build, "block int, file string"), "bit-files")
    return path, {r["block"]: r["file"] for r in files.collect()}  # one short row a block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact top-k: vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank, vec_id, score.

    The score is the inner product of the vectors turned into floor(256 x); one beyond the range of a long
    takes its end.  A query's own id is no candidate; repeated query rows are answered once, repeated
    candidates count each; the shorter of two vectors is padded with zeros; fewer candidates than k give all
    of them; null ids, null vectors and vectors with null or non-finite components take no part; further
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    path, files = build_index(integer_vectors(vectors))
    asked = cut(integer_vectors(queries).distinct(), "bit-queries")
    chunks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    # the hash leaves next to no number without a block; such a number finds nothing
    everywhere = asked.select("vec_id", "value", "chunk", F.explode(F.sequence(F.lit(0), F.lit(max(files, default=0)))).alias("block"))
    tasks = max(1, min(len(files) * chunks, TASKS * spark.sparkContext.defaultParallelism))
    met = everywhere.repartition(tasks, "block", "chunk").sortWithinPartitions("block")

    def search(batches):
        have, block = None, None
        for batch in batches:
            found = [], [], []
            for b, q, value in zip(*(batch.column(c).to_pylist() for c in ("block", "vec_id", "value")), strict=True):
                if b != have:
                    have, block = b, Block(_read(f"{path}/{files[b]}")) if b in files else None
                best = block.search(q, value, k) if block else []
                for column, x in zip(found, ([q] * len(best), [i for _, i in best], [s for s, _ in best]), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    local = met.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir):
    """The five best of all vectors for every vector whose id is divisible by 50; see ``top_k`` for nulls, ties and empty tables."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
