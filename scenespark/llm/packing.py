"""Best-fit packing of documents into sequences of fixed capacity, in bulk-synchronous rounds.

Pieces are taken by falling size class.  A round range-sorts the class's pieces together with the gaps
of the open sequences, largest first.  Each range is swept once: a piece takes the smallest gap that
holds it (its successor), and when several pieces want one gap their rank in the sweep decides, so the
next piece takes the next larger gap; what remains of a gap rejoins the sweep where it belongs.  What a
range cannot match is matched between ranges by rank: only the counts left over by each range go to the
driver.  Gaps are then updated and the round repeats; pieces that no gap can hold open new sequences.
"""

from __future__ import annotations

import json
import zlib
from bisect import insort
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, tokenizer_path
from .tokens import encoder, slices

CAPACITY = 2048
#: Lower ends of the size classes as shares of the capacity.
CLASSES = (1 / 2, 1 / 3, 1 / 6, 1 / 20, 0)
#: Rows of one range, about; the rows alone decide how many ranges there are, whatever the cluster.
RANGE_ROWS = 100_000
GAP, PIECE, PLACED, SUMMARY = 0, 1, 2, 3
#: GAP: seq, size left, rank among the gaps that later ranges may take (else -1).  PIECE: id, size, rank.
#: PLACED: id, seq, offset.  SUMMARY: pieces left, gaps that later ranges may take, smallest piece, largest gap, placed.
SWEPT = "part int, kind int, rank long, id long, size int, seq long, offset int"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _events(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _sweep(capacity: int):
    """Sweep of one range: rows (kind, id, size), larger sizes first and gaps before pieces."""

    def run(batches):
        part, placed, left, low = TaskContext.get().partitionId(), [], [], capacity
        usable: list[tuple[int, int]] = []  # (-gap, seq) of gaps that hold the current size, smallest last
        waiting: list[tuple[int, int]] = []  # heap of (-gap, seq) of what remains of taken gaps
        for kind, key, size in _events(batches, "kind", "id", "size"):
            low = size
            while waiting and -waiting[0][0] >= size:
                insort(usable, heappop(waiting))
            if kind == GAP:
                insort(usable, (-size, key))
            elif usable:
                gap, seq = usable.pop()
                placed.append((key, seq, capacity + gap))
                if gap + size < 0:
                    heappush(waiting, (gap + size, seq))
            else:
                left.append((key, size))
        while waiting and -waiting[0][0] >= low:
            insort(usable, heappop(waiting))
        rows = [(part, PLACED, 0, key, 0, seq, offset) for key, seq, offset in placed]
        rows += [(part, PIECE, r, key, size, 0, 0) for r, (key, size) in enumerate(left)]
        rows += [(part, GAP, r, 0, -gap, seq, 0) for r, (gap, seq) in enumerate(usable)]
        rows += [(part, GAP, -1, 0, -gap, seq, 0) for gap, seq in waiting]
        largest = max((-g for g, _ in [*usable[:1], *waiting[:1]]), default=0)
        if rows:
            rows.append((part, SUMMARY, len(left), len(usable), left[-1][1] if left else capacity, largest, len(placed)))
        yield _batch(rows, SWEPT)

    return run


def _fill(capacity: int):
    """Pieces (id, size) in falling order, placed one after another in new sequences, each named by its first piece."""

    def run(batches):
        rows, seq, used = [], None, 0
        for key, size in _events(batches, "id", "size"):
            if seq is None or used + size > capacity:
                if seq is not None and used < capacity:
                    rows.append((0, GAP, -1, 0, capacity - used, seq, 0))
                seq, used = key, 0
            rows.append((0, PLACED, 0, key, 0, seq, used))
            used += size
        if seq is not None and used < capacity:
            rows.append((0, GAP, -1, 0, capacity - used, seq, 0))
        yield _batch(rows, SWEPT)

    return run


def _between_ranges(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range, pieces left, gaps left) -> (range of the pieces, from rank, to rank, range of the gaps, gap rank of the first).

    Ranges come largest first.  A range's pieces take the gaps left by earlier ranges, nearest first.
    """
    stack, out = [], []
    for part, want, gaps in sorted(left):
        done = 0
        while done < want and stack:
            gap_part, free = stack.pop()
            take = min(free, want - done)
            out.append((part, done, done + take, gap_part, free - 1))
            if free > take:
                stack.append((gap_part, free - take))
            done += take
        if gaps:
            stack.append((part, gaps))
    return out


def n_ranges(rows: int) -> int:
    return max(1, -(-rows // RANGE_ROWS))


def _ranges(df: DataFrame, ranges: int) -> DataFrame:
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    # one range, of RANGE_ROWS rows at most, needs no borders
    dealt = df.repartition(1) if ranges == 1 else df.repartitionByRange(ranges, *order)
    return dealt.sortWithinPartitions(*order)


def _round(pieces: DataFrame, gaps: DataFrame, ranges: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """One round.  pieces(id, size), gaps(seq, gap) -> placed(id, seq, offset), pieces left, gaps after it, and totals."""
    both = pieces.select(F.lit(PIECE).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(GAP).alias("kind"), F.col("seq").alias("id"), F.col("gap").alias("size")))
    swept = cut(_ranges(both, ranges).mapInArrow(_sweep(capacity), SWEPT), "pack-sweep")
    told = swept.filter(F.col("kind") == SUMMARY).collect()  # a row a range
    links = _between_ranges([(r["part"], r["rank"], r["id"]) for r in told])
    totals = {"left": sum(r["rank"] for r in told), "linked": sum(hi - lo for _, lo, hi, _, _ in links), "placed": sum(r["offset"] for r in told)}
    totals |= {"smallest": min((r["size"] for r in told), default=0), "largest": max((r["seq"] for r in told), default=0), "ranges": len(told)}
    placed = swept.filter(F.col("kind") == PLACED).select("id", "seq", "offset")
    left = swept.filter(F.col("kind") == PIECE).select("part", "rank", "id", "size")
    free = swept.filter(F.col("kind") == GAP).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "seq", F.col("size").alias("gap"))
    if not links:
        return placed, left.select("id", "size"), free.select("seq", "gap"), totals
    # the links of each range by its number, at most two rows a range in all
    by_part: list[list] = [[] for _ in range(1 + max(part for part, *_ in links))]
    for part, lo, hi, gap_part, top in links:
        by_part[part].append({"lo": lo, "hi": hi, "gap_part": gap_part, "top": top})
    known = F.from_json(F.lit(json.dumps(by_part)), "array<array<struct<lo:bigint,hi:bigint,gap_part:int,top:bigint>>>")
    link = F.get(F.filter(F.get(known, F.col("part")), lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), F.lit(0))
    left = left.select("id", "size", "rank", link.alias("link"))
    left = left.select("id", "size", "link.gap_part", (F.col("link.top") - (F.col("rank") - F.col("link.lo"))).alias("gap_rank"))
    met = left.filter("gap_part is not null").join(free.filter("gap_rank >= 0"), ["gap_part", "gap_rank"])
    met = cut(met.select("id", "size", "gap_part", "gap_rank", "seq", "gap"), "pack-met")
    after = free.join(met.select("gap_part", "gap_rank", "size"), ["gap_part", "gap_rank"], "left")
    after = after.select("seq", (F.col("gap") - F.coalesce("size", F.lit(0))).cast("int").alias("gap")).filter("gap > 0")
    placed = placed.unionByName(met.select("id", "seq", (F.lit(capacity) - F.col("gap")).cast("int").alias("offset")))
    return placed, left.filter("gap_part is null").select("id", "size"), after, totals


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(id long unique, size int in 1..capacity) -> id, seq, offset.

    Sequences are named by the piece that opened them; offsets are gapless from 0 and no sequence holds
    more than ``capacity``.  Ties of size go by id.  An empty table gives an empty result.
    """
    lower = [int(capacity * share) for share in CLASSES]
    which = F.size(F.filter(F.array(*map(F.lit, lower)), lambda x: x >= F.col("size")))
    counts = {r["class"]: r["count"] for r in pieces.groupBy(which.alias("class")).count().collect()}  # a row a class
    # two pieces of the first class never meet: each opens a sequence
    first = pieces.filter(which == 0)
    out = first.select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"))
    gaps = first.filter(F.col("size") < capacity).select(F.col("id").alias("seq"), (F.lit(capacity) - F.col("size")).cast("int").alias("gap"))
    held = counts.get(0, 0)
    for level in range(1, len(lower)):
        todo, n = pieces.filter(which == level).select("id", "size"), counts.get(level, 0)
        # gaps that hold no piece of the class are left out of its rounds
        aside, gaps = gaps.filter(F.col("gap") <= lower[level]), gaps.filter(F.col("gap") > lower[level])
        more = n > 0
        while more:
            placed, todo, gaps, totals = _round(todo, gaps, n_ranges(n + held), capacity)
            out, n = out.unionByName(placed), totals["left"] - totals["linked"]
            # one range is swept to the end; several may still hold what another needs, as long as a round places something
            more = n > 0 and totals["ranges"] > 1 and totals["linked"] + totals["placed"] > 0 and totals["smallest"] <= totals["largest"]
        gaps = gaps.unionByName(aside)
        if n:
            order = todo.withColumn("kind", F.lit(PIECE))
            opened = cut(_ranges(order, n_ranges(n)).mapInArrow(_fill(capacity), SWEPT), "pack-open")
            out = out.unionByName(opened.filter(F.col("kind") == PLACED).select("id", "seq", "offset"))
            gaps = gaps.unionByName(opened.filter(F.col("kind") == GAP).select("seq", F.col("size").alias("gap")))
            held += n
    return out


PIECES = "id long, doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, keep_space: bool, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> pieces of at most ``capacity`` tokens, with the crc32 of their ids, written to the shared folder.

    A document is its ids, then ``end_id``; a null text has only the end id, a long one is cut and never shortened.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        code, key = encoder(path, keep_space), TaskContext.get().partitionId() << 36
        for batch in (part for whole in batches for part in slices(whole)):
            out = {n.split()[0]: [] for n in PIECES.split(", ")}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), code.encode(texts), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    for name, value in zip(out, (key, doc_id, piece, at // 4, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        out[name].append(value)
                    key += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES), "pack-pieces")


def pack_documents(docs: DataFrame, path: str, keep_space: bool = False, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    Null ids and repeated rows are packed like any other row; further columns are ignored; an empty table gives an
    empty result.
    """
    pieces = cut_pieces(docs, path, keep_space, capacity, end_id)
    places = pack(pieces.select("id", F.col("length").alias("size")), capacity)
    out = pieces.join(places, "id")
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op1_pack(spark, sf_dir):
    """All documents in sequences of 2048 tokens; see ``pack_documents`` for nulls, long texts, repeated rows and empty tables."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
