"""Token-id files with keyed access.

Layout of a written folder::

    shard-00003-<attempt>.ids   raw little-endian ids (2 bytes if the vocabulary allows, else 4), documents one after another
    shard-00003-<attempt>.len   raw uint32 number of ids of each document in it
    index-00017-<attempt>.mph   minimal perfect hash of the keys in bucket 17 and, by slot, fingerprint, place and copies
    shards.parquet, index.parquet   the committed file names, first document and first id of each shard

Documents lie in ascending id order over the shards.  A key goes to the bucket of its hash, the bucket's
perfect hash gives its slot, the slot's fingerprint rejects keys that were never written, and the slot
names shard, record and offset: a constant number of steps whatever the size.  Files that a lost task
left behind are not in the committed lists and are never read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, plain_path, table, tokenizer_path
from .tokens import encoder, slices

KEYS_PER_BUCKET = 1 << 19
LEVEL_SLACK, MAX_LEVELS = 2.0, 64
#: Rows sent at once.
SPREAD = 65_536
RECORDS = "shard int, file string, record long, doc_id long, offset long, n_tokens long"
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("record", "<i8"), ("offset", "<i8"), ("copies", "<i8")])


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of salted keys."""
    x = keys.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key owns a bit on the first level where no other key hits it; its rank is its slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.cumsum(np.concatenate([[0], np.bitwise_count(x)]), dtype=np.int64) for x in levels]
        base = np.cumsum([0, *(int(o[-1]) for o in ones)])
        self.ranks, self.n = [o + b for o, b in zip(ones, base, strict=False)], int(base[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            words = max(1, int(len(left) * LEVEL_SLACK / 64) + 1)
            at = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            hits = np.bincount(at, minlength=words * 64)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            left = left[hits[at] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if no level has its bit."""
        keys, out = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[todo], level) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[own]] = (ranks[word] + below)[own]
            todo = todo[~own]
        return out

    def dump(self) -> bytes:
        head = json.dumps([len(x) for x in self.levels]).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        size = int.from_bytes(raw[:4], "little")
        at, levels = 4 + size, []
        for n in json.loads(raw[4:at]):
            levels.append(np.frombuffer(raw, np.uint64, n, at))
            at += 8 * n
        return cls(levels), at


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def key_hash(doc_id):
    return F.xxhash64(doc_id)


def _write(path: str, parts) -> None:
    fs, at = plain_path(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        for x in parts:
            out.write(x)


def _read(path: str) -> bytes:
    fs, at = plain_path(path)
    with fs.open_input_file(at) as f:
        return f.read()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, keep_space: bool = True, end_id: int = 0, shards: int | None = None) -> None:
    """Encode docs(doc_id, text) and write shards, then the index, below ``path``.

    Rows are ordered by id, then by hash of the text; null ids come first, null texts are empty.  Texts of any
    length are encoded whole, repeated rows are written each, further columns are ignored; an empty table gives
    files without a document.
    """
    spark = docs.sparkSession
    partitions = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the last key lets ranges cut even through rows that are all alike
    keys = {"tie": F.xxhash64(F.coalesce("text", F.lit(""))), "nth": F.monotonically_increasing_id()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(k) for k, c in keys.items()])
    rows = rows.repartitionByRange(partitions, "doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").select("doc_id", "text")

    def run(batches):
        task, code = TaskContext.get(), encoder(tokenizer, keep_space)
        shard = task.partitionId()
        kind = "<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        name, end, state = f"shard-{shard:05d}-{task.taskAttemptId()}", np.array([end_id], "<u4").tobytes(), {"record": 0, "offset": 0}
        fs, at = plain_path(f"{path}/{name}")
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at + ".ids") as ids, fs.open_output_stream(at + ".len") as lengths:
            for batch in (part for whole in batches for part in slices(whole)):
                keys, raw = batch.column("doc_id").to_pylist(), code.encode(batch.column("text").to_pylist())
                counts = np.array([len(x) // 4 + 1 for x in raw], np.int64)
                lengths.write(counts.astype("<u4").tobytes())
                for x in raw:
                    ids.write(np.frombuffer(x + end, "<u4").astype(kind).tobytes())
                n, offsets = len(keys), state["offset"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array([f"{name}:{kind}"] * n), pa.array(state["record"] + np.arange(n)), pa.array(keys, pa.int64()), pa.array(offsets), pa.array(counts)],
                    names=[c.split()[0] for c in RECORDS.split(", ")],
                )
                state = {"record": state["record"] + n, "offset": state["offset"] + int(counts.sum())}

    rows.mapInArrow(run, RECORDS).write.parquet(f"{path}/records.parquet")
    records = spark.read.schema(RECORDS).parquet(f"{path}/records.parquet")
    sizes = records.groupBy("shard", "file").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_ids"))
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    firsts = [F.coalesce(F.sum(c).over(along), F.lit(0)).alias(n) for c, n in (("n_records", "first_record"), ("n_ids", "first_id"))]
    sizes.select("*", *firsts).write.parquet(f"{path}/shards.parquet")
    keys = records.groupBy("doc_id").agg(F.min(F.struct("shard", "record", "offset")).alias("at"), F.count("*").alias("copies"))
    buckets = max(partitions, -(-records.count() // KEYS_PER_BUCKET))
    keys = keys.select(key_hash(F.col("doc_id")).alias("key"), "at.*", "copies").withColumn("bucket", _bucket(F.col("key"), buckets))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, key = int(pdf["bucket"].iloc[0]), pdf["key"].to_numpy(np.int64).view(np.uint64)
        function = PerfectHash.build(key)
        entries = np.zeros(len(key), ENTRY)
        slots = function.slots(key)
        entries["fingerprint"][slots] = fingerprint(key)
        for c in ("shard", "record", "offset", "copies"):
            entries[c][slots] = pdf[c].to_numpy()
        name = f"index-{bucket:05d}-{TaskContext.get().taskAttemptId()}.mph"
        _write(f"{path}/{name}", [function.dump(), entries.tobytes()])
        return pd.DataFrame({"bucket": [bucket], "index_file": [name], "n_buckets": [buckets]})

    keys.groupBy("bucket").applyInPandas(index, "bucket int, index_file string, n_buckets int").write.parquet(f"{path}/index.parquet")


def _bucket(key, buckets: int):
    return F.pmod(F.shiftright(key, 7), F.lit(buckets)).cast("int")


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """keys(doc_id) distinct -> doc_id, shard, record, offset, copies for the keys that were written."""
    spark = keys.sparkSession
    files = spark.read.schema("bucket int, index_file string, n_buckets int").parquet(f"{path}/index.parquet")
    head = files.select("n_buckets").first()
    if head is None:
        return spark.createDataFrame([], "doc_id long, shard int, record long, offset long, copies long")
    names = {r["bucket"]: r["index_file"] for r in files.collect()}  # one short row an index file
    asked = keys.select("doc_id", key_hash(F.col("doc_id").cast("long")).alias("key")).withColumn("bucket", _bucket(F.col("key"), head[0]))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket not in names:
            return pd.DataFrame({"doc_id": [], "shard": [], "record": [], "offset": [], "copies": []})
        raw = _read(f"{path}/{names[bucket]}")
        function, at = PerfectHash.load(raw)
        entries, key = np.frombuffer(raw, ENTRY, function.n, at), pdf["key"].to_numpy(np.int64).view(np.uint64)
        slots = function.slots(key)
        known = (slots >= 0) & (entries["fingerprint"][slots] == fingerprint(key))
        hit = entries[slots[known]]
        return pd.DataFrame({"doc_id": pdf["doc_id"][known].to_numpy(), **{c: hit[c] for c in ("shard", "record", "offset", "copies")}})

    return asked.groupBy("bucket").applyInPandas(find, "doc_id long, shard int, record long, offset long, copies long")


def read_documents(keys: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """Read the documents of distinct keys back: doc_id, start, n_tokens, ids_crc32, and (with ``payload``) ids binary (little-endian uint32).

    A key written for several rows gives as many rows; one that was never written gives none.
    """
    spark = keys.sparkSession
    shards = spark.read.schema("shard int, file string, n_records long, n_ids long, first_record long, first_id long").parquet(f"{path}/shards.parquet").orderBy("shard").collect()  # one short row a shard
    firsts, by_shard = np.array([r["first_record"] for r in shards], np.int64), {r["shard"]: i for i, r in enumerate(shards)}
    files, first_ids = [r["file"] for r in shards], [r["first_id"] for r in shards]

    def spread(batches):
        """One row a copy, with the place of the shard in the list; a key of many rows gives several batches."""
        for batch in batches:
            doc_id, shard, record, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "shard", "record", "copies"))
            first = firsts[[by_shard[x] for x in shard]] + record if len(shard) else record
            ends = np.cumsum(copies)
            for at in range(0, int(ends[-1]) if len(ends) else 0, SPREAD):
                nth = np.arange(at, min(at + SPREAD, int(ends[-1])))
                row = np.searchsorted(ends, nth, "right")
                whole = first[row] + nth - (ends - copies)[row]
                place = np.searchsorted(firsts, whole, "right") - 1
                ids = batch.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), pa.array(whole - firsts[place])], names=["doc_id", "place", "record"])

    def fetch(batches):
        have, f, lengths, offsets, kind, fs = -1, None, None, None, "", None
        for batch in (part for whole in batches for part in slices(whole, SPREAD if not payload else 1024)):
            out = {"doc_id": batch.column("doc_id").to_pylist(), "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if payload else {})
            for place, record in zip(batch.column("place").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if place != have:
                    if f is not None:
                        f.close()
                    name, kind = files[place].split(":")
                    fs, at = plain_path(f"{path}/{name}")
                    lengths = np.frombuffer(_read(f"{path}/{name}.len"), "<u4").astype(np.int64)
                    offsets, f, have = np.cumsum(lengths) - lengths, fs.open_input_file(at + ".ids"), place
                wide = np.dtype(kind).itemsize
                ids = np.frombuffer(f.read_at(int(lengths[record]) * wide, int(offsets[record]) * wide), kind).astype("<u4").tobytes()
                out["start"].append(first_ids[place] + int(offsets[record]))
                out["n_tokens"].append(int(lengths[record]))
                out["ids_crc32"].append(zlib.crc32(ids))
                if payload:
                    out["ids"].append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in out.items()], names=list(out))

    placed = lookup(keys, path).mapInArrow(spread, "doc_id long, place int, record long")
    placed = placed.repartition("place").sortWithinPartitions("place", "record")
    return placed.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * payload)


def op2_token_files(spark, sf_dir):
    """All documents written as token-id files and read back by key; see ``write_token_files`` for nulls, repeated rows and empty tables."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(docs.select("doc_id").distinct(), path, payload=False)
