"""Interpolated modified Kneser-Ney trigram model, counted in Spark and read by memory mapping.

Words are known by a 64-bit hash.  The model is a folder of sorted arrays, cut into shards of bounded text:

* ``words-*``: the hashes of a hash range in order, with counts; a word's number is its place in all of them;
* ``contexts-*``: hashes of two words; of a context with one follower that word and its count, of others a row of
  ``branches-*``: how often a token follows them and how many of their followers were seen once, twice and more;
* ``triples-*``: 64-bit hashes of three numbers in order, with counts, where the context has several followers;
* ``pairs-*``: hashes of a word and its follower, with the number of different words before the two;
* ``wide-*``: hashes of two words with what ``branches-*`` says of others;
* ``stats-*``: for the words of a range the same of single words (by different words before), and how many
  different words they follow.

A triple belongs to the shard of its middle word, so its pair and its context are counted where it is.  Middle
words frequent enough to fill a shard are dealt over all shards by their follower; only the contexts that end in
them are then summed once more (``wide-*``).  Tasks count their own rows first and send packed pieces of those
counts.  Everything is counted over all training texts; the model grows with them.

Every triple is stored if ``least`` is 1, as ``op6_kneser_ney`` has it.  With 2, triples seen once are counted for the
orders below and for the discounts, but not stored: their whole count goes to what a context leaves to the pair model
(a discount of 1), and a context of such triples alone says nothing.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc, new_path, plain_path, table, words_of  # noqa: F401
from .token_files import _mix, _read, _write

END, START = 0, 1  # hashes of the end of a text and of what stands before its first word
UNKNOWN = np.int64(-1)
#: Distinct words and tokens a task holds before it sends their counts, tokens it scores at once.
HELD_WORDS, HELD_TOKENS, SCORED = 250_000, 1_500_000, 300_000
#: Bytes of text for which the model gets a shard, and the least count of a triple stored by ``train`` unless told otherwise.
SHARD_BYTES, LEAST = 12 << 20, 2
#: Instead of the count of a context's only follower: the context has a row of its own.
MANY = 255
_memory: dict = {}


def _pack(columns: list[np.ndarray], steps: int) -> bytes:
    """Columns of 64-bit integers as compressed bytes, the first of them as steps, byte by byte of each place."""
    columns = [np.diff(c, prepend=np.uint64(0)) if i < steps else c for i, c in enumerate(columns)]
    return pa.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, columns: int = 2, steps: int = 1) -> list[np.ndarray]:
    raw = pa.decompress(packed, decompressed_size=8 * n * columns, codec="zstd", asbytes=True)
    found = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in np.frombuffer(raw, np.uint8).reshape(columns, 8, n)]
    return [np.cumsum(c, dtype=np.uint64) if i < steps else c for i, c in enumerate(found)]


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, first = _groups(keys)
    return keys[order[first]], np.add.reduceat(counts[order], first) if len(keys) else counts


def _parts(shard: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of each shard."""
    order = np.argsort(shard.astype(counter_type(shard)), kind="stable")  # a radix sort for up to 65,536 shards
    return [part for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(part)]


def split_words(texts: pa.Array) -> pa.Array:
    """``words_of`` every text, as lists."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = found.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty words
    at = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][found.offsets.to_numpy()]
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), words.filter(full))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    size, at, data = np.diff(at), at[:-1], np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    eights, hashes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), _mix(size, 41)
    left, done = np.arange(len(size)), 0
    while len(left):
        rest = size[left] - done
        some = eights[at[left] + done] & (np.uint64(2**64 - 1) >> (8 * (8 - np.clip(rest, 1, 8))).astype(np.uint64))
        hashes[left] = _mix(hashes[left] ^ some, 42)
        left, done = left[rest > 8], done + 8
    return hashes


def coded(texts: pa.Array | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts -> hashes of the different ones, and which of these stand one after another."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))
    words = texts.flatten().dictionary_encode()
    return word_hashes(words.dictionary), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


PACKED = "shard int, packed binary, n int"


def _send(shard: np.ndarray, *columns: np.ndarray, order: np.ndarray | None = None, steps: int = 1):
    """Columns with the shard of each row -> one packed row a shard, in ``order`` inside it."""
    parts = _parts(shard) if order is None else [part for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(part)]
    if parts:
        columns = [np.ascontiguousarray(c).astype(np.uint64) for c in columns]
        rows = [(int(shard[part[0]]), _pack([c[part] for c in columns], steps), len(part)) for part in parts]
        s, p, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(p, pa.binary()), pa.array(n, pa.int32())], names=["shard", "packed", "n"])


def _gathered(pdf: pd.DataFrame, columns: int = 2, steps: int = 1) -> list[np.ndarray]:
    parts = [_unpack(p, n, columns, steps) for p, n in zip(pdf["packed"], pdf["n"], strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count_words(shards: int):
    def run(batches):
        held, count, ends = [], 0, 0

        def send(all_of_them: bool):
            """Adds up what is held; sends it if told to or if there are many different words."""
            keys, counts = _sum(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            if all_of_them or len(keys) > HELD_WORDS:
                yield from _send(word_shard(keys, shards), keys, counts)
            else:
                held.append((keys, counts))

        for batch in batches:
            texts = batch.column("text")
            ends += len(texts)
            for s in _batches_of(texts, 1 << 21):
                hashes, codes = coded(split_words(texts[s]))
                held.append((hashes, np.bincount(codes, minlength=len(hashes))))
                count += len(hashes)
                if count > 4 * HELD_WORDS:
                    yield from send(False)
                    count = sum(len(keys) for keys, _ in held)
        if held:
            yield from send(True)
        if ends:
            yield from _send(np.array([0]), np.array([END]), np.array([ends]))

    return run


def _by_shard(shard: np.ndarray, v: np.ndarray, u: np.ndarray, shards: int) -> np.ndarray:
    """Order by shard, and inside it about by v and u (by as many of their bits as fit, which only serves to pack them)."""
    bits = (63 - shards.bit_length()) // 2
    low = (1 << bits) - 1
    return np.argsort(shard << 2 * bits | (v & low) << bits | u & low)


def counter_type(values: np.ndarray) -> str:
    """The smallest unsigned type that holds the values."""
    return "<" + np.min_scalar_type(int(values.max(initial=0))).str[1:]


@functools.lru_cache(64)
def _mapped(path: str) -> np.ndarray:
    """The bytes of a file, mapped once for all its columns."""
    return np.memmap(path, np.uint8, "r").view(np.ndarray)


def _map(path: str, dtype: str, offset: int, n: int) -> np.ndarray:
    """An array of a model file: mapped if the folder is mounted here, else that part of the file is read."""
    fs, at = plain_path(path)
    if n == 0:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.frombuffer(_mapped(at), dtype, n, offset)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_at(n * np.dtype(dtype).itemsize, offset), dtype)


class Words:
    """Numbers of words, from the mapped word shards."""

    def __init__(self, path: str, files: list[tuple[str, int]]):
        self.path, self.shards = path, len(files)
        self.parts = [_map(f"{path}/{f}", "<u8", 0, n) for f, n in files]
        self.counts = [_map(f"{path}/{f}", "<i8", 8 * n, n) for f, n in files]
        self.base = np.cumsum([0, *(n for _, n in files)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), UNKNOWN)
        order = np.argsort(hashes)
        shard = word_shard(hashes[order], self.shards)
        for part in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            if len(part):
                s = int(word_shard(hashes[part[:1]], self.shards)[0])
                have = self.parts[s]
                at = np.minimum(np.searchsorted(have, hashes[part]), max(len(have) - 1, 0))
                hit = have[at] == hashes[part] if len(have) else np.zeros(len(part), bool)
                out[part[hit]] = self.base[s] + at[hit]
        return out

    def numbers(self, texts: pa.Array) -> np.ndarray:
        """Numbers of the words of the texts, one after another."""
        hashes, codes = coded(texts)
        return self.find(hashes)[codes]


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of two numbers or hashes."""
    return _mix(_mix(a, salt) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), salt + 1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return joined(first, second, 11)


def triple_hash(first_two: np.ndarray, third: np.ndarray) -> np.ndarray:
    return joined(first_two, third, 21)


def follower_mark(numbers: np.ndarray) -> np.ndarray:
    """What a context with one follower keeps of its number."""
    return numbers & 0xFFFFFFFF


def shard_of(middle: np.ndarray, frequent: np.ndarray, pair: np.ndarray, shards: int) -> np.ndarray:
    """By the middle word; by the pair if that word is frequent."""
    return (_mix(np.where(frequent, pair, middle.astype(np.uint64)), 5) % np.uint64(shards)).astype(np.int64)


def padded(texts: pa.Array | list[list[bytes]], numbers: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of the texts -> start, start, words, end of each text; and the lengths with the end."""
    n = (np.array([len(x) for x in texts], np.int64) if isinstance(texts, list) else texts.value_lengths().to_numpy().astype(np.int64)) + 1
    out = np.full(int(n.sum()) + 2 * len(n), end, np.int64)
    first = np.cumsum(n + 2) - n - 2
    keep = np.ones(len(out), bool)
    keep[np.concatenate([first, first + 1, first + n + 1])] = False
    out[keep] = numbers
    out[first] = out[first + 1] = start
    return out, n


def windows(sequence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the tokens (neither of the two starts of a text)."""
    keep = np.ones(len(sequence), bool)
    first = np.cumsum(n + 2) - n - 2
    keep[first] = keep[first + 1] = False
    return np.flatnonzero(keep)


def _batches_of(texts: pa.Array, size: int):
    """Slices of about so many bytes, of one text at least."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(at, size + (at[first - 1] if first else 0), "right")))
        yield slice(first, last)
        first = last


def _opened(path: str, files: list) -> Words:
    if path not in _memory:
        _memory.clear()
        _memory[path] = Words(path, files)
    return _memory[path]


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things were counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return (0.5, 0.5, 0.5) if n1 or n2 or n3 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return tuple(float(np.clip(x, 0.01, i - 0.01)) for i, x in enumerate(d, 1))


class Model:
    """What tasks need to open a trained model: file names and a few totals."""

    def __init__(self, path: str):
        self.path = path


class File:
    """Columns of a file; if the first of them are sorted hashes, the rest is found by these."""

    def __init__(self, path: str, name: str, n: int, kinds: tuple[str, ...]):
        self.columns, at = [], 0
        for kind in kinds:
            self.columns.append(_map(f"{path}/{name}", kind, at, n))
            at += n * np.dtype(kind).itemsize

    def find(self, keys: np.ndarray, out: np.ndarray) -> None:
        """out (columns x keys): counts of the keys, left as they are where a key is not held."""
        held, *columns = self.columns
        if len(held):
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            hit = np.flatnonzero(held[at] == keys)
            at = at[hit]
            for i, c in enumerate(columns):
                out[i, hit] = c[at]


@functools.lru_cache(16_000)
def _file(path: str, name: str, n: int, *kinds: str) -> File:
    return File(path, name, n, kinds)


def _store(path: str, what: str, shard: int, columns: list[np.ndarray], kinds: list[str] | None = None) -> tuple:
    """Writes a File and says what ``_file`` opens it by; a task that runs twice writes two of them, one of which is kept."""
    name, kinds = f"{what}-{shard:05d}-{np.random.bytes(8).hex()}", kinds or [counter_type(c) for c in columns]
    _write(f"{path}/{name}", [c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True)])
    return name, len(columns[0]), *kinds


def _store_keyed(path: str, what: str, shard: int, keys: np.ndarray, columns: list[np.ndarray]) -> tuple:
    return _store(path, what, shard, [keys, *columns], ["<u8", *map(counter_type, columns)])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each key begins in it."""
    order = np.argsort(keys)
    held = keys[order]
    return order, np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _by_count(counts: np.ndarray, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Sums, and ones where a count is 1, 2 and more."""
    return [counts if weights is None else weights, *(x.astype(np.int64) for x in (counts == 1, counts == 2, counts > 2))]


def telling(stats: list[np.ndarray], least: int) -> np.ndarray:
    """Contexts with a stored triple: all, or by their followers seen twice and more."""
    return stats[0] > 0 if least == 1 else stats[2] + stats[3] > 0


def train(docs: DataFrame, path: str | None = None, shards: int | None = None, least: int = LEAST) -> Model:
    """docs(text) -> trigram model of all of them, written to ``path``; ``least`` 1 stores every triple, 2 no triple seen once.

    Null texts are empty (an end and nothing else); texts of any length are read whole; repeated rows count
    each; further columns are ignored; an empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    model = Model(path or new_path(spark, "kneser-ney"))
    path, texts = model.path, docs.select("text")
    shards = shards or max(4, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def write_words(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _sum(*_gathered(pdf))
        counts = counts.astype(np.int64)
        name = f"words-{int(pdf['shard'].iloc[0]):05d}-{np.random.bytes(8).hex()}"
        _write(f"{path}/{name}", [keys.astype("<u8").tobytes(), counts.astype("<i8").tobytes()])
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "file": [name], "n": [len(keys)], "tokens": [int(counts.sum())]})

    rows = texts.mapInArrow(_count_words(shards), PACKED).groupBy("shard").applyInPandas(write_words, "shard int, file string, n long, tokens long")
    rows = {r["shard"]: r for r in cut(rows, "lm-words").collect()}  # one short row a shard
    _write(f"{path}/empty", [b""])
    model.words = [(rows[s]["file"], rows[s]["n"]) if s in rows else ("empty", 0) for s in range(shards)]
    model.tokens, model.types = sum(r["tokens"] for r in rows.values()), sum(r["n"] for r in rows.values())
    model.shards, words = shards, model.words
    base = np.cumsum([0, *(n for _, n in words)])
    model.end = end = 0 if model.types else -1  # hash 0 is the first of the first shard
    model.start = start = model.types
    # words that are more than half of a shard's share of all tokens: at most 2 x shards of them
    limit = max(1, model.tokens // (2 * shards))

    def frequent_words(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for s in pdf["s"]:
            f, n = words[s]
            found.append(base[s] + np.flatnonzero(_map(f"{path}/{f}", "<i8", 8 * n, n) > limit))
        return pd.DataFrame({"word": np.concatenate(found) if found else np.zeros(0, np.int64)})

    listed = spark.range(shards).select(F.col("id").cast("int").alias("s")).repartition(min(shards, 64))
    frequent = listed.mapInPandas(lambda it: map(frequent_words, it), "word long").toPandas()["word"].to_numpy(np.int64)
    frequent = model.frequent = np.sort(np.append(frequent, start))

    def count_triples(batches):
        known, held, count = _opened(path, words), [], 0

        def send():
            u, v, w = (np.concatenate(c) for c in zip(*held, strict=True))
            pair = pair_hash(v, w)
            order, at = _groups(joined(pair, u, 31))
            first, n = order[at], np.diff(np.append(at, len(u)))
            u, v, w, pair = u[first], v[first], w[first], pair[first]
            shard = shard_of(v, np.isin(v, frequent), pair, shards)
            yield from _send(shard, v, u, w, n, order=_by_shard(shard, v, u, shards), steps=2)

        for batch in batches:
            all_texts = batch.column("text")
            for s in _batches_of(all_texts, 1 << 21):
                split = split_words(all_texts[s])
                sequence, n = padded(split, known.numbers(split), end, start)
                at = windows(sequence, n)
                held.append((sequence[at - 2], sequence[at - 1], sequence[at]))
                count += len(at)
                if count > HELD_TOKENS:
                    yield from send()
                    held.clear()
                    count = 0
        if held:
            yield from send()

    # Rows of kind 0 and 1 are pieces of statistics for a word shard, of kind 2 pieces of wide contexts for a shard; kind -1 names the files of a shard.
    told = "shard int, kind int, packed binary, n int, files string"

    def write_triples(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        v, u, w, counts = (x.astype(np.int64) for x in _gathered(pdf, 4, 2))
        context = pair_hash(u, v)
        keys = triple_hash(context, w)
        order, at = _groups(keys)
        counts, keep = np.add.reduceat(counts[order], at), order[at]
        keys, u, v, w, context = keys[keep], u[keep], v[keep], w[keep], context[keep]
        rows, files = [], {}

        def piece(kind: int, target: np.ndarray, *columns: np.ndarray):
            for batch in _send(target, *columns):
                rows.extend((s, kind, p, n, None) for s, p, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))

        # contexts that end in a frequent word are spread over the shards
        wide = np.isin(v, frequent)
        order, at = _groups(context)
        stats = [np.add.reduceat(x[order], at) for x in _by_count(counts, counts)]
        first, followers = order[at], np.diff(np.append(at, len(order)))
        one = (followers == 1) & ~wide[first] & (counts[first] < MANY)
        own, far = np.flatnonzero(~wide[first] & telling(stats, least)), np.flatnonzero(wide[first])
        many = own[~one[own]]
        row = np.zeros(len(first), np.int64)
        row[many] = np.arange(len(many))
        files["contexts"] = _store(path, "contexts", shard, [context[first][own], np.where(one, follower_mark(w[first]), row)[own], np.where(one, counts[first], MANY)[own]], ["<u8", "<u4", "<u1"])
        files["branches"] = _store(path, "branches", shard, [x[many] for x in stats])
        alone = np.zeros(len(keys), bool)
        alone[first[one]] = True
        often = np.flatnonzero((counts >= least) & ~alone)
        files["triples"] = _store_keyed(path, "triples", shard, keys[often], [counts[often]])
        far = far[np.argsort(context[first][far], kind="stable")]
        piece(2, shard_of(v[first][far], np.ones(len(far), bool), context[first][far], shards), context[first][far], *[x[far] for x in stats])
        # pairs by the number of different words before them
        pair = pair_hash(v, w)
        order, at = _groups(pair)
        before, v, w = np.diff(np.r_[at, len(pair)]), v[order[at]], w[order[at]]
        files["pairs"] = _store_keyed(path, "pairs", shard, pair[order[at]], [before])
        order, at = _groups(v)
        stats = [np.add.reduceat(x[order], at) for x in _by_count(before, before)]
        piece(0, np.searchsorted(base, v[order[at]], "right") - 1, v[order[at]], *stats)
        follows, times = np.unique(w, return_counts=True)
        piece(1, np.searchsorted(base, follows, "right") - 1, follows, times)
        seen = [np.bincount(np.minimum(x, 5), minlength=6).tolist() for x in (counts, before)]
        rows.append((shard, -1, b"", 0, json.dumps([files, seen])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in told.split(", ")])

    found = cut(texts.mapInArrow(count_triples, PACKED).groupBy("shard").applyInPandas(write_triples, told), "lm-triples")
    named = {r["shard"]: json.loads(r["files"]) for r in found.filter("kind = -1").select("shard", "files").collect()}  # one short row a shard
    model.files = {what: {s: x[0][what] for s, x in named.items()} for what in ("triples", "contexts", "branches", "pairs")}
    high, middle = ({i: sum(x[1][k][i] for x in named.values()) for i in range(1, 5)} for k in (0, 1))

    def write_wide(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, *stats = _gathered(pdf, 5)
        order, at = _groups(keys)
        stats = [np.add.reduceat(x[order].astype(np.int64), at) for x in stats]
        some = telling(stats, least)
        stored = _store_keyed(path, "wide", shard, keys[order[at]][some], [x[some] for x in stats])
        return pd.DataFrame({"shard": [shard], "files": [json.dumps(stored)]})

    wide = found.filter("kind = 2").select("shard", "packed", "n").groupBy("shard").applyInPandas(write_wide, "shard int, files string")
    model.files["wide"] = {r["shard"]: json.loads(r["files"]) for r in cut(wide, "lm-wide").collect()}  # one short row a shard

    def write_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        lo, n = (start, 1) if shard == shards else (int(base[shard]), words[shard][1])  # the start has a shard of its own
        context, follows = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
        for kind, packed, k in zip(pdf["kind"], pdf["packed"], pdf["n"], strict=True):
            ids, *values = (x.astype(np.int64) for x in _unpack(packed, k, 5 - 3 * kind))
            if kind == 0:
                context[:, ids - lo] += np.stack(values)  # a piece names a word once
            else:
                follows[ids - lo] += values[0]
        stored = _store(path, "stats", shard, [*context, follows])
        some = np.bincount(np.minimum(follows, 5), minlength=6)
        return pd.DataFrame({"shard": [shard], "file": [json.dumps(stored)], "total": [int(follows.sum())], "ones": [some.tolist()]})

    stats = found.filter("kind in (0, 1)").select("shard", "kind", "packed", "n").groupBy("shard").applyInPandas(write_stats, "shard int, file string, total long, ones array<long>")
    stats = {r["shard"]: r for r in cut(stats, "lm-stats").collect()}  # one short row a shard
    model.stats = [json.loads(stats[s]["file"]) if s in stats else None for s in range(shards + 1)]
    model.follows = sum(r["total"] for r in stats.values())
    seen = {i: sum(r["ones"][i] for r in stats.values()) for i in range(1, 6)}
    model.discounts = [discounts(seen), discounts(middle), discounts(high) if least == 1 else (1.0, *discounts(high)[1:])]
    model.low_seen = (seen[1], seen[2], sum(seen[i] for i in range(3, 6)))
    return model


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


class Scorer:
    """A model opened in a task.  Words at hand are known by slots of small arrays; slot 0 is the start, 1 the end."""

    def __init__(self, model: Model):
        self.m, self.words = model, _opened(model.path, model.words)
        sizes = [*(n for _, n in model.words), 1]
        self.base = np.cumsum([0, *sizes])
        self.stats = [stored and _file(model.path, *stored).columns for stored in model.stats]

    def _load(self, numbers: np.ndarray) -> None:
        """Slots for words of these numbers (-1: unknown): number, low-order share, log10 base, count > 0, context sum and spare, frequent."""
        m, n = self.m, len(numbers)
        stats, counts = np.zeros((5, n), np.int64), np.zeros(n, np.int64)
        order = np.argsort(numbers, kind="stable")
        order = order[numbers[order] >= 0]
        where = np.searchsorted(self.base, numbers[order], "right") - 1
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(where)) + 1):
            if len(part):
                s, at = int(where[part[0]]), numbers[order[part]] - self.base[where[part[0]]]
                for i, c in enumerate(self.stats[s] or ()):
                    stats[i, order[part]] = c[at]
                if s < m.shards:
                    counts[order[part]] = self.words.counts[s][at]
        # single words by the number of different words before them, down to a uniform share for unknown words
        spare = np.dot(m.discounts[0], m.low_seen) / m.follows if m.follows else 1.0
        low = _discounted(stats[4], m.discounts[0]) / max(m.follows, 1) + spare / (m.types + 1)
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        self.arrays = [numbers, low, base, counts > 0, stats[0], np.array(m.discounts[1]) @ stats[1:4], np.isin(numbers, m.frequent)]

    def slots(self, texts: pa.Array | list[list[bytes]]) -> np.ndarray:
        """Slots of the words of the texts, one after another, which stand until other texts come."""
        hashes, codes = coded(texts)
        self._load(np.concatenate([[self.m.start, self.m.end], self.words.find(hashes)]))
        return codes + 2

    def _found(self, what: str, columns: int, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Columns x keys of the files of the shards, zero where a key is not held."""
        out = np.zeros((columns, len(keys)), np.int64)
        for part in _parts(shard):
            if stored := self.m.files[what].get(int(shard[part[0]])):
                some = np.zeros((columns, len(part)), np.int64)
                _file(self.m.path, *stored).find(keys[part], some)
                out[:, part] = some
        return out

    def _contexts(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Statistics of contexts, and what is kept of an only follower's number (-1 elsewhere)."""
        word, times = self._found("contexts", 2, keys, shard)
        stats, one = np.zeros((4, len(keys)), np.int64), np.flatnonzero((times > 0) & (times < MANY))
        stats[0, one], stats[np.minimum(times[one], 3), one] = times[one], 1
        many = np.flatnonzero(times == MANY)
        for part in _parts(shard[many]):
            at = many[part]
            for i, c in enumerate(_file(self.m.path, *self.m.files["branches"][int(shard[at[0]])]).columns):
                stats[i, at] = c[word[at]]
        return stats, np.where((times > 0) & (times < MANY), word, -1)

    def probabilities(self, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at these places of a sequence of slots, each after the two before it."""
        m = self.m
        number, low, _, _, total, spare, frequent = self.arrays
        # every two neighbours once: as a context they are followed by a token, as a pair their second is the token
        first, second = sequence[:-1], sequence[1:]
        keys = pair_hash(number[first], number[second])
        order, same = _groups(keys)
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(np.arange(len(same)), np.diff(np.append(same, len(keys))))
        place = order[same]
        keys, first, second = keys[place], first[place], second[place]
        real = (number[first] >= 0) & (number[second] >= 0)
        before, context, mark = np.zeros((1, len(keys)), np.int64), np.zeros((4, len(keys)), np.int64), np.full(len(keys), -1)

        def shards(some: np.ndarray, middle: np.ndarray) -> np.ndarray:
            return shard_of(number[middle[some]], frequent[middle[some]], keys[some], m.shards)

        some = np.flatnonzero(real)
        before[0, some] = self._found("pairs", 1, keys[some], shards(some, first))[0]
        some = np.flatnonzero(real & frequent[second])
        context[:, some] = self._found("wide", 4, keys[some], shards(some, second))
        some = np.flatnonzero(real & ~frequent[second])
        context[:, some], mark[some] = self._contexts(keys[some], shards(some, second))
        pair, two = back[at - 1], back[at - 2]
        v, w = sequence[at - 1], sequence[at]
        p = low[w]
        some = total[v] > 0
        p = np.where(some, (_discounted(before[0][pair], m.discounts[1]) + spare[v] * p) / np.where(some, total[v], 1), p)
        seen, only = context[0][two] > 0, mark[two]
        counts = np.where(only == follower_mark(number[w]), context[0][two], 0)
        ask = np.flatnonzero(seen & (only < 0) & (before[0][pair] > 0))
        counts[ask] = self._found("triples", 1, triple_hash(keys[two[ask]], number[w[ask]]), shard_of(number[v[ask]], frequent[v[ask]], keys[pair[ask]], m.shards))[0]
        left = np.array(m.discounts[2]) @ context[1:][:, two]
        return np.where(seen, (_discounted(counts, m.discounts[2]) + left * p) / np.where(seen, context[0][two], 1), p)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        split = split_words(texts)
        sequence, n = padded(split, self.slots(split), 1, 0)
        at = windows(sequence, n)
        p, starts, w = self.probabilities(sequence, at), np.cumsum(n) - n, sequence[at]
        sums = {"n_known": self.arrays[3][w].astype(np.int64), "base_score": self.arrays[2][w], "score": np.log10(p)}
        return {"n_tokens": n, **{k: np.add.reduceat(x, starts) for k, x in sums.items()}}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Null and empty texts are an end alone; null ids and repeated rows are scored like any other; further columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(model)
            texts, ids = batch.column("text"), batch.column("doc_id")
            for s in _batches_of(texts, 6 * SCORED):
                out = scorer.score(texts[s])
                k = len(out["score"])
                yield pa.RecordBatch.from_arrays([ids.slice(s.start, k), pa.array(out["n_tokens"]), pa.array(out["n_known"]), pa.array(np.full(k, model.tokens, np.int64)), pa.array(out["base_score"]), pa.array(out["score"])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_kneser_ney(spark, sf_dir):
    """Log probabilities of all documents by a model of those outside the fold; see ``train`` and ``score`` for nulls, empty and long texts."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 5 == 1
    model = train(docs.filter(~held_out), least=1)
    return score(docs, model).withColumn("held_out", held_out)
