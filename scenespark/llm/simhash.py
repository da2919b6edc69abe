"""SimHash near-duplicate groups with pivot distance tables.

Distinct fingerprints are dealt into buckets by several keys.  For small radii a key is a fixed choice of bits, and
linked fingerprints surely share a bucket (64 bits and radius 4, by the pigeonhole principle: they agree in two of six
blocks).  At a radius of a fifth of the bits every such choice is either too coarse or misses links, so there the keys
are bands of minima of the texts' shingle hashes, which unrelated texts do not share however many there are.  In a bucket no pair is compared at once.  Every fingerprint has a row in a table of
its Hamming distances to reference fingerprints; fingerprints are sorted by the first distance, a pair is
discarded when any coordinate differs by more than the radius (triangle inequality), and only survivors
are verified bit by bit.  A bucket gives the edges of a few small trees, not its pairs; buckets above a
size are cut into chunks and every two chunks meet in a task of their own.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table, words_of
from .components import connected_components
from .token_files import _mix

#: Bits of a fingerprint of a set of shingles, bands of minima and minima in a band.
LANES, BANDS, MINIMA = 4, 16, 4
#: Words a task remembers.
REMEMBERED = 60_000
#: Reference fingerprints of a pivot table, and rows of a bucket that one task takes at most twice of.
PIVOTS, CHUNK = 24, 2048
#: Links that one task thins out to a forest, and rows of a bucket beyond which keys are lengthened.
EDGES, BUCKET_ROWS = 500_000, 16
_WORDS_PER_STEP = 1 << 15


def simhash(text: str | None, ngram: int) -> int:
    """Fingerprint of the list of a text's shingles: a bit is 1 if more than half of the hashes set it.  No words: zero."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - ngram + 1)
    lo, hi = starts[:n].tolist(), ends[min(ngram, len(words)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _WORDS_PER_STEP):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at : at + _WORDS_PER_STEP], hi[at : at + _WORDS_PER_STEP], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ngram: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp0 long (bit pattern)."""

    def run(batches):
        for batch in batches:
            # copies that lie together are hashed once
            texts = batch.column("text").to_pylist()
            known = {t: simhash(t, ngram) for t in dict.fromkeys(texts)}
            values = np.array([known[t] for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp0"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp0 long")


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles of ``ngram`` words; a shorter text is one shingle, no words none."""

    def __init__(self, ngram: int):
        self.ngram, self.known = ngram, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w, 42)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.ngram, len(words))
        out = np.full(len(words) - k + 1 if k else 0, k, np.uint64)
        for i in range(k):
            out = _mix(out, i) ^ hashes[i : i + len(out)]
        return np.unique(_mix(out, k))


def multipliers(count: int) -> np.ndarray:
    rng = random.Random(23)
    return np.array([rng.getrandbits(64) | 1 for _ in range(count)], np.uint64)


_MULTIPLIERS = multipliers(BANDS * MINIMA)


def set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """LANES words of a set's fingerprint, then BANDS keys; no shingles: zeros."""
    out = np.zeros(LANES + BANDS, np.uint64)
    n = len(shingles)
    if n:
        votes, least = np.zeros(64 * LANES, np.int64), np.full(BANDS * MINIMA, 2**64 - 1, np.uint64)
        for at in range(0, n, 512):
            some = shingles[at : at + 512]
            words = np.stack([_mix(some, 50 + lane) for lane in range(LANES)], axis=1)
            votes += np.unpackbits(words.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
            least = np.minimum(least, (some[:, None] * _MULTIPLIERS[None, :]).min(0))
        out[:LANES] = np.packbits(votes * 2 > n, bitorder="little").view("<u8")
        keys = np.arange(BANDS, dtype=np.uint64)
        for minimum in least.reshape(BANDS, MINIMA).T:
            keys = _mix(keys ^ minimum, 3)
        out[LANES:] = keys
    return out


def set_fingerprints(docs: DataFrame, ngram: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp0 .. of the set of shingles, keys array<long>."""
    names = [f"fp{k}" for k in range(LANES)]

    def run(batches):
        shingles = Shingles(ngram)
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, len(whole), 512)):
                texts = batch.column("text").to_pylist()
                known = {t: set_fingerprint(shingles(t)) for t in dict.fromkeys(texts)}
                values = np.array([known[t] for t in texts], np.uint64).reshape(-1, LANES + BANDS).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(values[:, LANES:].ravel()))
                columns = [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(LANES)), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>")


def block_masks(blocks: int = 6, agree: int = 2, bits: int = 64) -> list[list[int]]:
    """Bit choices that any two fingerprints within ``blocks - agree`` bits share one of."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [list(range(a, b)) for a, b in itertools.pairwise(edges)]
    return [sorted(sum(x, [])) for x in itertools.combinations(parts, agree)]


def masks_for(rows: int, bits: int, radius: int) -> list[list[int]]:
    """Bit choices that find every pair: keys lengthen with the number of rows, so that buckets stay small."""
    for agree in (2, 3, 4):
        if rows >> agree * bits // (radius + agree) <= BUCKET_ROWS:
            break
    return block_masks(radius + agree, agree, bits)


def pivots(bits: int, count: int = PIVOTS) -> np.ndarray:
    rng = random.Random(11)
    return np.array([[rng.getrandbits(64) for _ in range(bits // 64)] for _ in range(count)], np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def bucket_trees(group: np.ndarray, fps: np.ndarray, reference: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by group) -> index pairs that join the same rows as all links inside the groups, of small degree."""
    n = len(group)
    tables = np.stack([hamming(fps, p) for p in reference], axis=1).astype(np.int16) if n else np.zeros((0, len(reference)), np.int16)
    order = np.lexsort((tables[:, 0], group))
    group, fps, tables = group[order], fps[order], tables[order]
    parent, live = np.arange(n), np.arange(n)
    for step in range(1, n):
        live = live[live + step < n]
        other = live + step
        live = live[(group[live] == group[other]) & (tables[other, 0] - tables[live, 0] <= radius)]
        if not len(live):
            break
        a, b = live, live + step
        keep = parent[a] != parent[b]  # joined already
        a, b = a[keep], b[keep]
        for lo in range(1, len(reference), 8):
            keep = np.abs(tables[a, lo : lo + 8] - tables[b, lo : lo + 8]).max(axis=1, initial=0) <= radius
            a, b = a[keep], b[keep]
        keep = hamming(fps[a], fps[b]) <= radius
        parent = _joined(parent, a[keep], b[keep])
    child, above = _trees(parent)
    return order[child], order[above]


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links (a, b)."""
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _roots(parent)
        keep = parent[a] != parent[b]
        a, b = a[keep], b[keep]
    return parent


def _trees(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, above) edges of a tree of four branches over each root's members."""
    n = len(parent)
    members = np.lexsort((np.arange(n), parent))
    own = parent[members]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.zeros(0, int)
    rank = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    child = np.flatnonzero(rank > 0)
    above = child - rank[child] + (rank[child] - 1) // 4
    return members[child], members[above]


def forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) -> fewer links with the same components: each task keeps a forest of the EDGES it reads at most."""
    tasks = max(1, -(-edges.count() // EDGES))

    def run(batches):
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            nodes, place = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
            half = len(place) // 2
            child, above = _trees(_joined(np.arange(len(nodes)), place[:half], place[half:]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[above])], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def bit_keys(names: list[str], masks: list[list[int]]) -> Column:
    """array<long>: a hash of each choice of bits."""

    def key(mask):
        words = []
        for k, name in enumerate(names):
            m = sum(1 << (b - 64 * k) for b in mask if 64 * k <= b < 64 * k + 64)
            if m:
                words.append(F.col(name).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
        return F.xxhash64(*words)

    return F.array(*map(key, masks))


def links(fps: DataFrame, lanes: int, radius: int) -> DataFrame:
    """fps(node long, fp0.., keys array<long>) distinct fingerprints -> links (a, b) with the components of all pairs within ``radius`` bits that share a key."""
    names, bits = [f"fp{k}" for k in range(lanes)], 64 * lanes
    reference = pivots(bits)
    keyed = fps.select("node", *names, F.posexplode("keys").alias("t", "k"))
    # A bucket's size is needed only where it is too large for one task.
    large = keyed.groupBy("t", "k").count().filter(F.col("count") > CHUNK)
    large = cut(large.select("t", "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large-buckets")
    if large.limit(1).count():
        keyed = keyed.join(large, ["t", "k"], "left")
        mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, mine).alias("i"), F.greatest(c, mine).alias("j")))
        keyed = keyed.withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)))
        keyed = keyed.select("node", *names, F.xxhash64("t", "k", "pair.i", "pair.j").alias("bucket"))
    else:
        keyed = keyed.select("node", *names, F.xxhash64("t", "k").alias("bucket"))
    spread = keyed.repartition("bucket").sortWithinPartitions("bucket")

    def whole_groups(batches):
        """Arrow batches cut at group borders, of bounded size unless one group is larger."""
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows < 1 << 16:
                continue
            t = pa.concat_tables(held)
            b = t.column("bucket").to_numpy()
            at = int(np.searchsorted(b, b[-1]))
            if at:
                yield t.slice(0, at)
            held, rows = [t.slice(at)], len(b) - at
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        for t in whole_groups(batches):
            b = t.column("bucket").to_numpy()
            group = np.cumsum(np.r_[0, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
            alone = np.bincount(group, minlength=1)[group] == 1 if len(b) else np.zeros(0, bool)
            rows = np.flatnonzero(~alone)
            fp = np.stack([t.column(n).to_numpy().view(np.uint64) for n in names], axis=1)[rows]
            node = t.column("node").to_numpy()[rows]
            x, y = bucket_trees(group[rows], fp, reference, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 5, radius: int = 4, masks: list[list[int]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp0, component_id (smallest doc_id reachable over links).

    A text is the list of its shingles, repeats included.  Two fingerprints of 64 bits link when at most
    ``radius`` of their bits differ; no link is lost.  Null and empty texts have fingerprint zero and are a group;
    long texts are read whole.  Rows with a null id get a fingerprint but no component and link nothing; rows
    that share an id share its component; equal rows give equal rows.  Further columns are ignored.  An empty
    table gives an empty result.
    """
    found = cut(fingerprints(docs, ngram), "simhash")
    nodes = cut(found.filter("doc_id is not null").groupBy("fp0").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    masks = masks_for(nodes.count(), 64, radius) if masks is None else masks
    return grouped(found, nodes.withColumn("keys", bit_keys(["fp0"], masks)), 1, radius)


def near_duplicate_sets(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp0 .. fp3, component_id (smallest doc_id reachable over links).

    A text is the set of its shingles.  Two fingerprints of 256 bits link when the share of equal bits is at
    least ``similarity``; by the angle that SimHash estimates, 0.8 is a cosine of the sets of 0.81.  Candidates
    share one of BANDS keys of MINIMA minima, which a pair of Jaccard similarity j does with probability
    1 - (1 - j^MINIMA)^BANDS: 0.9998 at 0.8, 0.987 at 0.7.  Nulls, empty and long texts, repeated rows, further
    columns and empty tables as in ``near_duplicates``.
    """
    found = cut(set_fingerprints(docs, ngram), "simhash")
    names = [f"fp{k}" for k in range(LANES)]
    nodes = found.filter("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"))
    return grouped(found.drop("keys"), cut(nodes, "simhash-nodes"), LANES, int(64 * LANES * (1 - similarity) + 1e-9))


def grouped(found: DataFrame, nodes: DataFrame, lanes: int, radius: int) -> DataFrame:
    """found(doc_id, fp..) with component_id, from the links between nodes(node, fp.., keys)."""
    names = [f"fp{k}" for k in range(lanes)]
    ids = found.filter("doc_id is not null")
    edges = forest(cut(links(nodes, lanes, radius), "simhash-links"))
    # an id with several texts is one document
    several = ids.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("lo"), F.max(F.struct(*names)).alias("hi")).filter("lo <> hi").select("doc_id")
    across = ids.join(several, "doc_id").join(nodes.select("node", *names), names).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = connected_components(edges.union(across))
    labels = nodes.select("node", *names).join(groups, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    out = found.join(cut(labels, "simhash-labels"), names, "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def op3_simhash(spark, sf_dir):
    """SimHash groups of all documents; see ``near_duplicates`` for nulls, long texts, repeated rows and empty tables."""
    out = near_duplicates(table(spark, sf_dir, "documents"), ngram=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
