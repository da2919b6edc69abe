"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on a bounded sample of labelled rows and flattened into arrays, which
tasks walk for all rows and trees at once.  Every document is scored on its whole text.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, quoted, table

#: At most so many labelled rows (those with the lowest id hash) are used to fit.
LABEL_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE = 80, 4, 0.15, 64, 10, 1.0

FEATURES = (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "space", "other_ascii", "high_bytes", "pipes", "bangs", "stops",
    "marks", "distinct_words", "top_word", "same_as_before", "two_before", "lines", "line_length", "distinct_lines", "compressed", "entropy", "marked_words", "capital_words",
)
_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = _UPPER | _DIGIT
_ALNUM[97:123] = True


def statistics(text: str | None) -> list[float]:
    """The features of a text; all 0 for an empty or null one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), text.split(), text.split("\n")
    w = len(words)
    share = count / n
    known = Counter(words)
    full = share[share > 0]
    return [
        np.log1p(n), np.log1p(w), n / (w + 1), max(map(len, words), default=0), share[_UPPER].sum(), share[_DIGIT].sum(), share[_SPACE].sum(),
        share[:128][~(_ALNUM | _SPACE)[:128]].sum(), share[128:].sum(), share[124], share[33], share[46],
        share[[35, 36, 37, 38, 42]].sum(), len(known) / (w + 1), max(known.values(), default=0) / (w + 1),
        sum(map(operator.eq, words, words[1:])) / (w + 1), sum(map(operator.eq, words, words[2:])) / (w + 1), np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / n, -(full * np.log2(full)).sum(), sum(not x[-1].isalnum() for x in words) / (w + 1), sum(x[0].isupper() for x in words) / (w + 1),
    ]


class Trees:
    """Boosted trees as arrays: (trees, nodes) feature, threshold and value; node i has children 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float, depth: int):
        self.feature, self.threshold, self.value, self.start, self.depth = feature, threshold, value, start, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not self.feature.size:
            return out
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, node]
                right = np.take_along_axis(rows, f, 1) > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[at : at + 4096] += self.value[trees, node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Logistic boosting on binned features.  With no rows or one class the score is constant."""
    n, k = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2 * inner + 1)), start, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2 * inner + 1))
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = node - first
            gain, cut_at, which = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
            for j in range(k):
                key = place * BINS + binned[:, j]
                g, h, c = (np.cumsum(np.bincount(key, w, width * BINS).reshape(width, BINS), axis=1) for w in (grad, hess, None))
                left, right = g[:, :-1], g[:, -1:] - g[:, :-1]
                hl, hr = h[:, :-1], h[:, -1:] - h[:, :-1]
                got = left**2 / (hl + RIDGE) + right**2 / (hr + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                got = np.where((c[:, :-1] >= LEAF_ROWS) & (c[:, -1:] - c[:, :-1] >= LEAF_ROWS), got, 0)
                b = got.argmax(1)
                top = got[np.arange(width), b]
                win = (top > gain + 1e-9) & (b < len(edges[j]))
                gain[win], cut_at[win], which[win] = top[win], b[win], j
            split = cut_at >= 0
            feature[t, first : first + width] = which
            threshold[t, first : first + width] = [edges[j][b] if s else np.inf for j, b, s in zip(which, cut_at, split, strict=True)]
            right = split[place] & (binned[np.arange(n), which[place]] > cut_at[place])
            node = 2 * node + 1 + right
        g, h = np.bincount(node, grad, 2 * inner + 1), np.bincount(node, hess, 2 * inner + 1)
        value[t] = rate * g / (h + RIDGE)
        value[t, :inner] = 0
        margin += value[t, node]
    return Trees(feature, threshold, value, start, depth)


SCHEMA = ", ".join(f"{f} double" for f in FEATURES)


def _features(batches, keep: list[str], extra):
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
        columns, names = extra(x)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns)], names=[*keep, *names])


def train(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> Trees:
    """docs(doc_id, text), labels(doc_id, quality 0/1) -> trees fitted on at most ``rows`` labelled documents.

    Labels that are null or other than 0 and 1, and ids without a document, are left out; equal ids count each.
    Without a label, or with one class alone, the trees give one score to all.
    """
    sample = labels.filter("quality in (0, 1) and doc_id is not null").orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(rows)
    # at most `rows` ids
    picked = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", F.col("quality").cast("double").alias("y"))), "doc_id").select("y", "text")
    data = picked.mapInArrow(lambda b: _features(b, ["y"], lambda x: (list(x.T), list(FEATURES))), f"y double, {SCHEMA}").toPandas()
    data = data.sort_values(list(data.columns)).to_numpy(float)
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """docs(text, ...) -> the columns ``keep`` and quality_score double in 0..1.

    Null and empty texts get a score too, long ones are read whole; repeated rows get the same score; a kept
    column named quality_score is replaced; an empty table gives an empty result.
    """
    keep = [c for c in keep if c != "quality_score"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keep)).schema] + ["quality_score double"])
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    held = docs.select(*map(quoted, keep), *(["text"] if "text" not in keep else []))
    return held.mapInArrow(lambda b: _features(b, keep, lambda x: ([shared.value.probability(x)], ["quality_score"])), schema)


def op4_quality(spark, sf_dir):
    """Quality of every document by trees fitted outside the fold; see ``train`` and ``score`` for nulls, long texts and empty tables."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out_of_fit = id_crc(F.col("doc_id")) % 4 == 2
    trees = train(docs, labels.filter(~out_of_fit))
    scored = score(docs.select("doc_id", out_of_fit.alias("held_out"), "text"), trees, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
