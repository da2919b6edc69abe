"""Language identification as inference of a mixture of languages.

Letter trigrams (with word borders) are counted per language over all training documents.  A document is
taken as a mixture: expectation-maximisation finds the share of each language from its trigram
likelihoods; then sets of one, two, ... of its strongest languages are fitted and the set with the best
likelihood less a penalty for each further language is chosen.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, table

BUCKETS, SMOOTHING = 1 << 15, 0.05
STEPS, CHUNK_CHARS = 6, 1 << 20
#: Log-likelihood a further language must add, as a multiple of the log of the number of trigrams.
PENALTY = 4.0
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter of the texts, and where each text's begin and end."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    codes = np.frombuffer(("\n" + joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    centre = letter[1:-1]
    before = np.concatenate([[0], np.cumsum(centre)])
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    ends = np.minimum(ends, len(centre))
    return (mixed % np.uint32(BUCKETS)).astype(np.int32)[centre], np.stack([before[starts], before[ends]], axis=1)


def chunks(texts: list[str]):
    """Slices of the list with a bounded number of characters unless one text is longer."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK_CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if texts:
        yield slice(at, len(texts))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs(text, lang) -> languages in order and log p(trigram | language), counted over all rows.

    The driver gets a count for each language and trigram bucket at most.  Null texts or languages are left out.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for s in chunks(texts):
                grams, spans = trigrams(texts[s])
                for (a, b), lang in zip(spans.tolist(), langs[s], strict=True):
                    if lang not in counts:
                        counts[lang] = np.zeros(BUCKETS, np.int64)
                    counts[lang] += np.bincount(grams[a:b], minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "gram", "n"])

    rows = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram int, n long")
    rows = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["gram"].to_numpy(int), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = rows["n"].to_numpy()
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)


def _mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, total: np.ndarray, share: np.ndarray, steps: int):
    """EM from ``share`` (documents x languages); p: likelihoods of each trigram relative to its best language."""
    for _ in range(steps):
        joint = p * share[owner]
        weight = n / np.maximum(joint.sum(1), 1e-30)
        share = np.add.reduceat(joint * weight[:, None], starts, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log(np.maximum((p * share[owner]).sum(1), 1e-30)), starts)


def infer(grams: np.ndarray, spans: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language (-1: no letter) and its share of the chosen mixture, for each text."""
    k, found = logp.shape[1], np.full(len(spans), -1)
    sure = np.zeros(len(spans))
    have = np.flatnonzero(spans[:, 1] > spans[:, 0])
    if not len(have) or not k:
        return found, sure
    kinds, counts = [], []
    for a, b in spans[have].tolist():
        c = np.bincount(grams[a:b], minlength=BUCKETS)
        at = np.flatnonzero(c)
        kinds.append(at)
        counts.append(c[at])
    sizes = np.array([len(x) for x in kinds])
    kinds, counts = np.concatenate(kinds), np.concatenate(counts).astype(np.float32)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(have)), sizes)
    log = logp[kinds]
    best = log.max(1, keepdims=True)
    p, total = np.exp(log - best), np.add.reduceat(counts, starts)
    single = np.add.reduceat((log - best) * counts[:, None], starts, axis=0).astype(float)
    share, _ = _mixture(p, counts, starts, owner, total, np.full((len(have), k), 1 / k, np.float32), STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    # one language
    choice = np.zeros((len(have), k))
    choice[np.arange(len(have)), single.argmax(1)] = 1
    value = single.max(1)
    # more languages, for as long as the next one pays
    going = np.flatnonzero(np.sort(share, axis=1)[:, -2] > 0.02) if k > 1 else np.zeros(0, int)
    for m in range(2, k + 1):
        if not len(going):
            break
        rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in going])
        s = np.cumsum(sizes[going]) - sizes[going]
        start = np.zeros((len(going), k), np.float32)
        np.put_along_axis(start, order[going, :m], np.take_along_axis(share[going], order[going, :m], 1), 1)
        start = np.maximum(start / start.sum(1, keepdims=True), np.where(start > 0, 1e-4, 0)).astype(np.float32)
        fit, like = _mixture(p[rows], counts[rows], s, np.repeat(np.arange(len(going)), sizes[going]), total[going], start, 2 * STEPS)
        like = like - PENALTY * (m - 1) * np.log(total[going] + 1)
        better = like > value[going]
        choice[going[better]], value[going[better]] = fit[better], like[better]
        going = going[better]
    rest = np.exp(np.clip(single - single.max(1, keepdims=True), -50, 0))
    alone = rest / rest.sum(1, keepdims=True)
    found[have] = choice.argmax(1)
    sure[have] = np.where((choice > 0).sum(1) == 1, alone[np.arange(len(have)), choice.argmax(1)], choice.max(1))
    return found, np.clip(sure, 0, 1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs(text, ...) -> docs with lang_pred and score (share of the language in the chosen mixture, or its posterior if alone).

    Null texts and texts without a letter (or a model of no language) give ``und`` and score 0.  Texts are
    read whole; further columns are kept, and columns named like the new ones are replaced.
    """
    langs, logp = model
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, logp))  # languages x 32768 floats

    def run(batches):
        langs, logp = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred, sure = [], []
            for s in chunks(texts):
                best, share = infer(*trigrams(texts[s]), logp)
                pred += [langs[b] if b >= 0 else UNDETERMINED for b in best]
                sure += share.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)


def held_out(fold: int = 2):
    return id_crc(F.col("doc_id")) % 4 == fold


def op7_language(spark, sf_dir):
    """Language of every document by a model of those outside the fold; see ``train`` and ``identify`` for nulls, long texts and empty tables."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("text", "lang"))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
