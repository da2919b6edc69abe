"""Trees walked one by one, and language mixtures fitted for every set of languages."""

import itertools

import numpy as np
import pandas as pd
from scenespark.llm import language, quality

SF = "/root/testdata/sf0.001"


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 6)).round(1)  # ties with thresholds
    y = (x[:, 0] + np.abs(x[:, 1]) + 0.3 * rng.normal(size=5000) > 1).astype(float)
    trees = quality.fit(x, y, trees=15, depth=3)

    def walk(row):
        total = trees.start
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node]
        return total

    np.testing.assert_allclose(trees.margin(x), [walk(r) for r in x], rtol=1e-12)
    assert ((trees.margin(x) > 0) == y).mean() > 0.9


def _mixture(p, counts, steps=400):
    """Plain expectation-maximisation for one text: shares and log-likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(steps):
        both = pi * p
        pi = (counts[:, None] * both / both.sum(1, keepdims=True)).sum(0) / counts.sum()
    return pi, float(counts @ np.log((pi * p).sum(1)))


def test_chosen_languages_equal_the_best_of_all_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, logp = language.train(docs)
    frame = docs.toPandas()
    by_lang = {x: [t[:1500] for t in frame.text[frame.lang == x] if len(t) > 400][:6] for x in langs}
    texts = [t for v in by_lang.values() for t in v]
    texts += [a + " " + b[: len(a) // 2] for x, z in itertools.combinations(langs, 2) for a, b in zip(by_lang[x][:2], by_lang[z][:2], strict=True)]
    grams, spans = language.trigrams(texts)
    found, sure = language.infer(grams, spans, logp)
    close = 0
    for i, (a, b) in enumerate(spans.tolist()):
        counts = pd.Series(grams[a:b]).value_counts()
        log = logp[counts.index.to_numpy()].astype(float)
        p, n = np.exp(log - log.max(1, keepdims=True)), counts.to_numpy().astype(float)
        best = (-np.inf, None, None)
        for m in range(1, len(langs) + 1):
            for chosen in itertools.combinations(range(len(langs)), m):
                pi, like = _mixture(p[:, chosen], n)
                value = like - language.PENALTY * (m - 1) * np.log(n.sum() + 1)
                best = max(best, (value, chosen, tuple(pi)))
        _, chosen, pi = best
        assert found[i] == chosen[int(np.argmax(pi))]
        close += abs(sure[i] - max(pi)) < 0.05 or len(chosen) == 1
    assert close >= 0.9 * len(texts) and len(texts) > 20
