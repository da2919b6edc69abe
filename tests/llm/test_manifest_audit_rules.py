"""Manifest, divergence audit and quality rules against plain Python, plain SQL and numpy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from scenespark.llm import divergence, merkle, outliers

NAMES = "leaf changed root places others _all term n docs p q value rank pool words lines kept distance n_words".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
WORDS = "the and of River stone Light under green window paper seven clear morning hollow".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, int(n))) + "." for n in rng.integers(1, 120, 150)]
    texts += [None, "", "   \n\t", "a", "12 34", "Word " * 30_000, "x" * 70_000, texts[0], texts[0], texts[1], "É ü\u0085  漢字 " * 20, "one\ntwo\none\n \none\n", "a_b-c D'e\x00f"]
    out = [(i, t, ("en", "de", None)[i % 3], (None, "b", "a", "ä")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, "No id", "en", "a", 5), (None, "No id", "en", "a", 5), (3, texts[3], "en", "b", None), (4, "Another text of an id used twice", "en", "b", 1), (77, "A lone language", "zz", "s", 1), (78, None, "", "", 1)]
    return [r + ("extra",) * len(NAMES) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _leaf(r, text):
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text))


def _tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % fanout
            paths[i].append((p % fanout, nodes[run:p] + nodes[p + 1 : run + fanout]))
            at[i] = p // fanout
        nodes = [_hash(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def _manifest(rows, fanout=8):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([leaf for *_, leaf, _ in sorted(by_lang[x], key=lambda z: z[:3])], fanout) for x in langs}
    root, above = _tree([trees[x][0] for x in langs], fanout)
    for x, top in zip(langs, above, strict=True):
        for (*_, leaf, r), path in zip(sorted(by_lang[x], key=lambda z: z[:3]), trees[x][1], strict=True):
            node = _leaf(r, _lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            for place, others in path + top:
                node = _hash([*others[:place], node, *others[place:]])
            yield r[0], leaf, trees[x][0], root, _hash(h for _, others in path + top for h in others), node, node == root


def _digests(proved):
    folded = merkle.folded(F.coalesce("changed", "leaf"), F.col("places"), F.col("others"))
    return [tuple(r) for r in proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("others", "").cast("binary"), 256), folded, folded == F.col("root")).collect()]


def _leaves(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", "lang", merkle.document_leaf(F.col("text")).alias("leaf"), F.when(tampered, merkle.document_leaf(low)).alias("changed"))


def test_manifest_equals_a_plain_tree(spark, docs, rows):
    want = sorted(_manifest(rows), key=str)
    assert sorted(_digests(merkle.manifest(_leaves(docs), ["doc_id"])), key=str) == want
    assert 0 < sum(not w[-1] for w in want) < len(want) / 2
    assert merkle.manifest(_leaves(docs.limit(0)), ["doc_id"]).count() == 0


def test_manifest_over_many_rounds_and_ragged_ends(spark):
    sizes = {"a": 1, "b": 2, "c": 37, "d": 61, None: 9}
    rows = [(1000 * i + k, f"T{k}", x, "s", k) for i, (x, n) in enumerate(sizes.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    for fanout, depth in ((2, 1), (3, 1), (2, 2)):
        assert sorted(_digests(merkle.manifest(_leaves(docs), ["doc_id"], fanout, depth)), key=str) == sorted(_manifest(rows, fanout), key=str)
    alone = docs.filter("lang = 'a'")
    got = _digests(merkle.manifest(_leaves(alone), ["doc_id"]))
    assert got == list(_manifest([r for r in rows if r[2] == "a"])) and got[0][1] == got[0][2] == got[0][3]


def _plain_terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or ""))


def test_audit_equals_sql_and_plain_counts(spark, docs, rows, monkeypatch):
    documents = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    con = duckdb.connect()
    con.register("documents", documents)
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.execute(divergence.ORACLE).fetchall())
    for held, shard, cells in ((400_000, 50_000, 1 << 20), (20, 10, 8)):
        monkeypatch.setattr(divergence, "HELD_TERMS", held)
        monkeypatch.setattr(divergence, "SHARD_ROWS", shard)
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert sorted(tuple(r) for r in divergence.audit(docs).select(*names).collect()) == want
    assert {w[2] for w in want} == {"pair", "term"} and ("zz", "s") not in {w[:2] for w in want}  # one source, no other to compare with
    counts = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(docs).collect() if r.term}
    plain, seen = Counter(), Counter()
    for r in rows:
        own = Counter(_plain_terms(r[1]))
        plain.update({(r[2] or "", r[3] or "", t): n for t, n in own.items()})
        seen.update((r[2] or "", r[3] or "", t) for t in own)
    assert counts == {k: (n, seen[k]) for k, n in plain.items()}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 3 * 10**15 + 7, 9 * 10**17 + 11, 10**9 + 1
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)), divergence.share(F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(got) == (1 + 10**9 * (n + 5) // (total + 5 * kept), None)


def _plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found, marked = Counter(windows), np.zeros(len(words) + 8, bool)
    for i, w in enumerate(windows):
        if found[w] > 1:
            marked[i : i + 8] = True
    repeated = int(marked.sum())
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, len(words) < 20 or 100 * repeated > 30 * len(words)


def test_statistics_of_whole_texts(spark, docs, rows):
    extra = ["a b c d e f g h i " * 2, "a b c d e f g h a b c d e f g h", "x " * 9, " ".join(map(str, range(40))) + " z " + " ".join(map(str, range(12, 30))), "# | <>\n# | <>\r\n\n\n"]
    more = spark.createDataFrame([(1000 + i, t, "en", "a", 0) + ("extra",) * len(NAMES) for i, t in enumerate(extra)], SCHEMA)
    got = outliers.with_statistics(docs.unionByName(more)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(r[0], *_plain_statistics(r[1])) for r in rows] + [(1000 + i, *_plain_statistics(t)) for i, t in enumerate(extra)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert outliers.screen(docs.limit(0), steps=0).count() == 0
    few = outliers.screen(docs, least_rows=10**6, steps=0)  # too few documents to estimate anything
    assert few.filter("kept = base_failed or distance is not null").count() == 0
    plan = few._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _mcd(x, steps, near):
    """Plain concentration steps on one group."""
    p, floors = x.shape[1], np.array([(outliers.UNIT * f) ** 2 for _, f in outliers.VECTOR.values()])
    middle = lambda v: np.sort(v, axis=0)[-(-len(v) // 2) - 1]
    m = middle(x)
    cov = np.diag((1.4826 * middle(np.abs(x - m))) ** 2)
    distance = lambda m, cov: ((x - m) @ np.linalg.inv(cov + np.diag(floors)) * (x - m)).sum(axis=1)
    for step in range(steps + 1):
        d = distance(m, cov)
        if step < steps:
            b = np.floor(np.log2(d + 1e-6) * outliers.BUCKETS)
            inside, share = b <= np.sort(b)[math.ceil(outliers.PART * len(x)) - 1], outliers.PART
        else:
            inside, share = d <= outliers.chi_square_quantile(near, p), near
        part = x[inside]
        m = part.mean(axis=0)
        cov = (part.T @ part / len(part) - np.outer(m, m)) * share / outliers.chi_square(outliers.chi_square_quantile(share, p), p + 2)
    return distance(m, cov)


def test_distances_equal_plain_concentration_steps_and_junk_goes(spark):
    rng = np.random.default_rng(2)
    known = [a + b.lower() for a in WORDS for b in WORDS]
    prose = lambda n: ". ".join(" ".join(rng.choice(known, 12)) for _ in range(n))
    rows, junk = [], set()
    for i in range(900):
        text = prose(int(rng.integers(4, 30)))
        if i % 15 == 0:
            junk.add(i)
            text = re.sub(r"(\w+)", r"\1###", text) if i % 2 else " ".join(w + " " + w for w in text.split())
        rows.append((i, text, (None, "en")[i % 2], ("a", "a", "a", None)[(i // 2) % 4]))
    rows += [(10_000 + i, prose(6), "xx", f"s{i}") for i in range(70)]  # sources too small for an estimate of their own
    rows += [(20_000, prose(6), "yy", "s")]  # a language too small
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = outliers.screen(docs).toPandas().set_index("doc_id")
    assert {i for i in got.index if not got.kept[i]} == junk
    rates = [got.word_chars / got.n_words, got.n_symbols / got.word_chars, got.n_capitals / got.word_chars, got.n_digits / got.word_chars, got.n_marks / got.n_words, got.n_twice / got.n_words, got.n_repeat_words / got.n_words, got.n_dup_lines / got.n_lines]
    x = np.column_stack([np.log(rates[0]), *map(np.sqrt, rates[1:])])
    x = np.floor(np.abs(x) * 1000 + 0.5) * np.sign(x)
    for lang, sources in ((None, ("a", None)), ("en", ("a", None)), ("xx", ("*",))):
        for source in sources:
            pick = (got.lang.isna() if lang is None else got.lang == lang) & (True if source == "*" else got.source.isna() if source is None else got.source == source) & ~got.base_failed
            assert pick.sum() >= 50
            np.testing.assert_allclose(got.distance[pick], _mcd(x[pick.to_numpy()], outliers.STEPS, outliers.NEAR), rtol=1e-6)
    np.testing.assert_allclose(got.distance[20_000], _mcd(x[~got.base_failed.to_numpy()], outliers.STEPS, outliers.NEAR)[list(got.index[~got.base_failed]).index(20_000)], rtol=1e-6)


def test_chi_square():
    assert abs(outliers.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(outliers.chi_square_quantile(0.75, 8) - 10.2189) < 1e-3
