"""How far the vocabulary of a source departs from other sources and from its language.

One translate table lowers letters and blanks everything else below 128 in a single pass over a text's bytes;
split and a Counter give the document's terms with their counts.  Tasks add the Counters of their documents up
by (language, source) and send sparse counts; Spark sums them, keeps the terms of enough documents and works
with integers from there on, so the result does not depend on how rows were dealt out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import BROADCAST_ROWS
from .common import cut, table

#: A term stays where so many documents of a language hold it; counts are raised by PRIOR; shares are in units of 1 / UNIT.
LEAST_DOCS, PRIOR, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Distinct terms a task holds before it sends their counts, (term, source) rows a task compares, cells it compares at once.
HELD_TERMS, SHARD_ROWS, CELLS = 400_000, 50_000, 1 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _batch(held: dict) -> pa.RecordBatch:
    """Counts of the groups, and for each group a row with an empty term: it occurs, with terms or without."""
    lang, source, term, n, docs = [], [], [], [], []
    for (its_lang, its_source), (counts, seen) in held.items():
        size = len(counts) + 1
        lang += [its_lang] * size
        source += [its_source] * size
        term += [b"", *counts]
        n += [0, *counts.values()]
        docs += [0, *map(seen.__getitem__, counts)]
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches):
    held, size = {}, 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(counts)
            own = Counter(terms_of(text))
            counts.update(own)
            seen.update(own.keys())
            size += len(counts) - before
            if size >= HELD_TERMS:
                yield _batch(held)
                held, size = {}, 0
    if held:
        yield _batch(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (occurrences), docs (documents that hold it); an empty term for each group."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR kept)), exactly; null where no term is kept."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = whole(count.cast("long") + PRIOR, 20) * whole(F.lit(UNIT), 10)
    below = whole(total.cast("long") + kept.cast("long") * PRIOR, 20)
    return F.when(kept > 0, 1 + F.floor((above - above % below) / below).cast("long"))


def _distances(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sum over the shard's terms of the distance between the shares of every two sources, lower name first."""
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    rest = np.array([groups.column("rest").to_pylist()[i] or 0 for i in order], np.int64)
    sums = np.zeros((len(names), len(names)), np.int64)
    if len(rows):
        place = {s: i for i, s in enumerate(names)}
        at = np.array([place[s] for s in rows.column("source").to_pylist()])
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        by_term = np.argsort(term, kind="stable")
        at, term, p = at[by_term], term[by_term], rows.column("p").to_numpy()[by_term]
        step = max(1, CELLS // len(names))
        for low in range(0, int(term[-1]) + 1, step):
            i, j = np.searchsorted(term, [low, low + step])
            shares = np.repeat(rest[None, :], min(step, int(term[-1]) + 1 - low), axis=0)
            shares[term[i:j] - low, at[i:j]] = p[i:j]
            for a in range(len(names)):
                sums[a] += np.abs(shares - shares[:, a : a + 1]).sum(axis=0)
    a, b = np.triu_indices(len(names), 1)
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array([names[i] for i in a], pa.string()), "b": pa.array([names[i] for i in b], pa.string()), "part": pa.array(sums[a, b], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank.

    Part ``pair``: the distance between the shares of a source and of each other source of its language, summed
    over the language's kept terms.  Part ``term``: the ``ranks`` terms whose share in the source is most above
    that in the language.  Ranks run from the largest value, ties by item.  Null texts, languages and sources are
    empty ones; a language without kept terms has pairs at distance 0 and no terms; each row counts as a document,
    repeated ones too; an empty table gives an empty result; further columns are left behind.  A task that
    compares sources holds a square of the sources of one language, as large as the result for it.
    """
    counts = cut(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    few_langs = cut(langs, "term-languages")
    whole = kept.join(_sent(few_langs), "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    used = cut(counts.select("lang", "source", "term", "n").join(whole, ["lang", "term"]), "used-terms")
    groups = counts.filter("term = ''").select("lang", "source")
    groups = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(few_langs.select("lang", "kept"), "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")]), "term-groups")
    used = used.join(_sent(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    shards = max(1, -(-used.count() // SHARD_ROWS))
    here = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    rest = groups.select("lang", "source", share(F.lit(0), F.col("total"), F.col("kept")).alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    parts = used.select("lang", "source", "term", "p", here).groupBy("lang", "shard").cogroup(rest.groupBy("lang", "shard")).applyInArrow(_distances, "lang string, a string, b string, part long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("z")
    pairs = pairs.select("lang", "value", both).select("lang", "z.source", F.lit("pair").alias("part"), "z.item", "value")
    terms = used.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= ranks))


def _sent(small: DataFrame) -> DataFrame:
    """A row a group goes to every task up to a checked number of rows; beyond it Spark splits skewed joins."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def op12_divergence(spark, sf_dir):
    """The audit of all documents; see ``audit`` for nulls, ties, repeated rows and empty tables."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, sum(n) AS total, count(*) AS kept FROM k GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (total + 5 * kept) AS q FROM k JOIN l USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
e AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(e.total, 0) + 5 * l.kept) AS p
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN e ON e.lang = g.lang AND e.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
v AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM v) WHERE part = 'pair' OR n <= 50
"""
