"""Training-corpus pipeline: language, near duplicates, personal data, mixing, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and reread as the next one's docs.  All but the last return the columns of
``documents``.  No stage is limited to a part of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenespark.llm import language, mixing, packing, pii, simhash
from scenespark.llm.common import cut, quoted, table, tokenizer_path

#: Below this share of its own mixture no language counts as the document's.
LEAST_SHARE = 0.3


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language reaches LEAST_SHARE, go; if no row names a language, all stay."""
    model = language.train(docs)
    if not model[0]:
        return docs
    found = language.identify(docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays, once; rows without an id stay.

    Of several texts with one id the first by code point stays.
    """
    groups = simhash.near_duplicate_sets(docs, ngram=5, similarity=0.8)
    first = cut(groups.filter("doc_id = component_id").groupBy("doc_id").count(), "first-copies")
    # texts meet the ids in one shuffle and are not sorted for it, at every size
    kept = docs.join(first.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*map(quoted, docs.columns))
    several = first.filter("count > 1").select("doc_id")
    if several.limit(1).count():
        row = F.struct(*map(quoted, docs.columns)).alias("row")
        one = docs.join(several, "doc_id", "left_semi").select("doc_id", "text", row)
        one = one.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("n = 1").select("row.*")
        kept = kept.join(several, "doc_id", "left_anti").select(*map(quoted, docs.columns)).unionByName(one)
    return kept.unionByName(docs.filter("doc_id is null"))


def personal_data_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by the name of its kind; n_chars follows the text.

    Rows are redacted one by one: null and empty texts stay as they are (n_chars null and 0), null ids and repeated
    rows are like any other, an empty table gives an empty one, and columns of any name are kept.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*map(quoted, docs.columns))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document.

    A null text counts no words and goes or stays by its hash; a null source is a source of its own; rows with one
    id are taken together, repeated rows each as often; an empty table gives an empty one, and columns of any name
    are kept.
    """
    taken = mixing.mixed(docs).filter("times > 0")
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("row.*")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in the training sequences.

    A null or empty text is its end id alone, a long one is cut and never shortened; null ids, repeated rows and
    equal sizes are packed like any other row; an empty table gives an empty result; further columns are left behind.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trees, expectation-maximisation and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
