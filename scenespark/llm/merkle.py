"""Merkle manifest of a dataset, built by a butterfly exchange.

Leaves are ordered within their tree and cut into aligned blocks of FANOUT ** DEPTH.  A block hashes its own
subtree.  Then, round by round, every FANOUT neighbouring nodes swap their roots: each block of a node gets the
roots of the other nodes of its run from one block of each (the one with the same place in its node, or, where
a node at the end is smaller, that place modulo its size) and hashes the common ancestor itself.  After
log(blocks) rounds each block knows the root and all siblings above it, so nothing is sent down again.  A row is
sent for each block and sibling; texts are hashed where they are read and never move.

The roots of all trees, in the order of their names, are the leaves of one more tree that is built alike.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import meet, numbered_within
from .common import ascii_lower, cut, table

FANOUT, DEPTH = 8, 3
#: A path from a leaf to the root: place in its run at each level, and the run's other nodes, 64 hex digits each.
PATH = "places array<int>, others array<string>"


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 of the columns one after the other: ``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]).cast("binary"), 256)


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents whose text is ``text``."""
    return leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])


def folded(leaf: Column, places: Column, others: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    width = 64

    def up(node: Column, step: Column) -> Column:
        at = step["place"] * width
        return F.sha2(F.concat(F.substring(step["others"], F.lit(1), at), node, F.substring(step["others"], at + 1, F.octet_length(step["others"]))).cast("binary"), 256)

    return F.aggregate(F.arrays_zip(places.alias("place"), others.alias("others")), leaf, up)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], n: int, fanout: int, depth: int) -> list[list[str]]:
    """Nodes of a block level by level, up to the root of the block in a tree of n leaves."""
    out, span = [nodes], 1
    while span < n and len(out) <= depth:
        nodes = [_hash(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
        span *= fanout
    return out


def place(leaves: DataFrame, by: str, order: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """leaves(by, leaf, ...) with their number in their tree, its size n, and their block."""
    rows = numbered_within(leaves, [by], order, "_pos", "_n")
    return rows.withColumn("_block", F.floor(F.col("_pos") / fanout**depth).cast("long"))


def climb(rows: DataFrame, by: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Placed leaves -> by, _block, root of the tree, and the path from the block's own root up to it."""
    kind = rows.schema[by].dataType.simpleString()

    def own_root(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        n = block.column("_n")[0].as_py()
        root = _levels(block.column("leaf").to_pylist(), n, fanout, depth)[-1][0]
        return pa.table({by: pa.array([key[0].as_py()], block.schema.field(by).type), "_block": [key[1].as_py()], "_blocks": [-(-n // fanout**depth)], "root": [root]})

    state = rows.select(by, "_block", "_pos", "_n", "leaf").groupBy(by, "_block").applyInArrow(own_root, f"{by} {kind}, _block long, _blocks long, root string")
    state = cut(state.select("*", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("others")), "merkle-blocks")
    most, span = state.agg(F.max("_blocks")).first()[0] or 1, 1
    while span < most:
        state = _swap(state, by, span, fanout)
        span *= fanout
    return cut(state.drop("_blocks"), "merkle-tops")


def _swap(state: DataFrame, by: str, span: int, fanout: int) -> DataFrame:
    """One round: blocks below a node of ``span`` blocks get the roots of the node's run and go on with its parent."""
    whole = lambda a, b: F.floor(a / b).cast("long")
    node, low = whole(F.col("_block"), span), F.col("_block") % span
    nodes = F.ceil(F.col("_blocks") / span).cast("long")
    first = whole(node, fanout) * fanout
    run = F.sequence(first, F.least(first + fanout - 1, nodes - 1))
    size = F.least(F.lit(span).cast("long"), F.col("_blocks") - node * span)
    sent = state.select("*", node.alias("_from"), F.sequence(low, F.lit(span - 1).cast("long"), size).alias("_lows"), F.explode(run).alias("_to"))
    sent = sent.withColumn("_low", F.explode("_lows")).withColumn("_at", F.col("_to") * span + F.col("_low")).filter(F.col("_at") < F.col("_blocks"))
    mine = F.col("_at") == F.col("_block")
    got = sent.select(by, "_blocks", F.col("_at"), F.struct("_from", "root").alias("_sent"), F.when(mine, F.struct("places", "others")).alias("_path"))
    got = got.groupBy(by, "_blocks", F.col("_at").alias("_block")).agg(F.sort_array(F.collect_list("_sent")).alias("_run"), F.max("_path").alias("_path"))
    node, more = whole(F.col("_block"), span), F.ceil(F.col("_blocks") / span) > 1
    names = F.array_join(F.transform("_run", lambda x: x["root"]), "")
    rest = F.array_join(F.transform(F.filter("_run", lambda x: x["_from"] != node), lambda x: x["root"]), "")
    return got.select(
        by, "_block", "_blocks", F.when(more, F.sha2(names.cast("binary"), 256)).otherwise(names).alias("root"),
        F.when(more, F.concat("_path.places", F.array((node % fanout).cast("int")))).otherwise(F.col("_path.places")).alias("places"),
        F.when(more, F.concat("_path.others", F.array(rest))).otherwise(F.col("_path.others")).alias("others"),
    )


def paths(rows: DataFrame, state: DataFrame, by: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Placed leaves with the path to their root: inside the block worked out again, above it the block's own."""
    keep = [c for c in rows.columns if c not in ("_pos", "_n", "_block")]

    def walk(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        levels = _levels(block.column("leaf").to_pylist(), block.column("_n")[0].as_py(), fanout, depth)
        up, high = above.column("places")[0].as_py(), above.column("others")[0].as_py()
        places, others = [], []
        for i in range(len(block)):
            at, siblings = [], []
            for nodes in levels[:-1]:
                run, p = i - i % fanout, i % fanout
                at.append(p)
                siblings.append("".join(nodes[run:i]) + "".join(nodes[i + 1 : run + fanout]))
                i //= fanout
            places.append(at + up)
            others.append(siblings + high)
        block = block.select(keep)
        return block.append_column("places", pa.array(places, pa.list_(pa.int32()))).append_column("others", pa.array(others, pa.list_(pa.string())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.groupBy(by, "_block").cogroup(state.select(by, "_block", "places", "others").groupBy(by, "_block")).applyInArrow(walk, f"{schema}, {PATH}")


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """leaves(lang, leaf, ...) -> the same columns with subroot, root, places and others (the path from leaf to root).

    Leaves of a language ascend by ``order`` and then by hash, so equal rows stay apart and their order does not
    matter.  A null language is a tree of its own and the first, null ids come first.  A lone leaf is its own
    subroot, a lone subroot the root.  An empty table gives an empty result.  Columns are those of ``leaves``:
    select what is to be kept; names that begin with an underscore are reserved.
    """
    rows = place(leaves, "lang", [*order, "leaf"], fanout, depth)
    state = climb(rows, "lang", fanout, depth)
    trees = place(state.filter("_block = 0").select("lang", F.col("root").alias("leaf"), F.lit(0).alias("_all")), "_all", ["lang"], fanout, depth)
    top = climb(trees, "_all", fanout, depth)
    above = paths(trees, top, "_all", fanout, depth).select("lang", F.col("leaf").alias("subroot"), F.col("places").alias("_places"), F.col("others").alias("_others"))
    root = F.broadcast(top.filter("_block = 0").select("root"))  # one row
    above = cut(above.crossJoin(root), "merkle-trees")
    state = meet(state.drop("root"), above, ["lang"])
    known = state.select("lang", "_block", F.concat("places", "_places").alias("places"), F.concat("others", "_others").alias("others"))
    return meet(paths(rows, cut(known, "merkle-paths"), "lang", fanout, depth), above.select("lang", "subroot", "root"), ["lang"])


def op11_merkle(spark, sf_dir):
    """Leaves, proofs and a tamper check of all documents.

    A null text, language, source, id or n_chars is hashed as ``-``; texts are hashed whole; a row without an id is
    not tampered with.  See ``manifest`` for ties, repeated rows and empty tables; further columns are left behind.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", document_leaf(F.col("text")).alias("leaf"), F.when(tampered, document_leaf(ascii_lower(F.col("text")))).alias("changed"))
    proved = manifest(leaves, ["doc_id"])
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("others", "").cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("places"), F.col("others")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
