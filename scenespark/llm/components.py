"""Connected components of a link table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> node, component (the smallest node reachable).

    Every round a node's parent is lowered to the smallest grandparent around it and around the nodes
    that point to it, then replaced by its own parent, until nothing changes; the number of rounds
    grows with the logarithm of the longest path.  State is written to the shared folder each round.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "links")
    parent = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        with_grand = cut(parent.join(up, "parent").select("node", "parent", "grand"), "grandparents")
        near = edges.join(with_grand.select(F.col("node").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("low"))
        hooks = with_grand.join(near.withColumnRenamed("u", "node"), "node")
        lowered = hooks.groupBy("parent").agg(F.min("low").alias("low")).select(F.col("parent").alias("node"), "low")
        offers = lowered.union(hooks.select("node", F.least("low", "grand").alias("low")))
        offers = offers.groupBy("node").agg(F.min("low").alias("low"))
        after = cut(with_grand.join(offers, "node").select("node", F.least("parent", "grand", "low").alias("parent"), F.col("parent").alias("was")), "parents")
        changed = after.filter("parent <> was").limit(1).count()
        parent = after.select("node", "parent")
        if not changed:
            return parent.select("node", F.col("parent").alias("component"))
