"""Connected components of links between documents, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of ``links`` (a, b).

    Stars are contracted until nothing changes: every larger neighbour of a node is linked
    to the least one, then every smaller one.  The least neighbour is a map-side minimum
    that is stored and joined back, so a node with any number of links is split over tasks;
    no list of neighbours is ever gathered.
    """
    def stored(frame: DataFrame):
        """The table, and how many edges it has and a sum of their digests, taken as it is written."""
        seen = Observation()
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        table = scratch.store(frame.observe(seen, F.count(F.lit(1)).alias("n"), total))
        return table, (seen.get["n"], seen.get["s"])

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = stored(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.store(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.store(large.distinct())
        least = scratch.store(large.groupBy("a").agg(F.min("b").alias("m")))
        # (a, b) with b < a: the smaller neighbours and the node itself go to the least of them.
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        old = edges
        edges, now = stored(small)
        scratch.drop(old)
        if now == before:
            break
        before = now
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return scratch.store(labels.unionAll(roots))


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after further links (a, b) between its components or single nodes.

    Only the labels that the links touch are looked at: they are the nodes of a smaller graph.
    """
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias("_label"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_label", side)).drop("_label")
    merged = components(links, scratch).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
    # Nodes that had no link before are labels of themselves.
    single = merged.join(labels, merged["label"] == labels["node"], "left_anti")
    return scratch.store(moved.unionAll(single.select(F.col("label").alias("node"), F.col("_new").alias("label"))))
