"""Joins and running totals that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.session import materialise


def join_stored(many: DataFrame, one: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join rows to a side that is unique on the key and the result of a grouping or
    of another join on it.

    Left in one plan, both sides would be read in one stage, and a partition with a
    hot key, or with all the rows that have none, could not be split.  Stored first,
    the unique side is broadcast if its measured size allows, and otherwise both
    sides come straight from a shuffle, where the planner splits hot partitions.
    """
    return many.join(materialise(one), list(key), how)


def keep_all_left(
    one: DataFrame, many: DataFrame, key: Sequence[str], keys: DataFrame | None = None
) -> DataFrame:
    """``one`` LEFT JOIN ``many`` where the key is unique in ``one`` only.

    The hot side of such a join is the right one, and a left outer join cannot
    split its right side at run time.  An inner join can split either side, so
    the matches come from an inner join and the unmatched left rows from an anti
    join against the distinct keys, which combine map-side.  Where ``many`` is a
    join itself, ``keys`` names the table that holds the same keys, so that only
    one column of it is read again.
    """
    key = list(key)
    matched = one.join(many, key, "inner")
    unmatched = one.join((many if keys is None else keys).select(*key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def in_ordered_blocks(
    df: DataFrame, order: Sequence[str], block: str = "_block", blocks: int | None = None
) -> DataFrame:
    """Cut the rows into contiguous blocks of their total order, one per task.

    ``order`` must identify a row.  Blocks are of about equal size whatever the
    distribution of the leading columns, so a group of any size is spread over
    many blocks.  The result is stored: the block limits come from a
    sample, and every later reader has to see the same ones.  Their number follows
    the shuffle settings unless ``blocks`` fixes it.
    """
    ranged = df.repartitionByRange(*order) if blocks is None else df.repartitionByRange(blocks, *order)
    return materialise(ranged.withColumn(block, F.spark_partition_id()))


def numbered(df: DataFrame, column: str, order: Sequence[str], highest: Column) -> DataFrame:
    """Number the rows by ``order`` from one after ``highest``, without bringing them together.

    Rows that ``order`` does not tell apart should be equal: which of them comes first is
    left open.  Blocks of the order are numbered on their own, after the rows before them.
    """
    blocks = in_ordered_blocks(df, order)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = materialise(sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return blocks.withColumn("_place", place).join(starts, "_block").withColumn(
        column, (highest + F.col("_before") + F.col("_place")).cast("bigint")
    ).select(*[c for c in df.columns if c != column], column)


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``part``, the least node reachable, for both ends of every link.

    In each round all neighbours of a node are linked to the least of them, the larger ones
    first and then the smaller; trees become stars in about as many rounds as the longest
    way has binary digits.  Only minima per node meet, so a node may have any number of links.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    edges, before = materialise(edges), None
    while True:
        ends = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = materialise(ends.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("hi", "m")))
        up = ends.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        up = materialise(up.distinct())
        least = materialise(up.groupBy("hi").agg(F.min("lo").alias("m")))
        down = up.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        edges = materialise(down.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    parts = edges.groupBy("hi").agg(F.min("lo").alias("part")).select(F.col("hi").alias("node"), "part")
    return parts.unionAll(parts.select(F.col("part").alias("node"), "part").distinct())
