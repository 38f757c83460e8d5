"""Line numbers for text files that are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashtide.session import materialise

_POSITION = ["_path", "_start"]
_PART_BITS = 33  # of a monotonically increasing id, the bits below the number of the partition
MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def not_blank(column: str = "value"):
    """Whether a line has more than spaces and control characters; readers of CSV skip the others."""
    return F.col(column).rlike("[^\\x00-\\x20]")


def file_splits(spark: SparkSession, path: str) -> DataFrame:
    """One stored row per split of the files: where it lies in the scan, how many lines it has,
    and its first one.

    The only pass over the files before the one that reads them; it parses nothing.  How
    files are cut must not follow the number of cores between the two, so a session that leaves
    it to them is given the number of now.
    """
    if spark.conf.get(MIN_PARTITIONS, None) is None:
        spark.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    lines = (
        spark.read.text(path)
        .filter(not_blank())
        .select("value", *_position(), F.monotonically_increasing_id().alias("_place"))
    )
    return materialise(
        lines.groupBy(*_POSITION).agg(
            F.count(F.lit(1)).alias("_lines"), F.min("_place").alias("_first"), F.min_by("value", "_place").alias("_head")
        )
    )


def _position():
    return F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")


def number_lines(rows: DataFrame, splits: DataFrame, column: str, first: int, header: bool = True) -> DataFrame:
    """Number the rows of a scan of the files in their order, starting at ``first``.

    Rows of one split are read in order by one task, so the place within the split is known
    there; only the rows of the splits before it have to be summed up, one small row per
    split.  Nothing is stored but these sums, which are broadcast on their true size, and
    the lines are not shuffled.  With ``header`` the first line of a file is no row.  If the
    files are cut otherwise than when they were counted, the read fails.
    """
    headers = (F.col("_start") == 0).cast("int") if header else F.lit(0)
    sizes = splits.select(*_POSITION, (F.col("_lines") - headers).alias("_rows"), "_first")
    part = F.shiftright("_first", _PART_BITS)
    here = Window.partitionBy(part).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(*_POSITION).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        sizes.select(
            *_POSITION,
            "_rows",
            (F.shiftleft(part, _PART_BITS) + F.coalesce(F.sum("_rows").over(here), F.lit(0))).alias("_first"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        )
    )
    placed = rows.select("*", *_position(), F.monotonically_increasing_id().alias("_place")).join(starts, _POSITION, "left")
    within = F.col("_place") - F.col("_first")
    known = F.coalesce((within >= 0) & (within < F.col("_rows")), F.lit(False))
    number = F.when(known, F.col("_before") + within + first).otherwise(
        F.raise_error(F.concat(F.lit("the file was cut otherwise than when it was counted: "), "_path")).cast("bigint")
    )
    return placed.withColumn(column, number).drop(*_POSITION, "_place", "_rows", "_first", "_before")


def number_whole_files(rows: DataFrame, column: str, first: int) -> DataFrame:
    """The same for scans of whole files whose rows only a parser can count: they are stored
    with their places."""
    positioned = materialise(rows.select("*", *_position(), F.monotonically_increasing_id().alias("_place")))
    splits = positioned.groupBy(*_POSITION).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.orderBy(*_POSITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (
        positioned.join(materialise(offsets), _POSITION)
        .withColumn(column, F.col("_before") + F.col("_place") - F.col("_first") + first)
        .drop(*_POSITION, "_place", "_before", "_first")
    )
