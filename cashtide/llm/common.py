"""Stored intermediate tables, and texts as arrays of word digests."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import cashtide
from cashtide.llm.files import new_file
from cashtide.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LAST_ID = 2**63 - 1  # the place of a null id in the order of ids


def ship(spark: SparkSession) -> None:
    """Make this package importable where tasks run, once per context.

    The code goes as an archive through the shared folder, as any job with Python in its
    tasks sends its modules.
    """
    context = spark.sparkContext
    if getattr(context, "_cashtide_shipped", False):
        return
    root = Path(cashtide.__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = f"{scratch_path(spark, 'code')}.zip"
    with new_file(path) as out:
        out.write(raw.getvalue())
    context.addPyFile(path)
    context._cashtide_shipped = True


class Scratch:
    """Tables of one run below the folder that ``spark.checkpoint.dir`` names.

    ``store`` writes a table and reads it back, which cuts the lineage, survives lost
    executors, and lets Spark delete the shuffle files of the work before it.  ``drop``
    removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0

    def store(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*partition_by).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        stored = self.spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
        stored._scratch = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as bigint and ``text`` with null as the empty text; other columns go."""
    ship(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def hex_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One digest for two digests in their order."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def digest_of_runs(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The digest of every ``length`` consecutive values, by where they start.

    Blocks double in length, so it takes about two steps per binary digit of ``length``.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block = mix(values + np.uint64(salt)) if salt else values
    size, total, have = 1, None, 0
    while True:
        if length & size:
            total = block if total is None else pair(total[: len(block) - have], block[have:])
            have += size
        if have == length:
            return total[:n]
        block = pair(block[:-size], block[size:])
        size *= 2


#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTERS = 64


class Words:
    """The words of several texts: digest, start and end byte, and number of the text.

    ``data`` is all texts in UTF-8, each followed by a line feed.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside = ~SPACE[raw]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.digest = self._digests(raw)

    def _digests(self, raw: np.ndarray) -> np.ndarray:
        """Horner's rule over the first letters of all words at once; the longest words stay longest."""
        length = self.end - self.start
        order = np.argsort(-length, kind="stable")
        starts, sizes = self.start[order], length[order]
        out = np.zeros(len(order), np.uint64)
        with np.errstate(over="ignore"):
            live = len(order)
            for step in range(min(_LETTERS, int(sizes[0]) if live else 0)):
                live = int(np.searchsorted(-sizes[:live], -step, side="left"))
                out[:live] = out[:live] * np.uint64(0x100000001B3) + _BYTE[raw[starts[:live] + step]]
            for i in range(int(np.searchsorted(-sizes, -_LETTERS, side="left"))):  # the rest of long words
                out[i] ^= np.uint64(xxhash.xxh64_intdigest(raw[starts[i] + _LETTERS : starts[i] + sizes[i]].tobytes()))
            back = np.empty(len(order), np.uint64)
            back[order] = out
            return mix(back + length.astype(np.uint64))


def spread(values: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Consecutive pieces of the given lengths."""
    return np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []
