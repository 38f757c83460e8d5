"""Questions of chunks of documents to buckets of keys, and the answers.

Documents are dealt to chunks of bounded size.  A chunk works out keys of its texts, sums
up what it knows of each key to one record (so a key that is frequent in every chunk is
still one record per chunk), and sends the records of a bucket of keys as one packed row.
A bucket meets all records of its keys and answers the chunks that need to know.  Volumes
are a few bytes a key, no row per key passes through the JVM, and no group is larger than
the records of its keys.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import LAST_ID

CHUNK_BYTES = 4 << 20
LEAST_CHUNKS = 8
QUESTION = "bucket int, chunk int, body binary"
ANSWER = "chunk int, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    parts += [struct.pack("<3sQ", a.dtype.str[:3].encode(), len(a)) for a in arrays]
    return b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unpack(raw: bytes) -> list[np.ndarray]:
    n, at = raw[0], 1
    heads = []
    for _ in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, at)
        heads.append((np.dtype(kind.decode()), size))
        at += 11
    out = []
    for kind, size in heads:
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def chunks_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with a chunk each, the same in every run; and the number of chunks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_CHUNKS, -(-size // chunk_bytes))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")), n


class Texts:
    """The rows of one chunk: ids (null as the last), whether they are set, and bytes."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.ids = np.array([LAST_ID if x is None else x for x in ids.to_pylist()], np.int64)
        self.column = ids
        self.bytes = [x.encode("utf-8", "replace") for x in table.column("text").to_pylist()]
        self.chunk = table.column("chunk")[0].as_py() if table.num_rows else None


def by_bucket(keys: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted ``keys`` and what belongs to them, cut into contiguous buckets of the key space."""
    width = np.uint64((1 << 64) // buckets + 1)
    where = (keys // width).astype(np.int64)
    edges = np.flatnonzero(np.diff(where)) + 1
    for part in zip(*(np.split(a, edges) for a in (where, keys, *more)), strict=True):
        if len(part[0]):
            yield int(part[0][0]), list(part[1:])


def ask(chunked: DataFrame, question: Callable, buckets: int, known: DataFrame | None = None) -> DataFrame:
    """Rows for buckets.  ``question(texts, known)`` gives sorted keys and arrays beside them;
    ``known`` is a table of earlier answers, unpacked for the chunk."""

    def rows(texts: Texts, answers: list[list[np.ndarray]]) -> pa.Table:
        keys, *more = question(texts, answers)
        found = list(by_bucket(keys, buckets, *more))
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in found], pa.int32()),
                "chunk": pa.array([texts.chunk] * len(found), pa.int32()),
                "body": pa.array([pack(*arrays) for _, arrays in found], pa.binary()),
            }
        )

    return _per_chunk(chunked, rows, QUESTION, known)


def answer(questions: DataFrame, reply: Callable) -> DataFrame:
    """``reply(chunks, bodies)`` yields (chunk, arrays) for the chunks that need an answer."""

    def run(table: pa.Table) -> pa.Table:
        bodies = [unpack(b) for b in table.column("body").to_pylist()]
        found = list(reply(table.column("chunk").to_pylist(), bodies))
        return pa.table(
            {
                "chunk": pa.array([c for c, _ in found], pa.int32()),
                "body": pa.array([pack(*arrays) for _, arrays in found], pa.binary()),
            }
        )

    return questions.groupBy("bucket").applyInArrow(run, ANSWER)


def _per_chunk(chunked: DataFrame, work: Callable, schema: str, known: DataFrame | None) -> DataFrame:
    empty = pa.table({n.split()[0]: pa.array([]) for n in schema.split(", ")})

    if known is None:

        def alone(table: pa.Table) -> pa.Table:
            return work(Texts(table), [])

        return chunked.groupBy("chunk").applyInArrow(alone, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        return work(Texts(left), [unpack(b) for b in right.column("body").to_pylist()])

    return chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(both, schema)


def shared_counts(chunks: list[int], bodies: list[list[np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """To every chunk the keys it asked about that occur at least twice, with their totals."""
    keys = np.concatenate([b[0] for b in bodies])
    counts = np.concatenate([b[1] for b in bodies]).astype(np.int64)
    known, where = np.unique(keys, return_inverse=True)
    totals = np.zeros(len(known), np.int64)
    np.add.at(totals, where, counts)
    at = 0
    for chunk, body in zip(chunks, bodies, strict=True):
        n = len(body[0])
        total = totals[where[at : at + n]]
        at += n
        shared = total >= 2
        if shared.any():
            yield chunk, [body[0][shared], np.minimum(total[shared], 2**32 - 1).astype(np.uint32)]


def merged_counts(answers: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The answers of ``shared_counts`` as sorted keys and totals."""
    if not answers:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, totals = np.concatenate([a[0] for a in answers]), np.concatenate([a[1] for a in answers])
    order = np.argsort(keys, kind="stable")
    return keys[order], totals[order]


def lookup(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each key among sorted known ones, or -1."""
    if not len(known):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)
