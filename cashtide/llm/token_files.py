"""Token files: ids packed by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all files.  Ids in the
order of their documents are cut into blocks that decode on their own: a block deals its
ids to interleaved lanes, one coder state each, so that a step codes one id of every lane.
Checkpoints keep the states and the place in the stream at every few steps, so that parts of
a block decode in parallel; a checksum guards the ids of a block.

A file holds blocks and a directory of them at its end; ``table`` in the same folder holds
the frequencies.  All numbers are little-endian.

Null texts are empty; documents without an id come last and keep it null; repeated rows
are kept in the order of their texts; an empty table gives a folder without blocks; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cashtide.llm.common import LAST_ID, Scratch, id_and_text
from cashtide.llm.files import listed, new_file, open_range

BLOCK_IDS = 1 << 19  # ids of a block at most, but for a single longer document
TEXTS = 4096  # encoded at a time, if they have no more bytes than
TEXT_BYTES = 3 << 21  # this, but for a single longer text
LANES = 2048  # of a long block; short ones take fewer, about 64 ids each
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)  # a state is at least this between steps
W32 = np.uint64(32)
TABLE, FILE, END = b"RTABLE01", b"RTOKEN01", b"RTOKDIR1"
HEAD = "<QQQIIIII"  # start, ids, documents, lanes, steps, checkpoints, words, crc of the ids
ENTRY = "<QQQQI"  # offset, bytes, start, ids, crc of the block's bytes


class Frequencies:
    """Counts scaled so that they add up to a power of two, each at least one."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray, bits: int):
        self.bits, self.ids, self.scaled = bits, ids, scaled
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = scaled
        self.cum[ids] = np.cumsum(scaled) - scaled
        self.symbol = np.repeat(ids, scaled).astype(np.uint32)

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> Frequencies:
        ids = np.array(sorted(counts), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        bits = max(16, int(len(ids)).bit_length() + 2)
        if not len(ids):
            return cls(ids, np.zeros(0, np.int64), bits)
        total = 1 << bits
        scaled = np.maximum(1, np.floor(n / n.sum() * total)).astype(np.int64)
        order = np.lexsort((ids, -n))
        over = int(scaled.sum()) - total
        at = 0
        while over:  # the most frequent ids bear the rounding
            change = -over if over < 0 else -min(over, int(scaled[order[at]]) // 2)
            scaled[order[at]] += change
            over += change
            at = (at + 1) % len(order)
        return cls(ids, scaled, bits)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.ids)) + self.ids.astype("<u4").tobytes()
        body += self.scaled.astype("<u4").tobytes()
        return TABLE + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Frequencies:
        body = raw[12:]
        if raw[:8] != TABLE or struct.unpack("<I", raw[8:12])[0] != zlib.crc32(body):
            raise ValueError("not a frequency table, or a damaged one")
        bits, n = struct.unpack_from("<II", body)
        ids = np.frombuffer(body, "<u4", n, 8).astype(np.int64)
        return cls(ids, np.frombuffer(body, "<u4", n, 8 + 4 * n).astype(np.int64), bits)


def lanes_for(n: int) -> int:
    return min(LANES, 1 << max(0, (n // 64).bit_length()))


def encode_lanes(ids: np.ndarray, table: Frequencies, lanes: int) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
    """Checkpoints (step, words before it, states) and the stream of 32-bit words."""
    n = len(ids)
    steps = -(-n // lanes)
    bits = np.uint64(table.bits)
    limit_shift = np.uint64(63 - table.bits)
    freq, cum = table.freq[ids], table.cum[ids]
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [None] * steps
    saved = {}
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= (f << limit_shift)
        words[step] = x[full].astype(np.uint32)
        x = np.where(full, x >> W32, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + cum[a:b]
        if step % CHECKPOINT_STEPS == 0:
            saved[step] = state.copy()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if steps else np.zeros(1, np.int64)
    stream = np.concatenate(words) if steps else np.zeros(0, np.uint32)
    return [(s, int(before[s]), saved[s]) for s in sorted(saved)], stream


def decode_lanes(
    stream: np.ndarray, table: Frequencies, n: int, step: int, word: int, state: np.ndarray, until: int
) -> np.ndarray:
    """The ids of the steps from a checkpoint to before ``until``."""
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    state = state.copy()
    out = []
    for at in range(step, until):
        live = min(n - at * len(state), len(state))
        x = state[:live]
        slot = x & mask
        ids = table.symbol[slot]
        x = table.freq[ids] * (x >> bits) + slot - table.cum[ids]
        low = x < LOW
        need = int(low.sum())
        if need:
            x[low] = (x[low] << W32) | stream[word : word + need].astype(np.uint64)
            word += need
        state[:live] = x
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode_block(start: int, doc_ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray, table) -> bytes:
    lanes = lanes_for(len(ids))
    points, stream = encode_lanes(ids, table, lanes)
    head = struct.pack(
        HEAD, start, len(ids), len(sizes), lanes, -(-len(ids) // lanes), len(points), len(stream), zlib.crc32(ids.astype("<u4").tobytes())
    )
    parts = [head, doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), sizes.astype("<u4").tobytes()]
    parts += [struct.pack("<II", s, w) + x.astype("<u8").tobytes() for s, w, x in points]
    return b"".join([*parts, stream.astype("<u4").tobytes()])


def decode_block(raw: bytes, table: Frequencies) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, document ids, whether they are set, sizes and ids; a wrong checksum is an error."""
    start, n, docs, lanes, steps, n_points, n_words, crc = struct.unpack_from(HEAD, raw)
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    valid = np.frombuffer(raw, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    points = []
    for _ in range(n_points):
        step, word = struct.unpack_from("<II", raw, at)
        points.append((step, word, np.frombuffer(raw, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    stream = np.frombuffer(raw, "<u4", n_words, at)
    ends = [p[0] for p in points[1:]] + [steps] * bool(points)
    ids = [decode_lanes(stream, table, n, *p, until) for p, until in zip(points, ends, strict=True)]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"the block that starts at id {start} is damaged")
    return start, doc_ids, valid, sizes, ids


#: How a tokenizers file must cut texts for its words to be encoded apart.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte of a piece: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Letters up to U+024F that do not combine and are lowered one by one, and signs that are no letters.
_LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SIGNS = "\u00a1\u00a7\u00ab\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018-\u201f\u2026\u20ac"


class WordTokens:
    """Ids of whole texts by a tokenizers file.

    A file that drops white space and merges words apart, as ``WORDWISE`` says, has its
    pieces encoded on their own and remembered.  Texts of Latin letters are lowered and cut
    into pieces as whole columns; of other texts each word is cut by the library.  Where that
    could differ (special tokens, control characters), and for all other files, the library
    encodes whole texts.
    """

    _ODD = r"<\||[\x00-\x08\x0e-\x1f\x7f]"
    _OTHER = f"[^\t-\r -~A-Z{_LATIN}{_SIGNS}]"
    _PIECES = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\t-\r 0-9{_LATIN}]+)"
    _LETTERS = {b: c for b, c in byte_letters().items() if chr(b) != c}
    REMEMBERED = 300_000  # words and pieces, for as long as the worker lives; as many older ones are kept

    def __init__(self, file: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        cuts = json.loads(self.library.to_str())
        self.wordwise = all(cuts[k] == v for k, v in WORDWISE.items())
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _recalled(self, key: str, make: Callable[[str], bytes]) -> bytes:
        """What is known of a key; when that is full, the keys met since then are kept."""
        ids = self.known.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = make(key)
            if len(self.known) >= self.REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[key] = ids
        return ids

    def _merged(self, letters: str) -> bytes:
        ids = [t.id for t in self.library.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._LETTERS))

    def _word(self, marked: str) -> bytes:
        plain = self.library.normalizer.normalize_str(marked[1:])
        parts = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return b"".join(self._recalled("\1" + p, lambda key: self._merged(key[1:])) for p in parts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, keys: pa.Array, make: Callable[[str], bytes], mark: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys, one after the other, and the places between those of each."""
        at_hand = self.known.get
        named = [mark + x for x in keys.to_pylist()] if mark else keys.to_pylist()
        found = [at_hand(x) or self._recalled(x, make) for x in named]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum(size)])

    @staticmethod
    def _by_distinct(parts: pa.LargeListArray, ids_of: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of parts, of which each distinct one is looked up once."""
        edges = parts.offsets.to_numpy() if len(parts) else np.zeros(1, np.int64)
        coded = parts.flatten().dictionary_encode()
        flat, places = ids_of(coded.dictionary)
        begin, size = places[:-1], np.diff(places)
        code = coded.indices.to_numpy()
        sizes = size[code]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begin[code] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[edges - edges[0]]

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of Latin letters by those of their pieces."""
        cut = pc.replace_substring_regex(pc.utf8_lower(words), self._PIECES, r"\1 ")
        return self._by_distinct(pc.ascii_split_whitespace(cut), lambda pieces: self._ids(pieces, self._piece))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.wordwise:
            return [ids + self.end for ids in self._whole(column.to_pylist())]
        odd = pc.match_substring_regex(column, self._ODD)
        other = pc.and_not(pc.match_substring_regex(column, self._OTHER), odd)
        latin = pc.invert(pc.or_(odd, other))
        def by_word(chosen: pa.Array, ids_of: Callable) -> list[bytes]:
            ids, places = self._by_distinct(pc.ascii_split_whitespace(column.filter(chosen)), ids_of)
            return [ids[a:b].tobytes() for a, b in pairwise(places.tolist())]

        found = (
            (odd, self._whole(column.filter(odd).to_pylist())),
            (other, by_word(other, lambda words: self._ids(words, self._word, "\0"))),
            (latin, by_word(latin, self._latin)),
        )
        out = [b""] * len(texts)
        for chosen, coded in found:
            for i, ids in zip(np.flatnonzero(chosen.to_numpy(zero_copy_only=False)).tolist(), coded, strict=True):
                out[i] = ids + self.end
        return out


def portions(texts: pa.Array, most: int = TEXTS, most_bytes: int = TEXT_BYTES) -> Iterator[pa.Array]:
    """Texts in their order, so many at a time that what is made of them stays small."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        until = min(max(int(np.searchsorted(ends, before + most_bytes, side="right")), at + 1), at + most)
        yield texts.slice(at, until - at)
        at, before = until, int(ends[until - 1])


@lru_cache(maxsize=1)
def _encoder(file: str, end_id: int | None) -> WordTokens:
    """One for all tasks of a worker process, with what it remembers."""
    return WordTokens(file, end_id)


_BLOCK_SCHEMA = "part int, block int, n_ids bigint, doc_ids binary, valid binary, sizes binary, ids binary"


def _blocks(docs: DataFrame, tokenizer_file: str, end_id: int | None) -> DataFrame:
    """Blocks of ids in the order of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, end_id)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, valid, sizes, ids, held = [], [], [], [], 0

        def cut() -> pa.RecordBatch:
            joined = zstandard.ZstdCompressor(level=1).compress(b"".join(ids))
            arrays = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([held], pa.int64()),
                pa.array([np.array(doc_ids, "<i8").tobytes()], pa.binary()),
                pa.array([np.array(valid, "u1").tobytes()], pa.binary()),
                pa.array([np.array(sizes, "<u4").tobytes()], pa.binary()),
                pa.array([joined], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            encoded = (x for some in portions(batch.column(1)) for x in encoder.encode(some))
            for doc, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if held and held + len(raw) // 4 > BLOCK_IDS:
                    yield cut()
                    doc_ids, valid, sizes, ids, held, block = [], [], [], [], 0, block + 1
                doc_ids.append(0 if doc is None else doc)
                valid.append(doc is not None)
                sizes.append(len(raw) // 4)
                ids.append(raw)
                held += len(raw) // 4
        if doc_ids:
            yield cut()

    ordered = docs.repartitionByRange(F.coalesce("doc_id", F.lit(LAST_ID))).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "text"
    )
    return ordered.mapInArrow(run, _BLOCK_SCHEMA)


def _counted(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.bincount(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4"))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counted = blocks.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.collect()}


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode the texts in ascending order of their ids and write them below ``folder``.

    Returns one row per file: part, path, blocks and ids.  A part is a range of document
    ids; its file is written by one task, block by block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    blocks = scratch.store(_blocks(id_and_text(docs, id_col, text_col), tokenizer_file, end_id))
    table = Frequencies.of_counts(_counted(blocks))
    with new_file(f"{folder}/table") as out:
        out.write(table.to_bytes())
    shared = spark.sparkContext.broadcast(table.to_bytes())

    # Where each block starts: totals of the parts before it and of the blocks before it.
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("at"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("base") + F.col("at")).alias("start"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequencies.from_bytes(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), "<u4").astype(np.int64)
                sizes = np.frombuffer(row["sizes"], "<u4")
                doc_ids, valid = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["valid"], "u1")
                raw = encode_block(row["start"], doc_ids, valid, sizes, ids, known)
                yield pa.RecordBatch.from_pylist(
                    [{"part": row["part"], "block": row["block"], "start": row["start"], "n_ids": len(ids), "raw": raw}],
                    schema=packed_schema,
                )

    packed_schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("raw", pa.binary())]
    )
    packed = scratch.store(
        blocks.join(starts, ["part", "block"])
        .select("part", "block", "start", "sizes", "doc_ids", "valid", "ids")
        .mapInArrow(pack, "part int, block int, start bigint, n_ids bigint, raw binary")
    )
    scratch.drop(blocks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive sorted by part and block; a file ends where the part does."""
        part, stream, closing, entries, done = None, None, None, [], []

        def finish():
            directory = b"".join(struct.pack(ENTRY, *e) for e in entries)
            stream.write(directory + struct.pack("<Q", len(entries)) + END)
            closing.__exit__(None, None, None)
            done.append({"part": part, "path": f"{folder}/part-{part:06d}.tokens", "n_blocks": len(entries), "n_ids": sum(e[3] for e in entries)})

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != part:
                        if stream is not None:
                            finish()
                        part, entries = row["part"], []
                        closing = new_file(f"{folder}/part-{part:06d}.tokens")
                        stream = closing.__enter__()
                        stream.write(FILE)
                        at = len(FILE)
                    stream.write(row["raw"])
                    entries.append((at, len(row["raw"]), row["start"], row["n_ids"], zlib.crc32(row["raw"])))
                    at += len(row["raw"])
            if stream is not None:
                finish()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            raise
        yield pa.RecordBatch.from_pylist(
            done,
            schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_blocks", pa.int64()), ("n_ids", pa.int64())]),
        )

    files = scratch.store(
        packed.repartition("part")
        .sortWithinPartitions("part", "block")
        .mapInArrow(write, "part int, path string, n_blocks bigint, n_ids bigint")
    )
    scratch.drop(packed)
    return files


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``).

    Directories are read first; then every block is fetched by its range, checked and
    decoded on its own, wherever there is room.
    """
    with open_range(f"{folder}/table") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_range(path) as file:
                    file.seek(length - 16)
                    n, mark = struct.unpack("<Q8s", file.read(16))
                    if mark != END:
                        raise ValueError(f"{path} is no token file")
                    file.seek(length - 16 - n * struct.calcsize(ENTRY))
                    entries = list(struct.iter_unpack(ENTRY, file.read(n * struct.calcsize(ENTRY))))
                yield pa.RecordBatch.from_pylist(
                    [{"path": path, "offset": e[0], "size": e[1], "crc": e[4]} for e in entries],
                    schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())]),
                )

    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        out.append(("ids", pa.list_(pa.int64())))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies.from_bytes(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["path"]) as file:
                    file.seek(row["offset"])
                    raw = file.read(row["size"])
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"{row['path']} is damaged at byte {row['offset']}")
                start, doc_ids, valid, sizes, ids = decode_block(raw, table)
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                whole = memoryview(ids.astype("<u4").tobytes())
                columns = [
                    pa.array(doc_ids, pa.int64(), mask=valid == 0),
                    pa.array(start + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(whole[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)], out[-1][1]))
                yield pa.RecordBatch.from_arrays(columns, [c for c, _ in out])

    places = listed(spark, folder, "*.tokens").mapInArrow(directory, "path string, offset bigint, size bigint, crc bigint")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a block would be coalesced
    return places.repartition(tasks, "path", "offset").mapInArrow(decode, schema)
