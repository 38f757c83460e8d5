"""Benchmark decontamination by one automaton over normalised test items.

Texts and items are normalised to lower-case words (letters a-z, digits and everything
beyond ASCII).  Every ``window`` consecutive words of an item, or all words of a shorter
one, are a pattern of an Aho-Corasick automaton over words.  It is built level by level in
arrays: a state is the place of its (parent, word) among the sorted keys, next to its failure
link and the nearest state on the way of failures that ends a pattern.  The arrays lie in the
shared folder and are mapped by the tasks, so a benchmark of many megabytes costs each task
little more than its vocabulary.

A text is scanned once.  Its words become numbers; only stretches in which every two
neighbouring words are neighbours in an item can hold a pattern, and the automaton walks over
all of these of a batch side by side.  Hits are mapped back to words and to character
offsets of the original.

Null and empty texts have no words; a null item id counts as a window but is not listed;
repeated items count once, repeated documents each; an empty benchmark marks nothing; a very
long text takes memory of a small multiple of its own; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch, id_and_text
from cashtide.llm.files import mapped, new_file

#: Bytes of items in one automaton.  Texts pass those of a larger benchmark one after the other.
AUTOMATON_BYTES = 12 << 20
#: Letters of the texts that are scanned side by side.
SCAN_LETTERS = 8 << 20

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, "
    "hits array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"
)
_RANGE = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


class Automaton:
    """The arrays of an automaton; state 0 is the root, state ``i`` > 0 has key ``keys[i - 1]``."""

    #: keys: parent * words + word; pairs: neighbours in items, likewise; listed: the items that
    #: end at state i are members[listed[i]:listed[i + 1]].
    ARRAYS = {"keys": "<i8", "fail": "<i4", "depth": "<i2", "ends": "<i4", "pairs": "<i8", "listed": "<i4", "members": "<i4"}

    def __init__(self, arrays: dict[str, np.ndarray], words: list[bytes], names: list[str]):
        self.__dict__.update(arrays)
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.base, self.names, self._items = len(words) + 1, names, {}

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], window: int) -> Automaton:
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number) + 1) for w in normalised(text)] for _, text in items]
        names = sorted({item for item, _ in items if item is not None})
        place = {item: i for i, item in enumerate(names)}
        base = len(number) + 1
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        words = np.array([w for t in texts for w in t], np.int64)
        # One pattern per place where a window, or a short item, starts.
        counts = np.where(lengths > 0, np.maximum(lengths - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        start = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        size = np.minimum(lengths[owner], window)
        keys, depth, first = [], [np.zeros(1, np.int16)], 1
        state = np.zeros(len(start), np.int64)
        for d in range(1, window + 1):
            live = np.flatnonzero(size >= d)
            level, at = np.unique(state[live] * base + words[start[live] + d - 1], return_inverse=True)
            state[live] = first + at
            keys.append(level)
            depth.append(np.full(len(level), d, np.int16))
            first += len(level)
        arrays = {"keys": np.concatenate(keys).astype(np.int64), "depth": np.concatenate(depth)}
        n = first
        ended = np.zeros(n, bool)
        ended[state] = True
        inside = np.ones(max(0, len(words) - 1), bool)
        inside[(begins[lengths > 0] - 1)[1:]] = False
        arrays["pairs"] = np.unique((words[:-1] * base + words[1:])[inside])
        of_item = np.array([-1 if items[i][0] is None else place[items[i][0]] for i in range(len(items))], np.int64)
        named = np.unique(np.stack([state, of_item[owner]], axis=1)[of_item[owner] >= 0], axis=0) if len(state) else np.zeros((0, 2), np.int64)
        arrays["members"] = named[:, 1].astype(np.int32)
        arrays["listed"] = np.searchsorted(named[:, 0], np.arange(n + 1))
        arrays |= {"fail": np.zeros(n, np.int32), "ends": np.zeros(n, np.int32)}
        machine = cls(arrays, list(number), names)
        begin = 1
        for level in keys:  # the failure link of a state is on a level above it
            own = np.arange(begin, begin + len(level))
            parent, word = level // base, level % base
            if begin > 1 and len(level) and parent[0] > 0:
                machine.fail[own] = machine.step(machine.fail[parent].astype(np.int64), word)
            machine.ends[own] = np.where(ended[own], own, machine.ends[machine.fail[own]])
            begin += len(level)
        return machine

    def save(self, folder: str) -> None:
        for name, kind in self.ARRAYS.items():
            with new_file(f"{folder}/{name}") as out:
                out.write(np.ascontiguousarray(getattr(self, name), kind).tobytes())
        for name, rows in (("words", list(self.number)), ("names", [x.encode() for x in self.names])):
            sizes = np.array([len(x) for x in rows], "<i8")
            with new_file(f"{folder}/{name}") as out:
                out.write(np.int64(len(rows)).tobytes() + sizes.tobytes() + b"".join(rows))

    @classmethod
    def load(cls, folder: str) -> Automaton:
        def strings(name: str) -> list[bytes]:
            raw = bytes(mapped(f"{folder}/{name}"))
            (n,) = np.frombuffer(raw, "<i8", 1)
            ends = 8 + 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n, 8))
            return [raw[a:b] for a, b in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist(), strict=False)][:n]

        arrays = {name: np.frombuffer(mapped(f"{folder}/{name}"), kind) for name, kind in cls.ARRAYS.items()}
        return cls(arrays, strings("words"), [x.decode() for x in strings("names")])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next state of each, by failure links where there is no arc."""
        out = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        state = state.copy()
        while len(left):
            key = state[left] * self.base + word[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[left[found]] = at[found] + 1
            left = left[~found]
            left = left[state[left] > 0]
            state[left] = self.fail[state[left]]
        return out

    def items_of(self, end: int) -> frozenset[str]:
        """The items of all patterns that end at a state."""
        found = self._items.get(end)
        if found is None:
            own = [self.names[i] for i in self.members[self.listed[end] : self.listed[end + 1]].tolist()]
            below = int(self.ends[self.fail[end]])
            found = self._items[end] = frozenset(own) | (self.items_of(below) if below else frozenset())
        return found

    def scan(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, frozenset[str]]]:
        """(text, first word, last word, items) of the longest pattern that ends at each place."""
        if not len(self.keys):
            return
        get = self.number.get
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        words = np.fromiter((x for t in texts for x in (*(get(w, 0) for w in t), 0)), np.int64, int(lengths.sum()))
        key = words[:-1] * self.base + words[1:]
        maybe = (words[:-1] > 0) & (words[1:] > 0)
        maybe[maybe] = np.isin(key[maybe], self.pairs, assume_unique=False)
        edges = np.flatnonzero(np.diff(maybe.astype(np.int8), prepend=0, append=0))
        begin, size = edges[0::2], edges[1::2] - edges[0::2] + 1
        # Words that are patterns of their own, wherever they stand.
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        single = np.flatnonzero((words > 0) & (self.keys[at] == words) & (self.ends[at + 1] > 0))
        begin, size = np.concatenate([begin, single]), np.concatenate([size, np.ones(len(single), np.int64)])
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, places, ends = np.zeros(len(begin), np.int64), [], []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            state[:live] = self.step(state[:live], words[begin[:live] + t])
            end = self.ends[state[:live]]
            hit = np.flatnonzero(end)
            places.append(begin[hit] + t)
            ends.append(end[hit])
        if not places:
            return
        place, end = np.concatenate(places), np.concatenate(ends)
        offsets = np.cumsum(lengths) - lengths
        text = np.searchsorted(offsets, place, side="right") - 1
        last = place - offsets[text]
        first = last - self.depth[end] + 1
        for i, a, b, e in zip(text.tolist(), first.tolist(), last.tolist(), end.tolist(), strict=True):
            yield i, a, b, self.items_of(e)


@lru_cache(maxsize=64)
def _loaded(folder: str) -> Automaton:
    """One for all tasks of a worker process."""
    return Automaton.load(folder)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with inclusive ends, joined where they touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets of ranges of words in the original text."""
    raw = text.encode("utf-8", "replace")
    places = np.array([m.span() for m in _WORD.finditer(raw)], np.int64)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[places[a, 0]]), int(before[places[b, 1]])) for a, b in ranges]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: words, hit words, the items found, and hits as ranges of words (ends
    included) and as ``spans`` of characters (ends excluded).

    One pass over the documents, no shuffle.  The benchmark is measured first; one task
    builds the automaton of at most ``AUTOMATON_BYTES`` of it, and neither it nor the items go
    through the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")
    ).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // AUTOMATON_BYTES))
    root = f"{scratch.root}/automaton"

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
        folder = f"{root}/{table.column('block')[0].as_py()}"
        Automaton.of(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), window).save(folder)
        return pa.table({"folder": [folder]})

    blocked = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    built = scratch.store(blocked.groupBy("block").applyInArrow(build, "folder string"))
    folders = sorted(r.folder for r in built.collect())  # one per block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [_loaded(folder) for folder in folders]
        for whole in batches:
            for batch in _parts(whole):
                texts = batch.column(1).to_pylist()
                words = [normalised(t) for t in texts]
                ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
                named: list[set[str]] = [set() for _ in texts]
                for machine in machines:
                    for i, first, last, found in machine.scan(words):
                        ranges[i].append((first, last))
                        named[i] |= found
                hits = [_merged(r) for r in ranges]
                columns = [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sum(b - a + 1 for a, b in r) for r in hits], pa.int64()),
                    pa.array([sorted(n) for n in named], pa.list_(pa.string())),
                    pa.array([[{"first": a, "last": b} for a, b in r] for r in hits], _RANGE("first", "last")),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in (_spans(t, r) if r else [])] for t, r in zip(texts, hits, strict=True)],
                        _RANGE("start", "end"),
                    ),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "hits", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``SCAN_LETTERS``, of one text at least."""
    sizes = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SCAN_LETTERS, side="right")))
        yield batch.slice(at, end - at)
        at = end
