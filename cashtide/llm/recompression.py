"""Substring deduplication by recompression.

Rounds shorten the sequence of words: runs of equal symbols become one symbol, then pairs
of a left and a right symbol do, where a digest of the symbol and the round says which
side it takes.  A new symbol is named by a 64-bit digest of what it replaces, so all tasks
name equal runs and pairs alike, and equal substrings get equal symbols in their interior.
Each symbol carries the stretch of words that decided it: where that stretch repeats, the
symbol does.

A window of words is held by one symbol of the highest level whose stretch lies inside it,
the same one wherever the window occurs.  Symbols whose stretch occurs once in the corpus
rule out all windows they hold; the windows of the others are compared by
digests of all their words, 96 bits long, and every one learns its first occurrence.

A null or empty text has no words.  A null id comes after all others, and rows with one id
are one document: a window is earlier at a smaller start.  Repeated rows with one id, whose
windows start alike, keep them.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cashtide.llm.common import Scratch, Words, digest_of_runs, id_and_text, mix, pair
from cashtide.llm.exchange import (
    Texts,
    answer,
    ask,
    chunks_of,
    lookup,
    merged_counts,
    shared_counts,
    unpack,
)

WINDOW = 20
ROUNDS = 2


class Symbols:
    """A level: names, and the first and the last word + 1 of the stretch that decided each.

    A stretch that reaches the end of its text goes one word beyond it, so that no window
    holds it: elsewhere other words may follow there.
    """

    def __init__(self, words: Words):
        self.name, self.text = words.digest, words.text
        self.lo = np.arange(len(self.name), dtype=np.int64)
        self.hi = self.lo + 1
        texts = np.arange(len(words.offsets))
        self.first = np.searchsorted(words.text, texts) - 1  # by text: the places just beyond it
        self.last = np.searchsorted(words.text, texts, side="right") + 1

    def _level(self, at: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Symbols:
        out = object.__new__(Symbols)
        out.name, out.text, out.lo, out.hi, out.first, out.last = name, self.text[at], lo, hi, self.first, self.last
        return out

    def _before(self, at: np.ndarray) -> np.ndarray:
        """Where the stretch of the symbol before each begins, or the place before the text."""
        return np.maximum(self.lo[at - 1], self.first[self.text[at]]) if len(at) else at

    def _after(self, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(self.name) - 1)
        beyond = self.last[self.text[at]]
        return np.where(self.text[nxt] == self.text[at], np.minimum(self.hi[nxt], beyond), beyond)

    def runs(self, salt: int) -> Symbols:
        """Maximal runs of equal symbols become one; the symbols beside a run decide it too."""
        joins = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        first = np.concatenate([[0], np.flatnonzero(~joins) + 1])
        last = np.concatenate([first[1:] - 1, [len(self.name) - 1]])
        name = self.name[first]
        many = np.flatnonzero(last > first)
        size = (last[many] - first[many] + 1).astype(np.uint64)
        name[many] = pair(name[many], size + np.uint64(salt))
        lo = self._before(first)
        lo[0] = self.first[self.text[0]]
        return self._level(first, name, lo, self._after(last))

    def pairs(self, bit: int) -> Symbols:
        """A left symbol and the right one after it become one symbol."""
        n = len(self.name)
        right = (self.name >> np.uint64(bit)) & np.uint64(1) == 1
        opens = np.zeros(n, bool)
        opens[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        closes = np.concatenate([[False], opens[:-1]])
        at = np.flatnonzero(~closes)
        name, lo = self.name[at], self.lo[at]
        # A single left symbol is decided with the one after it, a single right one with that before.
        hi = np.where(right[at], self.hi[at], self._after(at))
        two = np.flatnonzero(opens[at])
        name[two] = pair(name[two], self.name[at[two] + 1] + np.uint64(bit))
        alone = np.flatnonzero(right[at])
        lo[alone] = self._before(at[alone])
        if right[0]:
            lo[0] = self.first[self.text[0]]
        return self._level(at, name, lo, hi)


def holders(words: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the digest of the stretch of the symbol that holds each, and
    whether that is another place than the window before has."""
    n = len(words.digest)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    starts = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
    levels = [Symbols(words)]
    for r in range(1, rounds + 1):
        levels.append(levels[-1].runs(r).pairs(r))
    lo, hi = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    left = np.arange(len(starts))
    for level in range(rounds, -1, -1):
        if not len(left):
            break
        s = levels[level]
        p = starts[left]
        # Stretches begin and end in the order of the symbols: those inside a window are neighbours.
        a = np.cumsum(np.bincount(s.lo + 1, minlength=n + 1))[p]
        b = np.cumsum(np.bincount(s.hi, minlength=n + 1))[p + window] - 1
        safe = a <= b
        chosen = _least(mix(s.name), a[safe], b[safe])
        lo[left[safe]], hi[left[safe]] = s.lo[chosen], s.hi[chosen]
        left = left[~safe]
    value, new = _stretch(words.digest, lo, hi)
    return starts, value, new


def _stretch(digest: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of stretches of words, from sums of all words' digests times powers; and where
    a stretch differs from the one before."""
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    a, b = lo[new], hi[new]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(digest) + 1, _BASE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * power[:-1])])
        back = np.cumprod(np.full(len(digest) + 1, _BACK, np.uint64))
        value = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))
    return value[np.cumsum(new) - 1], new


_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the least value in each range, the first of equal ones."""
    if not len(a):
        return a
    bits = np.uint64(max(1, len(order)).bit_length())
    table = ((order >> bits) << bits) | np.arange(len(order), dtype=np.uint64)
    size = b - a + 1
    log = np.frexp(size.astype(np.float32))[1] - 1
    out = np.empty(len(a), np.uint64)
    for k in range(int(log.max()) + 1):
        fits = np.flatnonzero(log == k)
        out[fits] = np.minimum(table[a[fits]], table[b[fits] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return (out & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _holder_counts(texts: Texts, _) -> tuple[np.ndarray, np.ndarray]:
    """Holding symbols of the chunk and how often each occurs in it, twice at most."""
    _, held, new = holders(Words(texts.bytes))
    if not len(held):
        return held, np.zeros(0, np.uint8)
    keys, counts = np.unique(held[new], return_counts=True)
    return keys, np.minimum(counts, 2).astype(np.uint8)


class _Windows:
    """The windows of a chunk that may repeat: digests, check digests, ids and starts in the text."""

    def __init__(self, texts: Texts, answers):
        self.words = Words(texts.bytes)
        starts, held, _ = holders(self.words)
        shared, _ = merged_counts(answers)
        self.starts = starts[lookup(held, shared) >= 0]
        w = self.words
        self.key = digest_of_runs(w.digest, WINDOW)[self.starts] if len(starts) else np.zeros(0, np.uint64)
        self.check = (digest_of_runs(w.digest, WINDOW, 0x2545F491)[self.starts] if len(starts) else self.key).astype(np.uint32)
        first_word = np.searchsorted(w.text, np.arange(len(texts.bytes)))
        text = w.text[self.starts]
        self.id = texts.ids[text]
        self.place = self.starts - first_word[text]


def _first(key, check, id_, place) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by key, check, id and place, and where a new key and check begins in it."""
    order = np.lexsort((place, id_, check, key))
    k, c = key[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


def _window_question(texts: Texts, answers) -> list[np.ndarray]:
    w = _Windows(texts, answers)
    order, new = _first(w.key, w.check, w.id, w.place)
    at = order[new]
    return [w.key[at], w.check[at], w.id[at], w.place[at].astype(np.int32)]


def _window_reply(chunks, bodies):
    """To each chunk the first occurrence of the windows that it doesn't hold itself."""
    key, check, id_, place = (np.concatenate([b[i] for b in bodies]) for i in range(4))
    chunk = np.repeat(np.array(chunks), [len(b[0]) for b in bodies])
    order, new = _first(key, check, id_, place)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (id_[order] != id_[head]) | (place[order] != place[head])
    order, head = order[later], head[later]
    by = np.argsort(chunk[order], kind="stable")
    order, head = order[by], head[by]
    owners, begins = np.unique(chunk[order], return_index=True)
    for owner, a, b in zip(owners.tolist(), begins, [*begins[1:], len(order)], strict=True):
        h = head[a:b]
        yield owner, [key[h], check[h], id_[h], place[h]]


def _removed(texts: Texts, counts, firsts) -> tuple[Words, np.ndarray]:
    """The words of a chunk and whether each is covered by a window that starts earlier elsewhere."""
    w = _Windows(texts, counts)
    gone = np.zeros(len(w.words.digest) + 1, np.int64)
    if len(w.starts):
        order, new = _first(w.key, w.check, w.id, w.place)
        group = np.cumsum(new) - 1
        heads = order[new]
        first_id, first_place = w.id[heads].copy(), w.place[heads].copy()
        if firsts:
            key, check, id_, place = (np.concatenate([a[i] for a in firsts]) for i in range(4))
            by = np.lexsort((check, key))
            key, check, id_, place = key[by], check[by], id_[by], place[by]
            # Both are sorted by key and check; equal keys with other checks are next to each other.
            at = np.searchsorted(key, w.key[heads], side="left")
            for _ in range(2):
                ok = at < len(key)
                hit = ok.copy()
                hit[ok] = (key[at[ok]] == w.key[heads][ok]) & (check[at[ok]] == w.check[heads][ok])
                first_id[hit], first_place[hit] = id_[at[hit]], place[at[hit]]
                at = at + 1
        late = (w.id[order] != first_id[group]) | (w.place[order] != first_place[group])
        starts = w.starts[order[late]]
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + WINDOW, -1)
    return w.words, np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (ranges of words, ends
    excluded) and ``kept``, the other words joined by single spaces.

    Three exchanges of packed keys: which holding symbols repeat, where each window that one
    of them holds comes first, and the answers.  Texts meet the answers by chunk.
    """
    scratch = Scratch(docs.sparkSession, "recompression")
    chunked, n = chunks_of(id_and_text(docs, id_col, text_col))
    counts = scratch.store(answer(ask(chunked, _holder_counts, n), shared_counts))
    firsts = scratch.store(answer(ask(chunked, _window_question, n, counts), _window_reply))
    both = counts.selectExpr("chunk", "concat(X'00', body) as body").unionAll(
        firsts.selectExpr("chunk", "concat(X'01', body) as body")
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        known: tuple[list, list] = ([], [])
        for raw in right.column("body").to_pylist():
            known[raw[0]].append(unpack(raw[1:]))
        words, gone = _removed(texts, *known) if left.num_rows else (Words([]), np.zeros(0, bool))
        edges = np.searchsorted(words.text, np.arange(len(texts.bytes) + 1))
        n_words, n_removed, kept, ranges = [], [], [], []
        for i, raw in enumerate(texts.bytes):
            parts, mark = raw.split(), gone[edges[i] : edges[i + 1]]
            n_words.append(len(parts))
            n_removed.append(int(mark.sum()))
            if n_removed[-1]:
                steps = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0)).tolist()
                ranges.append([{"start": a, "end": b} for a, b in zip(steps[::2], steps[1::2], strict=True)])
                parts = [p for p, m in zip(parts, mark.tolist(), strict=True) if not m]
            else:
                ranges.append([])
            kept.append(b" ".join(parts).decode())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            {
                "doc_id": texts.column,
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "removed": pa.array(ranges, kind),
                "kept": pa.array(kept, pa.string()),
            }
        )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string"
    return chunked.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema)
