"""Substring deduplication with an enhanced suffix array and its common-prefix intervals.

Texts are UTF-8 bytes.  A repeat is a string of at least ``MIN`` bytes that occurs twice.

Suffix arrays of a corpus don't fit a task, so suffixes that can share ``MIN`` bytes are
brought together first.  Each string of ``MIN`` bytes has one anchor, the leftmost of its
least ``GRAM``-byte grams by digest; equal strings have equal anchors at equal places.
Consecutive strings with one anchor form a context, some 60 bytes long.  An exchange of
packed digests finds the anchors that repeat; a second one sends the distinct contexts of
those, once per chunk, to the bucket of their anchor.

A bucket sorts the suffixes of its contexts, takes the common prefix lengths of neighbours,
and scans them with a stack.  That visits the intervals of the common-prefix tree: an
interval of length at least ``MIN`` is a repeated string with all its occurrences.  It is
reported if it is left-diverse, so that no longer string to the left stands for it: its
occurrences are preceded by different bytes, or one of them begins a context, before which
the context before it goes on.  A repeat that is longer than a context comes out as
overlapping groups, one per anchor.

An anchor that more than ``HOT`` places share is dealt by whole strings of ``MIN`` bytes
instead: each chunk sends a string once, and strings spread over buckets by digest, so
neither a frequent passage nor the many texts around it meet in one task.

A null text is empty.  A null id is that of the last document; rows with one id are one
document, which takes nothing from itself.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import _BYTE, Scratch, id_and_text, mix
from cashtide.llm.exchange import Texts, answer, ask, by_bucket, chunks_of, lookup, merged_counts, pack, shared_counts, unpack

MIN = 50
GRAM = 20
HOT = 4096
CHUNK = 2 << 20
_P = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))


class Sums:
    """Digests of any stretch of bytes, from sums of byte digests times powers."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if Sums._powers is None or len(Sums._powers[0]) < n:
            with np.errstate(over="ignore"):
                size = max(n, 1 << 16)
                one = np.ones(1, np.uint64)
                Sums._powers = tuple(
                    np.concatenate([one, np.cumprod(np.full(size, x, np.uint64))]) for x in (_STEP, _BACK)
                )
        power, self.back = Sums._powers
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: n - 1])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[begin]) * self.back[begin])

    def runs(self, length: int) -> np.ndarray:
        """Of every stretch of one length; scrambled only as much as choosing a least one needs."""
        n = len(self.total) - length
        with np.errstate(over="ignore"):
            x = (self.total[length:] - self.total[:n]) * self.back[:n]
            return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class Contexts:
    """The contexts of a chunk: where each begins and ends, its anchor's digest and its text."""

    def __init__(self, texts: Texts):
        self.texts = texts
        sizes = np.array([len(b) + 1 for b in texts.bytes], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = np.frombuffer(b"\0".join(texts.bytes) + b"\0", np.uint8)
        self.sums = Sums(self.raw)
        n = len(self.raw)
        none = np.zeros(0, np.int64)
        self.begin, self.end, self.text, self.key = none, none, none, np.zeros(0, np.uint64)
        if n < MIN:
            return
        grams = self.sums.runs(GRAM)
        bits = np.uint64(n.bit_length())
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        reach, width = MIN - GRAM + 1, 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[: width - reach], low[reach - width :])
        anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # Strings that lie within their text.
        text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - MIN, 0))
        first = np.cumsum(np.maximum(sizes - MIN, 0)) - np.maximum(sizes - MIN, 0)
        start = np.arange(len(text)) - first[text] + self.offset[text]
        if not len(start):
            return
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(start)) - 1
        self.begin, self.end, self.text = start[at], start[last] + MIN, text[at]
        self.key = mix(grams[anchor[at]])

    def select(self, known: np.ndarray, totals: np.ndarray) -> None:
        """Keep contexts of repeated anchors; those of hot ones fall into single strings."""
        at = lookup(self.key, known)
        use = at >= 0
        hot = use & (totals[np.maximum(at, 0)] > HOT) if len(known) else use
        size = np.where(hot, self.end - self.begin - MIN + 1, 1)[use]
        piece = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hot = np.repeat(hot[use], size)
        begin, end = np.repeat(self.begin[use], size), np.repeat(self.end[use], size)
        self.begin = begin + piece
        self.end = np.where(hot, self.begin + MIN, end)
        self.text = np.repeat(self.text[use], size)
        self.digest = self.sums.of(self.begin, self.end)
        self.key = np.where(hot, self.digest, np.repeat(self.key[use], size))

    def records(self) -> None:
        """Distinct contexts in the order of key and digest, and the record of each context."""
        ids = self.texts.ids[self.text]
        order = np.lexsort((ids, self.digest, self.key))
        k, d = self.key[order], self.digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        self.order, self.heads = order, heads
        self.sizes = np.diff(np.append(heads, len(order)))
        self.rec_at = order[heads]
        self.rec_key = self.key[self.rec_at]
        self.first, self.last = ids[order[heads]], ids[order[heads + self.sizes - 1]] if len(heads) else ids


def _gram_question(texts: Texts, _) -> list[np.ndarray]:
    keys, counts = np.unique(Contexts(texts).key, return_counts=True)
    return [keys, counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))]


def _repeated(texts: Texts, answers) -> Contexts:
    c = Contexts(texts)
    c.select(*merged_counts(answers))
    c.records()
    return c


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after the other."""
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return raw[at]


def _context_rows(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows:
            texts = Texts(left)
            c = _repeated(texts, [unpack(b) for b in right.column("body").to_pylist()])
            size = c.end[c.rec_at] - c.begin[c.rec_at]
            number = np.arange(len(size))
            for bucket, (key, which) in by_bucket(c.rec_key, buckets, number):
                raw = _gather(c.raw, c.begin[c.rec_at[which]], size[which])
                body = pack(key, c.first[which], c.last[which], (c.sizes[which] > 1).astype(np.uint8), size[which].astype(np.uint16), raw)
                found.append((bucket, texts.chunk, body))
        return pa.table(
            {
                "bucket": pa.array([f[0] for f in found], pa.int32()),
                "chunk": pa.array([f[1] for f in found], pa.int32()),
                "body": pa.array([f[2] for f in found], pa.binary()),
            }
        )

    return run


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """First and last suffix and length of every interval of the common-prefix tree whose
    suffixes share at least ``least`` bytes; ``lcp[i]`` is shared by suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        length = lcp[i] if i < len(lcp) else 0
        if length < least:
            length = 0
        begin = i - 1
        while stack and stack[-1][1] > length:
            begin, shared = stack.pop()
            yield begin, i - 1, shared
        if length and (not stack or stack[-1][1] < length):
            stack.append((begin, length))


def suffix_groups(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray):
    """Repeats among distinct contexts of ``raw``: arrays of (interval, context, offset) and,
    by interval, its length.  Suffixes are those at least ``MIN`` long."""
    n = size - MIN + 1
    context = np.repeat(np.arange(len(size)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = begin[context] + offset
    # Only strings whose first MIN bytes occur twice can be in an interval.
    with np.errstate(over="ignore"):
        first = Sums(raw).of(start, start + MIN) ^ key[context]
    order = np.argsort(first, kind="stable")
    f = first[order]
    twice = np.zeros(len(f), bool)
    if len(f) > 1:
        same = f[1:] == f[:-1]
        twice[1:] |= same
        twice[:-1] |= same
    pick = np.sort(order[twice])
    context, offset, start = context[pick], offset[pick], start[pick]
    length = size[context] - offset
    none = np.zeros(0, np.int64)
    if not len(pick):
        return none, none, none, none
    width = -(-int(length.max()) // 8) * 8
    at = start[:, None] + np.arange(width)
    letters = np.where(np.arange(width) < length[:, None], raw[np.minimum(at, len(raw) - 1)], 0)
    words = np.ascontiguousarray(letters.astype(np.uint8)).view(">u8").astype(np.uint64)
    order = np.lexsort(tuple([length, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1))]))
    letters, context, offset, start, length = letters[order], context[order], offset[order], start[order], length[order]
    differ = letters[1:] != letters[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.minimum(shared, np.minimum(length[1:], length[:-1]))
    found = list(prefix_intervals([0, *shared.tolist()], MIN))
    if not found:
        return none, none, none, none
    lb, rb, depth = (np.array(x, np.int64) for x in zip(*found, strict=True))
    # Left diversity: another byte before some occurrence than before the one ahead of it in
    # the array, or an occurrence that begins its context.
    before = np.where(offset > 0, raw[np.maximum(start - 1, 0)].astype(np.int64), -1)
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    edge = np.concatenate([[0], np.cumsum(before == -1)])
    diverse = (change[rb] > change[lb]) | (edge[rb + 1] > edge[lb])
    lb, rb, depth = lb[diverse], rb[diverse], depth[diverse]
    n = rb - lb + 1
    member = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lb, n)
    return np.repeat(np.arange(len(n)), n), context[member], offset[member], depth


def _repeat_reply(every: bool):
    """To each chunk, for its records: stretches of a context that occur elsewhere, the least
    id that has each, and a name of the repeated string.  Without ``every``, only stretches
    that a smaller id has."""

    def reply(chunks, bodies):
        key, first, last, many, size, raw = (np.concatenate([b[i] for b in bodies]) for i in range(6))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        digest = Sums(raw).of(begin, begin + size)
        # Distinct contexts: the same bytes from several chunks are one.
        order = np.lexsort((first, digest, key))
        k, d = key[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[heads]
        least = first[one]
        copies = np.bincount(group) + np.maximum.reduceat(many[order], heads)
        # The whole context, where it occurs twice.
        rec = np.flatnonzero(copies[group] > 1)
        parts = [(rec, np.zeros(len(rec), np.int64), size[rec], least[group[rec]], digest[rec])]
        # Anchors with several contexts: the suffix array.
        alone = np.ones(len(one), bool)
        same = key[one][1:] == key[one][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        some = one[~alone]
        if len(some):
            interval, context, offset, depth = suffix_groups(raw, begin[some], size[some], key[some])
            if len(interval):
                which = np.flatnonzero(~alone)[context]
                low = np.full(len(depth), np.iinfo(np.int64).max)
                np.minimum.at(low, interval, least[which])
                head = np.searchsorted(interval, np.arange(len(depth)))
                at = begin[one[which[head]]] + offset[head]
                name = Sums(raw).of(at, at + depth)
                # From distinct contexts back to the records that have them.
                by = np.argsort(group, kind="stable")
                edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(one)))])
                n = np.diff(edges)[which]
                rec = by[np.repeat(edges[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                i = np.repeat(interval, n)
                parts.append((rec, np.repeat(offset, n), depth[i], low[i], name[i]))
        rec, start, length, low, name = (np.concatenate([p[j] for p in parts]) for j in range(5))
        if not every:
            use = last[rec] > low
            rec, start, length, low, name = rec[use], start[use], length[use], low[use], name[use]
        edges = np.concatenate([[0], np.cumsum([len(b[0]) for b in bodies])])
        order = np.argsort(rec, kind="stable")
        rec, start, length, low, name = rec[order], start[order], length[order], low[order], name[order]
        cuts = np.searchsorted(rec, edges)
        for i, chunk in enumerate(chunks):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                arrays = [
                    key[edges[i] : edges[i] + 1], (rec[a:b] - edges[i]).astype(np.uint32), start[a:b].astype(np.uint16),
                    length[a:b].astype(np.uint16), low[a:b],
                ]
                yield chunk, arrays + [name[a:b]] * every

    return reply


def _occurrences(c: Contexts, replies):
    """Begin, length, least id and name of every repeated stretch in the chunk, by occurrence."""
    parts = []
    for first_key, rec, start, length, low, *name in replies:
        # A body holds the records of one bucket, which are next to each other from its first key.
        number = int(np.searchsorted(c.rec_key, first_key[0])) + rec.astype(np.int64)
        n = c.sizes[number]
        i = np.repeat(np.arange(len(rec)), n)
        at = c.order[np.repeat(c.heads[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        parts.append(
            (c.begin[at] + start.astype(np.int64)[i], length.astype(np.int64)[i], low[i], c.text[at], name[0][i] if name else low[i])
        )
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(5))


def _replies(docs: DataFrame, every: bool, id_col: str, text_col: str):
    scratch = Scratch(docs.sparkSession, "suffixes")
    chunked, n = chunks_of(id_and_text(docs, id_col, text_col), CHUNK)
    counts = scratch.store(answer(ask(chunked, _gram_question, n), shared_counts))
    sent = chunked.groupBy("chunk").cogroup(counts.groupBy("chunk"))
    sent = sent.applyInArrow(_context_rows(n), "bucket int, chunk int, body binary")
    repeats = scratch.store(answer(sent, _repeat_reply(every)))
    both = counts.select("chunk", F.lit(0).alias("kind"), "body").unionAll(repeats.select("chunk", F.lit(1).alias("kind"), "body"))
    return chunked.groupBy("chunk").cogroup(both.groupBy("chunk"))


def _answers(right: pa.Table) -> tuple[list, list]:
    known: tuple[list, list] = ([], [])
    for kind, raw in zip(right.column("kind").to_pylist(), right.column("body").to_pylist(), strict=True):
        known[kind].append(unpack(raw))
    return known


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All occurrences of the repeats: ``group`` (a digest of the repeated bytes), ``length``,
    ``doc_id`` and ``start``, in bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [np.zeros(0, np.int64)] * 4
        texts = Texts(left)
        if left.num_rows:
            counts, replies = _answers(right)
            c = _repeated(texts, counts)
            at, length, _, text, name = _occurrences(c, replies)
            rows = [name.astype(np.uint64).view(np.int64), length, text, at - c.offset[text]]
        ids = texts.column.take(pa.array(rows[2])) if len(rows[2]) else pa.array([], pa.int64())
        return pa.table({"group": pa.array(rows[0]), "length": pa.array(rows[1]), "doc_id": ids, "start": pa.array(rows[3])})

    grouped = _replies(docs, True, id_col, text_col)
    return grouped.applyInArrow(run, "group bigint, length bigint, doc_id bigint, start bigint").distinct()


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``removed`` (maximal runs of bytes
    in a repeat that a document with a smaller id has too, ends excluded) and ``kept``, the
    remaining bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        kept, ranges, removed = [], [], []
        if left.num_rows:
            counts, replies = _answers(right)
            c = _repeated(texts, counts)
            at, length, low, text, _ = _occurrences(c, replies)
            late = texts.ids[text] > low
            steps = np.zeros(len(c.raw) + 1, np.int32)
            np.add.at(steps, at[late], 1)
            np.add.at(steps, at[late] + length[late], -1)
            gone = np.cumsum(steps[:-1]) > 0
            for i, raw in enumerate(texts.bytes):
                mask = gone[c.offset[i] : c.offset[i] + len(raw)]
                n = int(mask.sum())
                removed.append(n)
                if not n:
                    kept.append(raw)
                    ranges.append([])
                    continue
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
                ranges.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(np.frombuffer(raw, np.uint8)[~mask].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": texts.column,
                "n_bytes": pa.array([len(b) for b in texts.bytes], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "removed": pa.array(ranges, kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    return _replies(docs, False, id_col, text_col).applyInArrow(run, schema)
