"""Runs of repeated word sequences inside texts, from Lyndon arrays under both orders.

A run is a stretch of consecutive words with smallest period ``q``, so that words ``q`` apart
are equal, that no neighbouring word extends.  Every run has Lyndon roots, words of length
``q`` that start in it, under the order of the words or under the inverse one: such a root
is the longest Lyndon word at its place (the "runs" theorem).

The first phase of Baier's suffix sorter gives those lengths directly.  It keeps suffixes in
ordered groups that share a context, and takes the groups from the greatest down: each
suffix of a group looks for the nearest place to its left in a smaller group, whose context
grows by that of the group.  When a group is taken, its context is the longest Lyndon word
at its places.  Extending each root to both sides by common prefixes and suffixes of the
places ``q`` apart (LCE) gives the runs.

Runs shorter than ``least`` words or ``times`` periods are not asked for, and in all others
each eight words occur a second time in the text.  So the sorter works on the stretches of
a text whose eight-word grams repeat; a maximal stretch holds its runs whole.

Each text is one row of one pass; nothing is shuffled.  Memory is a small multiple of the
longest text, time nearly linear in it.  A null text has no words; rows that repeat are
judged each; null ids stay null; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import digest_of_runs, id_and_text, mix

GRAM = 8
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(ranks: list[int]) -> np.ndarray:
    """The length of the longest Lyndon word at each place: phase one of Baier's suffix sorter."""
    n = len(ranks)
    # Groups are numbered as they come; `lower` and `upper` link them in their order.
    values = sorted(set(ranks))
    number = {v: g for g, v in enumerate(values)}
    group = [number[v] for v in ranks]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * len(values)
    lower = list(range(-1, len(values) - 1))
    upper = [*range(1, len(values)), -1] if values else []
    left = list(range(-1, n - 1))  # towards the nearest place to the left that is not done
    done = bytearray(n)
    out = np.zeros(n, np.int64)
    g = len(values) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        size = context[g]
        for i in own:
            done[i] = 1
            out[i] = size
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            while j >= 0 and done[j]:  # halving the path for later searches
                left[i] = j = left[j]
                i = j
                if j >= 0 and done[j]:
                    j = left[j]
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((-k, group[j]), []).append(j)
        for (k, old), places in sorted(moved.items()):
            new = len(context)  # the next greater group after the old one
            context.append(context[old] - k * size)
            members.append(places)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
            for j in places:
                group[j] = new
        g = lower[g]
    return out


def _extent(a: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch with period ``q`` around the places i .. i+q, by doubling steps."""

    def same(at: int, step: int) -> int:
        length, width = 0, 16
        while True:
            if step > 0:
                x, y = a[at + length : at + length + width], a[at + q + length : at + q + length + width]
                x = x[: len(y)]
            else:
                x = a[max(0, at - length - width + 1) : max(0, at - length + 1)][::-1]
                y = a[max(0, at + q - length - width + 1) : max(0, at + q - length + 1)][::-1][: len(x)]
            differ = np.flatnonzero(x != y)
            if len(differ):
                return length + int(differ[0])
            length += len(x)
            if len(x) < width:
                return length
            width *= 2

    return i - same(i - 1, -1), i + q + same(i, 1)


def runs_of(ids: np.ndarray, grams: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs among equal-or-not numbers; ``grams`` as in ``find_runs``."""
    n, found = len(ids), set()
    for sign in (1, -1):
        roots = lyndon_lengths((sign * ids).tolist())
        at = np.arange(n)
        fits = at + roots < n
        at, roots = at[fits], roots[fits]
        # A run this long has eight words that repeat one period on, after the root or before it.
        ahead, back = np.minimum(at, len(grams) - 1), np.maximum(at - GRAM, 0)
        good = (grams[ahead] == grams[np.minimum(ahead + roots, len(grams) - 1)]) & (at + roots < len(grams))
        good |= (grams[back] == grams[np.minimum(back + roots, len(grams) - 1)]) & (at >= GRAM)
        at, roots = at[good], roots[good]
        end: dict[int, int] = {}
        for i, q in zip(at.tolist(), roots.tolist(), strict=True):
            if i + q <= end.get(q, 0):
                continue  # inside the last run of this period
            a, b = _extent(ids, i, q)
            if b - a >= 2 * q:
                end[q] = b
                if b - a >= max(least, times * q):
                    found.add((a, b - a, q))
    return found


def find_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """The runs of a text by start, then period: (start, length, period)."""
    if least < 3 * GRAM or times < 3:
        raise ValueError("grams of eight words only find runs of at least 24 words and 3 periods")
    n = len(words)
    if n < least:
        return []
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    grams = digest_of_runs(mix(ids.astype(np.uint64) + np.uint64(1)), GRAM)
    order = np.argsort(grams, kind="stable")
    equal = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(grams) + 2, bool)
    again[order[1:][equal] + 1] = True
    again[order[:-1][equal] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    out: list[tuple[int, int, int]] = []
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a + GRAM - 1 >= least:
            part = slice(a, b + GRAM - 1)
            _, dense = np.unique(ids[part], return_inverse=True)
            out += [(a + s, length, q) for s, length, q in runs_of(dense, grams[a:b], least, times)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_words``, its ``runs`` of at least ``least`` words and ``times``
    periods, by start and then period, and the text ``collapsed`` to what no run repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \t \n \v \f \r and space only
                found = find_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of ties the first."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x), b).otherwise(a)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one document in ten repeats a part of itself to its end.

    Which one, from where and how often follow from a checksum of its id; a document without
    an id stays as it is.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        # The arrays are bound once, as arguments of the outer lambda.
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(h % 10 == 0, F.coalesce(changed, F.lit(""))).otherwise(F.col("text")).alias("text"))
