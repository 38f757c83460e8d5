"""Deduplication across texts, against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cashtide.llm.near_dedup import IDF_SPAN, near_duplicates
from cashtide.llm.recompression import remove_repeats
from cashtide.llm.suffix_dedup import remove_repeated_bytes, repeat_groups

DOCS = "doc_id long, text string"
LAST = 2**63 - 1
CLASH = ["chunk", "body", "bucket", "n_words", "kept", "removed", "bands", "class_id", "kind"]


def passages(seed, alphabet, count, join):
    """Texts made of shared passages, runs, periods and own parts, with repeated ids and nulls."""
    draw = random.Random(seed)
    base = [[draw.choice(alphabet) for _ in range(120)] for _ in range(5)]
    rows = []
    for i in range(count):
        parts = []
        for _ in range(draw.randint(0, 6)):
            k = draw.random()
            if k < 0.5:
                at = draw.randint(0, 90)
                parts += draw.choice(base)[at : at + draw.randint(1, 80)]
            elif k < 0.7:
                parts += [draw.choice(alphabet)] * draw.randint(1, 70)
            elif k < 0.8:
                parts += [draw.choice(alphabet), draw.choice(alphabet)] * draw.randint(1, 40)
            else:
                parts += [f"u{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 9))]
        rows.append((draw.choice([i, i, i, 5, None]), draw.choice(join).join(parts) if draw.random() > 0.02 else None))
    return rows


def plain_windows(rows, size=20):
    place = lambda i: LAST if i is None else i
    docs = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, words in docs:
        for p in range(len(words) - size + 1):
            key = tuple(words[p : p + size])
            first[key] = min(first.get(key, (LAST + 1, 0)), (place(i), p))
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - size + 1):
            if first[tuple(words[p : p + size])] < (place(i), p):
                gone.update(range(p, p + size))
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=str)


def test_repeated_windows_of_words(spark):
    rows = passages(3, ["a", "b", "cc", "the", "zż", *[f"w{k}" for k in range(30)]], 250, [" ", "  ", "\n", " \t"])
    frame = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame).collect()]
    assert sorted(got, key=str) == plain_windows(rows)
    assert remove_repeats(frame.limit(0)).count() == 0


def plain_bytes(rows, size=50):
    place = lambda i: LAST if i is None else i
    docs = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in docs:
        for p in range(len(raw) - size + 1):
            first[raw[p : p + size]] = min(first.get(raw[p : p + size], LAST + 1), place(i))
    out = []
    for i, raw in docs:
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if first[raw[p : p + size]] < place(i):
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def letters():
    return passages(4, list("abcdé fgh\n\0"), 200, [""])


def test_repeated_bytes(spark, letters):
    frame = spark.createDataFrame(letters, DOCS).select("*", *[F.lit(1).alias(c) for c in CLASH])
    found = remove_repeated_bytes(frame).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256))
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_bytes(letters)
    assert remove_repeated_bytes(frame.limit(0)).count() == 0


def test_groups_hold_all_occurrences_of_a_repeat(spark, letters):
    texts = {i: (t or "").encode() for i, t in letters if i not in (5, None)}
    groups = collections.defaultdict(set)
    kept = [(i, t) for i, t in letters if i in texts]
    for r in repeat_groups(spark.createDataFrame(kept, DOCS)).collect():
        groups[r.group, r.length].add((r.doc_id, r.start))
    covered = collections.defaultdict(set)
    for (_, length), places in groups.items():
        strings = {texts[d][s : s + length] for d, s in places}
        assert len(strings) == 1 and length >= 50 and len(places) > 1
        for d, s in places:
            covered[d].update(range(s, s + length))
    counts = collections.Counter(t[p : p + 50] for t in texts.values() for p in range(len(t) - 49))
    for d, t in texts.items():
        repeated = {j for p in range(len(t) - 49) if counts[t[p : p + 50]] > 1 for j in range(p, p + 50)}
        assert covered[d] == repeated


def plain_classes(rows):
    n = len(rows)

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}

    sets = {i: shingles(t) for i, t in rows}
    df = collections.Counter(k for s in sets.values() for k in s)
    idf = {k: 1 + IDF_SPAN * math.log((1 + n) / (1 + f)) / math.log(1 + n) for k, f in df.items()}
    weights = {i: {k: c * idf[k] for k, c in s.items()} for i, s in sets.items()}
    label = {i: i for i in weights}
    for i in weights:
        for j in weights:
            if i < j:
                inter = sum(min(w, weights[j].get(k, 0)) for k, w in weights[i].items())
                union = sum(weights[i].values()) + sum(weights[j].values()) - inter
                if union and inter >= 0.8 * union:
                    a, b = sorted((label[i], label[j]))
                    label = {k: a if v == b else v for k, v in label.items()}
    return label


def test_classes_of_near_duplicates(spark):
    draw = random.Random(9)
    base = [" ".join(f"w{draw.randint(0, 300)}" for _ in range(draw.choice([3, 30, 80, 150]))) for _ in range(9)]
    rows = []
    for i in range(160):
        words = draw.choice(base).split()
        for _ in range(min(draw.choice([0, 0, 1, 2, 4, 8]), len(words))):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(700, ""), (701, None), (702, " \n"), (703, "one two"), (704, "one two"), (705, "one TWO ")]
    frame = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in CLASH])
    found = near_duplicates(frame).collect()
    want = plain_classes(rows)
    assert {r.doc_id: r.class_id for r in found} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_classes_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, "other words"), (3, text), (4, None)]
    found = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    assert [r.class_id for r in found if r.doc_id is None] == [None] and all(r.kept for r in found if r.doc_id is None)
    assert {r.class_id for r in found if r.doc_id == 2} == {1} and {r.class_id for r in found if r.doc_id == 4} == {4}
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_all_pairs_of_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_classes([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == want
    assert len(set(want.values())) < len(want)
