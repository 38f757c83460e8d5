"""Runs of words against a search over all periods and places."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cashtide.llm.periodic_runs import find_runs, lyndon_lengths, periodic_runs
from cashtide.llm.queries import op12_rows


def plain_lyndon(a):
    """The longest prefix of each suffix that is smaller than all its own proper suffixes."""
    out = []
    for i in range(len(a)):
        out.append(max(n for n in range(1, len(a) - i + 1) if all(a[i : i + n] < a[i + k : i + n] for k in range(1, n))))
    return out


def plain_runs(words, least=24, times=3):
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def repetitive(draw, size):
    out = []
    while len(out) < size:
        root = [draw.choice("abc") for _ in range(draw.randint(1, 12))]
        out += (root * draw.randint(1, 12))[: draw.randint(1, 90)]
        if draw.random() < 0.4:
            out.append(draw.choice("xyz"))
    return out[:size]


def test_lyndon_lengths_equal_their_definition():
    draw = random.Random(1)
    assert lyndon_lengths([]).tolist() == []
    for _ in range(1500):
        a = [draw.randint(0, draw.choice([0, 1, 2, 5])) for _ in range(draw.randint(1, 24))]
        assert lyndon_lengths(a).tolist() == plain_lyndon(a)
        assert lyndon_lengths([-x for x in a]).tolist() == plain_lyndon([-x for x in a])


def test_runs_equal_a_plain_search():
    draw = random.Random(2)
    some = 0
    for _ in range(600):
        words = repetitive(draw, draw.randint(0, 260))
        assert find_runs(words) == plain_runs(words)
        some += len(plain_runs(words)) > 1
    assert some > 100


@pytest.mark.parametrize("root", [["a"], ["a", "b"], [f"w{i}" for i in range(977)], ["a"] * 40 + ["b"]])
def test_very_long_texts(root):
    words = (root * (200_000 // len(root) + 1))[:200_000]
    assert (0, 200_000, len(root)) in find_runs(words)


def test_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 20_000:
        a, b = b, b + a
    assert find_runs(b[:2500]) == plain_runs(b[:2500])
    assert find_runs(b)


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *head, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(kept))


def test_the_query_on_odd_and_planted_rows(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(repetitive(draw, draw.randint(0, 120)))) for i in range(150)]
    rows += [(i, " ".join(draw.choice(["un", "deux\n", "trois"]) + str(draw.randint(0, 40)) for _ in range(200))) for i in range(200, 300)]
    rows += [(None, "a " * 30), (None, None), (1, ""), (1, ""), (5, None), (6, " \t\n"), (7, " x y\x1cz " * 30), (-3, "é ü \x0b" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["n_words", "runs", "collapsed", "start", "best", "h"]
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = op12_rows(frame.select("*", *[F.lit("x").alias(c) for c in extra])).select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert periodic_runs(frame.limit(0)).count() == 0
