"""The metric range join against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide.llm.metric_join import embedding_duplicates, forest

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold):
    """(id, links, component, kept) of each row by comparing all pairs."""
    sound = [label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    n, near = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(n):
        seen, ahead = {i}, [i]
        while ahead:
            new = near[ahead.pop()] - seen
            seen |= new
            ahead += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def got(frame, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame, **options).collect()), key=str)


def test_forest_spans_every_component():
    draw = np.random.default_rng(1)
    for _ in range(200):
        links = draw.random((draw.integers(1, 9), draw.integers(1, 9))) < 0.25
        root = {("r", i): ("r", i) for i in range(links.shape[0])} | {("c", i): ("c", i) for i in range(links.shape[1])}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in forest(links):
            assert links[i, j] and find(("r", i)) != find(("c", j))
            root[find(("r", i))] = find(("c", j))
        assert all(find(("r", i)) == find(("c", j)) for i, j in np.argwhere(links))


@pytest.mark.parametrize("cell,block", [(2048, 2048), (8, 5), (20, 3)])
def test_links_equal_all_pairs(spark, cell, block):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(260):
        v = centres[i % 6] + draw.normal(size=8) * draw.choice([0.05, 0.2, 0.5])
        rows.append((i * 3 % 260, v.tolist(), int(i % 4 == 0)))
    hot = centres[0].tolist()
    rows += [(1000 + i, hot, 0) for i in range(60)]  # copies
    rows += [(2000 + i, (np.array(hot) * (i + 1)).tolist(), 0) for i in range(9)]  # other lengths
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame, cell=cell, block=block) == brute(rows, 0.93)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [], 1), (8, [1.0, None], 1), (9, [1.0, math.nan], 1),
        (10, [math.inf, 0.0], 1), (11, [1.0], 1), (12, [1e300, 1e297], 1), (13, [1e-300, 0.0], 1), (None, [0.0, 1.0], 1),
        (None, [0.0, 1.0], 1), (14, [-1.0, -0.0], 1), (15, [1.0, 0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = frame.select("*", *[F.lit("x").alias(c) for c in ("node", "n", "vec", "cell", "kept", "k1", "size", "dim")])
    assert got(extra) == brute(rows, 0.93)
    assert got(extra.limit(0)) == []


def test_a_component_that_is_a_chain_and_a_hot_one(spark):
    step = math.acos(0.93) * 0.99
    rows = [(500 - i, [math.cos(i * step), math.sin(i * step), 0.0], 0) for i in range(12)]
    draw = np.random.default_rng(3)
    rows += [(1000 + i, (np.array([0.0, 0.0, 1.0]) + draw.normal(size=3) * 0.05).tolist(), 0) for i in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA), cell=16, block=32) == brute(rows, 0.93)
