"""Different texts under one id are different documents."""

import random

from corpus_pipeline import near_dedup

RNG = random.Random(5)
TEXTS = [" ".join(RNG.choices([f"word{i}" for i in range(500)], k=60)) for _ in range(6)]
A, B, C, D, E, G = TEXTS


def test_texts_under_one_id(spark):
    rows = [(1, A), (2, A), (2, B), (3, C), (3, D), (4, E), (4, E), (5, E + " more"), (None, A), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in near_dedup(spark, docs, "").collect()), key=str)
    want = [(1, A), (2, B), (3, C), (3, D), (4, E), (None, A), (6, "")]
    assert got == sorted(want, key=str)


def test_repeated_rows_and_copies(spark):
    docs = spark.createDataFrame([(7, G), (7, G), (8, G), (9, A)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in near_dedup(spark, docs, "").collect())
    assert got == [(7, G), (9, A)]
