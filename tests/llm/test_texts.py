"""Operators that judge each text on its own, against plain versions of them."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_pipeline import personal_data
from pyspark.sql import functions as F

from cashtide.llm.decontaminate import find_contamination
from cashtide.llm.personal_data import BASE, find_personal_data, personal_data_digest, redacted, written
from cashtide.llm.piece_segmentation import Encoder, Lattice, decode_pieces, encode_pieces, piece_scores
from cashtide.llm.quality_rules import fit_rules, judge_quality, text_statistics
from cashtide.llm.token_counts import LongestMatch, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with results."""
    rows = [(1, "The cat."), (1, "The cat."), (2, ""), (3, None), (None, "null id"), (4, "word " * 20000), (5, " \n\t")]
    frame = spark.createDataFrame(rows, DOCS)
    extra = ["n_words", "n_tokens", "words", "spans", "_0", "score", "hits", "bad", "rule", "kept", "body", "chunk"]
    return frame.select("*", *[F.lit("x").alias(c) for c in extra])


def greedy(pieces, word):
    i = n = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in pieces:
                i, n = j, n + 1
                break
        else:
            i, n = i + 1, n + len(word[i].encode())
    return n


def test_longest_match_counts_as_greedy_search_does():
    draw = random.Random(1)
    for _ in range(800):
        pieces = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 9))}
        word = "".join(draw.choice("abéc") for _ in range(draw.randint(0, 15)))
        assert LongestMatch(pieces).count(word) == greedy(pieces, word)


def test_token_counts_of_odd_rows(odd):
    rows = token_counts(odd, PIECES).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 2, 2, 2, 20000]
    assert token_counts(odd.limit(0), PIECES).count() == 0


def plain_hits(text, windows):
    words = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    hit, items = set(), set()
    for item, window in windows:
        for i in range(len(words) - len(window) + 1):
            if words[i : i + len(window)] == window:
                hit.update(range(i, i + len(window)))
                items.add(item)
    return len(words), len(hit), items


@pytest.mark.parametrize("automaton_bytes", [4_000_000, 60])
def test_contamination_matches_a_search_for_every_window(spark, monkeypatch, automaton_bytes):
    monkeypatch.setattr("cashtide.llm.decontaminate.AUTOMATON_BYTES", automaton_bytes)
    draw = random.Random(2)
    items = [(i, " ".join(draw.choice("abcde") for _ in range(draw.choice([0, 3, 10, 14])))) for i in range(12)]
    items += [(3, "Æsop, b!  C"), (None, "zz zz"), (20, None)]
    docs = [(i, draw.choice([" ", ", "]).join(draw.choice(["a", "B", "c", "æsop", "zz"]) for _ in range(draw.randint(0, 40)))) for i in range(60)]
    docs += [(90, None), (None, "æsop b c"), (91, "")]
    # Only A-Z are lowered, so the accented capital of an item stays.
    windows = []
    for item, text in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        windows += [(item, words[i : i + 10]) for i in range(max(1, len(words) - 9))] if words else []
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(frame, bench).collect()
    want = []
    for doc, text in docs:
        n, hit, found = plain_hits(text or "", windows)
        want.append((doc, n, hit, sorted({str(i) for i in found if i is not None}) if hit else []))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        text = dict(docs).get(r.doc_id) or ""
        covered = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text[s.start : s.end])) for s in r.spans)
        assert covered == r.n_hit


def test_a_benchmark_of_ten_megabytes_is_one_automaton(spark):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(20_000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(150))) for i in range(11_000)]
    assert sum(len(t) for _, t in items) > 10_000_000
    planted = {i: draw.randrange(len(items)) for i in range(0, 60, 3)}
    docs = []
    for i in range(60):
        words = [draw.choice(vocabulary) for _ in range(300)]
        if i in planted:
            words[100:100] = items[planted[i]][1].split()[40 : 40 + 10 + i]
        docs.append((i, " ".join(words)))
    found = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()}
    assert got == {i: (10 + i, [str(planted[i])]) if i in planted else (0, []) for i in range(60)}


def test_patterns_of_one_word_and_very_long_texts(spark):
    items = [(1, "one"), (2, "two two"), (3, "a b c d e f g h i j k"), (4, "j"), (None, "solo")]
    long = "a b c d e f g h i j k " * 20_000
    docs = [(1, "One, two! two two"), (2, long), (3, "solo one" + " x" * 100_000), (4, "two"), (5, "j")]
    found = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    assert got == {1: (4, 4, ["1", "2"]), 2: (220_000, 220_000, ["3", "4"]), 3: (100_002, 2, ["1"]), 4: (1, 0, []), 5: (1, 1, ["4"])}


def test_contamination_without_items_or_documents(spark, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_contamination(odd, empty).collect()} == {0}
    assert find_contamination(odd.limit(0), empty).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_expressions(spark):
    draw = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "+", "1", "23", "4 5", "255", "256", "0", "1.2.3.4", "🙂", "é", " ", "("]
    parts += ["4111111111111111", "4111-1111 1111 1111", "\n", "+1 (988) 555-2485"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    for r in find_personal_data(frame, kinds=BASE).select("doc_id", written(F.col("spans")).alias("w")).collect():
        assert r.w == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id]))


def test_checksums_and_context_decide_further_kinds(spark, odd):
    texts = {
        1: "IBAN GB82 WEST 1234 5698 7654 32.",
        2: "IBAN GB82 WEST 1234 5698 7654 33.",
        3: "call 212-555-1234 now",
        4: "part 212-555-1234 now",
        5: "é🙂 mail a@b.cd, card 4111 1111 1111 1111",
    }
    found = find_personal_data(spark.createDataFrame(list(texts.items()), DOCS))
    rows = {r.doc_id: r.out for r in found.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert rows == {
        1: "IBAN [IBAN].",
        2: texts[2],
        3: "call [LOCAL_PHONE] now",
        4: texts[4],
        5: "é🙂 mail [EMAIL], card [CARD]",
    }
    assert personal_data_digest(odd).filter("spans <> ''").count() == 0
    assert personal_data_digest(odd.limit(0)).count() == 0


def plain_marks(text, spans):
    """Text with marks; spans as (start, end, kind)."""
    out, at = [], 0
    for start, until, kind in sorted((a, -b, k) for a, b, k in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -until)
    return "".join(out) + text[at:]


def test_marks_of_overlapping_spans(spark):
    draw = random.Random(6)
    schema = "i int, text string, spans array<struct<kind:string,start:int,end:int,score:double,order:int>>"
    rows = []
    for i in range(60):
        text = "".join(draw.choice("aé🙂 ") for _ in range(draw.randint(2, 9000)))
        spans = []
        for _ in range(draw.choice([0, 1, 5, 600, 1300])):
            a = draw.randrange(len(text) - 1)
            spans.append((draw.choice(["ip", "card"]), a, min(len(text), a + draw.randint(1, 30)), 1.0, 0))
        rows.append((i, text, spans))
    frame = spark.createDataFrame(rows, schema)
    got = {r.i: r.out for r in frame.select("i", redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert got == {i: plain_marks(text, [(a, b, k) for k, a, b, _, _ in spans]) for i, text, spans in rows}


@pytest.mark.parametrize("stage", [False, True])
def test_very_long_addresses_and_very_many(spark, stage):
    long, many = "x a@b" + ".c" * 200_000, "a@b.cd " * 100_000
    dense = "1.2.3.4, +1 (988) 555-2485; " * 20_000
    frame = spark.createDataFrame([(1, long), (2, many), (3, dense)], DOCS)
    if stage:
        got = {r.doc_id: r.text for r in personal_data(spark, frame, "").collect()}
        assert got == {1: "x [EMAIL]", 2: "[EMAIL] " * 100_000, 3: "[IP], [PHONE]; " * 20_000}
        return
    rows = {r.doc_id: r for r in personal_data_digest(frame).collect()}
    assert rows[1].spans == f"email:2:{len(long)}"
    assert rows[2].n_email == 100_000 and rows[2].spans.endswith(f",email:{len(many) - 7}:{len(many) - 1}")
    assert (rows[3].n_ip, rows[3].n_phone) == (20_000, 20_000)
    assert rows[3].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(plain_spans(dense), key=lambda s: (s[0] != "ip", s[1])))


def plain_statistics(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics_of_whole_texts(spark, odd):
    draw = random.Random(7)
    texts = [
        "".join(draw.choice(["a", "b ", "c\n", " ", "#", "é", "\n", "x y z a b "]) for _ in range(draw.randint(0, 60)))
        for _ in range(300)
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in text_statistics(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(texts[r.doc_id])
    assert text_statistics(odd).filter("n_words = 20000").first().n_repeat_words == 20000


def test_rules_are_learned_from_labels_and_spare_clean_texts(spark, odd):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(40)) for _ in range(300)]
    junk = [" ".join(word() + "###" for _ in range(40)) for _ in range(100)]
    loud = [" ".join(word().upper() for _ in range(40)) for _ in range(100)]
    texts = clean + junk + loud
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 500, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    stats = text_statistics(frame).cache()
    rules = fit_rules(stats, labels)
    assert 2 <= len(rules.rules) <= 4
    judged = judge_quality(stats, rules)
    assert judged.filter("kept <> (doc_id < 300)").count() == 0
    assert judge_quality(text_statistics(odd), rules).filter("kept").count() == 0
    none = fit_rules(stats, labels.limit(0))
    assert none.rules == [] and judge_quality(stats, none).filter("not kept").count() == 0


def every_segmentation(lattice, text):
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, tuple(ids)))
            return
        for end, arc, s in lattice._arcs(text, at):
            go(end, ids + list(arc), score + s)

    go(0, [], 0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("estimated", [False, True])
def test_n_best_segmentations_are_those_of_all(spark, estimated):
    scores = None
    if estimated:
        scores = piece_scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PIECES)
    lattice, encoder, draw = Lattice(PIECES, scores), Encoder(PIECES, 4, scores), random.Random(3)
    letters = ["a", "n", " ", "  ", "the", "\n", "é", "▁", "漢", ";\r", "\r", ")", "\t"]
    for _ in range(150):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 7)))
        every = every_segmentation(lattice, " " + text) if text else [(0, ())]
        assert [s for s, _ in lattice.n_best(" " + text, 4)] == [s for s, _ in every[:4]] or not text
        ((ids, score, found),) = list(encoder.encode([text]))
        assert score == every[0][0] and [s for s, _ in found] == [s for s, _ in every[:4]]
        assert lattice.decode(ids).decode() == text


def test_segments_solved_together_are_those_solved_alone():
    sizes, draw = Lattice(PIECES), random.Random(5)
    lattice = Lattice(PIECES, [draw.choice((-7, -30, -30, -400)) for _ in sizes.spelled])  # with many ties
    letters = ["a", "n", "e", "t", "th", "ing", "é", "▁", "漢", "🙂", "\u0301", ")", "7"]
    texts = [draw.choice(("", " ", "  ")) + "".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "\n\n\t", " a\r\r", "▁", "a" * 64, "a" * 65, " the" + "n" * 300]
    alone = [lattice.best(t) for t in texts]
    together = [(np.frombuffer(ids, "<i4").tolist(), score, loss) for ids, score, loss in lattice.best_of_many(texts)]
    assert together == alone and lattice.best_of_many([]) == []


def test_most_words_are_split_as_by_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = collections.Counter(w for r in docs.select("text").collect() for w in (r.text or "").split())
    total = np.ones(library.get_piece_size(), np.int64)
    for word, n in counts.items():
        np.add.at(total, library.encode(word), n)
    scores = piece_scores(docs, PIECES)
    assert scores == np.round(10_000 * (np.log(total) - np.log(total.sum()))).astype(int).tolist()
    share = []
    for estimated in (None, scores):
        encoder = Encoder(PIECES, 1, estimated)
        same = [n * (next(iter(encoder.encode([w])))[0].tolist() == library.encode(w)) for w, n in counts.items()]
        share.append(sum(same) / sum(counts.values()))
    assert share[1] > 0.75 and share[1] > share[0] + 0.2


def test_pieces_round_trip(spark, odd):
    encoded = encode_pieces(odd, PIECES)
    rows = encoded.collect()
    assert all(r.round_trip for r in rows) and {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    back = {(r.doc_id, r.text) for r in decode_pieces(encoded, PIECES).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()}
    assert encode_pieces(odd.limit(0), PIECES).count() == 0
