"""File formats and the pipeline."""

import base64
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cashtide.llm.token_files import (
    TEXT_BYTES,
    TEXTS,
    Frequencies,
    WordTokens,
    decode_block,
    encode_block,
    portions,
    read_token_files,
    write_token_files,
)
from cashtide.llm.web_archive import parse_records, read_archives, record, stored_members, write_archives

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 300_000])
def test_blocks_decode_to_their_ids(n):
    ids = np.minimum(np.random.RandomState(n).zipf(1.3, n), 49000).astype(np.int64)
    found, counts = np.unique(ids, return_counts=True)
    table = Frequencies.from_bytes(Frequencies.of_counts(dict(zip(found.tolist(), counts.tolist(), strict=True))).to_bytes())
    raw = encode_block(7, np.array([3]), np.array([1]), np.array([n]), ids, table)
    start, docs, _, sizes, back = decode_block(raw, table)
    assert (start, docs.tolist(), sizes.tolist()) == (7, [3], [n]) and (back == ids).all()
    if n > 64:
        bad = bytearray(raw)
        bad[-3] ^= 1
        with pytest.raises((ValueError, IndexError)):
            decode_block(bytes(bad), table)


def test_words_encode_as_the_library_does():
    tokens, draw = WordTokens(WORDS, 1), random.Random(2)
    letters = "ab'sT tLlDdéÈçßİıΣσςñ漢字🙂 \u0085 ́̀ \n\t\x1c\x1f0١²½_-!?<|end of text|>KÅﬁÅ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += ["<|endoftext|> a", "don't we'll I'M 'S ''s", ""]
    for text, raw in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids + [1]


def test_portions_of_texts_are_small_and_whole():
    texts = ["é" * 1_000_000, "", *["ab" * 700_000] * 9, "x" * (2 * TEXT_BYTES), "y", *["z"] * 9000, ""]
    for column in (pa.array(texts), pa.array(["cut", *texts, "off"]).slice(1, len(texts))):
        parts = [some.to_pylist() for some in portions(column)]
        assert [t for some in parts for t in some] == texts
        assert all(len(some) <= TEXTS and (len(some) == 1 or len("".join(some).encode()) <= TEXT_BYTES) for some in parts)
    assert list(portions(pa.array([], pa.string()))) == []
    assert 2 * WordTokens.REMEMBERED <= 600_000  # what a worker keeps, with the older ones


def test_latin_texts_encode_as_the_library_does():
    tokens, draw = WordTokens(WORDS, 1), random.Random(3)
    letters = "aBzÀÿĀıſƀǅɏß×÷'’s'tTSéLl12_.,!<>\t\n\x0b\x0c\r «»–—…€“ "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["L'été " * 20_000, ""]
    tokens.REMEMBERED = 300
    want = [e.ids + [1] for e in tokens.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in tokens.encode(texts)] == want


def test_other_tokenizers_encode_whole_texts():
    tokens = WordTokens(public_tokenizers.path("byte_bpe_50k.json"), None)
    texts = ["The cat  sat\n", "", "L'été 12"]
    assert not tokens.wordwise
    for text, raw in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    rows = [(9, "the last"), (2, "b b b"), (2, "b b b"), (None, "no id"), (1, None), (4, ""), (3, "word " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(0).alias("part"), F.lit(0).alias("ids"))
    write_token_files(frame, str(tmp_path / "t"), WORDS)
    library, at, want = Tokenizer.from_file(WORDS), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = [tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    with_ids = read_token_files(spark, str(tmp_path / "t"), with_ids=True)
    assert with_ids.filter("size(ids) <> n_tokens").count() == 0


def test_empty_token_files(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), WORDS)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def plain_archive(rows):
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    first = {}
    for page, _, html in rows:
        p = (html or "").encode()
        if page is not None or p not in first:
            first[p] = min([x for x in (first.get(p), page) if x is not None], default=None)
    out, seen = [], set()
    for page, _, html in rows:
        p = (html or "").encode()
        revisit = page != first[p] or p in seen
        seen |= {p} if not revisit else set()
        out.append((page, len(p), digest(p), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [300_000, 0])
def test_archives_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr("cashtide.llm.web_archive.MOST_BROADCAST", most)
    rows = [(i, f"http://x/{i}", draw) for i, draw in enumerate(["a", "bé", "a", "", None, "c" * 70000, "bé\r\n\r\nWARC/1.1"])]
    rows += [(1, "u", "bé"), (None, None, "a"), (None, "u\r\nX: y", "own"), (9, "u", "c" * 70000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("sha1"), F.lit(1).alias("first"))
    write_archives(frame, str(tmp_path / "a"))
    got = read_archives(spark, str(tmp_path / "a"), with_payload=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_archive(rows)
    assert {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"} >= {(0, b"a"), (3, b""), (None, b"own")}


def test_empty_archives(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(frame, str(tmp_path / "a"))
    (tmp_path / "a").mkdir(exist_ok=True)
    assert read_archives(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_members_are_found_in_old_and_wide_directories(wide, monkeypatch):
    raw = io.BytesIO()
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in (("archive/data.warc", b"x" * 50), ("indexes/i", b"y" * 20)):
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("packed"), b"z" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a note"
    size = len(raw.getvalue())
    found = stored_members(raw, size)
    assert sorted(found) == ["archive/data.warc", "indexes/i"]
    for name, (offset, n) in found.items():
        assert raw.getvalue()[offset : offset + n] == {"archive/data.warc": b"x" * 50, "indexes/i": b"y" * 20}[name]


def test_damaged_records_are_refused():
    raw = record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, False)
    assert next(parse_records(raw))["payload"] == b"payload"
    with pytest.raises(ValueError):
        list(parse_records(raw.replace(b"payload\r\n", b"pavload\r\n")))


def test_pipeline_keeps_clean_texts_and_their_columns(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    clean = {i: " ".join(word() for _ in range(60)) for i in range(40)}
    item = " ".join(word() for _ in range(15))
    docs = dict(clean)
    docs[100] = clean[3]  # an exact copy
    docs[101] = clean[4] + " more"  # a near one
    docs[102] = clean[5][:200] + " " + item.upper() + ", " + " ".join(word() for _ in range(40))
    docs[103] = " ".join(word() for _ in range(60)) + " write to me@example.com"
    docs[104] = " ".join(word() + "%%%" for _ in range(60))
    docs[105] = "too short"
    rows = [(i, t, "en", "s", len(t), "extra") for i, t in docs.items()]
    rows += [(None, " ".join(word() for _ in range(60)), "en", None, None, None), (106, None, None, None, None, None), rows[7]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    many = [(200 + i, " ".join(word() + "%%%" for _ in range(60))) for i in range(30)]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(104, 0, 0)] + [(i, 0, 0) for i, _ in many]
    spark.createDataFrame([(i, t, "en", "s", 1, None) for i, t in many], frame.schema).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs_now, str(tmp_path))
        assert after.schema.simpleString() == docs_now.schema.simpleString()
        after.write.parquet(str(tmp_path / f"stage{k}"))
        docs_now = spark.read.parquet(str(tmp_path / f"stage{k}"))
    left = {r.doc_id: r.text for r in docs_now.collect()}
    assert set(left) == set(clean) | {103, None} and docs_now.count() == len(left)
    assert all(left[i] == t for i, t in clean.items()) and left[103].endswith("write to [EMAIL]")
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == set(left) and all(r.round_trip for r in final)
