"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five lower-cased words in a row (all words of a shorter text).  The weight of
a shingle in a text is how often it occurs there times a smoothed inverse document
frequency over all documents.  Two texts are linked if the weighted Jaccard similarity of
their shingles, the sum of the lesser weights over that of the greater, is at least
``threshold``; classes are the connected components of links.

1. Equal texts are one unit.  Document frequencies are counted by an exchange of packed
   digests; only shingles that occur in two documents or more are answered.
2. The shingles that a text shares with none bound its similarity to any other.  Texts
   whose bound is below the threshold are alone, and drop out exactly.
3. The rest are sampled: improved consistent weighted sampling picks the same shingle in
   two texts with the probability of their similarity.  Bands of samples make buckets.
4. In each bucket every text is compared with the one that shares the largest part of its
   weight, exactly, on the full weights.  In buckets whose texts then still belong to
   several classes, blocks of texts are compared with blocks, in tasks of bounded size,
   skipping pairs that are already in one class or that their shared weights rule out.

A null or empty text, or one without words, is alone, and so is a row without an id.  Of
several texts under one id the one with the least digest counts.  Repeated rows have one
class.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch, Words, digest_of_runs, id_and_text, mix, pair
from cashtide.llm.components import components, joined
from cashtide.llm.exchange import Texts, answer, ask, chunks_of, lookup, merged_counts, shared_counts, unpack

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4  # a pair at 0.8 shares a band with probability 0.9998, one at 0.9 with 1 - 3e-8
IDF_SPAN = 0.25  # the rarest shingle weighs this much more than one that all documents have
BLOCK_BYTES, BLOCK_TEXTS = 8 << 20, 512  # that are compared with another block in one task, at most
SLACK = 1e-6  # weights are stored as 32-bit numbers

UNIT = "doc_id bigint, bands array<bigint>, keys binary, weights binary, total double, shared double"


class Shingles:
    """Distinct shingles of each text of a chunk, with how often it has them."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        words = Words([t.decode("utf-8", "replace").lower().encode() for t in texts])
        n = len(words.digest)
        runs = digest_of_runs(words.digest, SHINGLE)
        at = np.flatnonzero(words.text[: len(runs)] == words.text[SHINGLE - 1 :]) if len(runs) else np.zeros(0, np.int64)
        text, key = words.text[at], runs[at] if len(at) else np.zeros(0, np.uint64)
        sizes = np.bincount(words.text, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
        first = np.cumsum(sizes) - sizes
        for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
            d = words.digest[first[i] : first[i] + sizes[i]]
            text, key = np.append(text, i), np.append(key, digest_of_runs(d, len(d), 77)[0])
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        self.text, self.key = text[starts], key[starts]
        self.count = np.diff(np.append(starts, len(key)))


def _frequency_question(texts: Texts, _) -> list[np.ndarray]:
    keys, counts = np.unique(Shingles(texts.bytes, texts.ids).key, return_counts=True)
    return [keys, counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))]


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """From 1 for a shingle of all documents to about 1 + IDF_SPAN for one of a single document."""
    return 1.0 + IDF_SPAN * np.log((1.0 + n_docs) / (1.0 + df)) / math.log(1.0 + n_docs)


def samples(key: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted samples, one row of digests per text.

    ``begin`` holds where each text's shingles start.  Per shingle and sample, r and c are
    gamma variates and b a uniform one, all drawn from the shingle's digest; the shingle
    with the least a = c / (y e^r), y = e^(r (t - b)), t = floor(ln w / r + b), is the sample.
    """
    out = np.empty((len(begin), n), np.uint64)
    low, scale = np.uint64(0xFFFFFFFF), 2.0**-32
    log_w = np.log(weight)
    sizes = np.diff(np.append(begin, len(key)))

    def two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((x >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((x & low).astype(np.float64) + 0.5) * scale

    with np.errstate(over="ignore"):
        for k in range(n):
            x = mix(key + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            y = mix(x ^ np.uint64(0xA0761D6478BD642F))
            z = mix(y + np.uint64(0xE7037ED1A0B428DB))
            u, v = two(x)
            r = -np.log(u * v)
            u, v = two(y)
            log_c = np.log(-np.log(u * v))
            b = two(z)[0]
            t = np.floor(log_w / r + b)
            a = log_c - r * (t - b + 1.0)
            least = np.minimum.reduceat(a, begin)
            hit = np.flatnonzero(a == np.repeat(least, sizes))
            owner = np.searchsorted(begin, hit, side="right") - 1
            first = hit[np.searchsorted(owner, np.arange(len(begin)))]
            out[:, k] = pair(key[first], t[first].astype(np.int64).astype(np.uint64) + np.uint64(k))
    return out


def _standing(texts: Texts, copies: set[int], own: dict[int, str]) -> np.ndarray:
    """Which rows are units: one for each id that no other stands for, with the text that counts."""
    out, seen = np.zeros(len(texts.bytes), bool), set()
    for i, (doc, ok) in enumerate(zip(texts.ids.tolist(), texts.column.is_valid().to_pylist(), strict=True)):
        if ok and doc not in copies and doc not in seen:
            if doc not in own or own[doc] == hashlib.sha256(texts.bytes[i]).hexdigest():
                out[i] = True
                seen.add(doc)
    return out


def _units(texts: Texts, answers, standing: np.ndarray, n_docs: int, threshold: float) -> pa.Table:
    s = Shingles(texts.bytes, texts.ids)
    known, totals = merged_counts(answers)
    at = lookup(s.key, known)
    df = np.where(at >= 0, totals[at], 1) if len(known) else np.ones(len(s.key))
    weight = s.count * idf(df, n_docs)
    n = len(texts.bytes)
    total = np.bincount(s.text, weight, n)
    shared = np.bincount(s.text, np.where(df >= 2, weight, 0.0), n)
    use = standing & (total > 0) & (shared >= threshold * total - SLACK)
    keep = use[s.text]
    key, w, text, df = s.key[keep], weight[keep], s.text[keep], df[keep]
    begin = np.searchsorted(text, np.flatnonzero(use))
    columns: dict[str, list] = {c.split()[0]: [] for c in UNIT.split(", ")}
    if len(begin):
        drawn = samples(key, w, begin, BANDS * ROWS).reshape(len(begin), BANDS, ROWS)
        ends = np.append(begin[1:], len(key))
        for i, (a, b) in enumerate(zip(begin, ends, strict=True)):
            where = int(text[a])
            bands = np.arange(BANDS, dtype=np.uint64)
            for row in range(ROWS):
                bands = pair(bands, drawn[i, :, row])
            common = df[a:b] >= 2
            columns["doc_id"].append(int(texts.ids[where]))
            columns["bands"].append(bands.view(np.int64).tolist())
            columns["keys"].append(key[a:b][common].tobytes())
            columns["weights"].append(w[a:b][common].astype("<f4").tobytes())
            columns["total"].append(float(total[where]))
            columns["shared"].append(float(shared[where]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(columns.items(), kinds, strict=True)})


def overlap(keys: np.ndarray, weights: np.ndarray, others: np.ndarray, other_weights: np.ndarray) -> float:
    """Sum of the lesser weights of two sets of sorted keys."""
    at = lookup(keys, others)
    hit = at >= 0
    return float(np.minimum(weights[hit], other_weights[at[hit]]).astype(np.float64).sum())


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                inter = overlap(
                    np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["weights"], "<f4"),
                    np.frombuffer(r["other_keys"], "<u8"), np.frombuffer(r["other_weights"], "<f4"),
                )
                if inter >= threshold * (r["total"] + r["other_total"] - inter) - SLACK:
                    a.append(r["doc_id"])
                    b.append(r["leader"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compare_blocks(threshold: float):
    """Links between the two blocks of a group (or within one) that join different classes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["doc_id"])
        keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
        weights = [np.frombuffer(r["weights"], "<f4").astype(np.float64) for r in rows]
        total, shared = np.array([r["total"] for r in rows]), np.array([r["shared"] for r in rows])
        side = np.array([r["block"] for r in rows])
        first_block = side.min()
        names = np.array([r["label"] for r in rows])
        # Postings: the texts of each key, in one array sorted by key.
        every = np.concatenate(keys)
        owner = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        every, owner, value = every[order], owner[order], np.concatenate(weights)[order]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(side == first_block).tolist():
            # At best two texts share all the weight that the poorer one shares with any.
            best = np.minimum(shared, shared[i])
            may = (names != names[i]) & (best >= threshold * (total + total[i] - best) - SLACK)
            may &= (side != first_block) if len(table) and side.max() != first_block else (np.arange(len(rows)) > i)
            if not may.any():
                continue
            lo, hi = np.searchsorted(every, keys[i], "left"), np.searchsorted(every, keys[i], "right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            inter = np.bincount(owner[at], np.minimum(value[at], np.repeat(weights[i], size)), len(rows))
            linked = may & (inter >= threshold * (total + total[i] - inter) - SLACK)
            for j in np.flatnonzero(linked).tolist():
                if names[j] != names[i]:
                    found.append((rows[i]["doc_id"], rows[j]["doc_id"]))
                    names[names == names[j]] = names[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` (the least id of its class), ``class_size`` (documents)
    and ``kept`` (whether it is the one that stands for the class)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    chunked, n = chunks_of(id_and_text(docs, id_col, text_col))

    # Equal texts: the least id stands for them.
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    rows = scratch.store(chunked.select("doc_id", "chunk", F.when(worded, F.sha2("text", 256)).alias("key")))
    n_docs = rows.count()
    # Of several texts of one id, one counts: each id has one key from here on.
    ids = scratch.store(rows.filter("key is not null").groupBy("doc_id").agg(F.min("key").alias("key")))
    reps = scratch.store(ids.groupBy("key").agg(F.min("doc_id").alias("rep")))
    standing = scratch.store(ids.join(reps, "key").select("doc_id", "key", "rep"))
    # What a chunk must leave out: ids that another stands for, and texts that don't count.
    mine = standing.select("doc_id", F.col("key").alias("own"), "rep")
    left_out = rows.filter("key is not null").join(mine, "doc_id").filter("rep <> doc_id or own <> key")

    counts = scratch.store(answer(ask(chunked, _frequency_question, n), shared_counts))
    known = counts.selectExpr("chunk", "body", "cast(null as bigint) as id", "cast(null as string) as own").unionAll(
        left_out.selectExpr("chunk", "cast(null as binary) as body", "doc_id as id", "if(rep = doc_id, own, null) as own")
    )

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        answers = [unpack(b) for b in right.column("body").to_pylist() if b is not None]
        ids, own = right.column("id").to_pylist(), right.column("own").to_pylist()
        copies = {i for i, k in zip(ids, own, strict=True) if i is not None and k is None}
        chosen = {i: k for i, k in zip(ids, own, strict=True) if k is not None}
        return _units(texts, answers, _standing(texts, copies, chosen), n_docs, threshold)

    units = chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(work, UNIT)
    units = scratch.store(units)

    # Buckets: their leader is the text that shares the largest part of its weight.
    bands = units.select("doc_id", (F.col("shared") / F.col("total")).alias("part"), F.octet_length("keys").alias("size"), F.explode("bands").alias("band"))
    bands = scratch.store(bands)
    leaders = scratch.store(
        bands.groupBy("band")
        .agg(F.max(F.struct("part", -F.col("doc_id"))).alias("top"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("band", (-F.col("top.col2")).alias("leader"), "n")
    )
    members = scratch.store(bands.join(leaders, "band"))
    pairs = scratch.store(members.filter("doc_id <> leader").select("doc_id", "leader").distinct())
    vectors = units.select("doc_id", "keys", "weights", "total")
    others = units.select(
        F.col("doc_id").alias("leader"), F.col("keys").alias("other_keys"),
        F.col("weights").alias("other_weights"), F.col("total").alias("other_total"),
    )
    links = scratch.store(pairs.join(vectors, "doc_id").join(others, "leader").mapInArrow(_verify(threshold), "a bigint, b bigint"))
    labels = components(links, scratch)

    # Buckets that hold several classes beside the leader's own comparisons.
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = scratch.store(labelled)
    open_bands = scratch.store(
        labelled.filter("doc_id <> leader")
        .groupBy("band")
        .agg(
            F.min("label").alias("a"), F.max("label").alias("z"), F.sum("size").alias("bytes"),
            F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("same"), F.count("*").alias("m"),
        )
        .filter("a <> z")
        # Buckets with the same texts need one comparison.
        .groupBy("same", "m")
        .agg(F.min("band").alias("band"), F.first("bytes").alias("bytes"))
        .select(
            "band",
            F.ceil(F.greatest(F.col("bytes") / F.lit(BLOCK_BYTES), F.col("m") / F.lit(BLOCK_TEXTS))).cast("int").alias("blocks"),
        )
    )
    grouped = labelled.filter("doc_id <> leader").join(open_bands, "band").withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.greatest("blocks", F.lit(1))).cast("int")
    )
    # Each text goes to the groups of its block with every other one.
    grouped = grouped.select(
        "doc_id", "label", "band", "block",
        F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("other"),
    ).select("doc_id", "label", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = scratch.store(
        grouped.join(units.select("doc_id", "keys", "weights", "total", "shared"), "doc_id")
        .groupBy("band", "i", "j")
        .applyInArrow(_compare_blocks(threshold), "a bigint, b bigint")
    )
    if not found.isEmpty():
        labels = joined(labels, found, scratch)

    # Every row: the class of the text that stands for its own.
    classes = standing.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("label", "rep").alias("class_id")
    )
    classes = scratch.store(classes)
    sizes = scratch.store(classes.groupBy("class_id").agg(F.count("*").alias("class_size")))
    classes = scratch.store(classes.join(sizes, "class_id"))
    ids_only = id_and_text(docs, id_col, text_col).select("doc_id")
    return ids_only.join(classes, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the one with the least id.

    If an id has several texts, each of them is a document of its own, known by the id and 128
    bits of the text, and numbered; of texts with the least id that with the least digest
    stays.  Of repeated rows one stays; rows without an id all do.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup-rows")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").cast("bigint").alias("_id"),
        text.alias("_text"),
        *[F.xxhash64(F.lit(i), text).alias(f"_h{i}") for i in (1, 2)],
    )
    name = ["_id", "_h1", "_h2"]
    digest = F.struct("_h1", "_h2")
    ids = rows.filter("_id is not null").groupBy("_id").agg(F.min(digest).alias("a"), F.max(digest).alias("z"))
    if ids.filter("a <> z").isEmpty():
        rows = rows.withColumn("_unit", F.col("_id"))
    else:
        units = rows.filter("_id is not null").select(*name).distinct().withColumn("_unit", F.monotonically_increasing_id())
        rows = rows.join(scratch.store(units), name, "left")
    found = near_duplicates(rows, id_col="_unit", text_col="_text")
    found = scratch.store(found.selectExpr("doc_id as _unit", "class_id", "class_size"))
    several = scratch.store(found.filter("class_size > 1").select("_unit", "class_id").distinct())
    named = several.join(rows.select("_unit", *name).distinct(), "_unit")
    first = scratch.store(named.groupBy("class_id").agg(F.min(F.struct(*name, "_unit")).alias("first")).select("first._unit"))
    gone = scratch.store(several.join(first, "_unit", "left_anti").select("_unit"))
    kept = rows.select("_row", "_unit").join(gone, "_unit", "left_anti")
    repeated = found.filter("_unit is not null").groupBy("_unit").agg(F.count("*").alias("n")).filter("n > 1").select("_unit")
    repeated = scratch.store(repeated.join(gone, "_unit", "left_anti"))
    if repeated.isEmpty():
        return kept.select("_row.*")
    once = kept.join(repeated, "_unit", "left_anti").select("_row.*")
    return once.unionByName(kept.join(repeated, "_unit", "left_semi").dropDuplicates(["_unit"]).select("_row.*"))
