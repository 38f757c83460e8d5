"""The training-data pipeline: from ``documents`` to pieces of clean texts.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and works on all rows the one
before it kept.  All but the last return the columns of ``docs``.

=====================  =========================================================
quality_rules          rejects texts that fail the base rules or a learned rule
near_dedup             keeps the document with the least id of each class
decontamination        drops documents in which windows of test items occur
personal_data          replaces personal data by its kind in brackets
piece_segmentation     encodes the texts in pieces, with the n best segmentations
=====================  =========================================================

Rows without an id pass all stages on their own; null texts are empty, and an empty text is
rejected by the first stage.  Of repeated rows with one id and text, one passes the second
stage; different texts under one id are different documents.
An empty table stays empty.  Further columns of ``docs`` are carried along unchanged,
whatever their names; ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch
from cashtide.llm.decontaminate import find_contamination
from cashtide.llm.near_dedup import keep_one_of_each
from cashtide.llm.personal_data import find_personal_data, redacted
from cashtide.llm.piece_segmentation import encode_pieces
from cashtide.llm.quality_rules import fit_rules, judge_quality, text_statistics
from cashtide.session import configure

PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: No SQL for the pipeline: learned rules, sampled buckets and piece lattices are none.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _as_row(docs: DataFrame) -> DataFrame:
    """The row as one column beside its id and text, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that neither the base rules nor the learned decision list rejects.

    The rules are learned from stored statistics; the verdict is then computed beside each
    row, so no text is shuffled.
    """
    spark = configure(spark)
    stats = Scratch(spark, "pipeline").store(text_statistics(docs))
    rules = fit_rules(stats, _table(spark, sf_dir, "labels"))
    judged = judge_quality(text_statistics(_as_row(docs), carry=["_row"]), rules)
    return judged.filter("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    configure(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a test item.

    The verdict depends on the text alone, so it is looked up by a digest of the text: texts
    whose first 64 bits are those of a hit are judged once more by their second ones.  The
    pairs of digests that go are few and meet the documents in one join.
    """
    spark = configure(spark)
    scratch, benchmark = Scratch(spark, "pipeline"), _table(spark, sf_dir, "benchmark")
    digests = [F.xxhash64(F.lit(i), F.coalesce(F.col("text"), F.lit(""))) for i in (1, 2)]

    def hit(rows: DataFrame, digest: Column, name: str) -> DataFrame:
        found = find_contamination(rows.select(digest.alias("doc_id"), "text"), benchmark)
        return scratch.store(found.filter("n_hit > 0").select(F.col("doc_id").alias(name)).distinct())

    first = hit(docs, digests[0], "_first")
    texts = scratch.store(docs.select("text").join(first, digests[0] == F.col("_first"), "left_semi"))
    second = hit(texts, digests[1], "_second")
    gone = texts.select(digests[0].alias("_first"), digests[1].alias("_second")).join(second, "_second", "left_semi")
    gone = scratch.store(gone.distinct())
    return docs.join(gone, (digests[0] == F.col("_first")) & (digests[1] == F.col("_second")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; texts without any stay as they are."""
    configure(spark)
    found = find_personal_data(_as_row(docs), keep=["_row"])
    found = found.select("_row", redacted(F.col("text"), F.col("spans")).alias("_text"))

    def column(name: str):
        if name == "text":
            return F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias(name)
        if name == "n_chars":
            return F.length("_text").cast(docs.schema[name].dataType).alias(name)
        return F.col("_row").getField(name).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def piece_segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, the n best segmentations, and whether they decode to the text."""
    configure(spark)
    return encode_pieces(docs, PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("piece_segmentation", piece_segmentation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.store(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
