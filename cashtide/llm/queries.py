"""One registered query per operator, and the SQL some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch, hex_digest
from cashtide.llm.conversation_trie import numbered_turns, prefix_trie, with_shared_openings
from cashtide.llm.decontaminate import find_contamination
from cashtide.llm.metric_join import embedding_duplicates
from cashtide.llm.near_dedup import near_duplicates
from cashtide.llm.periodic_runs import periodic_runs, strongest, with_planted_runs
from cashtide.llm.personal_data import personal_data_digest
from cashtide.llm.piece_segmentation import encode_pieces
from cashtide.llm.quality_rules import quality_digest
from cashtide.llm.recompression import remove_repeats
from cashtide.llm.suffix_dedup import remove_repeated_bytes
from cashtide.llm.token_counts import token_counts
from cashtide.llm.token_files import read_token_files, write_token_files
from cashtide.llm.web_archive import read_archives, write_archives
from cashtide.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    spans, digest = F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", spans, digest)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        hex_digest(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(table(spark, sf_dir, "documents"), PIECES)
    scores = F.array_join(F.transform("n_best", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", "n_pieces", "score", scores.alias("n_best_scores"), "ids_crc32", "round_trip")


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_digest(F.col("kept")).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return read_archives(spark, folder)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, WORDS, end_id=1)
    return read_token_files(spark, folder)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_rows(table(spark, sf_dir, "conversations"))


def op11_rows(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that open like one of their neighbours."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    return prefix_trie(*with_shared_openings(numbered_turns(conversations, scratch), scratch), scratch)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_rows(table(spark, sf_dir, "documents"))


def op12_rows(docs: DataFrame) -> DataFrame:
    """The runs of texts of which one in ten repeats a part of itself, as digests."""
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        hex_digest(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        hex_digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


#: Words as one operator reads them, in DuckDB: lower-case A-Z, digits and all beyond ASCII.
_OP4_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_OP4_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_OP4_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + least(10, len(w)) - 1) AS win, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, k, size, list_slice(w, k, k + size - 1) AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)
),
h AS (SELECT DISTINCT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw USING (win, size)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
p AS (
  SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 19), ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)
),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM f WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Base 32 in SQL: five hex digits at a time are twenty bits, four digits of base 32.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM h GROUP BY x)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS BIGINT), 1)
  ), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN f USING (x)
"""

#: A checksum of the decimal digits of ``c``, bit by bit.
_CRC32 = """
xor(list_reduce(
  [CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))
), 4294967295)
"""

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT c, len, {_CRC32} % 9 AS h FROM (SELECT c, max(pos) AS len FROM t GROUP BY c)),
fam AS (
  SELECT i.c, i.h, i.c - i.c % 5 AS b, least(i.h, coalesce(j.len, 0)) AS taken
  FROM ids i LEFT JOIN ids j ON j.c = i.c - i.c % 5
),
re AS (
  SELECT f.c, pos, r, x FROM fam f JOIN t ON t.c = f.b AND pos <= h
  UNION ALL SELECT f.c, taken + pos - h, r, x FROM fam f JOIN t ON t.c = f.c AND pos > h
),
seqs AS (
  SELECT c, coalesce(list(md5(strlen(r) || ':' || r || x) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS s,
         list(strlen(x) ORDER BY pos) AS b
  FROM fam LEFT JOIN re USING (c) GROUP BY c
),
m AS (
  SELECT c, d, array_to_string(list_slice(s, 1, d), ',') AS k, array_to_string(list_slice(s, 1, d - 1), ',') AS pk,
         d = len(s) AS done, b[d] AS bytes
  FROM (SELECT c, s, b, unnest(range(0, len(s) + 1)) AS d FROM seqs)
),
n AS (
  SELECT d, k, any_value(pk) AS pk, min(c) AS conv, count(*) AS n, max(bytes) AS bytes,
         string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE done) AS ends
  FROM m GROUP BY d, k
),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
w AS (
  SELECT d, k, pk, conv, n, coalesce(kids, 0) AS kids, ends, CASE WHEN d > 0 THEN (n - 1) * bytes ELSE 0 END AS own
  FROM n LEFT JOIN kids USING (d, k)
),
sums AS (
  SELECT a.d, a.k, count(*) FILTER (WHERE b.kids = 0) AS leaves, CAST(sum(b.own) AS BIGINT) AS saved
  FROM w a JOIN w b ON b.d >= a.d AND starts_with(b.k, a.k) GROUP BY a.d, a.k
)
SELECT w.conv AS conv_id, w.d AS depth, up.conv AS parent_conv_id, w.n AS n_convs, w.kids AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN sums USING (d, k) LEFT JOIN w up ON w.d > 0 AND up.d = w.d - 1 AND up.k = w.pk
"""

OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, b), vec_id) AS component_id,
       vec_id = coalesce(least(vec_id, b), vec_id) AS kept
FROM embeddings LEFT JOIN direct d ON d.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_piece_segmentation": op5_piece_segmentation,
    "op6_recompression": op6_recompression,
    "op7_quality_rules": op7_quality_rules,
    "op8_web_archives": op8_web_archives,
    "op9_token_files": op9_token_files,
    "op10_personal_data": op10_personal_data,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": OP4_SQL,
    "op6_recompression": OP6_SQL,
    "op8_web_archives": OP8_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op13_embedding_near_dedup": OP13_SQL,
}
