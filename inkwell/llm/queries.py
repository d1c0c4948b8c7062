"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hardnegatives, licences, merkle, neighbours, pieces, quality, simhash, substring, tokenbits, tokenfiles, toxicity

PROBE = "</s>[INST] ok [/INST]"
"""Text of both turns of conversation -1, which looks like template marks."""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts, and a source's languages its paths."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(_read(spark, sf_dir, "documents"), ["doc_id"], keep_ids=False)
    return coded.select("row.doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, stack(2, 0L, 'user', '{PROBE}', 1L, 'assistant', '{PROBE}') AS (turn, role, text)")
    return chat.digests(chat.format_conversations(table.unionByName(probe)))


OP5_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), marked AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS previous,
    length(text) + length(text) - length(replace(text, '\', '')) + 2 * len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars,
    length(role) + length(role) - length(replace(role, '\', '')) + 2 * len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  (7 + sum(chars + CASE WHEN previous IS NULL OR previous <> role THEN 9 + role_chars + 8 + 7 ELSE 8 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS win FROM words, unnest(range(1, len(w) - 18)) AS t(k)
), firsts AS (
  SELECT win, min({d: doc_id, k: k}) AS least FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT k + j) AS places
  FROM windows JOIN firsts USING (win), unnest(range(20)) AS t(j) WHERE {d: doc_id, k: k} <> least GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a directory with one for each language; documents are its files."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan_licences(_read(spark, sf_dir, "documents"), path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontamination.report(found)


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
), doc_windows AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM words, (SELECT DISTINCT n FROM item_windows), unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (
  SELECT DISTINCT d.doc_id, d.k, d.n, i.item_id FROM doc_windows d JOIN item_windows i USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, unnest(range(n)) AS t(j) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hardnegatives.mine(table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""

def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document's text loses its line ends, by a checksum of its id, before its proof is tried."""
    docs = _read(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = F.when(tampered, merkle.leaf_hash(*rest, F.replace("text", F.lit("\n"), F.lit(""))))
    table = docs.select("doc_id", "source", merkle.leaf_hash(*rest, F.col("text")).alias("leaf"), changed.alias("changed"))
    found = merkle.manifest(table, "source", ["doc_id"], "leaf", ["doc_id", "changed"])
    folded = merkle.fold(F.coalesce("row.changed", "leaf"), F.col("path"))
    found = found.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_binary_output(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("word_bpe_49k.json")
    back = tokenbits.write_and_read(_read(spark, sf_dir, "documents"), model)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_licence_scan": op8_licence_scan,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_binary_output": op13_token_binary_output,
}

ORACLES: dict[str, str] = {
    "op5_chat_formatting": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}
