"""Thin queries: each applies one operator to its whole table and derives the digest columns from what it returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm import bpe, embed_dedup, exact_dedup, html_extract, licenses, mixing, ngram_join, quality, substring_dedup, token_files
from landgrid.llm.common import cut, scratch_path
from landgrid.registry import Registry, table

REGISTRY = Registry()

#: Place of the vocabulary on the workers; never copied into the repository.
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN
QUALITY_THRESHOLD = 0.3

EXACT_DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@REGISTRY.add("op2_exact_dedup", EXACT_DEDUP_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@REGISTRY.add("op5_mixing", f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.mix_sql('SELECT doc_id, source, text FROM documents')})")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@REGISTRY.add("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), BPE_RANKS, BPE_PATTERN, decoded=True)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@REGISTRY.add("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@REGISTRY.add("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@REGISTRY.add("op9_embed_dedup")
def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@REGISTRY.add("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    best = lambda a: F.coalesce(F.array_max(F.transform(a, lambda m: m["coverage"])), F.lit(0.0))
    found = F.filter("matches", lambda m: m["found"])
    # What isn't found scores below all that is.
    score = F.when(F.size(found) > 0, best(found)).otherwise(best("matches") / 2)
    return out.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(found).alias("labels"), score.alias("score"))


#: The id that no pre-token encodes to.
END_OF_DOCUMENT = 50_256


@REGISTRY.add("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the encoded documents as flat token files, then counts every document's tokens from the files alone."""
    folder = scratch_path(spark, "tokens")
    ids = bpe.encode(table(spark, sf_dir, "documents"), BPE_RANKS, BPE_PATTERN)
    written = cut(token_files.write_token_files(ids, folder, END_OF_DOCUMENT), "written")
    counts = token_files.token_counts(spark, folder, END_OF_DOCUMENT)
    # Stored, both sides look small enough to broadcast; they grow with the documents.
    return written.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


@REGISTRY.add("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
