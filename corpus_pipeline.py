"""From raw documents to a tokenised training mix: five stages, each one operator of landgrid.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next stage's docs. All but the last
return the columns of documents. Ids that are null are never dropped as copies by the near-duplicate stage: they can't be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm import bpe, exact_dedup, mixing, ngram_join, quality
from landgrid.llm.common import bounded, cut, salted_totals
from landgrid.llm.queries import BPE_PATTERN, BPE_RANKS, QUALITY_THRESHOLD


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels of documents that aren't held out, scores at least the threshold.
    Documents without text are scored like others. Without labels all stay."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, out_col="__score").where(F.col("__score") >= QUALITY_THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one with the smallest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by Jaccard similarities of 0.8 or more on five-word shingles the one with the smallest id; null ids
    are larger than any. Rows are compared under numbers of their own, so that documents that share an id, or have none, are told apart."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    joined = cut(ngram_join.jaccard_join(rows.select("__row", "text"), id_col="__row").select("__row", "class_id"), "classes")
    named = joined.join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    held = salted_totals(named, ["class_id"], F.col("__row"), {"first": first}, {"first": F.min("first")})
    gone = cut(held.where("__row <> first.__row").select(F.col("__row").alias("__gone")), "gone")
    return rows.join(bounded(gone, gone.count(), 16), rows["__row"] == gone["__gone"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mixing.mix(docs, payload=True)
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest and size of the text that the ids decode to."""
    both = bpe.encode(docs, BPE_RANKS, BPE_PATTERN, decoded=True)
    return both.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.octet_length("decoded").cast("bigint").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenise),
]

#: The first and third stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs
