"""Exact dedup by two Bloom passes: only rows whose hash may be repeated are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.common import SPACES, bounded, cut, salted_totals

#: Bits of one block of the filter; bitmap_construct_agg makes blocks of this size.
BLOCK_BITS = 32768
BLOCK_BYTES = BLOCK_BITS // 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def repeated_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """First pass: (block, bits), a blocked Bloom filter of what was added twice. keys: block, b0, b1 of every row."""
    set_twice = keys.select("block", F.explode(F.array("b0", "b1")).alias("bit")).groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return set_twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, broadcast_limit: int = 64 << 20) -> DataFrame:
    """docs and, of each row: text_sha256, keep_id, group_size, kept.

    Two texts are equal if they agree once each run of white space is one space; null counts as empty. Of equal texts the row with
    the smallest id stays (null ids come last); if several rows share that id and text, exactly one of them stays. An empty table
    gives an empty result. Further columns of docs are carried along unless they bear the name of a result column; those are replaced.

    Pass one sets two bits of every row's hash in a blocked Bloom filter and keeps the bits set more than once; only (block, bit)
    counts are shuffled. Pass two tests every row: a row with a bit that nobody else set is unique and passes straight through.
    The others, repeated hashes and a few false positives, are written out, grouped by hash with salts, and compared exactly.
    The filter takes bits_per_row bits a row. It is broadcast up to broadcast_limit bytes; beyond, it is joined by block.
    """
    sha, rid = "text_sha256", "__row"
    made = [sha, "keep_id", "group_size", "kept"]
    spark = docs.sparkSession
    keyed = docs.drop(*made).withColumn(sha, F.sha2(normalised(docs[text_col]), 256))
    rows = docs.count()
    blocks = max(1, -(-rows * bits_per_row // BLOCK_BITS))
    h = F.xxhash64(sha)

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumns({"__block": F.pmod(h, F.lit(blocks)).cast("bigint"), "__b0": F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(BLOCK_BITS)).cast("int"), "__b1": F.pmod(F.xxhash64(sha, F.lit(2)), F.lit(BLOCK_BITS)).cast("int")})

    bloom = cut(repeated_filter(hashed(keyed).select(F.col("__block").alias("block"), F.col("__b0").alias("b0"), F.col("__b1").alias("b1")), blocks), "bloom")
    bloom = bloom.select(F.col("block").alias("__of"), F.col("bits").alias("__bits"))
    tested = hashed(keyed).join(bounded(bloom, blocks, BLOCK_BYTES, broadcast_limit), F.col("__block") == F.col("__of"), "left")
    tested = tested.withColumn("__maybe", F.coalesce(_bit(F.col("__bits"), F.col("__b0")) & _bit(F.col("__bits"), F.col("__b1")), F.lit(False))).drop("__bits", "__of", "__block", "__b0", "__b1")

    maybe = cut(tested.where("__maybe").drop("__maybe").withColumn(rid, F.monotonically_increasing_id()), "maybe")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("row")))
    grouped = salted_totals(maybe, [sha], F.col(rid), {"__first": first, "__n": F.count("*")}, {"__first": F.min("__first"), "__n": F.sum("__n")})
    grouped = grouped.withColumns({"keep_id": F.col("__first.id"), "group_size": F.col("__n").cast("bigint"), "kept": F.col(rid) == F.col("__first.row")}).drop("__first", "__n", rid)
    alone = tested.where("not __maybe").drop("__maybe").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    return alone.unionByName(grouped)
