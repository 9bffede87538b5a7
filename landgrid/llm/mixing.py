"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm.common import NON_SPACES, bounded, cut

#: The hash that orders a source's documents has 60 bits, refined 15 bits at a time.
HASH_BITS, STEP_BITS = 60, 15


def order_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over the id, or over the text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budgets by weight, each at most `most` times the source's size.

    Sources in code-point order, null last, take the weights in turn. What a capped source leaves over is reshared by weight among
    the others until none is above its cap: in the order of cap by weight, source i is capped if its cap by weight is at most what
    the sources from i on would get a unit of weight. One row a source goes through these windows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", rank).withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(most))})
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({"all": F.sum("source_size").over(whole) * F.lit(float(share)), "weight": F.sum("w").over(whole), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    level = F.max((F.col("all") - F.col("caps")) / (F.col("weight") - F.col("gone"))).over(whole)
    return s.withColumn("level", level).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs and __source, __size, __h: what the mix goes by."""
    return docs.withColumns({"__source": F.col(source_col), "__size": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(NON_SPACES)).cast("bigint"), "__h": order_hash(F.col(id_col), F.col(text_col))})


def thresholds(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """One row a source (of, source_size, target, full, prefix, with_unit), and the number of sources. sizes: source, size, h.

    A source's documents are taken `full` times, and once more below the hash `prefix`, and at it if with_unit. Cutting at a hash needs
    no sort: sizes are summed by source and 15-bit hash bucket, the bucket in which the budget ends is refined by the next 15 bits, and
    so on. A unit of equal hash at the threshold is taken if that brings the source nearer to its target.
    """
    targets = cut(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most), "targets")
    n_sources = targets.count()
    full = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("bigint")
    edge = targets.select("source", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        e = bounded(edge.select(F.col("source").alias("s"), "left", "prefix"), n_sources, 64)
        inside = sizes.join(e, sizes.source.eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("at")).agg(F.sum("size").alias("sum"), F.first("left").alias("left"))
        so_far = F.sum("sum").over(Window.partitionBy("source").orderBy("at"))
        over = sums.withColumn("so_far", so_far).where("so_far > left")
        at = over.groupBy("source").agg(F.min(F.struct("at", (F.col("left") - (F.col("so_far") - F.col("sum"))).alias("left"), "sum")).alias("x"))
        edge = cut(at.select("source", "x.left", F.col("x.at").alias("prefix"), F.col("x.sum").alias("unit")), "edge")
    limits = targets.join(edge.select(F.col("source").alias("s"), "left", "prefix", "unit"), targets.source.eqNullSafe(F.col("s")), "left")
    return limits.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), full.alias("__full"), F.col("prefix").alias("__prefix"), (2 * F.col("left") >= F.col("unit")).alias("__with_unit")), n_sources


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: bool = False) -> DataFrame:
    """docs and, of each row: size, source_size, target, copies, taken; how often, and with how many words, the mix takes it.

    Without payload only the id, the source and those columns come back, and docs are read once; with it, all columns of docs do, read again.
    size counts runs of non-space characters; null text counts 0. A source whose target is below its size takes the documents of the
    smallest hashes; one above takes all and those again. Equal ids have equal hashes and are one unit; a null id is hashed by its text.
    Sources may be null; empty tables give empty results. Same input, same rows.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    base = docs.drop(*made)
    wide = sized(base if payload else base.select(*dict.fromkeys([id_col, text_col, source_col])), id_col, text_col, source_col)
    narrow = wide.select(*dict.fromkeys([id_col, source_col]), "__source", "__size", "__h")
    stored = cut(narrow, "sizes")
    limits, n_sources = thresholds(stored.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__h").alias("h")), weights, share, most)
    rows = wide if payload else stored
    out = rows.join(bounded(limits, n_sources, 80), rows["__source"].eqNullSafe(F.col("__of")))
    more = F.when(F.col("__prefix").isNull(), F.col("__target") > F.col("__full") * F.col("__source_size")).otherwise((F.col("__h") < F.col("__prefix")) | ((F.col("__h") == F.col("__prefix")) & F.col("__with_unit")))
    out = out.withColumn("copies", F.col("__full") + more.cast("bigint"))
    keep = base.columns if payload else dict.fromkeys([id_col, source_col])
    return out.select(*keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mix_sql(source: str, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> str:
    """DuckDB SQL for mix() over the relation `source`: columns doc_id, size, source_size, target, copies, taken and those of source."""
    w = ", ".join(f"{float(x)}::DOUBLE" for x in weights)
    return f"""
WITH sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM ({source}) d),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM per_source),
weighed AS (SELECT *, ([{w}])[(rank % {len(weights)} + 1)::INT] AS w, source_size * {float(most)}::DOUBLE AS cap FROM ranked),
summed AS (SELECT *, sum(source_size) OVER () * {float(share)}::DOUBLE AS total, sum(w) OVER () AS weight,
  coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
  coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gone FROM weighed),
levelled AS (SELECT *, max((total - caps) / (weight - gone)) OVER () AS level FROM summed),
targets AS (SELECT source, source_size, least(cap, level * w)::DOUBLE AS target,
  CASE WHEN source_size > 0 THEN floor(least(cap, level * w) / source_size) ELSE 0 END::BIGINT AS full_copies FROM levelled),
placed AS (SELECT s.*, t.source_size, t.target, t.full_copies,
  sum(s.size) OVER (PARTITION BY s.source ORDER BY h) AS upto, sum(s.size) OVER (PARTITION BY s.source, h) AS unit
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (full_copies + CASE WHEN 2 * (upto - unit) + unit <= 2 * (target - full_copies * source_size) AND target > full_copies * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
SELECT *, copies * size AS taken FROM counted"""
