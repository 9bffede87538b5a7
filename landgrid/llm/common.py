"""What the corpus operators share: slices of batches, hot-group aggregation, connected components; scratch tables come from the engine."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.scratch import cut, scratch_path

#: Runs of ASCII white space and what lies between them, as the operators' contracts define words by space.
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACES = r"[^\x20\x09-\x0D]+"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

__all__ = ["NON_SPACES", "SPACES", "bounded", "connected_components", "cut", "give_back", "rows_at_a_time", "salted_totals", "scratch_path", "small_batches"]


def rows_at_a_time(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a task's batches: what a worker turns into Python objects at once stays small. Memory goes back when the task ends."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def small_batches(spark: SparkSession, rows: int = 1_024) -> None:
    """Send at most so many rows at once to Python workers in this session: whole texts have no bound, and Spark's default counts rows."""
    now = int(spark.conf.get(BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH, rows)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and would otherwise hold the most they ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def bounded(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes, as counted, is within the limit; else df as it is, to be joined by a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def salted_totals(rows: DataFrame, keys: list[str], salt_on: Column, partial: dict[str, Column], final: dict[str, Column], salts: int = 64) -> DataFrame:
    """rows with their group's totals, without ever bringing a group to one task.

    partial: aggregates over a group's rows of one salt; final: aggregates over those. A group's rows are spread over up to `salts`
    tasks, and its totals are sent once to each salt that occurs. Keys that are null match each other.
    """
    salt = "__salt"
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, salt).agg(*[c.alias(n) for n, c in partial.items()])
    totals = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()], F.collect_set(salt).alias("__salts"))
    sent = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *final, F.explode("__salts").alias("__to"))
    on = salted[salt] == sent["__to"]
    for i, k in enumerate(keys):
        on &= salted[k].eqNullSafe(sent[f"__k{i}"])
    return salted.join(sent, on).drop(salt, "__to", *[f"__k{i}" for i in range(len(keys))])


def connected_components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b: long); component is the smallest id that can be reached.

    Alternates large-star and small-star steps: each replaces a node's links by links to its smallest neighbour, by grouped
    minima and joins only, until no link changes (a logarithmic number of rounds in practice). A node that very many link to is
    spread over salts, and its minimum sent to each. Self-links keep an id in the result.
    """

    def lowest(links: DataFrame) -> DataFrame:
        return salted_totals(links, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})

    alone = edges.where("a = b").select(F.col("a").alias("id"))
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    alone = cut(alone.distinct(), label)
    sign = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == sign:
            break
        sign = seen
        both = now.union(now.select("v", "u"))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near = lowest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("v"))
        now = cut(small.union(root).distinct(), label)
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    ids = found.union(now.select(F.col("v"), F.col("v")).distinct())
    return ids.union(alone.join(ids, "id", "left_anti").select("id", F.col("id").alias("component")))
