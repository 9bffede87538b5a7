"""Token counts of flat, unindexed token files by a separator scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.llm.common import cut, rows_at_a_time, small_batches

#: Schemes whose files workers read by range themselves; files of others come through Spark's own reader.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "gcs")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    part = urlparse(uri)
    if part.scheme in ("", "file"):
        return fs.LocalFileSystem(), part.path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_token_files(tokens: DataFrame, folder: str, separator: int, dtype: str = "<u2", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Write each partition's ids to one flat file in folder, the separator after every document; (path, ordinal, id), to be written by the caller.

    A file's name is new for each attempt of a task; the rows name only the files of the attempts that count, so a lost executor leaves
    at most a file that nobody names. The separator must not be one of the ids. Null ids count as none.
    """
    kind = tokens.schema[id_col].dataType.simpleString()
    spark = tokens.sparkSession
    small_batches(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = _opened(folder)
        where.create_dir(name, recursive=True)
        file = f"tokens-{uuid.uuid4().hex}.bin"
        ordinal, out = 0, None
        names: list[pa.RecordBatch] = []
        try:
            for batch in rows_at_a_time(batches):
                out = out or where.open_output_stream(f"{name}/{file}")
                for ids in batch.column(1):
                    a = np.asarray(ids.values) if ids.is_valid else np.zeros(0, np.int32)
                    if (a == separator).any():
                        raise ValueError("a document holds the separator")
                    out.write(np.append(a, separator).astype(dtype).tobytes())
                n = len(batch)
                names.append(pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "id"]))
                ordinal += n
        finally:
            if out:
                out.close()
        yield from names

    return tokens.select(id_col, ids_col).mapInArrow(run, f"file string, ordinal bigint, id {kind}").withColumnRenamed("id", id_col)


BLOCK = "file string, block bigint, start bigint, n bigint, first bigint, last bigint, inner array<bigint>"


def _scanned(file: str, block: int, start: int, raw: bytes, dtype: str, separator: int) -> dict:
    """What a block shows by itself: its first and last separator, and the counts between neighbouring ones. start counts tokens."""
    ids = np.frombuffer(raw, dtype)
    at = np.flatnonzero(ids == separator)
    return {"file": file, "block": block, "start": start, "n": len(ids), "first": start + int(at[0]) if len(at) else None, "last": start + int(at[-1]) if len(at) else None, "inner": (np.diff(at) - 1).tolist()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("inner", pa.list_(pa.int64()))]))


def _read_ranges(block_bytes: int, width: int, dtype: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, name = _opened(path)
                with where.open_input_file(name) as f:
                    f.seek(block * block_bytes)
                    raw = f.read(min(block_bytes, length - length % width - block * block_bytes))
                yield _batch([_scanned(file, block, block * block_bytes // width, raw, dtype, separator)])

    return run


def _read_whole(block_bytes: int, width: int, dtype: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                for at in range(0, len(raw) - len(raw) % width, block_bytes):
                    yield _batch([_scanned(file, at // block_bytes, at // width, raw[at : min(at + block_bytes, len(raw) - len(raw) % width)], dtype, separator)])

    return run


def token_counts(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): every document of every file in folder, in order, without its separator.

    Files are flat arrays of ids and have no index. They are cut into blocks of block_tokens; each task finds the separators of its blocks
    in vectors. A document that spans blocks is stitched by a prefix scan over the blocks' few numbers: the last separator before a
    block says where its first document began, the separators before it say that document's ordinal. Tokens after a file's last
    separator are a document that is not ended. Empty files and bytes that don't fill a token give nothing.
    """
    width = np.dtype(dtype).itemsize
    block_bytes = block_tokens * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    if (urlparse(folder).scheme or "file") in RANGED:
        cuts = files.where("length > 0").select("path", file, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block_bytes).cast("bigint"))).alias("block"))
        blocks = cuts.repartition("path", "block").mapInArrow(_read_ranges(block_bytes, width, dtype, separator), BLOCK)
    else:
        blocks = files.select(file, "content").mapInArrow(_read_whole(block_bytes, width, dtype, separator), BLOCK)
    # The scan sees a few numbers a block; the counts within blocks wait for it in the shared folder.
    blocks = cut(blocks, "blocks")
    seps = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.size("inner") + 1)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    few = blocks.select("file", "block", "last", seps.alias("seps"))
    few = few.select("file", "block", F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("began"), F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("done"), F.lead("block").over(order).isNull().alias("final"))
    scan = blocks.join(few, ["file", "block"])
    counts = F.when(F.col("first").isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(F.array(F.col("first") - F.col("began")), F.col("inner")))
    rows = scan.select("file", "done", "began", F.posexplode(counts).alias("i", "n_tokens"))
    ended = rows.select("file", (F.col("done") + F.col("i")).cast("bigint").alias("ordinal"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.lit(True).alias("ended"))
    rest = scan.where("final").select("file", (F.col("done") + seps).cast("bigint").alias("ordinal"), (F.col("start") + F.col("n") - F.coalesce(F.col("last") + 1, F.col("began"))).cast("bigint").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest.where("n_tokens > 0"))
