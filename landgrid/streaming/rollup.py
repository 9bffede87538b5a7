"""Incremental hex counts over a stream of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landgrid.functions.geo import with_cell


def windowed_cells(stream: DataFrame, resolution: int, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by cell and window; a window closes, and its state goes, once the watermark has passed it."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    cells = with_cell(timed, resolution).withWatermark(time_col, late)
    return cells.groupBy(F.window(time_col, window).alias("w"), "h3_index").agg(F.count("*").alias("count"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "h3_index", "count", "value")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what there is and stop; closed windows are appended to Parquet."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
