"""Tables written to the folder that driver and executors share, to cut lineage or to stage a swap."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[object, object]] = []


@atexit.register
def _sweep() -> None:
    for fs, path in _made:
        try:
            fs.delete(path, True)
        except Exception:  # the session, or the store, may be gone by now
            pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs on one machine; elsewhere it must be set."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="landgrid-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/landgrid/{label}-{uuid.uuid4().hex}"
    _made.append(hadoop_path(spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    Shuffle files of the write are dropped once it is done, as nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def free(df: DataFrame) -> None:
    """Delete the files of a table that cut made and nothing will read again."""
    fs, path = hadoop_path(df.sparkSession, df.scratch)
    fs.delete(path, True)
