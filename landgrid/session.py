"""Session for one machine; on a cluster, sessions come configured."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("landgrid").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
