"""The driver's tables in the roles of the engine's inputs. They hold no coordinates: these are made from keys, alike in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from landgrid.functions.geo import num

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lat(k: str) -> str:
    return f"({num(55.74)} + CAST(({k} * {k} + 3 * {k}) % 10007 AS DOUBLE) / {num(10007)} * {num(0.09)})"


def lon(k: str) -> str:
    return f"({num(49.04)} + CAST(({k} * {k} * {k} + 7 * {k}) % 10009 AS DOUBLE) / {num(10009)} * {num(0.16)})"


#: Valuation objects: one a customer.
OBJECTS = f"""(SELECT concat('c/', CAST(c_custkey AS STRING)) AS object_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'apartment' WHEN 'BUILDING' THEN 'house' WHEN 'FURNITURE' THEN 'commercial' WHEN 'MACHINERY' THEN 'landplot' END AS asset_class,
  {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon, CAST(c_acctbal AS DOUBLE) AS synthetic_target_rub_per_m2,
  CAST(c_custkey % 25 + 1 AS BIGINT) AS levels, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 200 AS BIGINT) END AS flats,
  CAST(20 + c_custkey % 180 AS DOUBLE) AS area_m2, CASE WHEN c_custkey % 17 = 0 THEN CAST(0 AS BIGINT) WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(1900 + c_custkey * 7 % 126 AS BIGINT) END AS year_built,
  CAST(c_acctbal AS DOUBLE) + CAST(c_custkey % 11 AS DOUBLE) * 10 AS y_pred_oof, CAST(c_custkey % 5 AS BIGINT) AS fold_id,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE concat('raion ', CAST(c_nationkey % 8 AS STRING)) END AS intra_city_raion FROM customer)"""

#: Stations and entrances: a station for each supplier, and an entrance beside it.
STATIONS = f"(SELECT CAST(s_suppkey AS STRING) AS target, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon FROM supplier)"
ENTRANCES = f"(SELECT CAST(s_suppkey AS STRING) AS target, {lat('(s_suppkey + 7)')} AS lat, {lon('(s_suppkey + 7)')} AS lon FROM supplier)"

#: Points of layers: parts, by their type.
POINTS = f"(SELECT lower(p_type) AS layer, {lat('(p_partkey + 11)')} AS lat, {lon('(p_partkey + 11)')} AS lon FROM part)"

#: Ways: the lines of an order, in order, a part for each node.
NODES = f"(SELECT l_orderkey AS way, l_linenumber AS n, {lat('l_partkey')} AS lat, {lon('l_partkey')} AS lon FROM lineitem)"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the driver's tables that text names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text if text.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT * FROM {text}")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    nodes = sql(spark, sf_dir, NODES)
    return nodes.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geometry"))
