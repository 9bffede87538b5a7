"""Plans are the ones that hold at scale: no products, pruned scans, filters and partitions pushed down."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from landgrid.scratch import scratch_path
from landgrid.sources import readers, sinks

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@here
@pytest.mark.parametrize("name", ["neighbour_counts", "zonal_counts", "road_length_500m", "point_in_polygon", "relative_features", "hex_rollup", "municipality_features", "spearman"])
def test_no_products(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


@here
def test_rollup_reads_and_shuffles_once(spark):
    text = plan(entry.queries()["hex_rollup"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Python" not in text


@here
def test_scans_are_pruned(spark):
    text = plan(entry.queries()["age_features"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint>" in text


def test_only_the_partitions_asked_for_are_read(spark):
    base = scratch_path(spark, "pruned")
    o = spark.createDataFrame([("a", "house", 1.0, 2.0, "R"), ("b", "apartment", 1.0, 2.0, "R")], "object_id string, asset_class string, lat double, lon double, region string")
    sinks.save_objects(o, base)
    got = readers.partitioned(spark, base, asset_class="house").where("lat > 0")
    text = plan(got)
    assert "PartitionFilters: [isnotnull(asset_class" in text and "PushedFilters: [IsNotNull(lat), GreaterThan(lat,0.0)]" in text
    assert len(got.inputFiles()) >= 1 and got.count() == 1
