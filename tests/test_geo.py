from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.functions import kernels
from landgrid.functions.geo import apply_steps, center_steps, disk_offsets, hex_steps, utm_steps, with_cell, with_utm

LAT, LON = 55.7887, 49.1221


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def test_cell_center_lies_in_its_cell(spark):
    rng = np.random.default_rng(1)
    rows = [(float(LAT + x), float(LON + y)) for x, y in rng.uniform(-0.2, 0.2, (300, 2))]
    df = with_cell(spark.createDataFrame(rows, "lat double, lon double"), 9)
    again = apply_steps(df.select("h3_index").distinct(), center_steps("h3_index"), hex_steps(9, "again"))
    assert again.where("h3_index <> again").count() == 0
    assert len(disk_offsets(1)) == 7 and len(disk_offsets(2)) == 19


def test_null_coordinates_have_no_cell(spark):
    assert with_cell(spark.createDataFrame([(None, 1.0)], "lat double, lon double"), 8).first().h3_index is None


def test_utm_agrees_with_known_distances(spark):
    # Along the central meridian the scale is 0.9996: a degree of latitude near 55.5 is 111.33 km on the ellipsoid.
    df = spark.createDataFrame([(55.0, 51.0), (56.0, 51.0), (55.0, 51.01)], "lat double, lon double")
    x = apply_steps(df, utm_steps("lat", "lon")).orderBy("lat", "lon").collect()
    assert x[0].utm_x == pytest.approx(500_000, abs=1e-3)
    assert (x[2].utm_y - x[0].utm_y) == pytest.approx(111_324.6 * 0.9996, rel=2e-4)
    assert (x[1].utm_x - x[0].utm_x) == pytest.approx(6_378_137 / math.sqrt(1 - 0.00669438 * math.sin(math.radians(55)) ** 2) * math.cos(math.radians(55)) * math.radians(0.01) * 0.9996, rel=1e-5)


def test_shapes():
    square = kernels.shape("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")
    assert square[0] == 100 and square[1] == 40 and square[2] == pytest.approx(math.pi / 4) and square[3] == 1 and square[6] == 4
    bar = kernels.shape("POLYGON ((0 0, 100 0, 100 10, 0 10, 0 0))")
    assert bar[4] == pytest.approx(10) and bar[5] in (0, 180)
    ell = kernels.shape("POLYGON ((0 0, 20 0, 20 10, 10 10, 10 20, 0 20, 0 0))")
    assert ell[3] < 0.9 and ell[0] == 300
    s = math.sqrt(0.5)
    turned = kernels.shape(f"POLYGON ((0 0, {100 * s} {100 * s}, {90 * s} {110 * s}, {-10 * s} {10 * s}, 0 0))")
    assert turned[5] == pytest.approx(45) and turned[4] == pytest.approx(10)
    triangle = kernels.shape("POLYGON ((0 0, 10 0, 0 10, 0 0))")
    assert triangle[0] == 50 and triangle[3] == pytest.approx(1)
    assert kernels.shape(None) is None and kernels.shape("POLYGON EMPTY") is None
    two = kernels.shape("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))")
    assert two[0] == 2 and two[6] == 9


def test_projections_agree(spark):
    rows = spark.createDataFrame([(55.79, 49.1), (0.0, 51.0), (-33.0, 53.5), (70.0, 48.0)], "lat double, lon double")
    for r in with_utm(rows).collect():
        assert kernels.to_utm(np.array(r.lat), np.array(r.lon)) == pytest.approx((r.utm_x, r.utm_y), abs=1e-6)


@pytest.mark.parametrize("wkt", ["POINT (1 2)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"])
def test_wkt_round_trip(wkt):
    assert kernels.to_wkt(*kernels.parse_wkt(wkt)) == wkt


def test_centroids():
    assert kernels.centroid(*kernels.parse_wkt("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")) == pytest.approx((1, 1))
    assert kernels.centroid(*kernels.parse_wkt("LINESTRING (0 0, 2 0)")) == pytest.approx((1, 0))
    assert kernels.centroid(*kernels.parse_wkt("MULTIPOINT (0 0, 2 2)")) == pytest.approx((1, 1))
    assert F is not None
