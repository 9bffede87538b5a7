from __future__ import annotations

import math

import numpy as np
import pytest

from landgrid import scratch
from landgrid.functions import areas, discs, kernels
from landgrid.functions.geo import with_utm
from landgrid.operators import graph, layers, radius, spatial
from tests.test_geo import LAT, LON, haversine

DLAT, DLON = 1 / 111_194.9, 1 / (111_194.9 * math.cos(math.radians(LAT)))


def at(east: float, north: float) -> tuple[float, float]:
    return LAT + north * DLAT, LON + east * DLON


def points(spark, rows):
    return spark.createDataFrame([(i, *at(e, n)) for i, e, n in rows], "object_id string, lat double, lon double")


@pytest.mark.parametrize(("lat0", "lon0", "spread", "radius"), [(55.7, 49.0, 0.1, 500.0), (0.0, 179.98, 0.05, 700.0), (0.0, -179.999, 0.05, 700.0), (89.9, 10.0, 0.2, 20_000.0), (-89.99, 10.0, 0.02, 3_000.0), (80.0, 0.0, 0.05, 500.0)])
def test_discs_equal_all_distances(lat0, lon0, spread, radius):
    rng = np.random.default_rng(1)
    lat = np.clip(lat0 + rng.uniform(0, spread, 1500), -90, 90)
    lon = (lon0 + rng.uniform(0, spread * (1 if abs(lat0) < 85 else 3600), 1500) + 180) % 360 - 180
    weight, d = rng.random(1500), discs.haversine(lat[:200, None], lon[:200, None], lat, lon)
    assert (discs.Strips(lat, lon, None, radius).totals(lat[:200], lon[:200]) == (d < radius).sum(1)).all()
    assert np.allclose(discs.Strips(lat, lon, weight, radius).totals(lat[:200], lon[:200]), np.where(d < radius, weight, 0).sum(1), atol=1e-12)


@pytest.mark.parametrize("most", [1 << 16, 20])
def test_totals_equal_all_pairs_also_where_tiles_are_dealt(spark, monkeypatch, most):
    monkeypatch.setattr(radius, "MOST_PLACES", most)
    monkeypatch.setattr(radius, "MOST_POINTS", most)
    rng = np.random.default_rng(5)
    a = [(str(i), float(la), float((lo + 180) % 360 - 180)) for i, (la, lo) in enumerate(zip(rng.uniform(10, 10.05, 60), rng.uniform(179.97, 180.03, 60), strict=True))]
    b = [("x" if i % 3 else "y", float(la), float((lo + 180) % 360 - 180), float(i)) for i, (la, lo) in enumerate(zip(rng.uniform(10, 10.05, 150), rng.uniform(179.97, 180.03, 150), strict=True))]
    places = spark.createDataFrame([*a, ("none", None, 3.0)], "object_id string, lat double, lon double")
    pts = spark.createDataFrame([*b, ("x", None, None, 1.0)], "kind string, lat double, lon double, v double")
    n = {r.object_id: (r.x1, r.x2, r.y2, r.z) for r in radius.radius_totals(places, pts, "object_id", [("x1", "x", 300.0), ("x2", "x", 900.0), ("y2", "y", 900.0), ("z", "z", 900.0)]).collect()}
    s = {r.object_id: r.x2 for r in radius.radius_totals(places, pts, "object_id", [("x2", "x", 900.0)], "v").collect()}
    for i, la, lo in a:
        d = [(k, haversine(la, lo, ma, mo), v) for k, ma, mo, v in b]
        assert n[i] == (sum(k == "x" and x < 300 for k, x, _ in d), sum(k == "x" and x < 900 for k, x, _ in d), sum(k == "y" and x < 900 for k, x, _ in d), 0)
        assert s[i] == pytest.approx(sum(v for k, x, v in d if k == "x" and x < 900))


def test_pairs_and_nearest_cross_the_meridian(spark):
    o = spark.createDataFrame([("a", 60.0, 179.9999)], "object_id string, lat double, lon double")
    p = spark.createDataFrame([("near", 60.0, -179.9999), ("far", 60.0, 175.0)], "layer string, lat double, lon double")
    assert [r.r_layer for r in spatial.radius_pairs(o, p, 500.0).collect()] == ["near"]
    r = spatial.nearest_points(o, p, "object_id").first()
    assert r.r_layer == "near" and r.distance_m == pytest.approx(11.1, abs=0.1)


@pytest.mark.parametrize("lat0", [0.0, 55.8, -33.0, 78.0, -89.98])
def test_radius_join_equals_all_pairs(spark, lat0):
    rng = np.random.default_rng(3)
    p = [(str(i), float(lat0 + y), float(10 + x)) for i, (y, x) in enumerate(rng.uniform(-0.02, 0.02, (120, 2)))]
    df = spark.createDataFrame(p, "object_id string, lat double, lon double")
    got = {(r.object_id, r.r_object_id) for r in spatial.radius_pairs(df, df, 700.0).collect()}
    assert got == {(a, b) for a, la, lo in p for b, ma, mo in p if haversine(la, lo, ma, mo) < 700}
    assert len(got) > 120


def test_neighbours_leave_out_the_object_itself_but_not_its_twin(spark):
    o = spark.createDataFrame([("a", "house", *at(0, 0)), ("b", "house", *at(0, 0)), ("c", "apartment", *at(300, 0)), ("d", "commercial", *at(900, 0)), ("e", None, None, None)], "object_id string, asset_class string, lat double, lon double")
    got = {r.object_id: (r.count_apartments_500m, r.count_houses_500m, r.count_commercial_500m) for r in spatial.neighbour_counts(o).collect()}
    assert got == {"a": (1, 1, 0), "b": (1, 1, 0), "c": (0, 2, 0), "d": (0, 0, 0), "e": (0, 0, 0)}


def test_zones_count_by_radius_and_empty_layers_are_zero(spark):
    o = points(spark, [("a", 0, 0)])
    layer = spark.createDataFrame([("school", *at(90, 0)), ("school", *at(250, 0)), ("school", *at(799, 0)), ("cafe", *at(0, 2000))], "layer string, lat double, lon double")
    r = spatial.zonal_counts(o, layer, ["school", "cafe", "park"], [100, 300, 800]).first()
    assert (r.school_within_100m, r.school_within_300m, r.school_within_800m, r.cafe_within_800m, r.park_within_100m) == (1, 2, 3, 0, 0)
    own = layer.select("layer", "lat", "lon").limit(0).selectExpr("layer", "lat", "lon", "cast(null as string) as object_id").union(spark.createDataFrame([("school", *at(0, 0), "a"), ("school", *at(0, 0), "x")], "layer string, lat double, lon double, object_id string"))
    assert spatial.zonal_counts(o, own, ["school"], [100]).first().school_within_100m == 1


def test_radius_is_strict(spark):
    o = points(spark, [("a", 0, 0)])
    p = spark.createDataFrame([("s", *at(0, 500))], "layer string, lat double, lon double")
    d = spatial.radius_pairs(o, p, 600.0).first().distance_m
    assert spatial.radius_pairs(o, p, d).count() == 0
    assert spatial.radius_pairs(o, p, math.nextafter(d, 1e9)).count() == 1


def test_nearest_goes_as_far_as_needed(spark):
    o = points(spark, [("a", 0, 0), ("b", 90_000, 0)])
    p = spark.createDataFrame([("s", *at(100, 0)), ("t", *at(0, -3000))], "layer string, lat double, lon double")
    got = {r.object_id: r.r_layer for r in spatial.nearest_points(o, p, "object_id").collect()}
    assert got == {"a": "s", "b": "s"}


def box(e0, n0, e1, n1):
    c = [at(e, n) for e, n in ((e0, n0), (e1, n0), (e1, n1), (e0, n1), (e0, n0))]
    return "POLYGON ((" + ", ".join(f"{lo} {la}" for la, lo in c) + "))"


def scanned(polygons, x, y, r, lines=3000):
    """Area of the union of polygons in a disc of 32 corners, by the middles of thin lines."""
    corners = [(math.sin(k * math.pi / 16) * r, math.cos(k * math.pi / 16) * r) for k in range(-8, 9)]
    total, thick = 0.0, 2 * r / lines
    for i in range(lines):
        v = -r + (i + 0.5) * thick
        half = float(np.interp(v, [c[0] for c in corners], [c[1] for c in corners]))
        spans = []
        for rings in polygons:
            cross = sorted(x1 + (x2 - x1) * (v + y - y1) / (y2 - y1) - x for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False) if (y1 > v + y) != (y2 > v + y))
            spans += [(max(-half, a), min(half, b)) for a, b in zip(cross[::2], cross[1::2], strict=True)]
        reach = -half
        for a, b in sorted(spans):
            total += max(0.0, b - max(a, reach)) * thick
            reach = max(reach, b)
    return total


@pytest.mark.parametrize("n", [1, 4, 25, 90])
def test_outlines_of_unions_equal_scan_lines(n):
    rng = np.random.default_rng(n)
    polygons = []
    for c in rng.uniform(0, 3000, (n, 2)):
        t, d = np.sort(rng.uniform(0, 2 * math.pi, 8)), rng.uniform(50, 700, 8)
        ring = c + np.stack([d * np.cos(t), d * np.sin(t)], 1)
        polygons.append([np.vstack([ring, ring[:1]])])
    polygons.append([np.array([[0, 0], [900, 0], [900, 900], [0, 900], [0, 0.0]]), np.array([[300, 300], [600, 300], [600, 600], [300, 600], [300, 300.0]])])
    cells: dict = {}
    for p in polygons:
        for cx, cy, own in areas.by_cell(areas.upward(kernels.edges(p)), 1000.0):
            cells.setdefault((cx, cy), []).append(own)
    x, y = rng.uniform(0, 3000, (2, 6))
    got = np.zeros(6)
    for (cx, cy), own in cells.items():
        owner = np.repeat(np.arange(len(own)), [len(p) for p in own])
        got += areas.disc_areas(x, y, areas.outline(np.concatenate(own), owner, (cx * 1000.0, cy * 1000.0, cx * 1000.0 + 1000, cy * 1000.0 + 1000)), 400.0)
    assert got == pytest.approx([scanned(polygons, a, b, 400.0) for a, b in zip(x, y, strict=True)], abs=100)


def test_shares(spark):
    o = points(spark, [("a", 0, 0), ("far", 30_000, 0)])
    g = spark.createDataFrame([("water", box(-2000, -2000, 2000, 2000)), ("park", box(0, -2000, 2000, 2000)), ("park", box(0, -1000, 1000, 1000)), ("forest", "LINESTRING (49 55, 50 56)")], "layer string, wkt string")
    r = {x.object_id: x for x in layers.area_shares(o, g, ["water", "park", "forest", "none"], [100, 500]).collect()}
    assert r["a"].water_share_500m == pytest.approx(1.0) and r["a"].park_share_500m == pytest.approx(0.5, abs=0.01)
    assert r["a"].forest_share_500m == 0 and r["a"].none_share_100m == 0 and r["far"].water_share_500m == 0


def test_distances_have_no_end(spark):
    o = points(spark, [("a", 0, 0)])
    g = spark.createDataFrame([("water", box(290_000, 0, 291_000, 1000)), ("line", "LINESTRING ({1} {0}, {3} {2})".format(*at(-40_000, -30_000), *at(40_000, 50_000)))], "layer string, wkt string")
    r = layers.geometry_distances(o, g, ["water", "line"]).first()
    (x, y), (x1, y1), (x2, y2) = (kernels.to_utm(*map(np.array, p)) for p in (at(0, 0), at(-40_000, -30_000), at(40_000, 50_000)))
    assert r.dist_to_water_m == pytest.approx(290_000, rel=0.01)
    assert r.dist_to_line_m == pytest.approx(abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / math.hypot(x2 - x1, y2 - y1), abs=1e-3)


def brute_distance(x, y, polygons):
    """To the nearest edge, 0 within; polygons as lists of rings."""
    best = math.inf
    for rings in polygons:
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                odd ^= (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1)
                l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
                t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) if l2 else 0.0
                best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        best = 0.0 if odd else best
    return best


def test_distances_and_shares_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    star = lambda e, n, k: np.array([at(e + r * math.cos(t), n + r * math.sin(t)) for r, t in zip(rng.uniform(100, 900, k), np.sort(rng.uniform(0, 2 * math.pi, k)), strict=True)])
    rings = [star(e, n, 7) for e, n in rng.uniform(-3000, 3000, (12, 2))]
    rings = [np.vstack([r, r[:1]]) for r in rings]
    g = spark.createDataFrame([("water", kernels.to_wkt("POLYGON", [[r[:, ::-1]]])) for r in rings], "layer string, wkt string")
    o = points(spark, [(str(i), float(e), float(n)) for i, (e, n) in enumerate(rng.uniform(-4000, 4000, (40, 2)))])
    flat = [[np.stack(kernels.to_utm(r[:, 0], r[:, 1]), 1)] for r in rings]
    at_ = {r.object_id: (r.utm_x, r.utm_y) for r in with_utm(o).collect()}
    got = {r.object_id: r.dist_to_water_m for r in layers.geometry_distances(o, g, ["water"]).collect()}
    for i, (x, y) in at_.items():
        assert got[i] == pytest.approx(brute_distance(x, y, flat), abs=1e-6)
    shares = {r.object_id: (r.water_share_200m, r.water_share_700m) for r in layers.area_shares(o, g, ["water"], [200, 700]).collect()}
    for i, (x, y) in at_.items():
        assert shares[i] == pytest.approx([scanned(flat, x, y, r) / areas.disc_area(r) for r in (200.0, 700.0)], abs=2e-4)
    monkeypatch.setattr(layers, "MOST_BYTES", 100)
    monkeypatch.setattr(radius, "MOST_PLACES", 5)
    again = {r.object_id: (r.water_share_200m, r.water_share_700m) for r in layers.area_shares(o, g, ["water"], [200, 700]).collect()}
    assert all(again[i] == pytest.approx(shares[i], abs=1e-9) for i in at_)


def test_distances(spark):
    o = points(spark, [("in", 0, 0), ("out", 700, 0)])
    line = "LINESTRING ({1} {0}, {3} {2})".format(*at(-100, 1000), *at(1000, 1000))
    point = "POINT ({1} {0})".format(*at(0, -5000))
    g = spark.createDataFrame([("water", box(-500, -500, 500, 500)), ("railway", line), ("school", point)], "layer string, wkt string")
    r = {x.object_id: x for x in layers.geometry_distances(o, g, ["water", "railway", "school", "none"]).collect()}
    assert r["in"].dist_to_water_m == 0 and r["out"].dist_to_water_m == pytest.approx(200, abs=1)
    assert r["in"].dist_to_railway_m == pytest.approx(1000, abs=3) and r["in"].dist_to_school_m == pytest.approx(5000, abs=15)
    assert r["in"].dist_to_none_m is None


def test_polygons_and_boundary(spark):
    p = spark.createDataFrame([("in", 0.5, 0.5), ("edge", 0.0, 0.5), ("corner", 1.0, 1.0), ("out", 2.0, 2.0), ("null", None, None)], "object_id string, lat double, lon double")
    square = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    assert {r.object_id for r in spatial.filter_inside(p, square).collect()} == {"in"}
    named = spark.createDataFrame([("first", 1, square), ("second", 2, square)], "name string, ord int, wkt string")
    assert {r.object_id: r.intra_city_raion for r in spatial.districts_of(p, named).collect()} == {"in": "first", "edge": "first", "corner": "first"}


def test_graph_detour_and_unreached(spark):
    # A road that turns: the path is longer than the straight line; a second component isn't reached.
    way = [at(0, 0), at(0, 400), at(400, 400)]
    other = [at(9000, 0), at(9000, 100)]
    ways = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in w],) for w in (way, other)], "geometry array<struct<lat: double, lon: double>>")
    o = points(spark, [("a", 0, 0), ("lost", 9000, 0)])
    stations = spark.createDataFrame([("s", *at(400, 400))], "target string, lat double, lon double")
    r = {x.object_id: x for x in graph.metro_by_graph(o, graph.road_edges(ways), stations, stations).collect()}
    assert r["a"].dist_metro_m == pytest.approx(800, rel=0.01) and r["a"].count_stations_1km == 1 and r["a"].count_entrances_500m == 0
    assert r["lost"].dist_metro_m == 1e9 and r["lost"].count_stations_1km == 0


@pytest.mark.parametrize("block", [1 << 20, 6])
def test_paths_equal_relaxing_all_edges(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    rng = np.random.default_rng(9)
    at_ = [at(float(x), float(y)) for x, y in rng.uniform(0, 3000, (40, 2))]
    ends = [(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2)) if a != b]
    edges = [(i, j, haversine(*at_[i], *at_[j])) for i, j in ends]
    df = spark.createDataFrame([(*at_[i], *at_[j], d) for i, j, d in edges], "from_lat double, from_lon double, to_lat double, to_lon double, length_m double")
    starts = [("s", math.inf, 0, 5.0), ("s", math.inf, 1, 0.0), ("t", 900.0, 2, 10.0), ("u", 900.0, 3, 0.0), ("u", 900.0, 3, 40.0)]
    got = {(r.label, r.lat, r.lon): r.path_m for r in graph.shortest_paths(df, spark.createDataFrame([(k, lim, *at_[i], d) for k, lim, i, d in starts], "label string, limit_m double, lat double, lon double, path_m double")).collect()}
    want: dict = {}
    for k, lim, i, d in starts:
        want[k, i] = min(d, want.get((k, i), math.inf))
    limit = {k: lim for k, lim, *_ in starts}
    for _ in range(40):
        for (k, i), d in list(want.items()):
            for a, b, n in edges:
                for x, y in ((a, b), (b, a)):
                    if x == i and d + n < min(limit[k], want.get((k, y), math.inf)):
                        want[k, y] = d + n
    assert {k: round(v, 6) for k, v in got.items()} == {(k, *at_[i]): round(v, 6) for (k, i), v in want.items()}


def test_many_stations_are_joined_to_the_same_features(spark, monkeypatch):
    from landgrid.operators import hexgrid

    cover = hexgrid.cover_box(spark, 8, 55.75, 49.05, 55.8, 49.15)
    s = spark.createDataFrame([(str(i), *at(i * 300.0, i * -150.0)) for i in range(8)], "target string, lat double, lon double")
    rows = lambda: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in hexgrid.metro_features(cover, s, s).collect())
    few = rows()
    monkeypatch.setattr(hexgrid, "MOST_POINTS", 1)
    assert rows() == few and len(few) > 20


def test_blocks_of_a_graph_send_no_row_for_each_cell(spark, monkeypatch):
    """Before, every cell that holds an edge was broadcast, up to 2**20 rows through the driver; now a row for each run of cells."""
    sent, broadcast = [], graph.F.broadcast
    monkeypatch.setattr(graph.F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    monkeypatch.setattr(graph, "BLOCK_EDGES", 700)
    rng = np.random.default_rng(4)
    # Half of the nodes lie so close together that one run of cells holds several blocks.
    at_ = [at(float(x), float(y)) for x, y in np.concatenate([rng.uniform(0, 30000, (1500, 2)), rng.uniform(10000, 10800, (1500, 2))])]
    ends = [(i, i + 1) for i in range(len(at_) - 1)]
    df = spark.createDataFrame([(*at_[i], *at_[j], haversine(*at_[i], *at_[j])) for i, j in ends], "from_lat double, from_lon double, to_lat double, to_lon double, length_m double")
    starts = spark.createDataFrame([("s", 1500.0, *at_[i], 0.0) for i in (0, 1490, 2000)], "label string, limit_m double, lat double, lon double, path_m double")
    got = {(r.lat, r.lon): r.path_m for r in graph.shortest_paths(df, starts).collect()}
    along = np.concatenate([[0.0], np.cumsum([haversine(*at_[i], *at_[j]) for i, j in ends])])
    least = np.min([np.abs(along - along[i]) for i in (0, 1490, 2000)], axis=0)
    want = {a: d for a, d in zip(at_, least, strict=True) if d < 1500.0}
    assert got.keys() == want.keys() and len(want) > 4 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert sent and max(sent) <= 1 << graph.BITS


@pytest.mark.parametrize("first", [[0], [7], [0, 5, 1024, 1030, 5000], [3, 1023, 1 << 19, (1 << 20) - 1]])
def test_runs_of_cells_give_each_cell_its_block(spark, first):
    runs = {r[0]: (r[1], r[2]) for r in graph._runs(spark, first).collect()}
    assert len(runs) == 1 << graph.BITS and sum(len(later) for _, later in runs.values()) <= len(first)
    for c in {x + d for x in first for d in (-1, 0, 1, 1024)} & set(range(1 << 20)):
        block, later = runs[c >> graph.BITS]
        assert block + sum(x <= c for x in later) == max(np.searchsorted(first, c, side="right") - 1, 0)


def test_no_join_of_the_graph_broadcasts_what_fits_few_megabytes_of_files(spark, monkeypatch):
    """Before, objects and rings that are small as compressed files were broadcast through the driver by Spark's own choice."""
    plans, stored = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    ways = [[(float(i), 0.0), (float(i + 90), 0.0)] for i in range(0, 900, 90)]
    df = spark.createDataFrame([(*at(*a), *at(*b), haversine(*at(*a), *at(*b))) for a, b in ways], "from_lat double, from_lon double, to_lat double, to_lon double, length_m double")
    df = scratch.cut(df, "few")
    o = scratch.cut(points(spark, [("near", 100.0, 5.0), ("far", 890.0, 2000.0)]), "few")
    s = scratch.cut(points(spark, [("1", 0.0, 0.0)]).withColumnRenamed("object_id", "target"), "few")
    out = graph.metro_by_graph(o, df, s, s)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
    got = {r.object_id: (r.dist_metro_m, r.count_stations_1km) for r in out.collect()}
    assert got["near"][0] == pytest.approx(90 + math.hypot(10, 5), abs=0.1) and got["near"][1] == 1 and got["far"][1] == 0


@pytest.mark.parametrize(("limit", "sent"), [(math.inf, 1 << 15), (math.inf, 0), (900.0, 1 << 15)])
def test_short_edges_first_give_the_same_paths(spark, monkeypatch, limit, sent):
    """Nodes with dozens of random edges, some with only long ones, starts among these, and an edge that jumps between two parts."""
    monkeypatch.setattr(graph, "BLOCK_EDGES", 900)
    monkeypatch.setattr(graph, "MOST_SENT", sent)
    searched, search = [], graph._search
    monkeypatch.setattr(graph, "_search", lambda both, least, found=None: (searched.append(both.count()), search(both, least, found))[1])
    rng = np.random.default_rng(8)
    n = 220
    where = [at(float(x), float(y)) for x, y in rng.uniform(0, 3000, (n, 2))]
    where += [at(9000.0 + 40 * i, 9000.0) for i in range(6)] + [at(3000.0 + i, 6000.0 - i) for i in range(8)]
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, n, (4500, 2)) if p[0] != p[1]}
    pairs |= {(n + i, n + i + 1) for i in range(5)} | {(3, n)} | {(int(rng.integers(0, n)), n + 6 + i) for i in range(8)}
    ends = [(i, j, haversine(*where[i], *where[j])) for i, j in sorted(pairs)]
    df = spark.createDataFrame([(*where[i], *where[j], d) for i, j, d in ends], "from_lat double, from_lon double, to_lat double, to_lon double, length_m double")
    starts = [("s", 5, 10.0), ("s", n + 7, 1.0), ("e", n + 9, 0.0), ("e", 40, 30.0)]
    got = {(r.label, r.lat, r.lon): r.path_m for r in graph.shortest_paths(df, spark.createDataFrame([(k, limit, *where[i], d) for k, i, d in starts], "label string, limit_m double, lat double, lon double, path_m double")).collect()}
    want = {}
    for label in ("s", "e"):
        best = np.full(len(where), np.inf)
        for _, i, d in (x for x in starts if x[0] == label):
            best[i] = d
        for _ in where:
            for i, j, d in ends:
                best[i], best[j] = min(best[i], best[j] + d), min(best[j], best[i] + d)
        want |= {(label, *where[i]): float(d) for i, d in enumerate(best) if d < limit}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    # Within 900 m no longer edge shortens a path: there is no second search.
    assert len(searched) == (2 if limit == math.inf else 1) and searched[0] < len(ends)
