"""Radius joins, nearest points, polygons, road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions.geo import haversine, steps_sql, utm_steps
from landgrid.operators import graph, layers, spatial
from landgrid.operators import objects as objs
from landgrid.queries import REGISTRY
from landgrid.queries.data import ENTRANCES, OBJECTS, POINTS, STATIONS, sql, ways
from landgrid.queries.grid import MIDDLES, SEGMENTS, rounded

D = haversine("a.lat", "a.lon", "b.lat", "b.lon")
NEIGHBOURS_SQL = f"""SELECT a.object_id, count(*) FILTER (b.asset_class = 'apartment') AS count_apartments_500m, count(*) FILTER (b.asset_class = 'house') AS count_houses_500m, count(*) FILTER (b.asset_class = 'commercial') AS count_commercial_500m
FROM {OBJECTS} a LEFT JOIN {OBJECTS} b ON a.object_id <> b.object_id AND abs(a.lat - b.lat) < 0.01 AND {D} < 500 GROUP BY a.object_id"""


@REGISTRY.add("neighbour_counts", NEIGHBOURS_SQL)
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbour_counts(sql(spark, sf_dir, OBJECTS)).select("object_id", "count_apartments_500m", "count_houses_500m", "count_commercial_500m")


_RADII = [300, 800]
_ZONES = f"(SELECT CASE WHEN n % 3 = 0 THEN 'school' WHEN n % 3 = 1 THEN 'cafe' ELSE 'clinic' END AS layer, lat, lon FROM (SELECT *, CAST(round((lat - 55) * 1000000) AS BIGINT) AS n FROM {POINTS} p) q)"


def _zonal_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (b.layer = '{la}' AND {D} < {r}) AS {la}_within_{r}m" for la in ("school", "cafe", "park") for r in _RADII)
    return f"SELECT a.object_id, {cols} FROM {OBJECTS} a LEFT JOIN {_ZONES} b ON abs(a.lat - b.lat) < 0.01 AND {D} < 800 GROUP BY a.object_id"


@REGISTRY.add("zonal_counts", _zonal_sql())
def zonal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon")
    return spatial.zonal_counts(o, sql(spark, sf_dir, _ZONES), ["school", "cafe", "park"], _RADII).drop("lat", "lon")


@REGISTRY.add("road_length_500m", f"SELECT a.object_id, round(coalesce(sum(b.length_m), 0.0), 2) AS road_length_500m FROM {OBJECTS} a LEFT JOIN {MIDDLES} b ON abs(a.lat - b.lat) < 0.01 AND {D} < 500 GROUP BY a.object_id")
def road_length_500m(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon")
    return rounded(spatial.road_length(o, ways(spark, sf_dir)).drop("lat", "lon"), 2)


@REGISTRY.add("road_graph_edges", f"SELECT from_lat, from_lon, to_lat, to_lon, round(length_m, 6) AS length_m FROM {SEGMENTS} s")
def road_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.road_edges(ways(spark, sf_dir)).withColumn("length_m", F.round("length_m", 6))


@REGISTRY.add("nearest_station", f"SELECT a.object_id, round(min({D}), 6) AS dist_m, min_by(b.target, {D}) AS target FROM {OBJECTS} a CROSS JOIN {STATIONS} b GROUP BY a.object_id")
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spatial.nearest_points(sql(spark, sf_dir, OBJECTS), sql(spark, sf_dir, STATIONS), "object_id")
    return n.select("object_id", F.round("distance_m", 6).alias("dist_m"), F.col("r_target").alias("target"))


_BLOCKS = "(SELECT CONCAT('block ', CAST(i AS STRING)) AS name, i AS ord, 49.05 + i * 0.03 AS x0, 55.75 AS y0, 49.09 + i * 0.03 AS x1, 55.8 AS y1 FROM (SELECT CAST(r_regionkey AS BIGINT) AS i FROM region) r)"


@REGISTRY.add("point_in_polygon", f"SELECT a.object_id, min_by(b.name, b.ord) AS intra_city_raion FROM {OBJECTS} a JOIN {_BLOCKS} b ON a.lon BETWEEN b.x0 AND b.x1 AND a.lat BETWEEN b.y0 AND b.y1 GROUP BY a.object_id")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))"
    named = sql(spark, sf_dir, _BLOCKS).select("name", "ord", F.format_string(t, *[F.col(c).cast("double").cast("string") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")]).alias("wkt"))
    return spatial.districts_of(sql(spark, sf_dir, OBJECTS), named)


@REGISTRY.add("filter_inside_polygon", f"SELECT object_id FROM {OBJECTS} o WHERE lon > 49.06 AND lat > 55.75 AND lon - 49.06 + (lat - 55.75) * 2 < 0.1")
def filter_inside_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.filter_inside(sql(spark, sf_dir, OBJECTS), "POLYGON ((49.06 55.75, 49.16 55.75, 49.06 55.8, 49.06 55.75))").select("object_id")


_HALF = "0.002"
_SQUARES = f"(SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'water' ELSE 'park' END AS layer, concat('POLYGON ((', CAST(x - {_HALF} AS STRING), ' ', CAST(y - {_HALF} AS STRING), ', ', CAST(x + {_HALF} AS STRING), ' ', CAST(y - {_HALF} AS STRING), ', ', CAST(x + {_HALF} AS STRING), ' ', CAST(y + {_HALF} AS STRING), ', ', CAST(x - {_HALF} AS STRING), ' ', CAST(y + {_HALF} AS STRING), ', ', CAST(x - {_HALF} AS STRING), ' ', CAST(y - {_HALF} AS STRING), '))') AS wkt FROM (SELECT CAST(target AS BIGINT) AS s_suppkey, lat AS y, lon AS x FROM {STATIONS} s) u)"


@REGISTRY.add("area_shares")
def area_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon")
    return rounded(layers.area_shares(o, sql(spark, sf_dir, _SQUARES), ["water", "park", "forest"], [100, 500]).drop("lat", "lon"))


def _distances_sql() -> str:
    """Every object against every side of every square, projected; 0 where it is on the same side of all four."""
    objects = steps_sql(f"(SELECT object_id, lat, lon FROM {OBJECTS} o)", utm_steps("lat", "lon"))
    corners = f"(SELECT target, k, lat + CASE WHEN k < 2 THEN -{_HALF} ELSE {_HALF} END AS lat, lon + CASE WHEN k IN (0, 3) THEN -{_HALF} ELSE {_HALF} END AS lon FROM {STATIONS} s CROSS JOIN range(4) g(k))"
    projected = steps_sql(corners, utm_steps("lat", "lon"))
    return f"""WITH o AS MATERIALIZED (SELECT object_id, utm_x AS x, utm_y AS y FROM {objects} p), c AS MATERIALIZED (SELECT target, k, utm_x AS x, utm_y AS y FROM {projected} q),
e AS (SELECT a.target, CASE WHEN CAST(a.target AS BIGINT) % 2 = 0 THEN 'water' ELSE 'park' END AS layer, a.x AS x1, a.y AS y1, b.x - a.x AS ex, b.y - a.y AS ey FROM c a JOIN c b ON a.target = b.target AND b.k = (a.k + 1) % 4),
d AS (SELECT object_id, layer, target, x - x1 AS px, y - y1 AS py, ex, ey, greatest(0.0, least(1.0, ((x - x1) * ex + (y - y1) * ey) / (ex * ex + ey * ey))) AS t FROM o CROSS JOIN e),
m AS (SELECT object_id, layer, CASE WHEN min(ex * py - ey * px) >= 0 THEN 0.0 ELSE min(sqrt((px - t * ex) * (px - t * ex) + (py - t * ey) * (py - t * ey))) END AS d FROM d GROUP BY object_id, layer, target)
SELECT object_id, round(min(d) FILTER (layer = 'water'), 3) AS dist_to_water_m, round(min(d) FILTER (layer = 'park'), 3) AS dist_to_park_m, CAST(NULL AS DOUBLE) AS dist_to_forest_m FROM m GROUP BY object_id"""


@REGISTRY.add("geometry_distances", _distances_sql())
def geometry_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon")
    return rounded(layers.geometry_distances(o, sql(spark, sf_dir, _SQUARES), ["water", "park", "forest"]).drop("lat", "lon"), 3)


_SIDES = f"(SELECT object_id, CAST(10 + levels AS DOUBLE) AS w, CAST(40 + levels * 2 AS DOUBLE) AS h, levels FROM {OBJECTS} o)"


@REGISTRY.add("shape_features", f"SELECT object_id, round(w * h, 6) AS polygon_area_m2, round(2 * (w + h), 6) AS polygon_perimeter_m, round(4 * pi() * w * h / power(2 * (w + h), 2), 6) AS polygon_compactness, 1.0::DOUBLE AS polygon_convexity, round(h / w, 6) AS bbox_aspect_ratio, 90.0::DOUBLE AS polygon_orientation_deg, 4::BIGINT AS polygon_n_vertices FROM {_SIDES} s")
def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sql(spark, sf_dir, _SIDES)
    w, h = F.col("w").cast("string"), F.col("h").cast("string")
    o = s.select("object_id", F.concat(F.lit("POLYGON ((0 0, "), w, F.lit(" 0, "), w, F.lit(" "), h, F.lit(", 0 "), h, F.lit(", 0 0))")).alias("polygon_wkt_3857"))
    return rounded(spatial.shape_features(o).drop("polygon_wkt_3857"))


#: Edges of a shortest path to the nearest target, at most, in graphs of which every node has dozens of random edges.
_HOPS = 12


def _graph_sql() -> str:
    """Paths from all targets by relaxing all edges _HOPS times; from each target alone over edges shorter than its radius."""
    points = f"(SELECT 's' AS kind, 1000.0::DOUBLE AS near, target, lat, lon FROM {STATIONS} s UNION ALL SELECT 'e', 500.0::DOUBLE, target, lat, lon FROM {ENTRANCES} t)"
    snap = lambda keys, rows: f"SELECT {keys}, m.v AS v, {haversine('lat', 'lon', 'm.lat', 'm.lon')} AS snap FROM (SELECT {keys}, any_value(p.lat) AS lat, any_value(p.lon) AS lon, min(struct_pack(o := power(p.lat - n.lat, 2) + power(p.lon - n.lon, 2), v := n.v, lat := n.lat, lon := n.lon)) AS m FROM {rows} p CROSS JOIN n GROUP BY {keys}) g"
    ctes = [
        f"s AS MATERIALIZED (SELECT from_lat, from_lon, to_lat, to_lon, length_m FROM {SEGMENTS} x)",
        "n AS MATERIALIZED (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) AS v FROM (SELECT from_lat AS lat, from_lon AS lon FROM s UNION SELECT to_lat, to_lon FROM s) y)",
        "one AS MATERIALIZED (SELECT a.v AS u, b.v AS v, length_m AS len FROM s JOIN n a ON from_lat = a.lat AND from_lon = a.lon JOIN n b ON to_lat = b.lat AND to_lon = b.lon WHERE a.v <> b.v)",
        "e AS MATERIALIZED (SELECT u, v, min(len) AS len FROM (SELECT u, v, len FROM one UNION ALL SELECT v, u, len FROM one) z GROUP BY u, v)",
        f"here AS MATERIALIZED ({snap('object_id', OBJECTS)})",
        f"ends AS MATERIALIZED ({snap('kind, near, target', points)})",
        "a0 AS MATERIALIZED (SELECT kind, v, min(snap) AS d FROM ends GROUP BY kind, v)",
        "b0 AS MATERIALIZED (SELECT kind, near, target, v, snap AS d FROM ends WHERE snap < near)",
    ]
    for i in range(_HOPS):
        ctes.append(f"a{i + 1} AS MATERIALIZED (SELECT kind, v, min(d) AS d FROM (SELECT * FROM a{i} UNION ALL SELECT kind, e.v, d + len FROM a{i} a JOIN e ON e.u = a.v) z GROUP BY kind, v)")
        ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT kind, near, target, v, min(d) AS d FROM (SELECT * FROM b{i} UNION ALL SELECT kind, near, target, e.v, d + len FROM b{i} b JOIN e ON e.u = b.v WHERE len < near AND d + len < near) z GROUP BY kind, near, target, v)")
    least = f"(SELECT object_id, min(snap + d) FILTER (kind = 's') AS s, min(snap + d) FILTER (kind = 'e') AS e FROM here JOIN a{_HOPS} a USING (v) GROUP BY object_id)"
    close = f"(SELECT object_id, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 'e') AS e FROM here JOIN b{_HOPS} b USING (v) WHERE snap + d < near GROUP BY object_id)"
    return f"WITH {', '.join(ctes)} SELECT o.object_id, round(coalesce(l.s, 1e9), 3) AS dist_metro_m, round(coalesce(l.e, 1e9), 3) AS dist_entrance_m, coalesce(c.s, 0) AS count_stations_1km, coalesce(c.e, 0) AS count_entrances_500m FROM {OBJECTS} o LEFT JOIN {least} l USING (object_id) LEFT JOIN {close} c USING (object_id)"


@REGISTRY.add("graph_metro_features", _graph_sql())
def graph_metro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon")
    edges = graph.road_edges(ways(spark, sf_dir))
    return rounded(graph.metro_by_graph(o, edges, sql(spark, sf_dir, STATIONS), sql(spark, sf_dir, ENTRANCES)).drop("lat", "lon"), 3)


_FACTS = f"SELECT o.object_id, o.asset_class, o.levels * 37.0 AS dist_metro_m, o.levels % 3 AS count_stations_1km, o.levels % 7 AS count_apartments_500m, o.levels % 5 AS count_houses_500m, o.levels % 4 AS count_commercial_500m, o.area_m2 * 10 AS road_length_500m FROM {OBJECTS} o WHERE o.asset_class IN ('apartment', 'house', 'commercial')"
_TARGET_SQL = f"""SELECT object_id, round(CASE asset_class
 WHEN 'apartment' THEN 80000 * (1 + 0.6 * exp(-d / 800)) * (1 + 0.05 * ln(1 + a + c)) * (1 + 0.0001 * r)
 WHEN 'house' THEN 50000 * (1 + 0.3 * exp(-d / 5000)) * (1 + 0.04 * ln(1 + h)) * least(1, greatest(0.6, 1 - 0.02 * ln(1 + a))) * (1 + 0.00005 * r)
 ELSE 100000 * (1 + exp(-d / 1500)) * (1 + 0.1 * ln(1 + a + c + h)) * (1 + 0.0002 * r) END, 4)::DOUBLE AS target
FROM (SELECT object_id, asset_class, dist_metro_m::DOUBLE AS d, count_apartments_500m::DOUBLE AS a, count_houses_500m::DOUBLE AS h, count_commercial_500m::DOUBLE AS c, road_length_500m::DOUBLE AS r FROM ({_FACTS}) f) g"""


@REGISTRY.add("object_synthetic_target", _TARGET_SQL)
def object_synthetic_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = objs.object_target(sql(spark, sf_dir, _FACTS), seed=1, noisy=False)
    return t.select("object_id", F.round("synthetic_target_rub_per_m2", 4).alias("target"))
