"""Hex roll-ups, hex feature sets, relative statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions.geo import EARTH_M, LAT_REF, apply_steps, center_steps, edge_m, haversine, hex_steps, steps_sql, utm_steps, with_cell, with_utm
from landgrid.operators import hexgrid, objects
from landgrid.plans import serving
from landgrid.queries import REGISTRY
from landgrid.queries.data import ENTRANCES, NODES, OBJECTS, STATIONS, sql, ways

HEX = steps_sql(f"{OBJECTS} o", hex_steps(8))
R = "round(CAST({} AS DOUBLE), 6)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rollup_sql(where: str = "") -> str:
    aggs = "count(*) AS count, median(t) AS median_target_rub_per_m2, median(p) AS median_pred_oof_rub_per_m2, median(p - t) AS median_residual_rub_per_m2, avg(levels) AS mean_levels, avg(flats) AS mean_flats, avg(area_m2) AS mean_area_m2, avg(year_built) AS mean_year_built"
    base = f"(SELECT *, synthetic_target_rub_per_m2 AS t, y_pred_oof AS p FROM {HEX} h)"
    part = lambda cls, keys: f"SELECT g.*, m.d AS dominant_intra_city_raion FROM (SELECT h3_index, {cls} AS asset_class, {aggs} FROM {base} b GROUP BY {keys}) g LEFT JOIN (SELECT h3_index, asset_class, min(d) AS d FROM (SELECT h3_index, {cls} AS asset_class, intra_city_raion AS d, count(*) AS n, max(count(*)) OVER (PARTITION BY h3_index, {cls}) AS top FROM {base} b WHERE intra_city_raion IS NOT NULL GROUP BY h3_index, {cls}, intra_city_raion) x WHERE n = top GROUP BY h3_index, asset_class) m ON g.h3_index = m.h3_index AND g.asset_class IS NOT DISTINCT FROM m.asset_class"
    names = "median_target_rub_per_m2 median_pred_oof_rub_per_m2 median_residual_rub_per_m2 mean_levels mean_flats mean_area_m2 mean_year_built".split()
    cols = ", ".join(f"{R.format(n)} AS {n}" for n in names)
    return f"SELECT h3_index, 8 AS resolution, asset_class, count, {cols}, dominant_intra_city_raion FROM ({part('asset_class', 'h3_index, asset_class')} UNION ALL {part(chr(39) + 'all' + chr(39), 'h3_index')}) u {where}"


@REGISTRY.add("hex_rollup", _rollup_sql())
def hex_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hexgrid.hex_rollup(sql(spark, sf_dir, OBJECTS), 8))


@REGISTRY.add("serve_hex_values", f"SELECT h3_index AS hex, median_target_rub_per_m2 AS value FROM ({_rollup_sql()}) r WHERE asset_class = 'apartment' AND median_target_rub_per_m2 IS NOT NULL")
def serve_hex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.hex_values(hexgrid.hex_rollup(sql(spark, sf_dir, OBJECTS), 8), 8, "apartment", "median_target_rub_per_m2"))


_CENTERS = f"SELECT h3_index, 8 AS resolution, {R.format('c_lat')} AS lat, {R.format('c_lon')} AS lon FROM {steps_sql(f'(SELECT DISTINCT h3_index FROM {HEX} h)', center_steps('h3_index', 'c_lat', 'c_lon'))} c"


@REGISTRY.add("cell_centers", _CENTERS)
def cell_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = with_cell(sql(spark, sf_dir, OBJECTS), 8).select("h3_index", F.lit(8).alias("resolution")).distinct()
    return rounded(apply_steps(cells, center_steps("h3_index")))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box that holds all objects."""
    return hexgrid.cover_box(spark, 8, 55.735, 49.03, 55.835, 49.21)


def _cover_sql() -> str:
    inner = steps_sql("(SELECT concat('8:', CAST(q AS STRING), ':', CAST(r AS STRING)) AS h3_index, 8 AS resolution FROM range({q0}, {q1}) a(q), range({r0}, {r1}) b(r))", center_steps("h3_index"))
    e, k = edge_m(8), EARTH_M * math.cos(math.radians(LAT_REF))
    r0, r1 = int(math.radians(55.735) * EARTH_M / (1.5 * e)) - 2, int(math.radians(55.835) * EARTH_M / (1.5 * e)) + 3
    q0, q1 = int(math.radians(49.03) * k / (math.sqrt(3) * e) - r1 / 2) - 3, int(math.radians(49.21) * k / (math.sqrt(3) * e) - r0 / 2) + 4
    return f"SELECT h3_index, resolution FROM {inner.format(q0=q0, q1=q1, r0=r0, r1=r1)} x WHERE lat BETWEEN 55.735 AND 55.835 AND lon BETWEEN 49.03 AND 49.21"


COVERAGE = _cover_sql()


@REGISTRY.add("region_coverage", COVERAGE)
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir)


_BUILDINGS = f"(SELECT CASE asset_class WHEN 'apartment' THEN 'apartments' WHEN 'house' THEN 'detached' WHEN 'commercial' THEN 'retail' ELSE 'yes' END AS building, CASE WHEN levels % 6 = 0 THEN 'many' ELSE CAST(levels AS STRING) END AS levels, CAST(flats AS STRING) AS flats, lat, lon FROM {OBJECTS} o)"


def _building_sql() -> str:
    h = steps_sql(f"{_BUILDINGS} b", hex_steps(8))
    return f"""SELECT c.h3_index, c.resolution, coalesce(n, 0) AS building_count, coalesce(a, 0) AS building_count_apartments, coalesce(d, 0) AS building_count_detached, round(coalesce(lv, 0.0), 6) AS levels_mean, coalesce(f, 0)::BIGINT AS flats_total
FROM ({COVERAGE}) c LEFT JOIN (SELECT h3_index, count(*) AS n, count(*) FILTER (building = 'apartments') AS a, count(*) FILTER (building IN ('detached', 'house')) AS d, avg(TRY_CAST(levels AS BIGINT)) AS lv, sum(TRY_CAST(flats AS BIGINT)) AS f FROM {h} x GROUP BY h3_index) g ON c.h3_index = g.h3_index"""


@REGISTRY.add("hex_building_features", _building_sql())
def hex_building_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hexgrid.building_features(coverage(spark, sf_dir), sql(spark, sf_dir, _BUILDINGS), 8))


SEGMENTS = f"(SELECT way, lat AS from_lat, lon AS from_lon, to_lat, to_lon, {haversine('lat', 'lon', 'to_lat', 'to_lon')} AS length_m FROM (SELECT *, lead(lat) OVER (PARTITION BY way ORDER BY n, lat, lon) AS to_lat, lead(lon) OVER (PARTITION BY way ORDER BY n, lat, lon) AS to_lon FROM {NODES} n) s WHERE to_lat IS NOT NULL)"
MIDDLES = f"(SELECT (from_lat + to_lat) / 2 AS lat, (from_lon + to_lon) / 2 AS lon, length_m FROM {SEGMENTS} s)"


@REGISTRY.add("hex_road_features", f"SELECT c.h3_index, c.resolution, round(coalesce(s, 0.0), 2) AS road_length_m FROM ({COVERAGE}) c LEFT JOIN (SELECT h3_index, sum(length_m) AS s FROM {steps_sql(f'{MIDDLES} m', hex_steps(8))} x GROUP BY h3_index) g ON c.h3_index = g.h3_index")
def hex_road_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hexgrid.road_features(coverage(spark, sf_dir), ways(spark, sf_dir), 8), 2)


def _metro_sql() -> str:
    cells = steps_sql(f"({COVERAGE})", center_steps("h3_index"))
    part = lambda points, near: f"(SELECT c.h3_index, min({haversine('c.lat', 'c.lon', 's.lat', 's.lon')}) AS d, count(*) FILTER ({haversine('c.lat', 'c.lon', 's.lat', 's.lon')} < {near}) AS n FROM {cells} c CROSS JOIN {points} s GROUP BY c.h3_index)"
    return f"SELECT c.h3_index, c.resolution, round(a.d, 6) AS dist_metro_m, round(b.d, 6) AS dist_entrance_m, coalesce(a.n, 0) AS count_stations_1km, coalesce(b.n, 0) AS count_entrances_500m FROM ({COVERAGE}) c LEFT JOIN {part(STATIONS, 1000)} a ON c.h3_index = a.h3_index LEFT JOIN {part(ENTRANCES, 500)} b ON c.h3_index = b.h3_index"


@REGISTRY.add("hex_metro_features", _metro_sql())
def hex_metro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hexgrid.metro_features(coverage(spark, sf_dir), sql(spark, sf_dir, STATIONS), sql(spark, sf_dir, ENTRANCES)))


_GOLD = f"SELECT b.*, r.road_length_m, m.dist_metro_m, m.dist_entrance_m, m.count_stations_1km, m.count_entrances_500m FROM ({_building_sql()}) b JOIN ({REGISTRY.sql['hex_road_features']}) r USING (h3_index, resolution) JOIN ({_metro_sql()}) m USING (h3_index, resolution)"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hexgrid.gold_features(coverage(spark, sf_dir), [f(spark, sf_dir) for f in (hex_building_features, hex_road_features, hex_metro_features)])


@REGISTRY.add("hex_gold_features", _GOLD)
def hex_gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir)


@REGISTRY.add("hex_synthetic_target", f"SELECT h3_index, resolution, round(greatest(0, 1000 + 6000 * power(ln(1 + building_count_apartments) + 0.3 * ln(1 + road_length_m / 1000), 1.2) * (1 + CASE WHEN count_stations_1km > 0 THEN 0.5 ELSE 0 END)), 4)::DOUBLE AS target FROM ({_GOLD}) g")
def hex_synthetic_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hexgrid.cell_target(gold(spark, sf_dir), sigma=0.0)
    return t.select("h3_index", "resolution", F.round("synthetic_target_rub_per_m2", 4).alias("target"))


_REL = ["area_m2", "levels", "flats"]


def _relative_sql() -> str:
    p = steps_sql(f"{OBJECTS} o", hex_steps(7, "parent_h3_p7"))
    stats = ", ".join(f"median({c}::DOUBLE) AS m{i}, quantile_cont({c}::DOUBLE, 0.25) AS a{i}, quantile_cont({c}::DOUBLE, 0.75) AS b{i}" for i, c in enumerate(_REL))
    cols = ", ".join(f"round({c} - m{i}, 6) AS {c}__rel_p7_diff_med, round({c} / nullif(m{i}, 0), 6) AS {c}__rel_p7_ratio_med, round(({c} - m{i}) / nullif(b{i} - a{i}, 0), 6) AS {c}__rel_p7_z_iqr" for i, c in enumerate(_REL))
    return f"SELECT object_id, parent_h3_p7, n AS count_p7, {cols} FROM {p} x JOIN (SELECT parent_h3_p7, count(*) AS n, {stats} FROM {p} y GROUP BY parent_h3_p7) g USING (parent_h3_p7)"


@REGISTRY.add("relative_features", _relative_sql())
def relative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = hexgrid.relative_features(sql(spark, sf_dir, OBJECTS).select("object_id", "lat", "lon", *_REL), [7], _REL)
    return rounded(o.drop("lat", "lon", *_REL))


_ERAS = "CASE WHEN y IS NULL THEN 'unknown' WHEN y <= 1916 THEN 'pre_revolution' WHEN y <= 1945 THEN 'early_soviet' WHEN y <= 1956 THEN 'stalin' WHEN y <= 1968 THEN 'khrushchev' WHEN y <= 1980 THEN 'brezhnev' WHEN y <= 1991 THEN 'late_soviet' WHEN y <= 2000 THEN '90s_transition' WHEN y <= 2010 THEN '2000s' WHEN y <= 2020 THEN '2010s' ELSE 'new_2020+' END"


@REGISTRY.add("age_features", f"SELECT object_id, 2026 - y AS age_years, (2026 - y) * (2026 - y) AS age_years_sq, {_ERAS} AS era_category, 2026 - y <= 5 AS is_new_construction FROM (SELECT object_id, nullif(year_built, 0) AS y FROM {OBJECTS} o) t")
def age_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.age_features(sql(spark, sf_dir, OBJECTS), 2026).select("object_id", "age_years", "age_years_sq", "era_category", "is_new_construction")


_UTM = utm_steps("lat", "lon")


@REGISTRY.add("project_points", f"SELECT object_id, round(utm_x, 3) AS utm_x, round(utm_y, 3) AS utm_y, round(degrees(radians(lon)), 9) AS lon FROM {steps_sql(f'{OBJECTS} o', _UTM)} u")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = with_utm(sql(spark, sf_dir, OBJECTS))
    return u.select("object_id", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"), F.round(F.degrees(F.radians("lon")), 9).alias("lon"))
