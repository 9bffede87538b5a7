"""Registry ETL, sources and sinks, listings, serving, metrics, models, streaming."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions.geo import hex_steps, steps_sql
from landgrid.functions.text import to_float, to_int, to_str
from landgrid.ml import features as mlf
from landgrid.ml import metrics, models
from landgrid.operators import listings, objects, registry
from landgrid.plans import serving
from landgrid.queries import REGISTRY
from landgrid.queries.data import OBJECTS, sql, ways
from landgrid.queries.grid import rounded
from landgrid.scratch import cut, hadoop_path, scratch_path
from landgrid.sources import readers, sinks
from landgrid.streaming import rollup

# -- sources and sinks -----------------------------------------------------------------------------------------------------------------


@REGISTRY.add("parquet_partitions", f"SELECT object_id, asset_class, 'R1' AS region, lat FROM {OBJECTS} o WHERE asset_class = 'house'")
def parquet_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves objects by class, overwrites one class from itself, reads one partition."""
    base = scratch_path(spark, "objects")
    rows = sql(spark, sf_dir, OBJECTS).where("asset_class is not null").withColumn("region", F.lit("R1"))
    sinks.save_objects(rows, base)
    sinks.save_objects(readers.partitioned(spark, base, asset_class="apartment"), base)
    return readers.partitioned(spark, base, region="R1", asset_class="house").select("object_id", "asset_class", "region", "lat")


@REGISTRY.add("csv_overrides", f"SELECT object_id, TRY_CAST(CASE WHEN levels % 6 = 0 THEN 'many' ELSE CAST(levels AS STRING) END AS BIGINT) AS levels, area_m2 FROM {OBJECTS} o")
def csv_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sql(spark, sf_dir, f"SELECT object_id, CASE WHEN levels % 6 = 0 THEN 'many' ELSE CAST(levels AS STRING) END AS levels, area_m2 FROM {OBJECTS} o").write.csv(path, header=True)
    return readers.csv_table(spark, path, "object_id STRING, levels STRING, area_m2 DOUBLE").withColumn("levels", to_int(F.col("levels")))


_FEATURE_BASE = f"(SELECT o.*, CAST(split_part(object_id, '/', 2) AS BIGINT) AS k FROM {OBJECTS} o)"
_FEATURES = f"(SELECT k, k % 100 AS page, concat(' 16:', CAST(k AS STRING), ' ') AS cad_num, CASE k % 5 WHEN 0 THEN ' Многоквартирный дом' WHEN 1 THEN 'Жилой дом' WHEN 2 THEN 'Нежилое ' WHEN 3 THEN 'Гараж' ELSE '' END AS purpose, CASE WHEN k % 4 = 0 THEN concat(' ', CAST(levels AS STRING), ' ') WHEN k % 4 = 1 THEN concat(CAST(levels AS STRING), '.9') WHEN k % 4 = 2 THEN '' ELSE 'n/a' END AS floors, CAST(area_m2 AS STRING) AS area, k % 9 * 1000.5 AS cost, k * 10 + 5460000 AS x, k * 20 + 7500000 AS y FROM {_FEATURE_BASE} f)"


FEATURES_A_PAGE = 1_000


def _renamed(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Writes (page, value) as files page-<number>.json: by the executors, in a folder each, which the driver then only renames."""
    aside = f"{path}-aside"
    pages.write.partitionBy("page").text(aside)
    fs, out = hadoop_path(spark, path)
    fs.mkdirs(out)
    for folder in fs.globStatus(hadoop_path(spark, f"{aside}/page=*")[1]):
        number = int(folder.getPath().getName().split("=")[1])
        for file in fs.globStatus(hadoop_path(spark, f"{folder.getPath()}/part-*")[1]):
            fs.rename(file.getPath(), hadoop_path(spark, f"{path}/page-{number:09d}.json")[1])
    fs.delete(hadoop_path(spark, aside)[1], True)


def _registry_pages(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "pages")
    f = sql(spark, sf_dir, _FEATURES)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ring = F.array(*[F.array(a, b) for a, b in ((x, y), (x + 10, y), (x + 10, y + 20), (x, y + 20), (x, y))])
    options = F.struct("cad_num", "purpose", F.col("floors"), F.col("area").alias("build_record_area"), F.col("cost").cast("double").alias("cost_value"), (F.col("cost").cast("double") / 10).alias("cost_index"))
    one = F.struct(F.col("k").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(options.alias("options")).alias("properties"))
    pages = f.withColumn("page", F.floor(F.col("k") / FEATURES_A_PAGE)).groupBy("page").agg(F.collect_list(F.struct("k", one.alias("f"))).alias("fs")).select("page", F.to_json(F.struct(F.struct(F.transform(F.sort_array(F.col("fs").cast("array<struct<k:bigint,f:struct<id:bigint,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<options:struct<cad_num:string,purpose:string,floors:string,build_record_area:string,cost_value:double,cost_index:double>>>>>")), lambda v: v["f"]).alias("features")).alias("data"))).alias("value"))
    _renamed(spark, pages, path)
    return path


@REGISTRY.add("registry_buildings", f"""SELECT k AS geom_data_id, trim(cad_num) AS cad_num, nullif(trim(purpose), '') AS purpose, CASE lower(trim(purpose)) WHEN 'многоквартирный дом' THEN 'apartment' WHEN 'жилой дом' THEN 'house' WHEN 'нежилое' THEN 'commercial' END AS asset_class,
 TRY_CAST(trunc(TRY_CAST(trim(floors) AS DOUBLE)) AS BIGINT) AS floors, area::DOUBLE AS area_m2, cost::DOUBLE AS cost_value_rub, round(degrees((x + 5) / 6378137.0::DOUBLE), 7) AS lon, round(degrees(2 * atan(exp((y + 10) / 6378137.0::DOUBLE)) - pi() / 2), 7) AS lat FROM {_FEATURES} f""")
def registry_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = readers.registry_buildings(spark, _registry_pages(spark, sf_dir))
    return b.select("geom_data_id", "cad_num", "purpose", "asset_class", "floors", "area_m2", "cost_value_rub", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@REGISTRY.add("assemble_registry_objects", f"""SELECT concat('nspd-building/', CAST(k AS STRING)) AS object_id, CASE lower(trim(purpose)) WHEN 'многоквартирный дом' THEN 'apartment' WHEN 'жилой дом' THEN 'house' WHEN 'нежилое' THEN 'commercial' END AS asset_class, round(cost::DOUBLE / 10, 6) AS target, NULL::BIGINT AS flats FROM {_FEATURES} f WHERE k % 5 < 3 AND cost > 0
UNION ALL SELECT concat('nspd-landplot/', CAST(k AS STRING)), 'landplot', round(cost::DOUBLE / 10, 6), NULL FROM {_FEATURES} f WHERE cost > 0""")
def assemble_registry_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _registry_pages(spark, sf_dir)
    o = objects.from_registry(readers.registry_buildings(spark, path), readers.registry_landplots(spark, path))
    return o.select("object_id", "asset_class", F.round("synthetic_target_rub_per_m2", 6).alias("target"), "flats")


@REGISTRY.add("tolerant_casts", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE o_orderkey END::BIGINT AS i, CASE o_orderkey % 5 WHEN 0 THEN 7.0 WHEN 1 THEN 7.9 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE o_orderkey END::DOUBLE AS f, CASE o_orderkey % 5 WHEN 0 THEN '7' WHEN 1 THEN '7.9' WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS s FROM orders")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' 7 ' WHEN 1 THEN '7.9' WHEN 2 THEN ' ' WHEN 3 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS v FROM orders")
    return v.select("o_orderkey", to_int(F.col("v")).alias("i"), to_float(F.col("v")).alias("f"), to_str(F.col("v")).alias("s"))


# The address registry: regions are okrugs (level 3), nations settlements (level 5), customers houses.
_ADDR = "(SELECT CAST(1000 + r_regionkey AS BIGINT) AS objectid, r_name AS name, 'okrug' AS typename, '3' AS level, CASE WHEN r_regionkey = 4 THEN '0' ELSE '1' END AS active FROM region UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), n_name, 'town', CASE WHEN n_nationkey = 7 THEN 'x' ELSE '5' END, '1' FROM nation)"
_HIER = "(SELECT CAST(1000 + r_regionkey AS BIGINT) AS objectid, CAST(0 AS BIGINT) AS parentobjid, concat('92', CAST(r_regionkey AS STRING)) AS oktmo, CAST(1000 + r_regionkey AS STRING) AS path FROM region UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), CAST(1000 + n_regionkey AS BIGINT), concat('93', CAST(n_nationkey AS STRING)), concat(CAST(1000 + n_regionkey AS STRING), '.', CAST(2000 + n_nationkey AS STRING)) FROM nation UNION ALL SELECT CAST(100000 + c_custkey AS BIGINT), CAST(2000 + c_nationkey AS BIGINT), '', concat(CAST(1000 + n_regionkey AS STRING), '.', CAST(2000 + c_nationkey AS STRING), '.', CAST(100000 + c_custkey AS STRING)) FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_PARAMS = "(SELECT CAST(100000 + c_custkey AS BIGINT) AS objectid, t AS typeid, concat(CAST(t AS STRING), '-', CAST(c_custkey % 700 AS STRING)) AS value, CASE WHEN c_custkey % 13 = 0 THEN '2020-01-01' ELSE '2079-06-06' END AS enddate, c_custkey % 2 AS stead FROM customer CROSS JOIN (SELECT 5 AS t UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) ts)"
_LIVE = f"(SELECT objectid, typeid, value, stead FROM {_PARAMS} p WHERE enddate = '2079-06-06' AND typeid IN (5, 6, 7, 8))"


ROWS_A_FILE = 50_000


def _xml(spark: SparkSession, rows: DataFrame, tag: str, names: dict[str, str]) -> str:
    path = scratch_path(spark, "xml")
    text = F.concat(F.lit(f"<{tag}"), *[F.concat(F.lit(f' {k}="'), F.coalesce(F.col(v).cast("string"), F.lit("")), F.lit('"')) for k, v in names.items()], F.lit("/>"))
    flat = cut(rows.select(text.alias("line")), "lines")
    packs = flat.withColumn("pack", F.pmod(F.xxhash64("line"), F.lit(max(1, flat.count() // ROWS_A_FILE)))).groupBy("pack")
    packs.agg(F.concat(F.lit("<ROWS>"), F.array_join(F.collect_list("line"), "\n"), F.lit("</ROWS>")).alias("value")).write.partitionBy("pack").text(path)
    return path


def _address_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    a = sql(spark, sf_dir, _ADDR).withColumn("one", F.lit("1"))
    addr = readers.address_objects(spark, _xml(spark, a, "OBJECT", {"OBJECTID": "objectid", "OBJECTGUID": "objectid", "NAME": "name", "TYPENAME": "typename", "LEVEL": "level", "ISACTUAL": "active", "ISACTIVE": "one"}))
    h = sql(spark, sf_dir, _HIER).withColumns({"one": F.lit("1"), "end": F.lit(readers.ACTIVE_END)})
    hier = readers.municipal_hierarchy(spark, _xml(spark, h, "ITEM", {"OBJECTID": "objectid", "PARENTOBJID": "parentobjid", "OKTMO": "oktmo", "PATH": "path", "ISACTIVE": "one", "ENDDATE": "end"}))
    p = sql(spark, sf_dir, _PARAMS)
    part = lambda s: readers.parameters(spark, _xml(spark, p.where(F.col("stead") == s), "PARAM", {"OBJECTID": "objectid", "TYPEID": "typeid", "VALUE": "value", "ENDDATE": "enddate"}), [5, 6, 7, 8])
    return addr, hier, part(0), part(1)


@REGISTRY.add("xml_address_objects", f"SELECT objectid, name, level::BIGINT AS level FROM {_ADDR} a WHERE active = '1' AND level <> 'x'")
def xml_address_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _address_parts(spark, sf_dir)[0].select("objectid", "name", F.col("level").cast("bigint").alias("level"))


@REGISTRY.add("xml_hierarchy", f"SELECT objectid, nullif(parentobjid, 0) AS parentobjid, path FROM {_HIER} h")
def xml_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _address_parts(spark, sf_dir)[1].select("objectid", "parentobjid", "path")


@REGISTRY.add("xml_params", f"SELECT objectid, typeid::BIGINT AS typeid, value FROM {_LIVE} p")
def xml_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, a, b = _address_parts(spark, sf_dir)
    return a.unionByName(b).select("objectid", F.col("typeid").cast("bigint").alias("typeid"), "value")


_CADNUM = f"SELECT value AS cad_num, (min(CASE WHEN stead = 0 THEN objectid END)) AS h, min(objectid) AS s FROM {_LIVE} p WHERE typeid = 8 GROUP BY value"


@REGISTRY.add("cadnum_index", f"SELECT cad_num, coalesce(h, s) AS objectid, CASE WHEN h IS NULL THEN 'stead' ELSE 'house' END AS source FROM ({_CADNUM}) c")
def cadnum_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, houses, steads = _address_parts(spark, sf_dir)
    return registry.cadnum_index(houses, steads).select("cad_num", "objectid", "source")


_OK_R, _OK_N = "(SELECT * FROM region WHERE r_regionkey <> 4)", "(SELECT * FROM nation WHERE n_nationkey <> 7)"
_MUN = f"""SELECT h.objectid, r.r_name AS mun_okrug_name, CASE WHEN r.r_name IS NOT NULL THEN concat('92', CAST(r.r_regionkey AS STRING)) END AS mun_okrug_oktmo, n.n_name AS settlement_name
FROM {_HIER} h LEFT JOIN {_OK_R} r ON split_part(h.path, '.', 1) = CAST(1000 + r.r_regionkey AS STRING) LEFT JOIN {_OK_N} n ON split_part(h.path, '.', 2) = CAST(2000 + n.n_nationkey AS STRING)"""


@REGISTRY.add("mun_lookup", _MUN)
def mun_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr, hier, _, _ = _address_parts(spark, sf_dir)
    return registry.mun_lookup(addr, hier)


_WIDE = f"SELECT objectid, max(CASE WHEN typeid = 7 THEN value END) AS oktmo_full, max(CASE WHEN typeid = 6 THEN value END) AS okato, max(CASE WHEN typeid = 5 THEN value END) AS postal_index FROM {_LIVE} p WHERE typeid IN (5, 6, 7) GROUP BY objectid"


@REGISTRY.add("object_params", _WIDE)
def object_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, houses, steads = _address_parts(spark, sf_dir)
    return registry.object_params(houses, steads)


_ADDRESSED = "(SELECT concat('c/', CAST(c_custkey AS STRING)) AS object_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('8-', CAST(c_custkey % 700 AS STRING)) END AS cad_num, CASE c_custkey % 6 WHEN 0 THEN 'Российская Федерация, г.о. город Казань, г Казань, ул Баумана' WHEN 1 THEN 'Лаишевский муниципальный район, с Столбище' WHEN 2 THEN 'г Казань Советский район, ул Мира' WHEN 3 THEN NULL WHEN 4 THEN 'обл Кировский район, д Малая' ELSE 'п Мирный' END AS readable_address, c_custkey % 6 AS a FROM customer)"


def _municipality_sql() -> str:
    okrug = "CASE a WHEN 0 THEN 'город Казань' WHEN 1 THEN 'Лаишевский' WHEN 2 THEN 'город Казань' END"
    town = "CASE a WHEN 0 THEN 'Казань' WHEN 1 THEN 'Столбище' WHEN 2 THEN 'Казань' WHEN 4 THEN 'Малая' WHEN 5 THEN 'Мирный' END"
    return f"""SELECT o.object_id, coalesce(m.mun_okrug_name, {okrug}) AS mun_okrug_name, m.mun_okrug_oktmo, coalesce(m.settlement_name, {town}) AS settlement_name,
 CASE a WHEN 2 THEN 'Советский' WHEN 4 THEN 'Кировский' END AS intra_city_raion, CASE WHEN m.mun_okrug_name IS NULL THEN 'address' ELSE 'gar' END AS mun_source, w.oktmo_full, w.okato, w.postal_index
FROM {_ADDRESSED} o LEFT JOIN (SELECT cad_num, coalesce(h, s) AS objectid FROM ({_CADNUM}) c) i ON o.cad_num = i.cad_num LEFT JOIN ({_MUN}) m ON i.objectid = m.objectid LEFT JOIN ({_WIDE}) w ON i.objectid = w.objectid"""


@REGISTRY.add("municipality_features", _municipality_sql())
def municipality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr, hier, houses, steads = _address_parts(spark, sf_dir)
    o = sql(spark, sf_dir, _ADDRESSED).drop("a")
    return registry.municipality_features(o, registry.cadnum_index(houses, steads), registry.mun_lookup(addr, hier), registry.object_params(houses, steads)).drop("cad_num", "readable_address")


@REGISTRY.add("map_valuation_objects", f"SELECT concat('way/', CAST(levels AS STRING), '-', object_id) AS object_id, asset_class, levels FROM {OBJECTS} o WHERE asset_class IN ('apartment', 'house', 'commercial')")
def map_valuation_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sql(spark, sf_dir, f"SELECT 'way' AS osm_type, concat(CAST(levels AS STRING), '-', object_id) AS osm_id, CASE asset_class WHEN 'apartment' THEN 'Apartments' WHEN 'house' THEN ' bungalow' WHEN 'commercial' THEN 'kiosk' ELSE 'garage' END AS building, CAST(levels AS STRING) AS levels, CAST(flats AS STRING) AS flats, lat, lon FROM {OBJECTS} o")
    return objects.from_map_data(b).select("object_id", "asset_class", "levels")


_POI = f"(SELECT object_id, lat, lon, levels FROM {OBJECTS} o)"


@REGISTRY.add("geojson_layer_points", f"SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, 'school' AS layer FROM {_POI} p WHERE levels % 4 <> 3")
def geojson_layer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence with record separators, blank lines, squares among the points, and features without geometry."""
    path = scratch_path(spark, "geojsonseq")
    p = sql(spark, sf_dir, _POI)
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    at = lambda dx, dy: F.concat(F.lit("["), (F.col("lon") + dx).cast("string"), F.lit(","), (F.col("lat") + dy).cast("string"), F.lit("]"))
    h = 0.0001
    square = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", at(-h, -h), at(h, -h), at(h, h), at(-h, h), at(-h, -h)), F.lit("]]}"))
    geometry = F.when(F.col("levels") % 4 == 3, "null").when(F.col("levels") % 4 == 2, square).otherwise(point)
    line = F.concat(F.when(F.col("levels") % 2 == 0, F.lit("\x1e")).otherwise(""), F.lit('{"type":"Feature","properties":{"name":"'), F.col("object_id"), F.lit('"},"geometry":'), geometry, F.lit("}"))
    p.select(F.explode(F.array(line, F.lit("")))).write.text(path)
    g = readers.layer_points(spark, f"{path}/*", "school")
    return g.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "layer")


#: As downloads come in tiles of bounded size, files grow in number with the ways.
WAYS_A_FILE = 5_000


@REGISTRY.add("overpass_ways", "SELECT l_orderkey AS id, count(*)::BIGINT AS nodes FROM lineitem GROUP BY l_orderkey")
def overpass_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of elements: each way, a relation of the same geometry, and a way without any."""
    path = scratch_path(spark, "elements")
    w = cut(ways(spark, sf_dir), "ways")
    of = lambda kind, geometry: F.struct(F.lit(kind).alias("type"), F.col("way").alias("id"), geometry.alias("geometry"))
    none = F.lit(None).cast(w.schema["geometry"].dataType)
    packs = w.withColumn("pack", F.pmod(F.xxhash64("way"), F.lit(max(8, w.count() // WAYS_A_FILE)))).groupBy("pack").agg(F.flatten(F.collect_list(F.array(of("way", F.col("geometry")), of("relation", F.col("geometry")), of("way", none)))).alias("elements"))
    packs.select(F.to_json(F.struct("elements")).alias("value"), "pack").write.partitionBy("pack").text(path)
    return readers.road_ways(spark, path).select("id", F.size("geometry").cast("bigint").alias("nodes"))


_WIDE_TABLE = "SELECT o_orderpriority AS p, o_orderstatus AS s, year(o_orderdate) AS y, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3"


@REGISTRY.add("wide_to_long", f"SELECT substr(p, 1, 1) AS region_okato, trim(substr(p, 2)) AS region_name, CASE s WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS period_quarter, y::BIGINT AS year, concat(CAST(y AS STRING), '-Q', CASE s WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END) AS period_label, v AS value_rub_per_m2 FROM ({_WIDE_TABLE}) w")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sql(spark, sf_dir, _WIDE_TABLE)
    names = {v: k for k, v in readers.DIMENSIONS.items()}
    period = F.when(F.col("s") == "F", "10 I квартал").when(F.col("s") == "O", "11 II квартал").otherwise("12 III квартал")
    years = sorted(r[0] for r in t.select("y").distinct().collect())
    wide = t.select(F.concat(F.lit("   "), F.substring("p", 1, 1), F.lit(" "), F.trim(F.expr("substring(p, 2)"))).alias(names["okato"]), period.alias(names["period"]), "y", F.regexp_replace(F.format_number("v", 2), ",", "").alias("v")).groupBy(names["okato"], names["period"]).pivot("y", years).agg(F.first("v"))
    return readers.wide_to_long(wide, 61781).select("region_okato", "region_name", "period_quarter", "year", "period_label", "value_rub_per_m2")


_INDICATOR = "(SELECT '92000000000' AS region_okato, CAST(n_nationkey % 3 AS STRING) AS mestdom_code, CAST(n_nationkey % 2 AS STRING) AS tipkvartir_code, CAST(2024 + n_nationkey % 2 AS BIGINT) AS year, CAST(k AS STRING) AS rynzhel_code, CAST(n_nationkey * 100 + k AS DOUBLE) AS value_rub_per_m2 FROM nation CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 3) ks)"


@REGISTRY.add("serve_market_reference", f"SELECT region_okato, 'apartment' AS asset_class, year, round(avg(CASE WHEN rynzhel_code = '1' THEN value_rub_per_m2 END), 6) AS primary_rub_per_m2, round(avg(CASE WHEN rynzhel_code = '3' THEN value_rub_per_m2 END), 6) AS secondary_rub_per_m2 FROM {_INDICATOR} i WHERE mestdom_code = '2' AND tipkvartir_code = '1' AND year = 2025 GROUP BY region_okato, year")
def serve_market_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.market_reference(sql(spark, sf_dir, _INDICATOR), "RU-TA", "apartment", 2025))


# -- listings: pages of the three kinds, made from parts --------------------------------------------------------------------------------

_OFFERS = "(SELECT p_partkey AS k, p_partkey % 3 AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'Казань' ELSE 'Иркутск' END AS city, CAST(3000000 + p_partkey * 1000 AS BIGINT) AS price, CAST(30 + p_partkey % 60 AS BIGINT) AS area, CAST(1 + p_partkey % 9 AS BIGINT) AS floor, CAST(1 + p_partkey % 4 AS BIGINT) AS rooms FROM part)"


def _listing_pages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    o = sql(spark, sf_dir, _OFFERS).withColumns({"page_file": F.concat(F.lit("page-"), F.lpad((F.col("k") % 20).cast("string"), 4, "0"), F.lit(".html"))})
    s = {c: F.col(c).cast("string") for c in ("k", "price", "area", "floor", "rooms")}
    spaced = F.regexp_replace(F.format_number("price", 0), ",", " ")
    one = F.concat(F.lit('{"id":"'), s["k"], F.lit('","formattedFullPrice":"'), spaced, F.lit(' ₽","fullUrl":"/f/'), s["k"], F.lit('","roomsCount":'), s["rooms"], F.lit(',"totalArea":"'), s["area"], F.lit('","floorNumber":'), s["floor"], F.lit(',"building":{"floorsCount":10,"buildYear":2001,"materialType":"brick"},"geo":{"coordinates":{"lat":55.8,"lng":49.1}}}'))
    two = F.concat(F.lit('{"@type":"Offer","name":"'), s["rooms"], F.lit("-к. квартира, "), s["area"], F.lit(" м², "), s["floor"], F.lit('/10 эт.","url":"/kv_'), s["k"], F.lit('","price":"'), s["price"], F.lit('"}'))
    three = F.concat(F.lit('<div data-test="OffersSerpItem"><a href="/offer/'), s["k"], F.lit('/">'), s["rooms"], F.lit("-комнатная квартира</a><span>"), s["area"], F.lit(" м²</span><b>"), spaced, F.lit(" ₽</b><i>"), s["floor"], F.lit(" этаж из 10</i></div>"))
    wrap = [('<html>x {"offers":[', '],"more":1}</html>', one, 0, ","), ('<html><script type="application/ld+json">{"@graph":[{"@type":"Product","offers":{"@type":"AggregateOffer","offers":[', "]}}]}</script></html>", two, 1, ","), ("<html><body>", "</body></html>", three, 2, "")]
    return [o.where(F.col("kind") == kind).withColumn("t", text).groupBy("page_file", "city").agg(F.concat(F.lit(a), F.array_join(F.array_sort(F.collect_list("t")), sep), F.lit(b)).alias("html")) for a, b, text, kind, sep in wrap]


_UNIFIED = f"SELECT CAST(k AS STRING) AS listing_id, CASE kind WHEN 0 THEN 'cian' WHEN 1 THEN 'avito' ELSE 'yandex_realty' END AS source, city, price::DOUBLE AS price_rub, area::DOUBLE AS total_area_m2, rooms, floor / 10.0::DOUBLE AS floor_share, round(price / area::DOUBLE, 6) AS price_per_sqm_rub FROM {_OFFERS} o"


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _listing_pages(spark, sf_dir)
    return listings.unified(listings.from_embedded_json(a), listings.from_linked_data(b), listings.from_cards(c))


@REGISTRY.add("listings_unified", _UNIFIED)
def listings_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir).select("listing_id", "source", "city", "price_rub", "total_area_m2", "rooms", "floor_share", F.round("price_per_sqm_rub", 6).alias("price_per_sqm_rub"))


@REGISTRY.add("listings_summary", f"SELECT source, city, count(*) AS rows, median(price_rub) AS med_price, round(median(price_per_sqm_rub), 4) AS med_ppsqm FROM ({_UNIFIED}) u GROUP BY source, city")
def listings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.listing_summary(_unified(spark, sf_dir)).withColumn("med_ppsqm", F.round("med_ppsqm", 4))


@REGISTRY.add("listings_plausible", f"SELECT listing_id, source FROM ({_UNIFIED}) u WHERE price_per_sqm_rub > 30000 AND price_per_sqm_rub < 1000000 AND total_area_m2 > 15 AND total_area_m2 < 500")
def listings_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.plausible(_unified(spark, sf_dir)).select("listing_id", "source")


@REGISTRY.add("listings_comparison", f"SELECT source, city, count(*) AS rows_unique, round(median(v), 4) AS median_ppsqm_rub, count(v) AS n_valid_ppsqm, round(quantile_disc(v, 0.25), 4) AS p25_ppsqm_rub, round(100 * (median(v) - 100000) / 100000, 1) AS anchor_delta_pct FROM (SELECT *, CASE WHEN price_per_sqm_rub > 30000 AND price_per_sqm_rub < 1000000 THEN price_per_sqm_rub END AS v FROM ({_UNIFIED}) u) t GROUP BY source, city")
def listings_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _unified(spark, sf_dir)
    anchors = spark.createDataFrame([("Казань", 100_000.0), ("Иркутск", 100_000.0)], "city string, anchor double")
    c = listings.compare_sources(u, u, anchors, ["price_rub", "build_year"])
    return c.select("source", "city", "rows_unique", F.round("median_ppsqm_rub", 4).alias("median_ppsqm_rub"), "n_valid_ppsqm", F.round("p25_ppsqm_rub", 4).alias("p25_ppsqm_rub"), "anchor_delta_pct")


# -- serving ---------------------------------------------------------------------------------------------------------------------------


@REGISTRY.add("serve_inspection_list", f"SELECT object_id, round(synthetic_target_rub_per_m2, 6) AS y_true, round(y_pred_oof, 6) AS y_pred_oof, round(y_pred_oof - synthetic_target_rub_per_m2, 6) AS residual, levels FROM {OBJECTS} o WHERE asset_class = 'house'")
def serve_inspection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS)
    got = serving.inspection_list(o.drop("y_pred_oof", "fold_id"), o.select("object_id", "fold_id", "y_pred_oof"), "house")
    return rounded(got.select("object_id", "y_true", "y_pred_oof", "residual", "levels"))


@REGISTRY.add("serve_inspection_detail", f"SELECT object_id, asset_class, round(synthetic_target_rub_per_m2, 6) AS y_true, fold_id FROM {OBJECTS} o WHERE object_id = 'c/77'")
def serve_inspection_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS)
    got = serving.inspection_detail(o.drop("y_pred_oof", "fold_id"), o.select("object_id", "fold_id", "y_pred_oof"), "c/77")
    return rounded(got.select("object_id", "asset_class", "y_true", "fold_id"))


@REGISTRY.add("serve_quartet_detail", f"SELECT object_id, round(y_pred_oof, 6) AS catboost, round(y_pred_oof * 2 - synthetic_target_rub_per_m2, 6) AS ebm_residual, NULL::DOUBLE AS grey FROM {OBJECTS} o WHERE object_id = 'c/77'")
def serve_quartet_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS)
    p = o.select("object_id", "fold_id", "y_pred_oof")
    got = serving.quartet_detail(o.drop("y_pred_oof", "fold_id"), {"catboost": p, "ebm": p.withColumn("y_pred_oof", F.col("y_pred_oof") * 2)}, "c/77")
    return rounded(got.select("object_id", F.col("models")["catboost"]["y_pred_oof"].alias("catboost"), F.col("models")["ebm"]["residual"].alias("ebm_residual"), F.col("models")["grey_tree"]["y_pred_oof"].alias("grey")))


# -- metrics and models ----------------------------------------------------------------------------------------------------------------

_PAIRS = f"(SELECT object_id, asset_class, fold_id, synthetic_target_rub_per_m2 AS y_true, y_pred_oof AS y_pred FROM {OBJECTS} o WHERE asset_class IS NOT NULL)"


@REGISTRY.add("error_metrics", f"SELECT asset_class, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg(power(y_pred - y_true, 2))), 6) AS rmse, round(avg(CASE WHEN y_true <> 0 THEN abs((y_pred - y_true) / y_true) END), 6) AS mape FROM {_PAIRS} p GROUP BY asset_class")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sql(spark, sf_dir, _PAIRS).groupBy("asset_class").agg(*metrics.error_metrics()))


@REGISTRY.add("fold_metrics", f"SELECT asset_class, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape FROM (SELECT asset_class, fold_id, avg(abs(y_pred - y_true)) AS mae, sqrt(avg(power(y_pred - y_true, 2))) AS rmse, avg(CASE WHEN y_true <> 0 THEN abs((y_pred - y_true) / y_true) END) AS mape FROM {_PAIRS} p GROUP BY asset_class, fold_id) f GROUP BY asset_class")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fold_means(sql(spark, sf_dir, _PAIRS), ["asset_class"]))


def _ranks(c: str) -> str:
    return f"rank() OVER (PARTITION BY asset_class ORDER BY {c}) + (count(*) OVER (PARTITION BY asset_class, {c}) - 1) / 2.0"


@REGISTRY.add("spearman", f"SELECT asset_class, round(corr(a, b), 6) AS spearman FROM (SELECT asset_class, {_ranks('y_true')} AS a, {_ranks('y_pred')} AS b FROM {_PAIRS} p) r GROUP BY asset_class")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(sql(spark, sf_dir, _PAIRS), ["asset_class"]))


_Q = ", ".join(f"quantile_cont(y_pred, {q / 100}) - quantile_cont(y_true, {q / 100}) AS p{q}" for q in (10, 25, 50, 75, 90))


@REGISTRY.add("percentile_asymmetry", f"SELECT asset_class, {', '.join(f'round(any_value(p{q}), 6) AS p{q}_pred_minus_true' for q in (10, 25, 50, 75, 90))}, round(avg(CASE WHEN y_true <= lo THEN CASE WHEN y_pred > y_true THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS frac_overpredicted_in_bottom_decile, round(avg(CASE WHEN y_true >= hi THEN CASE WHEN y_pred < y_true THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS frac_underpredicted_in_top_decile FROM {_PAIRS} p JOIN (SELECT asset_class, quantile_cont(y_true, 0.1) AS lo, quantile_cont(y_true, 0.9) AS hi, {_Q} FROM {_PAIRS} p GROUP BY asset_class) l USING (asset_class) GROUP BY asset_class")
def percentile_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.percentile_asymmetry(sql(spark, sf_dir, _PAIRS), ["asset_class"]))


@REGISTRY.add("fidelity_r2", f"SELECT asset_class, round(1 - sum(power(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)), 6) AS r2 FROM {_PAIRS} p GROUP BY asset_class")
def fidelity_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fidelity_r2(sql(spark, sf_dir, _PAIRS), ["asset_class"], "y_pred", "y_true"))


@REGISTRY.add("spatial_folds", f"SELECT parent, count(*) AS objects, 1::BIGINT AS folds FROM {steps_sql(f'{OBJECTS} o', hex_steps(7, 'parent'))} x GROUP BY parent")
def spatial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parent cell's objects are in one fold."""
    from landgrid.functions.geo import parents

    f = mlf.with_folds(sql(spark, sf_dir, OBJECTS).drop("fold_id"), 5, 7)
    return parents(f, 7, "parent").groupBy("parent").agg(F.count("*").alias("objects"), F.count_distinct("fold_id").alias("folds"))


_TRAIN = f"(SELECT object_id, asset_class, lat, lon, levels, flats, area_m2, year_built, intra_city_raion, CAST(50000 + levels * 1500 + area_m2 * 20 AS DOUBLE) AS synthetic_target_rub_per_m2 FROM {OBJECTS} o WHERE asset_class = 'apartment')"


@REGISTRY.add("train_quartet_metrics")
def train_quartet_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.train_quartet(sql(spark, sf_dir, _TRAIN), folds=3, iterations=8)[1]


@REGISTRY.add("stream_windows", f"SELECT start, h3_index, count(*) AS count, round(sum(value), 4) AS value FROM (SELECT date_trunc('day', ts) AS start, value, h3_index FROM {steps_sql('(SELECT *, 55.75 + (user_id % 50) * 0.001 AS lat, 49.1 + (user_id % 40) * 0.001 AS lon FROM events)', hex_steps(7))} e) x GROUP BY start, h3_index HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: closed daily windows by cell."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    placed = stream.withColumns({"lat": F.expr("CAST(55.75 AS DOUBLE) + (user_id % 50) * CAST(0.001 AS DOUBLE)"), "lon": F.expr("CAST(49.1 AS DOUBLE) + (user_id % 40) * CAST(0.001 AS DOUBLE)")})
    out, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-state")
    rollup.run_available(rollup.windowed_cells(placed, 7, window="1 day"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).withColumns({"value": F.round("value", 4), "start": F.col("start").cast("timestamp_ntz")})


@REGISTRY.add("raster_rectangles")
def raster_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of classes, its runs of one class as rectangles."""
    import numpy as np

    path = scratch_path(spark, "raster")
    buf = io.BytesIO()
    np.save(buf, (np.add.outer(np.arange(40), np.arange(60)) // 7 % 3).astype(np.uint8))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/a.npy")
    out = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(jpath, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    return readers.raster_class_polygons(readers.raster_cells(spark, path), 1, 49.0, 55.8, 0.001).select("row", "cells", "wkt")

