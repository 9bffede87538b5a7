"""Readers of semi-structured sources. All parse on the executors with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import kernels
from landgrid.functions.geo import mercator_lat, mercator_lon
from landgrid.functions.text import purpose_class, to_float, to_int, to_str
from landgrid.schemas import REGISTRY_BUILDINGS, REGISTRY_LANDPLOTS, struct
from landgrid.scratch import hadoop_path

#: End date of rows of the address registry that are in force.
ACTIVE_END = "2079-06-06"


def partitioned(spark: SparkSession, base: str, **keys: str) -> DataFrame:
    """A hive-style table, restricted to partition values; Spark reads no other partition."""
    df = spark.read.parquet(base)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def list_keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path of any store that Spark reads, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One small object whole; what is large is for the readers below."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def csv_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header and a fixed schema: ambiguous columns are read as text and cast tolerantly later."""
    return spark.read.csv(path, header=True, schema=ddl)


# -- registry pages: {"data": {"features": [...]}} -------------------------------------------------------------------------------------

_OPTIONS = "cad_num STRING, purpose STRING, build_record_area STRING, cost_value STRING, cost_index STRING, year_built STRING, floors STRING, underground_floors STRING, materials STRING, ownership_type STRING, build_record_registration_date STRING, readable_address STRING, specified_area STRING, land_record_category_type STRING, land_record_subtype STRING, land_record_reg_date STRING"
_PAGE = f"data STRUCT<features: ARRAY<STRUCT<id: STRING, geometry: STRING, properties: STRUCT<options: STRUCT<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in _OPTIONS.split(', ')))}>>>>>"


def registry_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of all pages page-*.json in path, in order (ord): id, geometry as JSON text, options with numbers as text."""
    pages = spark.read.schema(_PAGE).option("multiLine", True).option("pathGlobFilter", "page-*.json").json(path).select(F.col("_metadata.file_name").alias("file"), "data.features")
    rows = pages.select("file", F.posexplode("features").alias("pos", "f"))
    return rows.select(F.concat_ws("/", "file", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("ord"), F.col("f.id").alias("id"), F.col("f.geometry").alias("geometry"), F.col("f.properties.options").alias("o"))


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("wkt", T.StringType())]))
def _footprint(geometry: pd.Series) -> pd.DataFrame:
    rows = []
    for g in geometry:
        kind, parts = kernels.geojson_parts(json.loads(g) if g else None)
        rows.append((*(kernels.centroid(kind, parts) or (None, None)), kernels.to_wkt(kind, parts) if parts else None))
    return pd.DataFrame(rows, columns=["x", "y", "wkt"])


def _flat(features: DataFrame, ddl: str, columns: dict[str, Column]) -> DataFrame:
    g = features.withColumn("g", _footprint("geometry"))
    base = {"geom_data_id": to_int(F.col("id")), "lat": F.expr(mercator_lat("g.y")), "lon": F.expr(mercator_lon("g.x")), "polygon_wkt_3857": F.col("g.wkt"), "cad_num": to_str(F.col("o.cad_num")), "cost_value_rub": to_float(F.col("o.cost_value")), "cost_index_rub_per_m2": to_float(F.col("o.cost_index")), "ownership_type": to_str(F.col("o.ownership_type")), "readable_address": to_str(F.col("o.readable_address"))} | columns
    return g.select(*[base[f.name].cast(f.dataType).alias(f.name) for f in struct(ddl)], "ord")


def registry_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Buildings: tolerant numbers, class by purpose, centroid in degrees, footprint as WKT; ord orders them as the pages do."""
    o = lambda c: F.col(f"o.{c}")
    return _flat(registry_features(spark, path), REGISTRY_BUILDINGS, {"purpose": to_str(o("purpose")), "asset_class": purpose_class(o("purpose")), "area_m2": to_float(o("build_record_area")), "year_built": to_int(o("year_built")), "floors": to_int(o("floors")), "underground_floors": to_int(o("underground_floors")), "materials": to_str(o("materials")), "registration_date": to_str(o("build_record_registration_date"))})


def registry_landplots(spark: SparkSession, path: str) -> DataFrame:
    o = lambda c: F.col(f"o.{c}")
    return _flat(registry_features(spark, path), REGISTRY_LANDPLOTS, {"asset_class": F.lit("landplot"), "area_m2": to_float(o("specified_area")), "land_record_category_type": to_str(o("land_record_category_type")), "land_record_subtype": to_str(o("land_record_subtype")), "registration_date": to_str(o("land_record_reg_date"))})


# -- address registry XML --------------------------------------------------------------------------------------------------------------


def _xml(spark: SparkSession, path: str, tag: str, attributes: str) -> DataFrame:
    ddl = ", ".join(f"_{a} STRING" for a in attributes.split())
    return spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)


def address_objects(spark: SparkSession, path: str) -> DataFrame:
    """Address objects in force; rows whose level is no number are skipped."""
    x = _xml(spark, path, "OBJECT", "OBJECTID OBJECTGUID NAME TYPENAME LEVEL ISACTUAL ISACTIVE").where("_ISACTUAL = '1' AND _ISACTIVE = '1'")
    return x.select(F.col("_OBJECTID").try_cast("bigint").alias("objectid"), F.col("_OBJECTGUID").alias("objectguid"), F.col("_NAME").alias("name"), F.col("_TYPENAME").alias("typename"), F.col("_LEVEL").try_cast("tinyint").alias("level")).where("level is not null")


def municipal_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Places in the hierarchy in force; a parent of 0 is none."""
    x = _xml(spark, path, "ITEM", "OBJECTID PARENTOBJID OKTMO PATH ISACTIVE ENDDATE").where(f"_ISACTIVE = '1' AND _ENDDATE = '{ACTIVE_END}'")
    return x.select(F.col("_OBJECTID").try_cast("bigint").alias("objectid"), F.nullif(F.col("_PARENTOBJID").try_cast("bigint"), F.lit(0)).alias("parentobjid"), F.col("_OKTMO").alias("oktmo"), F.col("_PATH").alias("path"))


def parameters(spark: SparkSession, path: str, types: list[int]) -> DataFrame:
    """Parameters in force of the types named."""
    x = _xml(spark, path, "PARAM", "OBJECTID TYPEID VALUE ENDDATE").where(f"_ENDDATE = '{ACTIVE_END}'")
    return x.select(F.col("_OBJECTID").try_cast("bigint").alias("objectid"), F.col("_TYPEID").try_cast("smallint").alias("typeid"), F.col("_VALUE").alias("value")).where(F.col("typeid").isin(types))


# -- map data --------------------------------------------------------------------------------------------------------------------------


def road_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways with geometry of an elements file: (id, geometry array<struct<lat, lon>>)."""
    ddl = "elements ARRAY<STRUCT<type: STRING, id: BIGINT, geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>>>"
    rows = spark.read.schema(ddl).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    return rows.where("e.type = 'way' and e.geometry is not null").select("e.id", "e.geometry")


def geojson_sequence(spark: SparkSession, path: str, properties: str = "name STRING") -> DataFrame:
    """A feature a line, with or without the record separator before it: geometry as WKT (degrees) and properties. Blank lines and features
    without geometry are skipped; a path without files is an empty layer."""
    schema = f"properties STRUCT<{', '.join(f'`{n}`: {t}' for n, t in (c.rsplit(' ', 1) for c in properties.split(', ')))}>, geometry STRING"
    fs, where = hadoop_path(spark, path)
    found = fs.globStatus(where)
    lines = spark.read.text(path) if found else spark.createDataFrame([], "value STRING")
    f = lines.select(F.from_json(F.ltrim(F.col("value"), F.lit("\x1e")), schema).alias("f")).select("f.properties.*", "f.geometry").where("geometry is not null")
    names = [c for c in f.columns if c != "geometry"]
    out = T.StructType([*[f.schema[c] for c in names], T.StructField("wkt", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            got = [kernels.geojson_parts(json.loads(g)) for g in d["geometry"]]
            mid = [kernels.centroid(*g) or (None, None) for g in got]
            yield d.drop(columns="geometry").assign(wkt=[kernels.to_wkt(*g) if g[1] else None for g in got], x=[m[0] for m in mid], y=[m[1] for m in mid])

    return f.mapInPandas(run, out).where("wkt is not null")


def layer_geometries(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return geojson_sequence(spark, path).select(F.lit(layer).alias("layer"), "wkt")


def named_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord, wkt) of named areas, without the word for district at the end of the name."""
    g = geojson_sequence(spark, path).where("name is not null and wkt like '%POLYGON%'")
    return g.select(F.regexp_replace("name", "( район| р-н)$", "").alias("name"), F.col("name").alias("ord"), "wkt")


def layer_points(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Points of a layer: themselves, or the centroid of other geometries."""
    return geojson_sequence(spark, path).select(F.lit(layer).alias("layer"), F.col("y").alias("lat"), F.col("x").alias("lon"))


def building_points(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of map data as points, to seven decimals, with their tags: what the map CSV holds."""
    g = geojson_sequence(spark, path, "@id STRING, building STRING, building:levels STRING, building:flats STRING").where("wkt like '%POLYGON%'")
    i = F.col("@id")
    return g.select(F.split_part(i, F.lit("/"), F.lit(1)).alias("osm_type"), F.split_part(i, F.lit("/"), F.lit(2)).alias("osm_id"), F.round("y", 7).alias("lat"), F.round("x", 7).alias("lon"), "building", F.col("building:levels").alias("levels"), F.col("building:flats").alias("flats"))


def region_boundary(spark: SparkSession, path: str, code: str) -> str:
    """WKT of the feature whose shapeISO is code; KeyError if there is none."""
    rows = spark.read.schema("features ARRAY<STRUCT<properties: STRUCT<shapeISO: STRING>, geometry: STRING>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    got = rows.where(F.col("f.properties.shapeISO") == code).select("f.geometry").limit(1).collect()
    if not got:
        raise KeyError(code)
    return kernels.to_wkt(*kernels.geojson_parts(json.loads(got[0][0])))


# -- wide tables -----------------------------------------------------------------------------------------------------------------------

# Headers of the dimension columns, and quarters in Roman numerals.
DIMENSIONS = {
    "Классификатор объектов административно-территориального деления (ОКАТО)": "okato",
    "Место расположения жилья": "mestdom",
    "Единица измерения": "unit",
    "Период": "period",
    "Рынок жилья": "rynzhel",
    "Типы квартир": "tipkvartir",
}
QUARTERS = {"I": 1, "II": 2, "III": 3, "IV": 4}


def wide_to_long(wide: DataFrame, indicator_id: int) -> DataFrame:
    """One row for each number in a year column of a wide table whose other columns are "<code> <name>" dimensions."""
    years = [c for c in wide.columns if c.strip().isdigit() and len(c.strip()) == 4 and c.strip()[:2] in ("19", "20")]
    dims = {}
    for c in wide.columns:
        if c not in years:
            key = DIMENSIONS.get(c.strip()) or next((k for h, k in DIMENSIONS.items() if c.strip().startswith(h[:30])), None)
            if key is None:
                raise ValueError(f"unknown dimension: {c!r}")
            dims[key] = c
    long = wide.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(k) for k, c in dims.items()], *[F.col(f"`{y}`").cast("string").alias(y.strip()) for y in years])
    long = long.unpivot(list(dims), [y.strip() for y in years], "year", "cell")
    code = lambda k: F.regexp_extract(k, r"(?Us)^(\S+)\s+(.+?)$", 1)
    name = lambda k: F.when(F.col(k).rlike(r"(?Us)^\S+\s+.+$"), F.regexp_extract(k, r"(?Us)^(\S+)\s+(.+?)$", 2)).otherwise(F.col(k))
    short = {"okato": "region", "mestdom": "mestdom", "unit": "unit", "period": "period", "rynzhel": "rynzhel", "tipkvartir": "tipkvartir"}
    cols = {}
    for k, p in short.items():
        cols["region_okato" if k == "okato" else f"{p}_code"] = code(k) if k in dims else F.lit("")
        cols[f"{p}_name"] = name(k) if k in dims else F.lit("")
    out = long.withColumns(cols).withColumn("value_rub_per_m2", F.regexp_replace(F.trim("cell"), ",", ".").try_cast("double")).where("value_rub_per_m2 is not null")
    quarter = F.element_at(F.create_map(*[F.lit(x) for kv in QUARTERS.items() for x in kv]), F.upper(F.split_part(F.trim("period_name"), F.lit(" "), F.lit(1)))).cast("bigint")
    out = out.withColumns({"indicator_id": F.lit(indicator_id).cast("bigint"), "year": F.col("year").cast("bigint"), "period_quarter": quarter})
    out = out.withColumn("period_label", F.coalesce(F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("period_quarter").cast("string")), F.col("year").cast("string")))
    from landgrid.schemas import MARKET_INDICATOR

    return out.select(*[f.name for f in struct(MARKET_INDICATOR)])


# -- run artefacts ---------------------------------------------------------------------------------------------------------------------


def run_folders(spark: SparkSession, base: str, run_name: str) -> list[tuple[str, str]]:
    """(time stamp, path) of the folders run_name_<stamp>, newest first; other names that merely begin alike don't count."""
    fs, where = hadoop_path(spark, base)
    if not fs.exists(where):
        return []
    found = []
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        stamp = name[len(run_name) + 1 :]
        if s.isDirectory() and name.startswith(f"{run_name}_") and stamp[:4].isdigit():
            found.append((stamp, s.getPath().toString()))
    return sorted(found, reverse=True)


def latest_predictions(spark: SparkSession, base: str, run_names: list[str], artefact: str = "oof_predictions.parquet") -> DataFrame:
    """Out-of-fold predictions of the newest run, by time stamp over all names, that has them; an empty table without any."""
    from landgrid.schemas import OOF_PREDICTIONS

    for _, path in sorted((f for n in run_names for f in run_folders(spark, base, n)), reverse=True):
        fs, where = hadoop_path(spark, f"{path}/{artefact}")
        if fs.exists(where):
            return spark.read.parquet(f"{path}/{artefact}")
    return spark.createDataFrame([], OOF_PREDICTIONS)


def raster_cells(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """Cells of NumPy raster files (one .npy array a file): file, row, col, value. Files are read on the executors, a tile a row of work."""
    import io

    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["file"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for r0 in range(0, a.shape[0], tile):
                    part = a[r0 : r0 + tile]
                    r, c = np.indices(part.shape)
                    yield pd.DataFrame({"file": name, "row": (r + r0).ravel(), "col": c.ravel(), "value": part.ravel().astype("int64")})

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInPandas(run, "file string, row bigint, col bigint, value bigint")


def raster_class_polygons(cells: DataFrame, value: int, west: float, north: float, step: float, min_cells: int = 1) -> DataFrame:
    """Runs of cells of one class along each raster row, as rectangles in degrees: (layer parts) row, wkt, cells. Rectangles of a class tile
    its area without overlap, so that area shares and distances come out as those of merged polygons."""
    hit = cells.where(F.col("value") == value)
    from pyspark.sql import Window

    runs = hit.withColumn("__run", F.col("col") - F.row_number().over(Window.partitionBy("file", "row").orderBy("col")))
    spans = runs.groupBy("file", "row", "__run").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).withColumn("cells", F.col("c1") - F.col("c0") + 1).where(F.col("cells") >= min_cells)
    x0, x1 = F.lit(west) + F.col("c0") * step, F.lit(west) + (F.col("c1") + 1) * step
    y1, y0 = F.lit(north) - F.col("row") * step, F.lit(north) - (F.col("row") + 1) * step
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    return spans.select("file", "row", "cells", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)), F.lit("))")).alias("wkt"))
