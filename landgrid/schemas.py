"""Schemas of the tables, and the guard that stores apply when they save and load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table lacks a required column or has it in another type."""


VALUATION_REQUIRED = "object_id STRING, asset_class STRING, lat DOUBLE, lon DOUBLE"
VALUATION_OBJECTS = "object_id STRING, asset_class STRING, lat DOUBLE, lon DOUBLE, levels BIGINT, flats BIGINT, area_m2 DOUBLE, year_built BIGINT, materials STRING, cost_value_rub DOUBLE, synthetic_target_rub_per_m2 DOUBLE, cad_num STRING, readable_address STRING, polygon_wkt_3857 STRING"
REGISTRY_BUILDINGS = "geom_data_id BIGINT, cad_num STRING, purpose STRING, asset_class STRING, lat DOUBLE, lon DOUBLE, area_m2 DOUBLE, cost_value_rub DOUBLE, cost_index_rub_per_m2 DOUBLE, year_built BIGINT, floors BIGINT, underground_floors BIGINT, materials STRING, ownership_type STRING, registration_date STRING, readable_address STRING, polygon_wkt_3857 STRING"
REGISTRY_LANDPLOTS = "geom_data_id BIGINT, cad_num STRING, asset_class STRING, lat DOUBLE, lon DOUBLE, area_m2 DOUBLE, cost_value_rub DOUBLE, cost_index_rub_per_m2 DOUBLE, land_record_category_type STRING, land_record_subtype STRING, ownership_type STRING, registration_date STRING, readable_address STRING, polygon_wkt_3857 STRING"
COVERAGE = "h3_index STRING, resolution INT"
ROAD_EDGES = "from_lat DOUBLE, from_lon DOUBLE, to_lat DOUBLE, to_lon DOUBLE, length_m DOUBLE"
ADDRESS_OBJECTS = "objectid BIGINT, objectguid STRING, name STRING, typename STRING, level TINYINT"
MUN_HIERARCHY = "objectid BIGINT, parentobjid BIGINT, oktmo STRING, path STRING"
OBJECT_PARAMS = "objectid BIGINT, typeid SMALLINT, value STRING"
OOF_PREDICTIONS = "object_id STRING, lat DOUBLE, lon DOUBLE, fold_id BIGINT, y_true DOUBLE, y_pred_oof DOUBLE"
MARKET_INDICATOR = "indicator_id BIGINT, region_okato STRING, region_name STRING, mestdom_code STRING, mestdom_name STRING, unit_code STRING, unit_name STRING, period_code STRING, period_name STRING, period_quarter BIGINT, rynzhel_code STRING, rynzhel_name STRING, tipkvartir_code STRING, tipkvartir_name STRING, year BIGINT, period_label STRING, value_rub_per_m2 DOUBLE"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require_columns(df: DataFrame, ddl: str) -> DataFrame:
    """df, if it has every column of ddl in its type."""
    have = {f.name: f.dataType for f in df.schema}
    for f in struct(ddl):
        if f.name not in have:
            raise SchemaError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise SchemaError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df
