"""Valuation objects: assembling them from map data and registries, age, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions.text import clip, era, mapped, noise, tag_class
from landgrid.schemas import VALUATION_OBJECTS, struct


def from_map_data(buildings: DataFrame) -> DataFrame:
    """Buildings of a known class at plausible coordinates: object_id, asset_class, lat, lon, levels, flats."""
    made = buildings.select(F.concat("osm_type", F.lit("/"), F.col("osm_id").cast("string")).alias("object_id"), tag_class(F.col("building")).alias("asset_class"), "lat", "lon", F.col("levels").try_cast("bigint").alias("levels"), F.col("flats").try_cast("bigint").alias("flats"))
    return made.where(F.col("asset_class").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def _aligned(silver: DataFrame, prefix: str, renamed: dict[str, str]) -> DataFrame:
    named = silver.withColumn("object_id", F.concat(F.lit(prefix), F.col("geom_data_id").cast("string"))).withColumns({k: F.col(v) for k, v in renamed.items()})
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(VALUATION_OBJECTS)])


def from_registry(buildings: DataFrame | None, landplots: DataFrame | None) -> DataFrame:
    """Objects of both registries with a class, a positive target and a positive cost; of rows with one id the first in the order of source
    and of the columns ord, if the tables have it, and target."""
    target = {"synthetic_target_rub_per_m2": "cost_index_rub_per_m2"}
    parts = []
    for rank, (silver, prefix, renamed) in enumerate(((buildings, "nspd-building/", target | {"levels": "floors"}), (landplots, "nspd-landplot/", target))):
        if silver is not None:
            order = F.col("ord") if "ord" in silver.columns else F.lit(0)
            parts.append(_aligned(silver.withColumn("__ord", order), prefix, renamed).withColumn("__rank", F.lit(rank)) if "ord" not in silver.columns else _aligned(silver, prefix, renamed).withColumn("__rank", F.lit(rank)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    valid = both.where((F.col("synthetic_target_rub_per_m2") > 0) & (F.col("cost_value_rub") > 0) & F.col("asset_class").isNotNull())
    return first_of(valid, ["object_id"], [F.col("__rank"), F.col("synthetic_target_rub_per_m2")]).drop("__rank")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, as a partial aggregate: no group is ever held or sorted."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min(rank).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def age_features(objects: DataFrame, current_year: int) -> DataFrame:
    """objects and age_years, age_years_sq, era_category, is_new_construction; a year of 0 counts as unknown."""
    if "year_built" not in objects.columns:
        raise KeyError("column year_built is missing")
    year = F.when(F.col("year_built") != 0, F.col("year_built"))
    age = (F.lit(current_year) - year).cast("bigint")
    return objects.withColumns({"age_years": age, "age_years_sq": age * age, "era_category": era(year), "is_new_construction": age <= 5})


# Base price and noise by class.
BASE = {"apartment": 80_000.0, "house": 50_000.0, "commercial": 100_000.0}
SIGMA = {"apartment": 10_000.0, "house": 8_000.0, "commercial": 15_000.0}


def object_target(objects: DataFrame, seed: int, noisy: bool = True) -> DataFrame:
    """objects and a target by class from distances, counts and roads; noise depends on object and seed only; never negative. A class without
    a base price is an error when the row is computed."""
    for c in ("asset_class", "dist_metro_m", "count_stations_1km", "count_apartments_500m", "count_houses_500m", "count_commercial_500m", "road_length_500m"):
        if c not in objects.columns:
            raise KeyError(f"column {c} is missing")
    flats, houses, shops = (F.col(f"count_{c}_500m").cast("double") for c in ("apartments", "houses", "commercial"))
    metro = lambda weight, reach: 1 + weight * F.exp(-F.col("dist_metro_m") / reach)
    road = lambda weight: 1 + weight * F.col("road_length_500m")
    kinds = {
        "apartment": metro(0.6, 800.0) * (1 + 0.05 * F.log1p(flats + shops)) * road(0.0001),
        "house": metro(0.3, 5000.0) * (1 + 0.04 * F.log1p(houses)) * clip(1 - 0.02 * F.log1p(flats), 0.6, 1.0) * road(0.00005),
        "commercial": metro(1.0, 1500.0) * (1 + 0.1 * F.log1p(flats + shops + houses)) * road(0.0002),
    }
    value = F.when(F.lit(False), F.lit(0.0))
    for name, factor in kinds.items():
        v = F.lit(BASE[name]) * factor
        value = value.when(F.col("asset_class") == name, v + F.lit(SIGMA[name]) * noise(F.col("object_id"), seed) if noisy else v)
    value = value.otherwise(F.raise_error(F.concat(F.lit("no base price for class "), F.coalesce("asset_class", F.lit("null")))).cast("double"))
    return objects.withColumn("synthetic_target_rub_per_m2", clip(value, 0.0))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


__all__ = ["age_features", "first_of", "from_map_data", "from_registry", "mapped", "numbered", "object_target"]
