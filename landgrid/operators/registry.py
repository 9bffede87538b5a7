"""Address registry: cadastral index, hierarchy lookup, parameters, territorial features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions.text import CITY, DISTRICT, RURAL_OKRUG, TRAILING, URBAN_OKRUG, VILLAGE, extract, stripped
from landgrid.operators.objects import first_of

# Types of parameters, and the columns that they become. 8 is the cadastral number.
PARAMS = {7: "oktmo_full", 6: "okato", 5: "postal_index"}
CADNUM_TYPE = 8
TERRITORY = ["mun_okrug_name", "mun_okrug_oktmo", "settlement_name", "intra_city_raion", "mun_source", *PARAMS.values()]


def cadnum_index(houses: DataFrame, steads: DataFrame) -> DataFrame:
    """(cad_num, objectid, source) from parameters of houses and plots; a house wins, then the smallest objectid."""
    part = lambda df, source, rank: df.where((F.col("typeid") == CADNUM_TYPE) & F.col("value").isNotNull()).select(F.col("value").alias("cad_num"), "objectid", F.lit(source).alias("source"), F.lit(rank).alias("__rank"))
    both = part(houses, "house", 0).unionByName(part(steads, "stead", 1))
    return first_of(both, ["cad_num"], [F.col("__rank"), F.col("objectid")]).drop("__rank")


def mun_lookup(addr_obj: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Of each leaf the segment of its path nearest to it that is a municipal okrug (levels 2, 3), with its code, and the one that is a
    settlement (levels 4 to 6). Both come from one exploded pass by max_by over the position; nothing is sorted."""
    names = addr_obj.select(F.col("objectid").alias("segment"), F.col("name"), F.col("level").cast("int").alias("level"))
    codes = hierarchy.select(F.col("objectid").alias("segment"), "oktmo")
    steps = hierarchy.select("objectid", F.posexplode(F.split("path", "[.]")).alias("at", "part")).select("objectid", "at", F.col("part").try_cast("bigint").alias("segment"))
    known = steps.join(names, "segment", "left").join(codes, "segment", "left")
    kind = lambda low, high: F.when(F.col("level").between(low, high), F.col("at"))
    got = known.groupBy("objectid").agg(F.max_by(F.struct("name", "oktmo"), kind(2, 3)).alias("o"), F.max_by("name", kind(4, 6)).alias("settlement_name"))
    return got.select("objectid", F.col("o.name").alias("mun_okrug_name"), F.col("o.oktmo").alias("mun_okrug_oktmo"), "settlement_name")


def object_params(houses: DataFrame, steads: DataFrame) -> DataFrame:
    """(objectid, oktmo_full, okato, postal_index): parameters as columns, houses before plots; all columns are there even if no row has them."""
    part = lambda df, rank: df.where(F.col("typeid").isin(*PARAMS)).select("objectid", F.col("typeid").cast("int").alias("typeid"), "value", F.lit(rank).alias("rank"))
    both = part(houses, 0).unionByName(part(steads, 1))
    wide = both.groupBy("objectid").pivot("typeid", list(PARAMS)).agg(F.min_by("value", F.struct("rank", "value")))
    return wide.select("objectid", *[F.col(str(k)).alias(v) for k, v in PARAMS.items()])


def municipality_features(objects: DataFrame, index: DataFrame, lookup: DataFrame, params: DataFrame | None = None, districts: DataFrame | None = None) -> DataFrame:
    """objects and TERRITORY: from the registry by cadastral number, else from the address.

    districts: (object_id, intra_city_raion) from polygons, which go before what the address says. Columns of these names that objects
    already have are replaced, so that the step can be repeated. Addresses may be null.
    """
    base = objects.drop(*TERRITORY)
    out = base.join(index.select("cad_num", "objectid"), "cad_num", "left").join(lookup, "objectid", "left")
    out = out.join(params.select("objectid", *PARAMS.values()), "objectid", "left") if params is not None else out.withColumns({c: F.lit(None).cast("string") for c in PARAMS.values()})
    if districts is not None:
        out = out.join(districts.select("object_id", F.col("intra_city_raion").alias("__district")), "object_id", "left")
    else:
        out = out.withColumn("__district", F.lit(None).cast("string"))
    address = F.coalesce("readable_address", F.lit(""))
    cleaned = lambda pattern: stripped(F.regexp_replace(extract(address, pattern), TRAILING, ""))
    out = out.withColumns({"__urban": cleaned(URBAN_OKRUG), "__city": cleaned(CITY), "__rural": F.trim(extract(address, RURAL_OKRUG)), "__village": F.trim(extract(address, VILLAGE)), "__said": extract(address, DISTRICT)})
    okrug = F.coalesce("mun_okrug_name", "__urban", "__rural", F.concat(F.lit("город "), F.col("__city")))
    out = out.withColumn("__okrug", okrug)
    codes = lookup.where("mun_okrug_name is not null and mun_okrug_oktmo <> ''").groupBy(F.col("mun_okrug_name").alias("__okrug")).agg(F.min("mun_okrug_oktmo").alias("__code"))
    out = out.join(codes, "__okrug", "left")
    return out.select(
        *base.columns, F.col("__okrug").alias("mun_okrug_name"), F.coalesce("mun_okrug_oktmo", "__code").alias("mun_okrug_oktmo"), F.coalesce("settlement_name", "__city", "__village").alias("settlement_name"), F.coalesce("__district", "__said").alias("intra_city_raion"),
        F.when(F.col("mun_okrug_name").isNotNull(), "gar").otherwise("address").alias("mun_source"), *PARAMS.values(),
    )
