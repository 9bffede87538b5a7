"""Coverage, hex feature sets, roll-ups by class, and statistics relative to parent cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions.geo import EARTH_M, LAT_REF, apply_steps, center_steps, edge_m, haversine, haversine_col, hex_steps, with_cell
from landgrid.functions.text import noise

CELL = ["h3_index", "resolution"]
TARGET, PREDICTED = "synthetic_target_rub_per_m2", "y_pred_oof"

# Numbers of which a cell shows the mean, and categories of which it shows the most frequent value.
POINTS = "school kindergarten clinic hospital pharmacy supermarket cafe restaurant bus_stop tram_stop railway_station".split()
AREAS = "water park forest industrial cemetery".split()
MEANS = [
    *("levels", "flats", "area_m2", "year_built", "age_years"),
    *(f"dist_to_{x}_m" for x in [*AREAS, "landfill", "powerline", "railway", *POINTS]),
    *("dist_metro_m", "dist_entrance_m"),
    *(f"{x}_share_500m" for x in AREAS),
    *("road_length_500m", "count_stations_1km", "count_entrances_500m", "count_apartments_500m", "count_houses_500m", "count_commercial_500m"),
    *(f"{x}_within_500m" for x in POINTS),
]
MODES = ["intra_city_raion", "mun_okrug_name", "settlement_name"]


def cover_box(spark: SparkSession, resolution: int, south: float, west: float, north: float, east: float, keep: Column | None = None) -> DataFrame:
    """Cells whose centre lies in a box, and fulfils keep (over columns lat and lon) if given: (h3_index, resolution).

    Grid lines are generated by range, so a coverage of any size is made where it is used.
    """
    e, scale = edge_m(resolution), EARTH_M * math.cos(math.radians(LAT_REF))
    r0, r1 = math.floor(math.radians(south) * EARTH_M / (1.5 * e)), math.ceil(math.radians(north) * EARTH_M / (1.5 * e))
    x0, x1 = math.radians(west) * scale / (math.sqrt(3) * e), math.radians(east) * scale / (math.sqrt(3) * e)
    rows = spark.range(r0, r1 + 1).withColumnRenamed("id", "r")
    cells = rows.select("r", F.explode(F.sequence(F.floor(F.lit(x0) - F.col("r") / 2).cast("bigint"), F.ceil(F.lit(x1) - F.col("r") / 2).cast("bigint"))).alias("q"))
    cells = cells.select(F.concat_ws(":", F.lit(str(resolution)), F.col("q").cast("string"), F.col("r").cast("string")).alias("h3_index"), F.lit(resolution).alias("resolution"))
    placed = apply_steps(cells, center_steps("h3_index")).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return (placed if keep is None else placed.where(keep)).select(*CELL)


def _one_resolution(coverage: DataFrame, resolution: int) -> DataFrame:
    """coverage, failing at run time on a row of another resolution."""
    return coverage.withColumn("resolution", F.when(F.col("resolution") == resolution, F.col("resolution")).otherwise(F.raise_error(F.lit("coverage mixes resolutions")).cast("int")))


def building_features(coverage: DataFrame, buildings: DataFrame, resolution: int) -> DataFrame:
    """Buildings by cell: counts, by kind too, mean of levels, sum of flats. Cells without buildings have counts of 0; levels and flats that
    aren't numbers are ignored."""
    cells = with_cell(buildings, resolution).groupBy("h3_index").agg(
        F.count("*").alias("building_count"), F.count_if(F.col("building") == "apartments").alias("building_count_apartments"), F.count_if(F.col("building").isin("detached", "house")).alias("building_count_detached"),
        F.avg(F.col("levels").try_cast("bigint")).alias("levels_mean"), F.coalesce(F.sum(F.col("flats").try_cast("bigint")), F.lit(0)).alias("flats_total"),
    )
    counts = ["building_count", "building_count_apartments", "building_count_detached", "flats_total"]
    return _one_resolution(coverage, resolution).join(cells, "h3_index", "left").na.fill(0, counts).na.fill(0.0, ["levels_mean"]).select(*CELL, "building_count", "building_count_apartments", "building_count_detached", "levels_mean", "flats_total")


def segments(ways: DataFrame, nodes_col: str = "geometry") -> DataFrame:
    """Consecutive pairs of each way's nodes: from_lat, from_lon, to_lat, to_lon, length_m; ways of fewer than two nodes have none."""
    g = F.col(nodes_col)
    pairs = F.when(F.size(g) > 1, F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: F.struct(F.element_at(g, i).alias("a"), F.element_at(g, i + 1).alias("b"))))
    flat = ways.select(F.explode(pairs).alias("s")).select(F.col("s.a.lat").alias("from_lat"), F.col("s.a.lon").alias("from_lon"), F.col("s.b.lat").alias("to_lat"), F.col("s.b.lon").alias("to_lon"))
    return flat.withColumn("length_m", haversine_col("from_lat", "from_lon", "to_lat", "to_lon"))


def road_features(coverage: DataFrame, ways: DataFrame, resolution: int) -> DataFrame:
    """Metres of road by cell, each segment counted where its middle lies; 0 without any."""
    middle = segments(ways).select(((F.col("from_lat") + F.col("to_lat")) / 2).alias("lat"), ((F.col("from_lon") + F.col("to_lon")) / 2).alias("lon"), "length_m")
    cells = with_cell(middle, resolution).groupBy("h3_index").agg(F.sum("length_m").alias("road_length_m"))
    return _one_resolution(coverage, resolution).join(cells, "h3_index", "left").na.fill(0.0, ["road_length_m"]).select(*CELL, "road_length_m")


#: So many points go to every task as one array (16 bytes each); more are found by joins on cells.
MOST_POINTS = 20_000


def metro_features(coverage: DataFrame, stations: DataFrame, entrances: DataFrame) -> DataFrame:
    """Distance from each cell's centre to the nearest station and entrance, and how many are nearer than 1 km and 500 m.

    A city's stations are few: up to MOST_POINTS, as counted, are gathered into one array that is broadcast as one row, and no pair is ever
    a row. More are found by the nearest-point and radius joins. Without points distances are null and counts 0.
    """
    from landgrid.operators.spatial import nearest_points, radius_pairs

    out = apply_steps(coverage, center_steps("h3_index", "__lat", "__lon"))
    for points, dist, count, near in ((stations, "dist_metro_m", "count_stations_1km", 1000.0), (entrances, "dist_entrance_m", "count_entrances_500m", 500.0)):
        own = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        if own.limit(MOST_POINTS + 1).count() > MOST_POINTS:
            centres = out.select(F.concat_ws("/", *CELL).alias("__cell"), F.col("__lat").alias("lat"), F.col("__lon").alias("lon"))
            least = nearest_points(centres, own, "__cell").select("__cell", F.col("distance_m").alias(dist))
            close = radius_pairs(own, centres, near).groupBy(F.col("r___cell").alias("__cell")).agg(F.count("*").alias(count))
            out = out.withColumn("__cell", F.concat_ws("/", *CELL)).join(least, "__cell", "left").join(close, "__cell", "left").na.fill({count: 0}).drop("__cell")
            continue
        one = own.agg(F.collect_list(F.struct("lat", "lon")).alias("__p"))
        out = out.crossJoin(F.broadcast(one))
        out = out.withColumn("__d", F.expr("transform(__p, p -> " + haversine("__lat", "__lon", "p.lat", "p.lon") + ")"))
        out = out.withColumns({dist: F.array_min("__d"), count: F.size(F.filter("__d", lambda d: d < near)).cast("bigint")}).drop("__p", "__d")  # noqa: B023
    return out.select(*coverage.columns, "dist_metro_m", "dist_entrance_m", "count_stations_1km", "count_entrances_500m")


def gold_features(coverage: DataFrame, feature_sets: list[DataFrame]) -> DataFrame:
    """coverage and the columns of every feature set, joined by cell and resolution."""
    return reduce(lambda a, b: a.join(b, CELL, "left"), feature_sets, coverage)


def cell_target(gold: DataFrame, seed: int = 42, sigma: float = 2_000.0) -> DataFrame:
    """gold and a target made from flats, roads and stations, with noise that depends on cell and seed only; never negative."""
    for c in (*CELL, "building_count_apartments", "count_stations_1km", "road_length_m"):
        if c not in gold.columns:
            raise KeyError(f"column {c} is missing")
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = F.log1p(filled("building_count_apartments")) + 0.3 * F.log1p(filled("road_length_m") / 1000)
    value = 1_000 + 6_000 * F.pow(score, F.lit(1.2)) * (1 + 0.5 * (filled("count_stations_1km") > 0).cast("double"))
    if sigma:
        value = value + F.lit(sigma) * noise(F.concat_ws("/", *CELL), seed)
    return gold.withColumn(TARGET, F.greatest(value, F.lit(0.0)))


def hex_rollup(objects: DataFrame, resolution: int) -> DataFrame:
    """A row for each cell and class, and one for each cell and "all": counts, medians of target, prediction and residual, means of numbers and
    modes of categories, of those columns that objects have. Ties of a mode go to the smallest value.

    One pass: grouping sets, not two aggregations.
    """
    have = set(objects.columns)
    o = objects if PREDICTED in have else objects.withColumn(PREDICTED, F.lit(None).cast("double"))
    o = with_cell(o, resolution).withColumn("__residual", F.col(PREDICTED) - F.col(TARGET))
    means = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in MEANS if c in have]
    modes = [F.mode(c, True).alias(f"dominant_{c}") for c in MODES if c in have]
    keys = [F.col("h3_index"), F.col("asset_class")]
    rolled = o.groupingSets([keys, keys[:1]], *keys).agg(
        F.grouping("asset_class").alias("__all"), F.count("*").alias("count"), F.median(TARGET).alias("median_target_rub_per_m2"), F.median(PREDICTED).alias("median_pred_oof_rub_per_m2"), F.median("__residual").alias("median_residual_rub_per_m2"), *means, *modes,
    )
    rolled = rolled.withColumns({"asset_class": F.when(F.col("__all") == 1, "all").otherwise(F.col("asset_class")), "resolution": F.lit(resolution)}).drop("__all")
    return rolled.select("h3_index", "resolution", "asset_class", *[c for c in rolled.columns if c not in ("h3_index", "resolution", "asset_class")])


def relative_features(objects: DataFrame, parent_resolutions: list[int], columns: list[str]) -> DataFrame:
    """objects and, for each parent resolution, the parent cell, the number of objects in it, and of each column the difference from the cell's
    median, the ratio to it (null if that is 0) and the distance in interquartile ranges (null if that is 0). Quantiles are linear.

    Statistics are one grouped aggregation for each resolution, joined back; a window would hold a cell's rows once for each column.
    """
    out = objects
    for r in parent_resolutions:
        parent = f"parent_h3_p{r}"
        out = apply_steps(out.drop(parent, f"count_p{r}"), hex_steps(r, parent))
        q = [F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q{i}") for i, c in enumerate(columns)]
        stats = out.groupBy(parent).agg(F.count("*").alias(f"count_p{r}"), *q)
        other = stats.withColumnRenamed(parent, "__parent")
        out = out.join(other, out[parent].eqNullSafe(other["__parent"]), "left")
        made = {}
        for i, c in enumerate(columns):
            v, (low, mid, high) = F.col(c).cast("double"), (F.col(f"__q{i}")[k] for k in range(3))
            made[f"{c}__rel_p{r}_diff_med"] = v - mid
            made[f"{c}__rel_p{r}_ratio_med"] = F.try_divide(v, mid)
            made[f"{c}__rel_p{r}_z_iqr"] = F.try_divide(v - mid, high - low)
        out = out.withColumns(made).drop("__parent", *[f"__q{i}" for i in range(len(columns))])
    return out
