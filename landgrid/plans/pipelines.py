"""Named pipelines: what a user calls, each a lazy plan over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.operators import graph, hexgrid, objects, registry, spatial
from landgrid.operators.layers import area_shares, geometry_distances
from landgrid.scratch import cut
from landgrid.sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """Layers, radii and resolutions of the feature build."""

    point_layers: tuple[str, ...] = tuple(hexgrid.POINTS)
    area_layers: tuple[str, ...] = tuple(hexgrid.AREAS)
    distance_layers: tuple[str, ...] = (*hexgrid.AREAS, "landfill", "powerline", "railway", *hexgrid.POINTS)
    zonal_radii: tuple[int, ...] = (100, 300, 500, 800)
    share_radii: tuple[int, ...] = (100, 300, 500, 800)
    parent_resolutions: tuple[int, ...] = (7, 8)
    relative_columns: tuple[str, ...] = ("dist_metro_m", "dist_entrance_m", "count_stations_1km", "count_entrances_500m", "count_apartments_500m", "count_houses_500m", "count_commercial_500m", "road_length_500m", "levels", "flats", "area_m2", "year_built")
    neighbour_radius_m: float = 500.0
    current_year: int = 2026
    hex_resolutions: tuple[int, ...] = field(default=(7, 8, 9, 10))


@dataclass
class Layers:
    """What the feature build reads besides the objects; None leaves its step out."""

    ways: DataFrame | None = None
    stations: DataFrame | None = None
    entrances: DataFrame | None = None
    points: DataFrame | None = None
    geometries: DataFrame | None = None
    cadnum_index: DataFrame | None = None
    mun_lookup: DataFrame | None = None
    object_params: DataFrame | None = None
    districts: DataFrame | None = None


def object_features(rows: DataFrame, layers: Layers, settings: Settings = Settings()) -> DataFrame:
    """All features of objects of all classes at once: graph distances, roads, neighbours, zones, shares, distances, territory, shape, age,
    and statistics relative to parent cells. Lineage is cut before the last, which reads its input twice for each resolution."""
    s, o = settings, rows
    if layers.stations is not None and layers.entrances is not None and layers.ways is not None:
        o = graph.metro_by_graph(o, graph.road_edges(layers.ways), layers.stations, layers.entrances)
    if layers.ways is not None:
        o = spatial.road_length(o, layers.ways)
    o = spatial.neighbour_counts(o, s.neighbour_radius_m)
    if layers.points is not None:
        o = spatial.zonal_counts(o, layers.points, list(s.point_layers), list(s.zonal_radii))
    if layers.geometries is not None:
        o = area_shares(o, layers.geometries, list(s.area_layers), list(s.share_radii))
        o = geometry_distances(o, layers.geometries, list(s.distance_layers))
    if layers.cadnum_index is not None and layers.mun_lookup is not None:
        held = spatial.districts_of(o, layers.districts) if layers.districts is not None else None
        o = registry.municipality_features(o, layers.cadnum_index, layers.mun_lookup, layers.object_params, held)
    if "polygon_wkt_3857" in o.columns:
        o = spatial.shape_features(o)
    if "year_built" in o.columns:
        o = objects.age_features(o, s.current_year)
    o = cut(o, "features")
    return hexgrid.relative_features(o, list(s.parent_resolutions), [c for c in s.relative_columns if c in o.columns])


def build_object_features(spark: SparkSession, base: str, region: str, layers: Layers, settings: Settings = Settings()) -> None:
    """Read a region's objects, add the features, and put them back by class."""
    rows = readers.partitioned(spark, base, region=region)
    sinks.save_objects(object_features(rows, layers, settings), base)


def load_registry(spark: SparkSession, pages: str, kind: str, boundary_wkt: str, base: str, region: str) -> int:
    """Parse registry pages, keep what lies strictly inside the boundary, save it as silver; the number of rows."""
    parse = {"buildings": readers.registry_buildings, "landplots": readers.registry_landplots}[kind]
    kept = cut(spatial.filter_inside(parse(spark, pages), boundary_wkt), "silver")
    sinks.save_silver(kept.withColumns({"region": F.lit(region), "source": F.lit(kind)}), base)
    return kept.count()


def address_lookups(houses: DataFrame, steads: DataFrame, addr_obj: DataFrame, hierarchy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cadastral index, municipality lookup and parameters, from tables of which the parameters are read once."""
    h, s = cut(houses, "houses"), cut(steads, "steads")
    return registry.cadnum_index(h, s), registry.mun_lookup(addr_obj, hierarchy), registry.object_params(h, s)


def hex_gold(coverage: DataFrame, resolution: int, buildings: DataFrame, ways: DataFrame, stations: DataFrame, entrances: DataFrame) -> DataFrame:
    """Gold features of one resolution's cells: buildings, roads, metro."""
    return hexgrid.gold_features(coverage, [hexgrid.building_features(coverage, buildings, resolution), hexgrid.road_features(coverage, ways, resolution), hexgrid.metro_features(coverage, stations, entrances)])


def hex_aggregates(rows: DataFrame, predictions: DataFrame | None, resolutions: list[int]) -> DataFrame:
    """Roll-ups at several resolutions, with out-of-fold predictions attached by object."""
    joined = rows if predictions is None else rows.join(predictions.select("object_id", "y_pred_oof"), "object_id", "left")
    out = None
    for r in resolutions:
        part = hexgrid.hex_rollup(joined, r)
        out = part if out is None else out.unionByName(part)
    return out
