"""Spatial joins as equi-joins on derived cells with exact residual predicates; never a product of two tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import kernels
from landgrid.functions.geo import EARTH_M, haversine_col, num
from landgrid.operators.hexgrid import segments
from landgrid.operators.radius import radius_totals
from landgrid.scratch import cut

#: Cells are this much wider than the radius, against rounding.
WIDER = 1.0001


def _columns(band: str, step: float) -> str:
    """Number of columns of a band: at least the radius wide at the latitude, within a neighbouring band, farthest from the equator; one
    near a pole."""
    top = f"((greatest(abs({band}), abs({band} + 1)) + 1) * {num(step)})"
    return f"(CASE WHEN {top} > 89.9 THEN 1 ELSE greatest(1, CAST(floor(360 * cos(radians({top})) / {num(step)}) AS BIGINT)) END)"


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of rows nearer than radius_m: columns of both (those of right with the prefix r_) and distance_m. Both have lat and lon.

    Bands of latitude are at least a radius high and columns within a band at least a radius wide, so that what is near lies in the same or a
    neighbouring cell, around the globe: right, which should be the smaller side, is sent to nine cells at most, and the join is on the cell.
    Null coordinates pair with nothing. No side is broadcast, whatever its size in files, as millions of rows fit few compressed megabytes there.
    Where only counts or sums are wanted, see radius.radius_totals.
    """
    step = math.degrees(radius_m / EARTH_M) * WIDER
    column = lambda lon, band: f"CAST(floor(({lon} + 180) / 360 * {_columns(band, step)}) AS BIGINT)"
    a = left.withColumn("__band", F.floor(F.col("lat") / step)).withColumn("__col", F.expr(f"pmod({column('lon', '__band')}, {_columns('__band', step)})"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("__rb", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("r_lat") / step) + i)))
    b = b.withColumn("__rc", F.expr(f"explode(array_distinct(transform(array(-1L, 0L, 1L), i -> pmod({column('r_lon', '__rb')} + i, {_columns('__rb', step)}))))"))
    pairs = a.join(b.hint("merge"), (F.col("__band") == F.col("__rb")) & (F.col("__col") == F.col("__rc"))).withColumn("distance_m", haversine_col("lat", "lon", "r_lat", "r_lon"))
    return pairs.where(F.col("distance_m") < radius_m).drop("__band", "__col", "__rb", "__rc")


def _joined_counts(objects: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    return objects.drop(*columns).join(counts, "object_id", "left").na.fill(0, columns)


def _own_points(objects: DataFrame, points: DataFrame, wanted: list[tuple[str, str, float]]) -> DataFrame:
    """Of each object how many of the points counted for it carry its own id."""
    own = points.select(F.col("object_id").alias("__id"), F.col("kind").alias("__kind"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    pairs = objects.select("object_id", "lat", "lon").join(own, F.col("object_id") == F.col("__id")).withColumn("__d", haversine_col("lat", "lon", "__lat", "__lon"))
    return pairs.groupBy("object_id").agg(*[F.count_if((F.col("__kind") == k) & (F.col("__d") < r)).alias(n) for n, k, r in wanted])


def _counted(objects: DataFrame, points: DataFrame, wanted: list[tuple[str, str, float]]) -> DataFrame:
    """objects and the counts wanted of points (kind, lat, lon, and object_id where they are objects, which don't count for themselves)."""
    counts = radius_totals(objects, points, "object_id", wanted)
    if "object_id" in points.columns:
        names = [n for n, *_ in wanted]
        own = _own_points(objects, points, wanted).select("object_id", *[F.expr(f"-`{n}`").alias(n) for n in names])
        counts = counts.unionByName(own).groupBy("object_id").agg(*[F.sum(f"`{n}`").alias(n) for n in names])
    return _joined_counts(objects, counts, [n for n, *_ in wanted])


def neighbour_counts(objects: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """objects and the number of other apartments, houses and commercial objects nearer than the radius (names say 500 m for any). Ids are
    unique."""
    kinds = {"apartment": "count_apartments_500m", "house": "count_houses_500m", "commercial": "count_commercial_500m"}
    points = objects.select(F.col("asset_class").alias("kind"), "lat", "lon", "object_id")
    return _counted(objects, points, [(n, k, radius_m) for k, n in kinds.items()])


def zonal_counts(objects: DataFrame, points: DataFrame, layers: list[str], radii: list[int]) -> DataFrame:
    """objects and, for each layer and radius, how many of the layer's points are nearer: {layer}_within_{r}m.

    points: layer, lat, lon, and object_id where they are objects themselves (these don't count for themselves). Ids of objects are unique.
    Layers without points count 0.
    """
    wanted = [(f"{la}_within_{r}m", la, float(r)) for la in layers for r in sorted(set(radii))]
    return _counted(objects, points.withColumnRenamed("layer", "kind"), wanted)


def road_length(objects: DataFrame, ways: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """objects and road_length_500m: metres of segments whose middle is nearer than the radius. Ids are unique."""
    middle = segments(ways).select(((F.col("from_lat") + F.col("to_lat")) / 2).alias("lat"), ((F.col("from_lon") + F.col("to_lon")) / 2).alias("lon"), "length_m", F.lit("road").alias("kind"))
    sums = radius_totals(objects, middle, "object_id", [("road_length_500m", "road", radius_m)], "length_m")
    return objects.drop("road_length_500m").join(sums, "object_id", "left").na.fill(0.0, ["road_length_500m"])


def nearest_points(left: DataFrame, right: DataFrame, key: str, order: Column | None = None, first_m: float = 62.5, factor: float = 4.0) -> DataFrame:
    """(key, r_..., distance_m): for each row of left the nearest of right, by order if given (over the pair's columns), else by distance.

    Rings: rows that find a point within a radius are done; the others try the next, four times as wide. As what is found within a radius
    is all there is within it, the nearest is exact. With an order other than distance, the ring after the first hit is searched as well.
    """
    todo, done, r = left.select(key, "lat", "lon").where("lat is not null and lon is not null"), None, first_m
    if right.isEmpty():
        return radius_pairs(todo, right, first_m)
    rank = F.struct((F.col("distance_m") if order is None else order).alias("o"), *[F.col(f"r_{c}") for c in right.columns], "distance_m")
    while r < 2.0e7:
        found = radius_pairs(todo, right, r).groupBy(key).agg(F.min(rank).alias("best"))
        if order is not None:  # another order may prefer a point that is farther by up to the scale's distortion
            found = found.where(F.col("best.distance_m") < r / 2)
        found = cut(found.select(key, *[F.col(f"best.r_{c}") for c in right.columns], F.col("best.distance_m")), "ring")
        done = found if done is None else done.unionByName(found)
        todo = cut(todo.join(found.select(key).hint("merge"), key, "left_anti"), "left")
        if todo.isEmpty():
            break
        r *= factor
    return done


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    across = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    return F.explode(F.flatten(F.transform(across, lambda cx: F.transform(F.sequence(F.floor(y0 / size), F.floor(y1 / size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))))


EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def inside(x: Column, y: Column, edges: Column, boundary: bool) -> Column:
    """Whether a point is inside closed rings, by the parity of crossings; points on an edge count as boundary says."""
    crossed = F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + F.coalesce(F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]), F.lit(0.0))))) % 2 == 1
    on = F.exists(edges, lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    return (crossed | on) if boundary else (crossed & ~on)


def polygons_of(named: DataFrame, wkt_col: str = "wkt") -> DataFrame:
    """named polygons with their edges and box in the coordinates of the WKT."""
    schema = T.StructType([*named.schema.fields, *T.StructType.fromDDL(f"edges {EDGES}, x0 double, y0 double, x1 double, y1 double").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for wkt in f[wkt_col]:
                kind, parts = kernels.parse_wkt(wkt)
                e = np.concatenate([kernels.edges(p) for p in parts]) if parts and "POLYGON" in kind else np.zeros((0, 4))
                box = [float(e[:, [0, 2]].min()), float(e[:, [1, 3]].min()), float(e[:, [0, 2]].max()), float(e[:, [1, 3]].max())] if len(e) else [None] * 4
                made.append([[dict(zip(("x1", "y1", "x2", "y2"), map(float, r), strict=True)) for r in e], *box])
            yield f.assign(**{c: [m[i] for m in made] for i, c in enumerate(("edges", "x0", "y0", "x1", "y1"))})

    return named.mapInPandas(run, schema).where("size(edges) > 0")


def polygon_join(points: DataFrame, polygons: DataFrame, cell: float = 0.05, boundary: bool = True) -> DataFrame:
    """Pairs of points (lon, lat) and polygons (as polygons_of gives them; columns prefixed p_) that hold them. Polygons are sent to the cells
    that their box touches, points to one; the exact test follows."""
    b = polygons.select(*[F.col(c).alias(f"p_{c}") for c in polygons.columns])
    b = b.withColumn("__c", _cells(F.col("p_x0"), F.col("p_y0"), F.col("p_x1"), F.col("p_y1"), cell))
    a = points.withColumns({"__cx": F.floor(F.col("lon") / cell), "__cy": F.floor(F.col("lat") / cell)})
    near = a.join(b, (F.col("__cx") == F.col("__c.cx")) & (F.col("__cy") == F.col("__c.cy")) & F.col("lon").between(F.col("p_x0"), F.col("p_x1")) & F.col("lat").between(F.col("p_y0"), F.col("p_y1")))
    return near.where(inside(F.col("lon"), F.col("lat"), F.col("p_edges"), boundary)).drop("__c", "__cx", "__cy", "p_edges", "p_x0", "p_y0", "p_x1", "p_y1")


def districts_of(objects: DataFrame, named: DataFrame) -> DataFrame:
    """(object_id, intra_city_raion): the polygon (name, ord, wkt) that holds an object, boundary included; of several that of the lowest ord."""
    return polygon_join(objects.select("object_id", "lon", "lat"), polygons_of(named)).groupBy("object_id").agg(F.min_by("p_name", "p_ord").alias("intra_city_raion"))


def filter_inside(points: DataFrame, polygon_wkt: str) -> DataFrame:
    """points strictly inside a polygon; those on its boundary and those without coordinates go. The polygon is one row of constants."""
    kind, parts = kernels.parse_wkt(polygon_wkt)
    e = np.concatenate([kernels.edges(p) for p in parts])
    edges = F.from_json(F.lit("[" + ",".join('{"x1":%r,"y1":%r,"x2":%r,"y2":%r}' % tuple(map(float, r)) for r in e) + "]"), EDGES)
    box = F.col("lon").between(float(e[:, [0, 2]].min()), float(e[:, [0, 2]].max())) & F.col("lat").between(float(e[:, [1, 3]].min()), float(e[:, [1, 3]].max()))
    return points.where(box).where(inside(F.col("lon"), F.col("lat"), edges, boundary=False))


SHAPE = ["polygon_area_m2", "polygon_perimeter_m", "polygon_compactness", "polygon_convexity", "bbox_aspect_ratio", "polygon_orientation_deg", "polygon_n_vertices"]


def shape_features(objects: DataFrame) -> DataFrame:
    """objects and seven descriptors of the footprint in polygon_wkt_3857; null for null and empty ones."""
    if "polygon_wkt_3857" not in objects.columns:
        raise KeyError("column polygon_wkt_3857 is missing")
    kind = ", ".join(f"{n} {'bigint' if n.endswith('vertices') else 'double'}" for n in SHAPE)

    @F.pandas_udf(f"struct<{kind.replace(' double', ': double').replace(' bigint', ': bigint')}>")
    def shapes(wkt: pd.Series) -> pd.DataFrame:
        rows = [kernels.shape(w) or (None,) * 7 for w in wkt]
        out = pd.DataFrame(rows, columns=SHAPE, dtype=object)
        return out.astype({n: "Int64" if n.endswith("vertices") else "float64" for n in SHAPE})

    made = objects.drop(*SHAPE).withColumn("__s", shapes("polygon_wkt_3857"))
    return made.select("*", *[F.nanvl(F.col(f"__s.{n}"), F.lit(None).cast("double")).alias(n) if not n.endswith("vertices") else F.col(f"__s.{n}") for n in SHAPE]).drop("__s")
