"""Layers of geometries: distances to the nearest one, and shares of discs that polygons cover."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import areas, kernels
from landgrid.functions.geo import with_utm
from landgrid.operators.radius import TILES, in_tiles, tasks
from landgrid.scratch import cut

#: Cells of polygons are so many metres wide, and so many bytes of edges are united at once; more are dealt to several tasks first.
CELL_M, MOST_BYTES = 2_000.0, 16 << 20


def _projected(wkt: str | None) -> tuple[bool, list[np.ndarray]]:
    """Whether a geometry bounds areas, and its edges in metres of the zone, by part."""
    kind, parts = kernels.parse_wkt(wkt)
    flat = [[np.stack(kernels.to_utm(r[:, 1], r[:, 0]), 1) for r in p if len(r)] for p in parts]
    return "POLYGON" in kind, [kernels.edges(p) for p in flat if p]


def _chosen(geometries: DataFrame, layers: list[str]) -> DataFrame:
    code = F.array_position(F.array(*map(F.lit, layers)), F.col("layer")).cast("int")
    chosen = geometries.where(F.col("layer").isin(layers)).select(code.alias("layer"), "wkt")
    return chosen.repartition(tasks(chosen))


def layer_edges(geometries: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, x1, y1, x2, y2) of every edge, in metres of the zone; layer counts from 1. A point is an edge of length 0."""
    names = ["x1", "y1", "x2", "y2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, wkt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for e in _projected(wkt)[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), layer, np.int32)), *(pa.array(np.ascontiguousarray(e[:, i])) for i in range(4))], ["layer", *names])

    return _chosen(geometries, layers).mapInArrow(run, "layer int, " + ", ".join(f"{c} double" for c in names))


def layer_outlines(geometries: DataFrame, layers: list[str], size: float) -> DataFrame:
    """(layer, cell, edges) of the union of a layer's polygons in each cell of a grid: signed edges as areas.outline gives them, as bytes.

    Each polygon is cut up by cells where it is read, so that no cell gets a whole one, and cells that one polygon fills are done at once.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for layer, wkt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                polygonal, parts = _projected(wkt)
                for e in parts if polygonal else []:
                    for cx, cy, own in areas.by_cell(areas.upward(e), size):
                        rows.append((layer, cy, cx, own.tobytes()))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
            if rows:
                yield _rows(rows)

    keys = ["layer", *TILES]
    schema = "layer int, __band bigint, __col bigint, edges binary"
    parts = cut(_chosen(geometries, layers).mapInArrow(split, schema), "parts")
    heavy = cut(parts.groupBy(*keys).agg(F.sum(F.octet_length("edges")).alias("n")).where(F.col("n") > MOST_BYTES).select(*keys, F.ceil(F.col("n") / MOST_BYTES).alias("n")), "heavy")
    if not heavy.isEmpty():
        salted = parts.join(heavy, keys, "left").withColumn("salt", F.pmod(F.xxhash64("edges"), F.coalesce("n", F.lit(1))))
        parts = salted.groupBy(*keys, "salt").applyInArrow(_united(size, signed=False), schema)
    return parts.repartition(tasks(parts), *keys).groupBy(*keys).applyInArrow(_united(size, signed=True), schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["layer", *TILES, "edges"])


def _united(size: float, signed: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        layer, cy, cx = (group.column(c)[0].as_py() for c in ("layer", *TILES))
        polygons = [np.frombuffer(x, float).reshape(-1, 4) for x in group.column("edges").to_pylist()]
        owner = np.repeat(np.arange(len(polygons)), [len(p) for p in polygons])
        out = areas.outline(np.concatenate(polygons), owner, (cx * size, cy * size, (cx + 1) * size, (cy + 1) * size))
        return pa.Table.from_batches([_rows([(layer, cy, cx, np.ascontiguousarray(out if signed else out[:, :4]).tobytes())])])

    return run


def _placed(objects: DataFrame) -> DataFrame:
    at = with_utm(objects.select(F.col("object_id").alias("__key"), "lat", "lon"))
    return at.where("utm_x is not null and utm_y is not null").select("__key", "utm_x", "utm_y")


def _cell(axis: str, size: float, off: float = 0.0) -> str:
    return f"CAST(floor(({axis} + {off!r}D) / {size!r}D) AS BIGINT)"


def area_shares(objects: DataFrame, geometries: DataFrame, layers: list[str], radii: list[int]) -> DataFrame:
    """objects and {layer}_share_{r}m: the part of the 32-cornered disc around an object that the layer's polygons cover, overlaps once.

    geometries: layer, wkt (degrees). Ids of objects are unique. The outlines of a layer's union by cell are made once; objects are sent to
    the cells that their largest disc reaches, and add up what each cell's outline covers. 0 without polygons or coordinates.
    """
    radii = sorted(set(radii))
    big, names = float(max(radii)), [(i + 1, r, f"{la}_share_{r}m") for i, la in enumerate(layers) for r in sorted(set(radii))]
    size = max(CELL_M, 4 * big)
    spread = lambda axis: F.expr(f"explode(sequence({_cell(axis, size, -big)}, {_cell(axis, size, big)}))")
    places = cut(_placed(objects), "places").withColumn("__band", spread("utm_y")).withColumn("__col", spread("utm_x"))
    pieces = cut(layer_outlines(geometries, layers, size), "outlines")
    left, right, _ = in_tiles(places, pieces, ["__key", "utm_x", "utm_y"], ["layer", "edges"])

    def run(places: pa.Table, pieces: pa.Table) -> pa.Table:
        if not len(pieces):
            places = places.slice(0, 0)
        x, y = (places.column(c).to_numpy() for c in ("utm_x", "utm_y"))
        out = {"__key": places.column("__key"), **{n: np.zeros(len(x)) for *_, n in names}}
        for layer, edges in zip(pieces.column("layer").to_pylist(), pieces.column("edges").to_pylist(), strict=True):
            signed = np.frombuffer(edges, float).reshape(-1, 5)
            for i, r, n in names:
                if i == layer and len(x):
                    out[n] = out[n] + areas.disc_areas(x, y, signed, float(r))
        return pa.table(out)

    key = objects.schema["object_id"].dataType.simpleString()
    made = left.cogroup(right).applyInArrow(run, ", ".join([f"__key {key}", *(f"`{n}` double" for *_, n in names)]))
    share = lambda r, n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(f"`{n}`") / areas.disc_area(float(r))))
    wide = made.groupBy(F.col("__key").alias("object_id")).agg(*[share(r, n).alias(n) for _, r, n in names])
    return objects.drop(*[n for *_, n in names]).join(wide, "object_id", "left").na.fill(0.0, [n for *_, n in names])


def _held(objects: DataFrame, geometries: DataFrame, layers: list[str]) -> DataFrame:
    """(__key, layer) of objects that lie in a polygon."""
    places = objects.withColumn("__band", F.expr(_cell("utm_y", CELL_M))).withColumn("__col", F.expr(_cell("utm_x", CELL_M)))
    left, right, _ = in_tiles(places, cut(layer_outlines(geometries, layers, CELL_M), "outlines"), ["__key", "utm_x", "utm_y"], ["layer", "edges"])

    def run(places: pa.Table, pieces: pa.Table) -> pa.Table:
        x, y = (places.column(c).to_numpy() for c in ("utm_x", "utm_y"))
        found = [(places.slice(0, 0).column("__key"), np.zeros(0, np.int32))]
        for layer, edges in zip(pieces.column("layer").to_pylist(), pieces.column("edges").to_pylist(), strict=True):
            held = areas.inside(x, y, np.frombuffer(edges, float).reshape(-1, 5))
            found.append((places.column("__key").filter(pa.array(held)), np.full(int(held.sum()), layer, np.int32)))
        return pa.concat_tables([pa.table({"__key": k, "layer": pa.array(n, pa.int32())}) for k, n in found])

    return left.cogroup(right).applyInArrow(run, f"__key {objects.schema['__key'].dataType.simpleString()}, layer int")


def geometry_distances(objects: DataFrame, geometries: DataFrame, layers: list[str], first_m: float = 31.25) -> DataFrame:
    """objects and dist_to_{layer}_m: planar metres to the nearest geometry of each layer, 0 inside a polygon, null for a layer without any.

    geometries: layer, wkt (degrees). Ids of objects are unique. What lies in a polygon is found by outlines of unions. For the rest, edges go
    to the cells within a radius of them, walked along each edge, and objects to one cell; those without a hit try a radius four times as
    wide, until all are done. As the first radius is small, objects in a dense place meet few edges, and those that go on have few around.
    """
    names = [f"dist_to_{la}_m" for la in layers]
    edges, places = cut(layer_edges(geometries, layers), "edges"), cut(_placed(objects), "places")
    have = sorted(r.layer for r in edges.select("layer").distinct().collect())  # layers are named by the caller: few
    if not have:
        return objects.drop(*names).withColumns({n: F.lit(None).cast("double") for n in names})
    done = cut(_held(places, geometries, layers).distinct().withColumn("d", F.lit(0.0)), "held")
    every = places.withColumn("layer", F.explode(F.array(*map(F.lit, have)).cast("array<int>")))
    todo, r = cut(every.join(done.select("__key", "layer"), ["__key", "layer"], "left_anti"), "todo"), first_m
    while not todo.isEmpty():
        found = cut(_nearer(todo, edges, r), "near")
        done = done.unionByName(found)
        todo = cut(todo.join(found.select("__key", "layer"), ["__key", "layer"], "left_anti"), "todo")
        r *= 4
    wide = done.groupBy(F.col("__key").alias("object_id")).agg(*[F.min(F.when(F.col("layer") == i, F.col("d"))).alias(n) for i, n in enumerate(names, 1)])
    return objects.drop(*names).join(wide, "object_id", "left")


def _nearer(places: DataFrame, edges: DataFrame, r: float) -> DataFrame:
    """(__key, layer, d): distance to the nearest edge of the layer where it is nearer than r."""
    low, up, slack = "least(x1, x2)", "greatest(x1, x2)", 1e-6
    walked = edges.withColumn("__col", F.expr(f"explode(sequence({_cell(low, r, -r - slack)}, {_cell(up, r, r + slack)}))"))
    # The part of the edge within a radius of the column.
    at = lambda x: f"CASE WHEN x1 = x2 THEN NULL ELSE y1 + (y2 - y1) * (({x}) - x1) / (x2 - x1) END"
    a = at(f"greatest({low}, (__col - 1) * {r!r}D - {slack!r}D)")
    b = at(f"least({up}, (__col + 2) * {r!r}D + {slack!r}D)")
    south, north = f"coalesce(least({a}, {b}), least(y1, y2))", f"coalesce(greatest({a}, {b}), greatest(y1, y2))"
    walked = walked.withColumn("__band", F.expr(f"explode(sequence({_cell(south, r, -r - slack)}, {_cell(north, r, r + slack)}))"))
    own = places.withColumns({"__band": F.expr(_cell("utm_y", r)), "__col": F.expr(_cell("utm_x", r))})
    near = own.join(walked, ["layer", *TILES])
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("utm_x") - F.col("x1")) * ex + (F.col("utm_y") - F.col("y1")) * ey, ex * ex + ey * ey), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = F.hypot(F.col("utm_x") - F.col("x1") - t * ex, F.col("utm_y") - F.col("y1") - t * ey)
    return near.groupBy("__key", "layer").agg(F.min(d).alias("d")).where(F.col("d") < r)
