"""What lies within a radius, summed without making a row of each pair: tiles of the globe and a sorted kernel for each."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from landgrid.functions.discs import Strips
from landgrid.functions.geo import EARTH_M, num
from landgrid.scratch import cut

#: Tiles are so many radii high, and points and places of a tile that are more than this are dealt to several tasks.
TILE, MOST_PLACES, MOST_POINTS = 4.0, 1 << 16, 1 << 21
#: Rows of a side that may be broadcast: sizes of overfull tiles are 32 bytes each.
MOST_SENT = 1 << 18
TILES = ["__band", "__col"]


def _columns(band: str, high: float) -> str:
    """Number of columns of a band of latitude: at least as wide as it is high, one where it touches a pole."""
    top = f"greatest(abs({band} * {num(high)} - 90), abs(({band} + 1) * {num(high)} - 90))"
    return f"CASE WHEN {top} > 89.9 THEN 1 ELSE greatest(1, CAST(floor(360 * cos(radians({top})) / {num(high)}) AS BIGINT)) END"


def _tile(df: DataFrame, high: float) -> DataFrame:
    """df and the tile that its place is in: __band, __col."""
    banded = df.withColumn("__band", F.expr(f"CAST(floor((lat + 90) / {num(high)}) AS BIGINT)"))
    return banded.withColumn("__col", F.expr(f"pmod(CAST(floor((lon + 180) / 360 * ({_columns('__band', high)})) AS BIGINT), {_columns('__band', high)})"))


def _tiles_near(df: DataFrame, high: float, radius_m: float) -> DataFrame:
    """df with a row for each tile that the disc around its place reaches into: around the globe where it crosses the 180th meridian."""
    angle = radius_m / EARTH_M * (1 + 1e-6)
    reach = math.degrees(angle)
    banded = df.withColumn("__band", F.expr(f"explode(sequence(CAST(floor((greatest(lat - {num(reach)}, -90) + 90) / {num(high)}) AS BIGINT), CAST(floor((least(lat + {num(reach)}, 90) + 90) / {num(high)}) AS BIGINT)))"))
    wide = f"CASE WHEN abs(lat) + {num(reach)} >= 89.99 THEN 180 ELSE degrees(asin(least(1, {num(math.sin(min(angle, math.pi / 2)))} / cos(radians(lat))))) * {num(1 + 1e-6)} END"
    n = "__n"
    spread = banded.withColumns({n: F.expr(_columns("__band", high)), "__wide": F.expr(wide)})
    low, up = (f"CAST(floor((lon + 180 {sign} __wide) / 360 * __n) AS BIGINT)" for sign in "-+")
    cols = f"CASE WHEN {up} - {low} + 1 >= __n THEN sequence(0L, __n - 1) ELSE transform(sequence({low}, {up}), c -> pmod(c, __n)) END"
    return spread.withColumn("__col", F.explode(F.expr(cols))).drop(n, "__wide")


def _parts(df: DataFrame, most: int, name: str) -> DataFrame:
    """(band, col, name): into how many parts a tile's rows go, of tiles with more than most."""
    many = df.groupBy(*TILES).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return many.select(*TILES, F.ceil(F.col("n") / most).cast("int").alias(name))


def radius_totals(places: DataFrame, points: DataFrame, key: str, wanted: list[tuple[str, str, float]], value: str | None = None) -> DataFrame:
    """(key, names...): for each (name, kind, radius_m) of wanted, how many points of that kind are nearer to a place than the radius, or
    the sum of their values. places: key (unique), lat, lon; points: kind, lat, lon and value. Places without any point near may be missing.

    Each place is in one tile, and each point is sent to the tiles that its disc reaches (2.25 on average); a kernel counts what is well
    inside a disc by binary search and measures only the rim. Pairs never become rows, so that the work grows with the places times the
    root of the density. A tile's places and points beyond a bound are dealt to several tasks, and their sums added. Rows without
    coordinates count for nothing. Distances go across the 180th meridian and the poles.
    """
    far = max(r for *_, r in wanted)
    high = math.degrees(min(TILE * far / EARTH_M, math.pi))
    a = _tile(places.select(F.col(key).alias("__key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null"), high)
    kinds = sorted({k for _, k, _ in wanted})
    weight = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    b = points.where(F.col("kind").isin(kinds)).select(code.alias("kind"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), weight.alias("w"))
    b = _tiles_near(cut(b.where("lat is not null and lon is not null"), "points"), high, far)
    left, right, dealt = in_tiles(a, b, ["__key", "lat", "lon"], ["lat", "lon", "kind", "w"])
    names = [x for x, *_ in wanted]
    schema = ", ".join([f"__key {places.schema[key].dataType.simpleString()}", *(f"`{x}` {'bigint' if value is None else 'double'}" for x in names)])
    made = left.cogroup(right).applyInArrow(_kernel([(x, kinds.index(k) + 1, r) for x, k, r in wanted], value is not None), schema)
    made = made.withColumnRenamed("__key", key)
    return made.groupBy(key).agg(*[F.sum(F.col(f"`{x}`")).alias(x) for x in names]) if dealt else made


def in_tiles(a: DataFrame, b: DataFrame, salt_a: list[str], salt_b: list[str]) -> tuple[GroupedData, GroupedData, bool]:
    """Two sides grouped by tile (columns of TILES), for a cogroup whose results add up, and whether any tile is dealt to several tasks:
    one with more rows than a bound has its rows dealt by the salts, each part meeting each part of the other side."""
    sizes = cut(_parts(a, MOST_PLACES, "__pa").join(_parts(b, MOST_POINTS, "__pb"), TILES, "full").na.fill(1), "tiles")
    overfull = sizes.count()
    if overfull:
        sizes = F.broadcast(sizes) if overfull <= MOST_SENT else sizes
        a, b = _dealt(a, sizes, "a", "b", salt_a), _dealt(b, sizes, "b", "a", salt_b)
    else:
        a, b = (x.withColumns({"__a": F.lit(0), "__b": F.lit(0)}) for x in (a, b))
    # Numbers of partitions are given, as work is out of proportion to the bytes by which Spark would merge them.
    n = tasks(a)
    at = [*TILES, "__a", "__b"]
    return a.repartition(n, *at).groupBy(*at), b.repartition(n, *at).groupBy(*at), overfull > 0


def tasks(df: DataFrame) -> int:
    """Partitions for kernels: the session's shuffle partitions, and several for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _dealt(df: DataFrame, sizes: DataFrame, own: str, other: str, salt: list[str]) -> DataFrame:
    """df with the part of its tile that each row is in, and a row for each part of the other side."""
    out = df.join(sizes, TILES, "left").withColumn(f"__{own}", F.pmod(F.xxhash64(*salt), F.coalesce(f"__p{own}", F.lit(1))).cast("int"))
    return out.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__p{other}", F.lit(1)) - 1))).drop("__pa", "__pb")


def _kernel(wanted: list[tuple[str, int, float]], valued: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    number = np.float64 if valued else np.int64

    def run(places: pa.Table, points: pa.Table) -> pa.Table:
        lat, lon = places.column("lat").to_numpy(), places.column("lon").to_numpy()
        if not len(points):
            places, lat, lon = places.slice(0, 0), lat[:0], lon[:0]
        kind, south, west, weight = (points.column(c).to_numpy() for c in ("kind", "lat", "lon", "w"))
        out = {"__key": places.column("__key")}
        for name, k, r in wanted:
            mine = kind == k
            some = len(lat) and mine.any()
            out[name] = Strips(south[mine], west[mine], weight[mine] if valued else None, r).totals(lat, lon) if some else np.zeros(len(lat), number)
        return pa.table(out)

    return run
