"""Distances, projections and the hexagonal grid as SQL arithmetic, so that plans stay in generated code.

Formulas are strings over column names. `steps` are lists of {column: formula}, each using those before; apply_steps() adds them to a
DataFrame and steps_sql() to a SQL relation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
#: Latitude at which the grid's plane is true to scale, and the edge of its coarsest cells; each finer resolution divides by sqrt(7).
LAT_REF, EDGE_0_M = 55.79, 1_107_712.591


def num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres between two points on a sphere."""
    a = f"power(sin(radians({lat2} - {lat1}) / {num(2)}), {num(2)}) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / {num(2)}), {num(2)})"
    return f"({num(2 * EARTH_M)} * asin(least({num(1)}, sqrt({a}))))"


def haversine_col(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine(lat1, lon1, lat2, lon2))


def mercator_lon(x: str) -> str:
    return f"degrees({x} / {num(MERCATOR_M)})"


def mercator_lat(y: str) -> str:
    return f"degrees({num(2)} * atan(exp({y} / {num(MERCATOR_M)})) - {num(math.pi / 2)})"


def edge_m(resolution: int) -> float:
    return EDGE_0_M / math.sqrt(7) ** resolution


def utm_steps(lat: str, lon: str, x: str = "utm_x", y: str = "utm_y", lon0: float = 51.0) -> list[dict[str, str]]:
    """Transverse Mercator (zone 39 N by default) by the sixth-order series in the third flattening; exact to millimetres within a zone."""
    n = (f := 1 / 298.257223563) / (2 - f)
    a = MERCATOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh_(({s})) - {num(e)} * atanh_({num(e)} * ({s})))"
    while "atanh_(" in t:  # neither engine need have atanh
        i = t.rindex("atanh_(")
        depth, j = 1, i + 7
        while depth:
            depth += (t[j] == "(") - (t[j] == ")")
            j += 1
        v = t[i + 7 : j - 1]
        t = f"{t[:i]}({num(0.5)} * ln(({num(1)} + {v}) / ({num(1)} - {v}))){t[j:]}"
    t = t.replace("sinh(", "sinh_(")
    v = t[len("sinh_(") : -1]
    t = f"((exp({v}) - exp(-({v}))) / {num(2)})"
    dl = f"radians({lon} - {num(lon0)})"
    k = num(0.9996 * a)
    u, w = f"__xi_{x}", f"__eta_{x}"
    cosh = lambda z: f"((exp({z}) + exp(-({z}))) / {num(2)})"
    sinh = lambda z: f"((exp({z}) - exp(-({z}))) / {num(2)})"
    east = " + ".join([w, *(f"{num(c)} * cos({num(2 * j)} * {u}) * {sinh(f'{num(2 * j)} * {w}')}" for j, c in enumerate(alpha, 1))])
    north = " + ".join([u, *(f"{num(c)} * sin({num(2 * j)} * {u}) * {cosh(f'{num(2 * j)} * {w}')}" for j, c in enumerate(alpha, 1))])
    p = f"(sin({dl}) / sqrt({num(1)} + __t_{x} * __t_{x}))"
    return [
        {f"__t_{x}": t},
        {u: f"atan2(__t_{x}, cos({dl}))", w: f"({num(0.5)} * ln(({num(1)} + {p}) / ({num(1)} - {p})))"},
        {x: f"{num(500_000)} + {k} * ({east})", y: f"{k} * ({north})"},
    ]


def with_utm(df: DataFrame, lat: str = "lat", lon: str = "lon", lon0: float = 51.0) -> DataFrame:
    """df and utm_x, utm_y: what utm_steps says, by the engine's own hyperbolic functions, which keep the generated code small."""
    n = (f := 1 / 298.257223563) / (2 - f)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e, k = 2 * math.sqrt(n) / (1 + n), 0.9996 * MERCATOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    s, dl, t, xi, eta = F.sin(F.radians(lat)), F.radians(F.col(lon) - lon0), F.col("__t"), F.col("__xi"), F.col("__eta")
    out = df.withColumn("__t", F.sinh(F.atanh(s) - e * F.atanh(e * s)))
    out = out.withColumns({"__xi": F.atan2(t, F.cos(dl)), "__eta": F.atanh(F.sin(dl) / F.sqrt(1 + t * t))})
    east = sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), eta)
    north = sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), xi)
    return out.withColumns({"utm_x": 500_000 + k * east, "utm_y": k * north}).drop("__t", "__xi", "__eta")


def hex_steps(resolution: int, out: str = "h3_index", lat: str = "lat", lon: str = "lon") -> list[dict[str, str]]:
    """The id resolution:q:r of the pointy-top hexagon, in axial coordinates, that holds a point; null coordinates give null."""
    p, e = f"__{out}", num(edge_m(resolution))
    x, y = f"{num(EARTH_M * math.cos(math.radians(LAT_REF)))} * radians({lon})", f"{num(EARTH_M)} * radians({lat})"
    dq, dr, ds = f"abs({p}_q0 - {p}_qf)", f"abs({p}_r0 - {p}_rf)", f"abs({p}_s0 + {p}_qf + {p}_rf)"
    return [
        {f"{p}_qf": f"({num(math.sqrt(3) / 3)} * {x} - {y} / {num(3)}) / {e}", f"{p}_rf": f"({num(2 / 3)} * {y}) / {e}"},
        {f"{p}_q0": f"round({p}_qf)", f"{p}_r0": f"round({p}_rf)", f"{p}_s0": f"round(-{p}_qf - {p}_rf)"},
        {out: f"concat('{resolution}:', CAST(CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{p}_r0 - {p}_s0 ELSE {p}_q0 END AS BIGINT) AS STRING), ':', CAST(CAST(CASE WHEN NOT ({dq} > {dr} AND {dq} > {ds}) AND {dr} > {ds} THEN -{p}_q0 - {p}_s0 ELSE {p}_r0 END AS BIGINT) AS STRING))"},
    ]


def center_steps(cell: str, lat: str = "lat", lon: str = "lon") -> list[dict[str, str]]:
    """Centre of a cell from its id."""
    part = lambda i: f"CAST(split_part({cell}, ':', {i}) AS DOUBLE)"
    e = f"({num(EDGE_0_M)} / power({num(math.sqrt(7))}, {part(1)}))"
    return [{lat: f"degrees({e} * {num(1.5)} * {part(3)} / {num(EARTH_M)})", lon: f"degrees({e} * ({num(math.sqrt(3))} * {part(2)} + {num(math.sqrt(3) / 2)} * {part(3)}) / {num(EARTH_M * math.cos(math.radians(LAT_REF)))})"}]


def disk_offsets(k: int) -> list[tuple[int, int]]:
    """Axial offsets of the cells within k steps."""
    return [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k]


def neighbours(cell: Column, k: int) -> Column:
    """Array of the ids of the cells within k steps of a cell."""
    parts = F.split(cell, ":")
    q, r = parts[1].cast("bigint"), parts[2].cast("bigint")
    return F.array(*[F.concat_ws(":", parts[0], (q + a).cast("string"), (r + b).cast("string")) for a, b in disk_offsets(k)])


def apply_steps(df: DataFrame, *lists: list[dict[str, str]]) -> DataFrame:
    """df and the columns of the last step of each list; those before are dropped again."""
    for steps in lists:
        for s in steps:
            df = df.withColumns({k: F.expr(v) for k, v in s.items()})
        df = df.drop(*[k for s in steps[:-1] for k in s if k.startswith("__")])
    return df


def steps_sql(relation: str, *lists: list[dict[str, str]]) -> str:
    for steps in lists:
        for s in steps:
            relation = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM {relation})"
    return relation


def parents(df: DataFrame, resolution: int, out: str) -> DataFrame:
    """df and the cell of its points at a coarser resolution."""
    return apply_steps(df, hex_steps(resolution, out))


def with_cell(df: DataFrame, resolution: int, out: str = "h3_index") -> DataFrame:
    return apply_steps(df, hex_steps(resolution, out))
