"""Road graph: edges, snapping, shortest paths block by block."""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.functions.geo import EARTH_M
from landgrid.operators.hexgrid import segments
from landgrid.operators.radius import tasks
from landgrid.operators.spatial import nearest_points
from landgrid.scratch import cut, free

#: Distance of an object that no path leads to.
UNREACHED_M = 1e9


def road_edges(ways: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of each way, in metres."""
    return segments(ways)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct coordinates of the edges' ends."""
    return edges.select(F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")).union(edges.select("to_lat", "to_lon")).distinct()


def _first_m(nodes: DataFrame) -> float:
    """The radius of the first ring: 62.5 m, or less where nodes are so dense that all but a few points have one within half of less."""
    r = nodes.agg(F.count("*").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("n_"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    if not r.n or r.s is None:
        return 62.5
    high = math.radians(r.n_ - r.s) * EARTH_M
    wide = math.radians(r.e - r.w) * EARTH_M * math.cos(math.radians((r.s + r.n_) / 2))
    return min(62.5, max(1.0, 4 * math.sqrt(high * wide / math.pi / r.n)))


def snapped(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_lat, node_lon, snap_m): each point's nearest node by squared degrees, and how far it is in metres."""
    degrees2 = F.pow(F.col("lat") - F.col("r_lat"), F.lit(2)) + F.pow(F.col("lon") - F.col("r_lon"), F.lit(2))
    return nearest_points(points, nodes, key, degrees2, _first_m(nodes)).select(key, F.col("r_lat").alias("node_lat"), F.col("r_lon").alias("node_lon"), F.col("distance_m").alias("snap_m"))


#: A block of the graph holds about so many directed edges (30 bytes each). Blocks are runs of cells of a square grid of so many bits a side.
BLOCK_EDGES, BITS = 1 << 20, 10
PATH = "block int, label string, limit_m double, lat double, lon double, path_m double"


def _interleaved(x: Column, y: Column) -> Column:
    """Bits of two numbers in turn: what is near on this curve is near on the plane."""

    def apart(v: Column) -> Column:
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return apart(x).bitwiseOR(F.shiftleft(apart(y), 1))


def _cell(box: dict[str, float], lat: str, lon: str) -> Column:
    part = lambda c, low, up: F.floor((F.col(c) - low) / ((up - low) or 1.0) * (1 << BITS)).cast("int")
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), v))
    return _interleaved(inside(part(lon, box["w"], box["e"])), inside(part(lat, box["s"], box["n"])))


def _runs(spark: SparkSession, first: list[int]) -> DataFrame:
    """(__run, __block, __later) for each run of 2**BITS cells: the block that its first cell is in, and the cells of the run where later
    blocks begin. first: the cell that each block begins with, in order."""
    ends = [bisect.bisect_right(first, run << BITS) for run in range(1 << BITS)] + [len(first)]
    return spark.createDataFrame([(run, max(i - 1, 0), first[max(i, 1) : max(j, 1)]) for run, (i, j) in enumerate(zip(ends, ends[1:], strict=False))], "__run int, __block int, __later array<int>")


def _pack(group: pa.Table) -> pa.Table:
    """A block as one row: its nodes, sorted; edges within it and edges that leave it, by the node they start from."""
    at = {c: group.column(c).to_numpy() for c in ("from_lat", "from_lon", "to_lat", "to_lon", "length_m", "to_block")}
    start, end = at["from_lat"] + 1j * at["from_lon"], at["to_lat"] + 1j * at["to_lon"]
    nodes, u = np.unique(start, return_inverse=True)
    out = {"block": group.column("block").slice(0, 1), "nodes": nodes}
    stays = at["to_block"] == group.column("block")[0].as_py()
    for name, those in (("in", stays), ("out", ~stays)):
        order = np.flatnonzero(those)[np.argsort(u[those], kind="stable")]
        out[f"{name}_first"] = np.searchsorted(u[order], np.arange(len(nodes) + 1)).astype(np.int32)
        out[f"{name}_length"] = at["length_m"][order]
        out[f"{name}_to"] = np.searchsorted(nodes, end[order]).astype(np.int32) if name == "in" else end[order]
        if name == "out":
            out["out_block"] = at["to_block"][order].astype(np.int32)
    return pa.table({k: v if k == "block" else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in out.items()})


PACKED = {"nodes": np.complex128, "in_first": np.int32, "in_length": np.float64, "in_to": np.int32, "out_first": np.int32, "out_length": np.float64, "out_to": np.complex128, "out_block": np.int32}


def _ranges(first: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the edges of nodes u, and which of u each is from."""
    n = first[u + 1] - first[u]
    return np.arange(n.sum()) + np.repeat(first[u] - (np.cumsum(n) - n), n), np.repeat(np.arange(len(u)), n)


def _advance(graph: pa.Table, paths: pa.Table) -> pa.Table:
    """Shorter paths within a block from those that came in (fresh), and what they send to other blocks (block is theirs, sent is true)."""
    empty = pa.table({"block": pa.array([], pa.int32()), "label": pa.array([], pa.string()), **{c: pa.array([], pa.float64()) for c in ("limit_m", "lat", "lon", "path_m")}, "sent": pa.array([], pa.bool_())})
    if not len(graph) or not len(paths):
        return empty
    g = {k: np.frombuffer(graph.column(k)[0].as_py(), t) for k, t in PACKED.items()}
    block = graph.column("block")[0].as_py()
    first, to, length = g["in_first"].tolist(), g["in_to"].tolist(), g["in_length"].tolist()
    at = paths.column("lat").to_numpy() + 1j * paths.column("lon").to_numpy()
    node = np.minimum(np.searchsorted(g["nodes"], at), len(g["nodes"]) - 1)
    known = g["nodes"][node] == at
    paths, node = paths.filter(pa.array(known)), node[known]
    names, label = np.unique(paths.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    cost, limits, fresh = paths.column("path_m").to_numpy(), paths.column("limit_m").to_numpy(), paths.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((cost, label))
    cuts = np.searchsorted(label[order], np.arange(len(names) + 1))
    made: dict[str, list[np.ndarray]] = {k: [] for k in ("block", "label", "limit_m", "at", "path_m", "sent")}
    for i, name in enumerate(names):
        own = order[cuts[i] : cuts[i + 1]]
        limit, best, heap, better = float(limits[own[0]]), {}, [], {}
        for v, d, new in zip(node[own].tolist(), cost[own].tolist(), fresh[own].tolist(), strict=True):
            if new and d < limit:
                heap.append((d, v))
            elif not new:
                best.setdefault(v, d)
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d >= best.get(v, limit):
                continue
            best[v] = better[v] = d
            for e in range(first[v], first[v + 1]):
                far = d + length[e]
                if far < best.get(to[e], limit):
                    heapq.heappush(heap, (far, to[e]))
        if not better:
            continue
        u, d = np.fromiter(better, np.int64, len(better)), np.fromiter(better.values(), float, len(better))
        e, who = _ranges(g["out_first"], u)
        far = d[who] + g["out_length"][e]
        e, far = e[far < limit], far[far < limit]
        by = np.lexsort((far, g["out_to"][e]))
        e, far = e[by], far[by]
        one = np.concatenate([[True], g["out_to"][e][1:] != g["out_to"][e][:-1]]) if len(e) else np.zeros(0, bool)
        e, far = e[one], far[one]
        where = np.concatenate([g["nodes"][u], g["out_to"][e]])
        n = len(where)
        for k, v in (("block", np.concatenate([np.full(len(u), block, np.int32), g["out_block"][e]])), ("label", np.full(n, i, np.int32)), ("limit_m", np.full(n, limit)), ("at", where), ("path_m", np.concatenate([d, far])), ("sent", np.arange(n) >= len(u))):
            made[k].append(v)
    if not made["at"]:
        return empty
    out = {k: np.concatenate(v) for k, v in made.items()}
    label = pa.DictionaryArray.from_arrays(pa.array(out["label"]), pa.array(names.tolist(), pa.string())).cast(pa.string())
    return pa.table({"block": out["block"], "label": label, "limit_m": out["limit_m"], "lat": out["at"].real.copy(), "lon": out["at"].imag.copy(), "path_m": out["path_m"], "sent": out["sent"]})


#: Graphs with more than twice so many directed edges a node are searched over about so many of the shortest first, for so many labels at most.
FIRST_EDGES, MOST_LABELS = 8, 16
#: Nodes that may be broadcast: 24 bytes each.
MOST_SENT = 1 << 15
START = ["label", "limit_m", "lat", "lon"]


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(label, lat, lon, path_m): least path by undirected edges from any start of a label to each node nearer than the label's limit.

    starts: label, limit_m, lat, lon, path_m (what it costs to begin).
    """
    edges = cut(edges.select(*EDGE), "ends")
    return _paths(edges, cut(graph_nodes(edges), "nodes"), starts)


EDGE = ["from_lat", "from_lon", "to_lat", "to_lon", "length_m"]


def _paths(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """shortest_paths of edges and their nodes that are stored.

    Where nodes have many edges and labels are few, the shortest edges are searched first. What a label needs to a node by these is an upper
    bound: an edge as long as the largest bound of the node that it leads to shortens no path. Few of the longer ones are left to search on with.
    """
    ends = edges.select(*EDGE).where("length_m is not null and (from_lat <> to_lat or from_lon <> to_lon)")
    least = cut(starts.groupBy(*START).agg(F.min("path_m").alias("path_m")).where("path_m < limit_m"), "starts")
    limits = [r.limit_m for r in least.select("label", "limit_m").distinct().limit(MOST_LABELS + 1).collect()]
    n = 2 * ends.count() if 0 < len(limits) <= MOST_LABELS else 0
    if n <= BLOCK_EDGES or n <= 2 * FIRST_EDGES * (count := nodes.count()):
        found = _search(cut(_both_ways(ends), "both"), least)
    else:
        short_m = ends.agg(F.percentile_approx("length_m", FIRST_EDGES * count / n, 10000)).first()[0]
        short = _both_ways(ends.where(F.col("length_m") <= short_m))
        found = _least(_search(cut(short, "both"), least), least)
        longer = cut(_useful(_both_ways(ends.where(F.col("length_m") > short_m)), found, nodes, limits), "longer")
        better = cut(_shortened(longer, found), "better")
        if not better.isEmpty():
            found = _search(cut(short.union(_both_ways(longer)), "both"), better, found)
    # A start that no edge touches reaches itself.
    names = ["label", "lat", "lon", "path_m"]
    return found.select(*names).union(least.select(*names)).groupBy(*names[:3]).agg(F.min("path_m").alias("path_m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).union(edges.select("to_lat", "to_lon", "from_lat", "from_lon", "length_m"))


def _least(found: DataFrame, starts: DataFrame) -> DataFrame:
    return cut(found.unionByName(starts).groupBy(*START).agg(F.min("path_m").alias("path_m")), "found")


def _useful(edges: DataFrame, found: DataFrame, nodes: DataFrame, limits: list[float]) -> DataFrame:
    """Of directed edges those that may shorten a path, with need_m: the most that any label is known to need to the node that they lead to,
    or the largest limit where a label doesn't get there. Most edges are longer than almost all needs; of these only what leads to the other
    nodes is looked at."""
    known = found.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.max("path_m").alias("most_m"))
    need = F.when(F.col("n") == len(limits), F.col("most_m")).otherwise(F.lit(max(limits)))
    to = nodes.join(known.hint("merge"), ["lat", "lon"], "left").select(F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), need.alias("need_m"))
    to = cut(to, "needs")
    usual_m = to.agg(F.percentile_approx("need_m", 0.99)).first()[0]
    far = to.where(F.col("need_m") > usual_m)
    far = F.broadcast(far) if far.count() <= MOST_SENT else far.hint("merge")
    usual = edges.where(F.col("length_m") < usual_m).join(to.hint("merge"), ["to_lat", "to_lon"])
    return usual.union(edges.where(F.col("length_m") >= usual_m).join(far, ["to_lat", "to_lon"])).where("length_m < need_m")


def _shortened(edges: DataFrame, found: DataFrame) -> DataFrame:
    """What found becomes shorter or longer-reaching by, one of the edges (with need_m) after a path that is known."""
    start = found.select("label", "limit_m", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.col("path_m").alias("before_m"))
    far = edges.join(start.hint("merge"), ["from_lat", "from_lon"]).withColumn("path_m", F.col("before_m") + F.col("length_m")).where("path_m < limit_m and path_m < need_m")
    far = far.groupBy("label", "limit_m", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")).agg(F.min("path_m").alias("path_m"))
    return far.join(found.withColumnRenamed("path_m", "known_m").hint("merge"), START, "left").where("known_m is null or path_m < known_m").drop("known_m")


def _search(both: DataFrame, least: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(label, limit_m, lat, lon, path_m): paths by edges, stored both ways, from what is new (least), where found is known already. Frees them.

    The graph is cut into blocks of about BLOCK_EDGES edges that lie together; in each round every block that something came in for searches
    on from there, and sends what leaves it to other blocks, until nothing does. A path takes as many rounds as it changes blocks. Rounds are
    written to the shared folder, and freed when the next is.
    """
    r = both.agg(F.min("from_lat").alias("s"), F.max("from_lat").alias("n"), F.min("from_lon").alias("w"), F.max("from_lon").alias("e")).first()
    names = [*START, "path_m"]
    if r.s is None:
        return least.select(*names)
    box = r.asDict()
    # At most 4**BITS cells: small enough for one window, not for the driver, which gets a number for each block.
    cells = both.groupBy(_cell(box, "from_lat", "from_lon").alias("cell")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("cell", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_EDGES).alias("block"))
    runs = _runs(both.sparkSession, sorted(x.first_cell for x in cells.groupBy("block").agg(F.min("cell").alias("first_cell")).collect()))

    def blocked(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
        at = df.withColumn("__c", _cell(box, lat, lon)).withColumn("__run", F.shiftright("__c", BITS)).join(F.broadcast(runs), "__run")
        return at.withColumn(name, F.when(F.size("__later") == 0, F.col("__block")).otherwise(F.col("__block") + F.size(F.filter("__later", lambda x: x <= F.col("__c"))))).drop("__c", *runs.columns)

    n = tasks(both)
    packed = ", ".join(f"{k} binary" for k in PACKED)
    graph = blocked(blocked(both, "from_lat", "from_lon", "block"), "to_lat", "to_lon", "to_block")
    graph = cut(graph.repartition(n, "block").groupBy("block").applyInArrow(_pack, f"block int, {packed}"), "graph")
    free(both)
    sent = blocked(least, "lat", "lon", "block")
    touched, step = sent.select("block").distinct(), None
    if found is not None:
        found = cut(blocked(found, "lat", "lon", "block").select(*PATH_NAMES), "found")
    while True:
        fresh = sent.select(*PATH_NAMES, F.lit(True).alias("fresh"))
        paths = fresh if found is None else fresh.unionByName(found.join(F.broadcast(touched), "block", "left_semi").select(*PATH_NAMES, F.lit(False).alias("fresh")))
        left, right = graph.repartition(n, "block").groupBy("block"), paths.repartition(n, "block").groupBy("block")
        before, step = (found, step), cut(left.cogroup(right).applyInArrow(_advance, PATH + ", sent boolean"), "step")
        better = step.where("not sent").select(*PATH_NAMES)
        found = better if found is None else found.unionByName(better)
        found = cut(found.groupBy(*[c for c in PATH_NAMES if c != "path_m"]).agg(F.min("path_m").alias("path_m")), "found")
        for old in before:
            if old is not None:
                free(old)
        touched = step.where("sent").select("block").distinct()
        sent = step.where("sent").groupBy(*[c for c in PATH_NAMES if c != "path_m"]).agg(F.min("path_m").alias("path_m"))
        if step.where("sent").isEmpty():
            break
    for old in (step, graph):
        free(old)
    return found.select(*names)


PATH_NAMES = [c.split()[0] for c in PATH.split(", ")]


def target_distances(edges: DataFrame, targets: DataFrame, limit_m: float = float("inf")) -> DataFrame:
    """(target, lat, lon, path_m) for every node that a target (target, node_lat, node_lon, snap_m) reaches by undirected edges within
    limit_m; path_m includes the target's snap. Edges as long as the limit or longer are left out."""
    starts = targets.select(F.col("target").cast("string").alias("label"), F.lit(float(limit_m)).alias("limit_m"), F.col("node_lat").alias("lat"), F.col("node_lon").alias("lon"), F.col("snap_m").alias("path_m"))
    found = shortest_paths(edges.where(F.col("length_m") < limit_m), starts)
    return found.select(F.col("label").cast(targets.schema["target"].dataType).alias("target"), "lat", "lon", "path_m")


def graph_distances(objects: DataFrame, edges: DataFrame, targets: DataFrame, limit_m: float = float("inf")) -> DataFrame:
    """(object_id, target, distance_m): snap + path + snap of every pair that a path joins within limit_m. targets: target, lat, lon."""
    nodes = cut(graph_nodes(edges), "nodes")
    return _joined(snapped(objects.select("object_id", "lat", "lon"), nodes, "object_id"), target_distances(edges, snapped(targets.select("target", "lat", "lon"), nodes, "target"), limit_m)).select("object_id", "target", "distance_m").where(F.col("distance_m") < limit_m)


def _joined(at: DataFrame, reach: DataFrame) -> DataFrame:
    return at.join(reach.hint("merge"), (F.col("node_lat") == F.col("lat")) & (F.col("node_lon") == F.col("lon"))).withColumn("distance_m", F.col("snap_m") + F.col("path_m"))


def metro_by_graph(objects: DataFrame, edges: DataFrame, stations: DataFrame, entrances: DataFrame) -> DataFrame:
    """objects with graph distances to the nearest station and entrance (1e9 if none is reached), and how many are nearer than 1 km and 500 m.

    Distances to the nearest come from one search with two labels, counts from a search with a label for each target that ends at its
    radius, over edges shorter than that.
    """
    out = objects.drop("dist_metro_m", "dist_entrance_m", "count_stations_1km", "count_entrances_500m")
    edges = cut(edges.select(*EDGE), "edges")
    nodes = cut(graph_nodes(edges), "nodes")
    at = snapped(objects.select("object_id", "lat", "lon"), nodes, "object_id")
    kinds = (("s", stations, "dist_metro_m", "count_stations_1km", 1000.0), ("e", entrances, "dist_entrance_m", "count_entrances_500m", 500.0))
    ends = None
    for kind, points, _, _, near in kinds:
        own = snapped(points.select(F.col("target").cast("string").alias("target"), "lat", "lon"), nodes, "target")
        own = own.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind), "target").alias("target"), F.lit(near).alias("near"), F.col("node_lat").alias("lat"), F.col("node_lon").alias("lon"), F.col("snap_m").alias("path_m"))
        ends = own if ends is None else ends.unionByName(own)
    least = _paths(edges, nodes, ends.select(F.col("kind").alias("label"), F.lit(float("inf")).alias("limit_m"), "lat", "lon", "path_m"))
    close = shortest_paths(edges.where(F.col("length_m") < max(k[-1] for k in kinds)), ends.select(F.col("target").alias("label"), F.col("near").alias("limit_m"), "lat", "lon", "path_m"))
    first = lambda k: F.min(F.when(F.col("label") == k, F.col("distance_m")))
    least = _joined(at, least).groupBy("object_id").agg(*[first(k).alias(dist) for k, _, dist, _, _ in kinds])
    within = lambda k, near: F.count_if((F.substring("label", 1, 1) == k) & (F.col("distance_m") < near))
    close = _joined(at, close).groupBy("object_id").agg(*[within(k, near).alias(count) for k, _, _, count, near in kinds])
    out = out.join(least.hint("merge"), "object_id", "left").join(close.hint("merge"), "object_id", "left")
    return out.na.fill({"dist_metro_m": UNREACHED_M, "dist_entrance_m": UNREACHED_M, "count_stations_1km": 0, "count_entrances_500m": 0})
