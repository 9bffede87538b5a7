"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.common import bounded, connected_components, cut, salted_totals

SEED, KEY_BITS = 97, 64


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def passes_for(n: int, alike: float, threshold: float, window: int, block: int, least: int, miss: float) -> int:
    """Passes over a label of n rows whose pairs have a mean cosine of `alike`, so that a pair at the threshold is missed with a chance of about
    `miss`; 0 if comparing all rows in blocks sends a row no more often.

    Around the label's mean rows have a squared length of 1 - alike, so the pair's angle is wider there than at the origin. It stays
    together while its signs agree, and has to until about 2 * window rows are left.
    """
    if n <= window + 1:
        return 1
    spread = 1 - alike
    cosine = 1 - (1 - threshold) / spread if spread > 0 else -1.0
    agree = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    met = max(agree ** math.log2(max(1.0, n / (2 * window))), min(1.0, 2 * window / n))
    passes = max(least, math.ceil(math.log(miss) / math.log1p(-met))) if met < 1 else least
    return passes if passes < -(-n // block) else 0


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sum of a task's vectors by label and dimension; a label may come again where labels are very many."""
    held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        keys, got = list(held), list(held.values())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n for n, _ in got], pa.int64()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["label", "dim", "n", "total"])

    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            label, x = part.column(0).to_numpy(zero_copy_only=False), _vectors(part.column(2), int(dim))
            order = np.argsort(label, kind="stable")
            s = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
            sizes = np.diff(np.append(s, len(order)))
            for name, size, total in zip(label[order][s].tolist(), sizes.tolist(), np.add.reduceat(x[order], s), strict=True):
                n, old = held.get((name, int(dim)), (0, 0.0))
                held[name, int(dim)] = (n + size, old + total)
        if len(held) >= 4_096:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _plan(threshold: float, window: int, block: int, least: int, miss: float):
    """Rows, passes and mean of a label."""

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        n, total = sum(group.column("n").to_pylist()), _vectors(group.column("total"), dim).sum(0)
        alike = (float(total @ total) - n) / (n * (n - 1)) if n > 1 else 0.0
        passes = passes_for(n, alike, threshold, window, block, least, miss)
        return pa.table({"of_label": group.column("label")[:1], "of_dim": group.column("dim")[:1], "n": pa.array([n], pa.int64()), "passes": pa.array([passes], pa.int32()), "mean": pa.array([(total / n).tobytes()], pa.binary())})

    return run


def keys_of(x: np.ndarray, p: int) -> np.ndarray:
    """The signs of KEY_BITS random projections of pass p, packed."""
    planes = np.random.default_rng([SEED, p, x.shape[1]]).standard_normal((x.shape[1], KEY_BITS))
    return np.packbits(x @ planes > 0, axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass of its label: the signs of its projections around the label's mean; bytes sort lexicographically."""
    for batch in batches:
        dims, passes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 4))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(at))
            mine, x = passes[at], _vectors(part.column(3), int(dim)) - _vectors(part.column(5), int(dim))
            for p in range(int(mine.max())):
                on = np.flatnonzero(mine > p)
                rows = part.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), p, np.int32)), pa.array([b.tobytes() for b in keys_of(x[on], p)], pa.binary()), *rows.columns[:4]], ["pass", "key", *batch.schema.names[:4]])


def window_links(pas: np.ndarray, label: np.ndarray, x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart, of the same pass and label, with cosine >= threshold. Rows of x have length 1."""
    a, b = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        same = (pas[d:] == pas[:-d]) & (label[d:] == label[:-d])
        i = np.flatnonzero(same & (np.einsum("ij,ij->i", x[d:], x[:-d]) >= threshold))
        a.append(i)
        b.append(i + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links only those that join what wasn't joined: fewer than the rows."""
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        s, t = top(x), top(y)
        if s != t:
            up[max(s, t)] = min(s, t)
            out.append((int(ids[x]), int(ids[y])))
    return out


EDGE = "a bigint, b bigint, seam int, pass int, label bigint, dim int, vec binary"


def _table(links: list[tuple[int, int]]) -> dict[str, pa.Array]:
    n = len(links)
    return {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64()), "seam": pa.nulls(n, pa.int32()), "pass": pa.nulls(n, pa.int32()), "label": pa.nulls(n, pa.int64()), "dim": pa.nulls(n, pa.int32()), "vec": pa.nulls(n, pa.binary())}


def _windows(window: int, threshold: float):
    """Links within one sorted partition, and its first and last rows for the seams with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        pid = TaskContext.get().partitionId()
        dims, ids = t.column("dim").to_numpy(), t.column("id").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = t.take(pa.array(at))
            x = _vectors(part.column("vec"), int(dim))
            links = _forest(ids[at], *window_links(part.column("pass").to_numpy(), part.column("label").to_numpy(), x, window, threshold))
            yield pa.RecordBatch.from_pydict(_table(links))
        for seam, part in ((pid, t.slice(0, window)), (pid + 1, t.slice(max(0, len(t) - window)))):
            n = len(part)
            yield pa.RecordBatch.from_pydict({"a": part.column("id").combine_chunks(), "b": pa.nulls(n, pa.int64()), "seam": pa.array(np.full(n, seam, np.int32)), **{c: part.column(c).combine_chunks() for c in ("pass", "label", "dim", "vec")}})

    return run


def _seam(window: int, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        dims = group.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = group.take(pa.array(np.flatnonzero(dims == dim)))
            x = _vectors(part.column("vec"), int(dim))
            pas, label, ids = (part.column(c).to_numpy() for c in ("pass", "label", "a"))
            i, j = np.triu_indices(len(ids), 1)
            ok = (pas[i] == pas[j]) & (label[i] == label[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            out += _forest(ids, i[near], j[near])
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return run


def _all_pairs(threshold: float):
    """Links between two blocks of a label, or within one, thinned to a forest."""

    def run(group: pa.Table) -> pa.Table:
        ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
        x = _vectors(group.column("vec"), group.column("dim")[0].as_py())
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold - 1e-9)
        i, j = a[i], b[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        out = _forest(ids, i[near], j[near])
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return run


def _cell(threshold: float):
    """Count the links between two blocks of a component, or within one: a row for each row, none for a pair."""

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "copies"))
        x = _vectors(group.column("vec"), dim)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links = np.zeros(len(ids), np.int64)
        # Row by row in the same order of sums as between any two rows, so that a pair counts alike for both.
        near = np.empty((len(a), len(b)), bool)
        for r, i in enumerate(a):
            near[r] = np.einsum("ij,j->i", x[b], x[i]) >= threshold
        if lo == hi:
            near &= ~np.eye(len(a), dtype=bool)
            near |= near.T
            links[a] = near @ copies[b]
        else:
            links[a] = near @ copies[b]
            links[b] = near.T @ copies[a]
        return pa.table({"id": ids, "links": links})

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in double precision at length 1, as bytes; their dimension; those that can't be compared go."""
    for batch in batches:
        keep, dims, vecs = [], [], []
        for r, v in enumerate(batch.column(2).to_pylist()):
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            if not len(x) or not np.isfinite(x).all() or not (big := np.abs(x).max()):
                continue
            x = x / big  # so that the squares neither overflow nor vanish
            keep.append(r)
            dims.append(len(x))
            vecs.append((x / math.sqrt(float(x @ x))).tobytes())
        got = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "vec"])


def near_vectors(vectors: DataFrame, threshold: float = 0.98, passes: int = 12, window: int = 32, block: int = 128, part_rows: int = 20_000, miss: float = 0.02, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", broadcast_limit: int = 64 << 20) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least the threshold. Vectors that
    are null, empty, zero, or hold a null or a value that isn't finite link with nothing, nor do vectors of different lengths.
    component_id is the smallest id reachable by links found, n_links the number of rows linked directly within the component.
    A null id becomes the smallest negative while comparing; rows that share an id count as one vector's copies of it.

    Rows of the same direction and label are one row with a number of copies. In each pass rows are sorted by label and by the
    concatenated signs of random projections around the label's mean, and each is compared with the next `window` rows, across partition
    seams too; a pass emits a spanning forest of its verified pairs, not the pairs. A label gets as many passes, `passes` at least, as
    its rows and their mean cosine ask for, so that a pair at the threshold is missed with a chance of about `miss`; a label for which
    that sends each row as often as comparing all its rows in blocks is compared so instead. The forests are united to components; inside
    these all pairs are compared in blocks, so that runs of near vectors longer than a window lose no link.
    """
    none = -(2**63)
    ids = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(none)).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    if not isinstance(vectors.schema[label_col].dataType, T.IntegralType):  # others are numbered, as equal as their kind has it
        numbers = cut(ids.where("label is not null").select(F.col("label").alias("named")).distinct().withColumn("number", F.monotonically_increasing_id()), "labels")
        ids = ids.join(numbers, F.col("label") == F.col("named"), "left").select("id", F.col("number").alias("label"), "v")
    ids = ids.withColumn("label", F.col("label").cast("bigint"))
    unit = cut(ids.where("label is not null and v is not null").mapInArrow(_unit, "id bigint, label bigint, dim int, vec binary"), "unit")
    same = cut(salted_totals(unit, ["label", "vec"], F.col("id"), {"rep": F.min("id"), "copies": F.count("*")}, {"rep": F.min("rep"), "copies": F.sum("copies")}).select("id", "label", "dim", "vec", "rep", "copies"), "same")
    reps = cut(same.where("id = rep").dropDuplicates(["rep", "label", "vec"]).select("id", "label", "dim", "vec", "copies"), "reps")
    sums = reps.select("label", "dim", "vec").mapInArrow(_sums, "label bigint, dim int, n bigint, total binary")
    plans = cut(sums.groupBy("label", "dim").applyInArrow(_plan(threshold, window, block, passes, miss), "of_label bigint, of_dim int, n bigint, passes int, mean binary").where("n > 1"), "plans")
    count, size, rows = plans.agg(F.count("*"), F.max(F.octet_length("mean")), F.sum(F.col("n") * F.col("passes"))).first()
    parts = max(1, -(-(rows or 0) // part_rows))
    planned = reps.join(bounded(plans, count, (size or 0) + 40, broadcast_limit), (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim")))
    keyed = planned.where("passes > 0").select("id", "label", "dim", "vec", "passes", "mean").mapInArrow(_keys, "pass int, key binary, id bigint, label bigint, dim int, vec binary")
    blocks = planned.where("passes = 0").select("id", "label", "dim", "vec", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    whole = blocks.groupBy("label", "dim", "lo", "hi").applyInArrow(_all_pairs(threshold), "a bigint, b bigint")
    order = ["pass", "label", "dim", "key", "id"]
    walked = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(window, threshold), EDGE), "walked")
    seams = walked.where("seam is not null").groupBy("seam").applyInArrow(_seam(window, threshold), "a bigint, b bigint")
    comps = cut(connected_components(walked.where("seam is null").select("a", "b").union(seams).union(whole), "vectors"), "components")
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = cut(comps.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "placed")
    full = reps.join(bounded(placed, placed.count(), 40, broadcast_limit), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = full.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).select("id", "copies", "dim", "vec", "component", "block", "lo", "hi", "label")
    links = cells.groupBy("component", "label", "lo", "hi").applyInArrow(_cell(threshold), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))
    linked = cut(links.join(comps, "id"), "links").withColumnRenamed("id", "of")
    row = same.select("id", "rep", "copies").join(bounded(linked, placed.count(), 40, broadcast_limit), F.col("rep") == F.col("of"), "left")
    row = row.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Rows that can't be compared have no links; ids tell them apart from those that can.
    sorry = ids.where("label is null or v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) or forall(v, x -> x = 0)").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    real = lambda c: F.when(F.col(c) == none, F.lit(None)).otherwise(F.col(c))
    both = row.unionByName(sorry)
    return both.select(real("id").alias(id_col), "n_links", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
