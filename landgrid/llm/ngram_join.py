"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.common import bounded, connected_components, cut, give_back, rows_at_a_time, salted_totals, small_batches

WORD = re.compile(r"\w+")
SEED = 20_240_607


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of n words (lower case); a shorter text is one shingle, one without words has none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = max(1, len(w) - n + 1)
    h = np.full(m, len(w) if len(w) < n else n, np.uint64)
    for i in range(min(n, len(w))):
        h = _mixed(h ^ w[i : i + m]) + np.uint64(i)
    return np.unique(h)


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash values, len(sets) by k; no set may be empty."""
    a, b = _permutations(k)
    out = np.empty((len(sets), k), np.uint32)
    at = 0
    while at < len(sets):  # a few hundred thousand shingles at a time
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 200_000):
            size += len(sets[to])
            to += 1
        x = (np.concatenate(sets[at:to]) >> np.uint64(17)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        v = np.empty_like(x)
        for i in range(k):
            np.multiply(x, a[i], out=v)
            np.bitwise_xor(v, b[i], out=v)
            out[at:to, i] = np.minimum.reduceat(v, starts)
        at = to
    return out


def posterior_limits(threshold: float, tolerance: float, k: int, step: int) -> list[int]:
    """After each `step` compared values, the fewest matches with which a pair stays: its chance of Jaccard >= threshold, given the
    matches and a uniform prior (a Beta posterior), is at least the tolerance."""
    p = (np.arange(20_000) + 0.5) / 20_000
    limits = []
    for n in range(step, k + 1, step):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[p >= threshold].sum() >= tolerance * w.sum():
                limits.append(m)
                break
    return limits


def _sign(n: int, bands: int, rows: int):
    """Class hash of the shingle set and band keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            cls: list[bytes | None] = [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some], bands * rows)
                h = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    h = _mixed(h ^ sig[:, r::rows].astype(np.uint64)) + np.uint64(r)
                for i, key in zip(some, h.view(np.int64), strict=True):
                    keys[i] = key.tolist()
                    cls[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "cls", "bands"])

    return run


def _payload(n: int, k: int):
    """Shingles and signature of the candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 64):
            sets = [shingles(t, n) for t in batch.column(0).to_pylist()]
            sig = signatures(sets, k)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], [*batch.schema.names[1:], "shingles", "sig"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def compare_block(ids: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, threshold: float, limits: list[int], step: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right; each once if same) whose exact Jaccard is at least the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    for i in left:
        j = right[right > i] if same else right
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[small >= threshold * large - 1e-9]
        match = np.zeros(len(j), np.int64)
        for s, limit in enumerate(limits):
            if not len(j):
                break
            match += (sig[j, s * step : (s + 1) * step] == sig[i, s * step : (s + 1) * step]).sum(1)
            stay = match >= limit
            j, match = j[stay], match[stay]
        if len(j):
            both = np.array([common(sets[i], sets[x]) for x in j], np.int64)
            ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
            if ok.any():
                yield np.full(ok.sum(), i), j[ok]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, by the others' weights, and the first row that it hangs together with."""
    links, up = np.zeros(n, np.int64), list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    return links, np.array([top(i) for i in range(n)], np.int64)


def _cell(threshold: float, limits: list[int], step: int):
    """Compare the rows of one cell: a block with itself, or two blocks with each other. A row for each row, none for a pair."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        ids, block, weight = (group.column(c).to_numpy() for c in ("rep", "block", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        low, high = block.min(), block.max()
        diagonal = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        pairs = compare_block(ids, left, right, sets, sig, threshold, limits, step, True) if diagonal else compare_block(ids, left, right, sets, sig, threshold, limits, step, False) if low != high else iter(())
        links, root = _roots(len(ids), pairs, weight)
        if len(ids) >= 64:
            give_back()
        return pa.table({"rep": ids, "root": ids[root], "links": links})

    return run


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, tolerance: float = 1e-7, block: int = 256, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = 64 << 20) -> DataFrame:
    """(id, class_id, set_id, copies, n_links, kept), one row for each row of docs.

    Texts are sets of runs of n words (of lower-case \\w+). set_id is the smallest id of the texts with an equal set, copies their number.
    n_links counts the other rows whose set has a Jaccard similarity of at least the threshold, copies included; class_id is
    the smallest id that can be reached by such links, and kept marks the row with that id. A text without words has an empty set
    and links with nothing. Ids must be distinct: rows that share an id are linked as one. A null id is given the smallest negative.

    Only class representatives are compared. Band keys of MinHash values name candidates; buckets with one member go no further, and
    each other member is tied to its bucket's smallest (never all pairs). The components of these ties are compared in blocks: each
    pair once, first by size, then by MinHash values `step` at a time, dropped as soon as the posterior chance of reaching the
    threshold is below the tolerance, and exactly if it survives. A block emits a row for each of its rows and none for its pairs.
    With 32 bands of 6 values and the default tolerance a pair at the threshold is missed with a chance of 6.1e-5: 6e-5 by the bands and
    1.2e-6 by the pruning; one above with less.
    """
    step = 16
    small_batches(docs.sparkSession)
    limits = posterior_limits(threshold, tolerance, bands * rows // step * step, step)
    ids = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"), F.col(text_col).alias("text"))
    signed = cut(ids.mapInArrow(_sign(n, bands, rows), "id bigint, cls binary, bands array<bigint>"), "signed")
    classes = cut(signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "classes")
    keys = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(shared, "shared")
    ties = keys.join(bounded(shared, shared.count(), 40, broadcast_limit), ["band", "key"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    near = cut(connected_components(ties, "ties"), "near")
    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = near.join(classes.select("rep", "copies"), near.id == classes.rep)
    # Components of several blocks are the exception: their count fits a broadcast or is joined by a shuffle that can be split.
    placed = placed.join(sizes, "component").select("rep", "copies", "component", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    placed = cut(placed, "placed")
    texts = ids.join(bounded(placed, placed.count(), 64, broadcast_limit), F.col("id") == F.col("rep")).select("text", "rep", "copies", "component", "blocks", "block")
    full = texts.mapInArrow(_payload(n, bands * rows), "rep bigint, copies bigint, component bigint, blocks int, block int, shingles binary, sig binary").where("octet_length(shingles) > 0")
    cells = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    found = cells.groupBy("component", "lo", "hi").applyInArrow(_cell(threshold, limits, step), "rep bigint, root bigint, links bigint")
    found = cut(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).where("links > 0")
    joined = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "linked")
    per_class = cut(links.join(joined, F.col("rep") == F.col("id")).select("rep", "links", "component"), "linked")

    row = salted_totals(signed.where("cls is not null").select("id", "cls"), ["cls"], F.col("id"), {"rep": F.min("id"), "copies": F.count("*")}, {"rep": F.min("rep"), "copies": F.sum("copies")})
    row = row.select("id", "rep", "copies").unionByName(signed.where("cls is null").select("id", F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("copies")))
    row = row.join(bounded(per_class.withColumnRenamed("rep", "of"), per_class.count(), 48, broadcast_limit), F.col("rep") == F.col("of"), "left")
    links_all = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint")
    row = row.select("id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("set_id"), "copies", links_all.alias("n_links"))
    real = lambda c: F.when(F.col(c) == F.lit(-(2**63)), F.lit(None)).otherwise(F.col(c))
    return row.select(real("id").alias(id_col), real("class_id").alias("class_id"), real("set_id").alias("set_id"), "copies", "n_links", (F.col("id") == F.col("class_id")).alias("kept"))
