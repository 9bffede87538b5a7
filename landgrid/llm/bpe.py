"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where their boundaries meet again."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.common import cut, rows_at_a_time, small_batches

#: Distinct pre-tokens whose ids a worker remembers before it starts over.
CACHE = 150_000
_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Ids of pre-tokens, and bytes of ids, by the ranks in a file of base64 tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.of: dict[str, tuple[int, ...]] = _Remembered(self.core)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token = by_id

    @classmethod
    def get(cls, path: str, pattern: str) -> "Coder":
        if (path, pattern) not in _coders:
            _coders[path, pattern] = cls(path, pattern)
        return _coders[path, pattern]

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.of.__getitem__, self.split.findall(text))), np.int32)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the start of each pre-token, and the number of ids before it."""
        pieces = self.split.findall(text)
        ids = [self.of[p] for p in pieces]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])[:-1]
        before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])[:-1]
        return np.fromiter(chain.from_iterable(ids), np.int32), starts, before

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Remembered(dict):
    def __init__(self, core) -> None:
        super().__init__()
        self.core = core

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = tuple(self.core.encode_single_piece(piece.encode()))
        if len(piece) < 64:
            self[piece] = ids
        return ids


def _ids(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def _both(coder: Coder, ids: pa.Array, encoded: list[np.ndarray], decoded: bool) -> dict[str, pa.Array]:
    out = {"id": ids, "ids": _ids(encoded)}
    return out | {"decoded": pa.array([coder.decode(e.tolist()) for e in encoded], pa.binary())} if decoded else out


def _encode_short(path: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for batch in rows_at_a_time(batches):
            yield pa.RecordBatch.from_pydict(_both(coder, batch.column(0), [coder.encode(t) for t in batch.column(1).to_pylist()], decoded))

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                starts = list(range(0, len(text), chunk))
                for i in range(0, len(starts), 64):
                    part = starts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array([doc] * len(part), batch.schema.field(1).type), pa.array([s // chunk for s in part], pa.int32()), pa.array([s + chunk >= len(text) for s in part]), pa.array([text[s : s + chunk + overlap] for s in part])], ["row", "id", "chunk", "last", "text"])

    return run


def _encode_chunks(path: str, pattern: str, chunk: int, overlap: int):
    """Ids of every chunk and, in the zones it shares with its neighbours, where pre-tokens start and how many ids come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for batch in rows_at_a_time(batches, 32):
            out: dict[str, list[np.ndarray]] = {k: [] for k in ("ids", "head", "head_ids", "tail", "tail_ids")}
            for text in batch.column(4).to_pylist():
                ids, starts, before = coder.spans(text)
                sure = starts <= len(text) - 2  # later ones may have been made by the cut
                head, tail = (starts < overlap) & sure, (starts >= chunk) & sure
                for k, v in (("ids", ids), ("head", starts[head]), ("head_ids", before[head]), ("tail", starts[tail] - chunk), ("tail_ids", before[tail])):
                    out[k].append(v.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(_ids, out.values())], [*batch.schema.names, *out])

    return run


def stitch(coder: Coder, chunks: list[dict], chunk: int) -> np.ndarray:
    """The text's ids from those of its chunks in order. Neighbours are joined at the first start that both have: from there on
    both scans see the same text from the same place. If they share none, one pre-token fills the overlap, and the text is read whole."""
    parts, begin = [], 0
    for here, after in zip(chunks, chunks[1:], strict=False):
        both, i, j = np.intersect1d(here["tail"], after["head"], return_indices=True)
        if not len(both):
            return coder.encode("".join(c["text"][:chunk] for c in chunks[:-1]) + chunks[-1]["text"])
        parts.append(here["ids"][begin : here["tail_ids"][i[0]]])
        begin = after["head_ids"][j[0]]
    return np.concatenate([*parts, chunks[-1]["ids"][begin:]])


def _stitch_group(path: str, pattern: str, chunk: int, decoded: bool):
    names = ("ids", "head", "head_ids", "tail", "tail_ids")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        columns = {n: [np.asarray(v.values) for v in group.column(n)] for n in names}
        rows = [{n: columns[n][i] for n in names} | {"text": group.column("text")[i].as_py()} for i in range(len(group))]
        coder = Coder.get(path, pattern)
        return pa.table(_both(coder, group.column("id").combine_chunks().slice(0, 1), [stitch(coder, rows, chunk)], decoded))

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 1_024, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, and, if asked for, decoded: the raw bytes of the ids, concatenated. Each match of pattern in the whole text is encoded by the ranks in path.

    Texts of up to `chunk` characters are encoded where they are read. Longer ones are cut into chunks that overlap, spread over the
    cluster, pre-tokenised and encoded there, and stitched where the boundaries of neighbours meet again; their ids are written
    out first, so that no shuffle is left behind in what follows. Null counts as empty and gives no ids. Ids may be null or repeated: every row gives one row.
    """
    small_batches(docs.sparkSession)
    at = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = at.schema["id"].dataType.simpleString()
    result = f"id {kind}, ids array<int>" + ", decoded binary" * decoded
    short = at.where(F.length("text") <= chunk).mapInArrow(_encode_short(path, pattern, decoded), result)
    long = at.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    cuts = long.mapInArrow(_chunks(chunk, overlap), f"row bigint, id {kind}, chunk int, last boolean, text string").repartition("row", "chunk")
    done = cuts.mapInArrow(_encode_chunks(path, pattern, chunk, overlap), f"row bigint, id {kind}, chunk int, last boolean, text string, ids array<int>, head array<int>, head_ids array<int>, tail array<int>, tail_ids array<int>")
    stitched = cut(done.groupBy("row").applyInArrow(_stitch_group(path, pattern, chunk, decoded), result), "long")
    return short.unionByName(stitched).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens and the raw bytes of its ids, concatenated; null ids give empty bytes."""
    small_batches(tokens.sparkSession)
    at = tokens.columns.index(ids_col)
    schema = tokens.drop(out_col).schema.add(out_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for batch in rows_at_a_time(batches):
            ids = batch.column(at)
            raw = [coder.decode(np.asarray(x.values).tolist()) if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, out_col])

    return tokens.drop(out_col).mapInArrow(run, schema)
