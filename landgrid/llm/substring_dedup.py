"""Suffix-array dedup of byte strings: minimizer anchors find where documents may agree, hash-compared suffix sorts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from landgrid.llm.common import bounded, cut, give_back, rows_at_a_time, salted_totals, small_batches

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NO_ID = 2**63 - 1  # stands for null: no id is larger
FLUSH = 1 << 20
#: Surroundings sorted at once, and neighbours compared at once; an anchor's are never parted.
SLICE = 1 << 14
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all prefixes along the last axis; the empty one first."""
    power, _ = _power_tables(b.shape[-1] + 1)
    out = np.zeros((*b.shape[:-1], b.shape[-1] + 1), np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: b.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(data: np.ndarray, room: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-grams that are smallest by hash in some window of `length` bytes of their document, and the hashes.

    room: bytes from each position to its document's end. What a window picks depends on its bytes alone, so that equal windows
    of two documents always share an anchor.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = prefix_hashes(data)
    _, inverse = _power_tables(len(data) + 1)
    h = _mixed((p[k:] - p[:-k]) * inverse[: len(p) - k])
    wide = length - k + 1
    low = _slide(h, wide, np.minimum)
    low[room[: len(low)] < length] = 0
    high = _slide(np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)]), wide, np.maximum)
    at = np.flatnonzero((h == high[: len(h)]) & (room[: len(h)] >= k))
    return at, h[at]


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows, as lists of columns, of about FLUSH bytes of text (the last column) at a time."""
    held: list[tuple] = []
    size = 0
    for batch in rows_at_a_time(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= FLUSH:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]
        held = []
    give_back()


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def _spread(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(doc.view(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A row for each anchor or range; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


#: An anchor and its place; without a hash, a place already known to be shared, and its document's bucket.
FOUND = pa.schema([("bucket", pa.int32()), ("hash", pa.int64()), ("doc", pa.int64()), ("off", pa.int32())])
PLACES = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("off", pa.int32())])


def _find(length: int, k: int, buckets: int):
    """Anchors, a row each, whatever the number of buckets. Those that several documents of one flush share are known to be repeated: they
    travel by document as found, and only those of the smallest and largest document stand for them in the hash's bucket, so that a
    passage that very many documents share makes no bucket large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in _flushes(batches):
            lens = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum(lens)
            room = np.repeat(ends, lens) - np.arange(len(data))
            at, h = anchors(data, room, length, k)
            if not len(at):
                continue
            row = np.searchsorted(ends, at, side="right")
            doc, off = np.array(docs, np.int64)[row], (at - (ends - lens)[row]).astype(np.int32)
            order = np.lexsort((doc, h))
            h, doc, off = h[order], doc[order], off[order]
            s = _runs(h)
            size = np.diff(s)
            least, most = np.repeat(doc[s[:-1]], size), np.repeat(doc[s[1:] - 1], size)
            shared = least != most
            yield _rows(FOUND, bucket=_spread(doc[shared], buckets), doc=doc[shared], off=off[shared])
            first = np.zeros(len(h), bool)
            first[s[:-1]] = True
            first[s[1:] - 1] = True
            send = ~shared | first
            off = np.where(shared, np.int32(-1), off)
            yield _rows(FOUND, bucket=(h[send] % np.uint64(buckets)).astype(np.int32), hash=h[send].view(np.int64), doc=doc[send], off=off[send])

    return run


def _numbers(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _repeated(buckets: int):
    """Places of the anchors that at least two documents have."""

    def run(group: pa.Table) -> pa.Table:
        known, rest = group.filter(group.column("hash").is_null()), group.filter(group.column("hash").is_valid())
        h, doc, off = _numbers(rest, "hash", "doc", "off")
        order = np.lexsort((doc, h))
        h, doc, off = h[order], doc[order], off[order]
        s = _runs(h)
        size = np.diff(s)
        shared = (np.repeat(doc[s[:-1]], size) != np.repeat(doc[s[1:] - 1], size)) & (off >= 0) if len(h) else np.zeros(0, bool)
        more = _numbers(known, "doc", "off")
        doc, off = np.concatenate([doc[shared], more[0]]), np.concatenate([off[shared], more[1]])
        return pa.Table.from_batches([_rows(PLACES, part=_spread(doc, buckets), doc=doc, off=off)])

    return run


def _places_of(group: pa.Table) -> pa.Table:
    """A row for each document, with its places as bytes."""
    doc, off = _numbers(group, "doc", "off")
    order = np.lexsort((off, doc))
    doc, off = doc[order], off[order]
    s = _runs(doc)
    return pa.table({"doc": pa.array(doc[s[:-1]], pa.int64()), "at": pa.array([off[a:b].tobytes() for a, b in zip(s, s[1:], strict=False)], pa.binary())})


#: A repeated anchor and its surroundings, document bytes start to end; without a hash, a range that is covered, and its document's bucket.
SNIPS = pa.schema([("bucket", pa.int32()), ("hash", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("off", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.binary())])
RANGES = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _as_binary(text: np.ndarray) -> pa.Array:
    n, wide = text.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(wide)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text))])


def _as_matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Rows of bytes of a column of values of `wide` bytes."""
    parts = []
    for c in column.chunks:
        c = c.cast(pa.large_binary())
        starts = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        if len(c):
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[starts[0] : starts[-1]])
    return np.concatenate([*parts, np.zeros(0, np.uint8)]).reshape(-1, wide)


def _snippets(length: int, k: int, buckets: int):
    """The surroundings of every repeated anchor in which a window of `length` bytes may hold it, a row each.
    Of equal ones in a flush only those of the smallest document go; the others are covered, and travel as ranges by document."""
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, rows, places, texts in _flushes(batches):
            doc, row, off, left, right, text, h = [], [], [], [], [], [], []
            for d, r, at, t in zip(docs, rows, places, texts, strict=True):
                o = np.unique(np.frombuffer(at, np.int32)).astype(np.int64)
                o = o[o + k <= len(t)]
                if not len(o):
                    continue
                b = np.frombuffer(t, np.uint8)
                pad = np.concatenate([np.zeros(reach, np.uint8), b, np.zeros(reach, np.uint8)])
                snip = np.lib.stride_tricks.sliding_window_view(pad, length + reach)[o]
                text.append(snip)
                off.append(o)
                left.append(np.minimum(o, reach))
                right.append(np.minimum(len(t) - o - k, reach))
                doc.append(np.full(len(o), d, np.int64))
                row.append(np.full(len(o), r, np.int64))
            if not doc:
                continue
            doc, row, off, left, right, text = np.concatenate(doc), np.concatenate(row), np.concatenate(off).astype(np.int32), np.concatenate(left).astype(np.uint8), np.concatenate(right).astype(np.uint8), np.concatenate(text)
            p = prefix_hashes(text)
            h = _mixed((p[:, reach + k] - p[:, reach]) * _power_tables(reach + 1)[1][reach])
            covered, kept = _collapse(h, p[:, -1], doc, left, right, text)
            start, end = off - left, off + k + right
            yield _rows(SNIPS, bucket=_spread(doc[covered], buckets), doc=doc[covered], row=row[covered], start=start[covered], end=end[covered])
            yield _rows(SNIPS, bucket=(h[kept] % np.uint64(buckets)).astype(np.int32), hash=h[kept].view(np.int64), doc=doc[kept], row=row[kept], off=off[kept], start=start[kept], end=end[kept], text=_as_binary(text[kept]))

    return run


def _collapse(h: np.ndarray, whole: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal surroundings: those of a document larger than the smallest that has them (covered), and those of the smallest (kept).
    Equal by hash, then by bytes; one that only has the hash of another is kept."""
    key = _mixed(whole ^ _mixed(h) + left.astype(np.uint64) * np.uint64(257) + right.astype(np.uint64))
    order = np.lexsort((doc, key))
    s = _runs(key[order])
    size = np.diff(s)
    lead = np.repeat(order[s[:-1]], size)
    covered = np.zeros(len(h), bool)
    later = doc[order] > doc[lead]
    mine, theirs = order[later], lead[later]
    covered[mine] = (text[mine] == text[theirs]).all(1) & (left[mine] == left[theirs]) & (right[mine] == right[theirs])
    return covered, ~covered


class Suffixes:
    """Suffixes, cut at `length`, of rows of bytes: suffix i starts at byte a[i] of row r[i]. Comparisons go by common extension, which
    prefix hashes and a binary search over its length find."""

    def __init__(self, text: np.ndarray, r: np.ndarray, a: np.ndarray, length: int) -> None:
        self.text, self.r, self.a, self.length = text, r, a, length
        self.wide = text.shape[1]
        self.p = prefix_hashes(text).ravel()
        self.inverse = _power_tables(self.wide + 1)[1]
        self.at = r * (self.wide + 1) + a
        every = np.arange(len(r))
        #: Hash of all `length` bytes, and the first eight as a number: most comparisons end with one of them.
        self.whole = self.hashed(every, length)
        flat, start = text.ravel(), r * self.wide + a
        self.lead = np.zeros(len(r), np.uint64)
        for i in range(min(8, length)):
            self.lead = (self.lead << np.uint64(8)) | flat[start + i]

    def hashed(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        at = self.at[i]
        return (self.p[at + n] - self.p[at]) * self.inverse[self.a[i]]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length, np.int64)
        low[self.whole[i] == self.whole[j]] = self.length
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) // 2
            same = self.hashed(i, mid) == self.hashed(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_same: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j, or, where or_same, is equal."""
        a, b = self.lead[i], self.lead[j]
        out = np.where(self.whole[i] == self.whole[j], or_same, a < b)
        open_ = np.flatnonzero((a == b) & (self.whole[i] != self.whole[j]))
        if len(open_):
            i, j = i[open_], j[open_]
            n = np.minimum(self.extension(i, j), self.length - 1)
            flat = self.text.ravel()
            out[open_] = flat[self.r[i] * self.wide + self.a[i] + n] < flat[self.r[j] * self.wide + self.a[j] + n]
        return out

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of all suffixes within their groups (of neighbours): by eight bytes, and by the next eight where suffixes that share them
        aren't the same string by hash; by mergesort where few are left."""
        order = np.lexsort((self.lead, np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))))
        at, part, word = np.arange(len(order)), group[order], self.lead[order]
        flat, depth = self.text.ravel(), 8
        while len(at):
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])])
            s = np.append(np.flatnonzero(new), len(at))
            whole = self.whole[order[at]]
            mixed = np.repeat(np.minimum.reduceat(whole, s[:-1]) != np.maximum.reduceat(whole, s[:-1]), np.diff(s))
            at, part = at[mixed], np.cumsum(new)[mixed]
            if depth + 8 > self.length or len(at) < 1_000:
                break
            here = order[at]
            start = self.r[here] * self.wide + self.a[here] + depth
            word = np.zeros(len(at), np.uint64)
            for n in range(8):
                word = (word << np.uint64(8)) | flat[start + n]
            by = np.lexsort((word, part))
            order[at], word, part = here[by], word[by], part[by]
            depth += 8
        if len(at):
            order[at] = self.merged(order[at], part)
        return order

    def merged(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A bottom-up mergesort; each element's place in a merge is its own place in its run and its rank in the other run, found by binary
        search."""
        n = len(group)
        s = _runs(group)
        start, end = np.repeat(s[:-1], np.diff(s)), np.repeat(s[1:], np.diff(s))
        at = np.arange(n) - start
        width, most = 1, int(np.diff(s).max()) if n else 0
        while width < most:
            run = at // width
            low = np.minimum(start + (run ^ 1) * width, end)
            stop = np.minimum(low + width, end)
            base, right = low.copy(), run % 2 == 1
            live = np.flatnonzero(low < stop)
            while len(live):
                mid = (low[live] + stop[live]) // 2
                goes = self.before(order[mid], order[live], right[live])
                low[live] = np.where(goes, mid + 1, low[live])
                stop[live] = np.where(goes, stop[live], mid)
                live = live[low[live] < stop[live]]
            to = start + (run // 2) * 2 * width + at % width + (low - base)
            new = np.empty_like(order)
            new[to] = order
            order = new
            width *= 2
        return order


def shared_windows(anchor: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, a): the windows at byte a of surroundings i that a smaller document's surroundings of the same anchor hold as well.
    Rows come sorted by anchor. All suffixes are sorted within their anchor; runs of neighbours that agree in `length` bytes are the
    strings that occur more than once."""
    reach = length - k
    first = reach - left.astype(np.int64)
    spare = left.astype(np.int64) + k + right - length + 1  # windows of each
    spare = np.maximum(spare, 0)
    r = np.repeat(np.arange(len(anchor)), spare)
    a = np.repeat(first, spare) + np.arange(len(r)) - np.repeat(np.cumsum(spare) - spare, spare)
    if not len(r):
        return r, a
    suffix = Suffixes(text, r, a, length)
    order = suffix.sort(anchor[r])
    i, j = order[:-1], order[1:]
    same = (anchor[r[i]] == anchor[r[j]]) & (suffix.whole[i] == suffix.whole[j])
    view = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)
    x, y = i[same], j[same]
    if not all((view[r[x[n : n + SLICE]], a[x[n : n + SLICE]]] == view[r[y[n : n + SLICE]], a[y[n : n + SLICE]]]).all() for n in range(0, len(x), SLICE)):
        # Two strings of one hash: suffixes are sorted by the bytes themselves.
        order = np.lexsort((*view[r, a].T[::-1], anchor[r]))
        i, j = order[:-1], order[1:]
        same = (anchor[r[i]] == anchor[r[j]]) & (view[r[i], a[i]] == view[r[j], a[j]]).all(1)
    cls = np.concatenate([[0], np.cumsum(~same)])
    d = doc[r[order]]
    least = np.minimum.reduceat(d, _runs(cls)[:-1])
    out = order[d > least[cls]]
    return r[out], a[out]


def _decide(length: int, k: int, buckets: int):
    """Ranges to remove: of each surroundings, runs of bytes that its shared windows cover."""
    reach = length - k

    def run(group: pa.Table) -> pa.Table:
        known, rest = group.filter(group.column("hash").is_null()), group.filter(group.column("hash").is_valid())
        names = ["doc", "row", "start", "end"]
        out = [_numbers(known, *names)]
        if len(rest):
            h, doc, off = _numbers(rest, "hash", "doc", "off")
            row, start, end = _numbers(rest, "row", "start", "end")
            left, right = (off - start).astype(np.uint8), (end - off - k).astype(np.uint8)
            text = _as_matrix(rest.column("text"), length + reach)
            covered, kept = _collapse(h.view(np.uint64), prefix_hashes(text)[:, -1], doc, left, right, text)
            out.append([c[covered] for c in (doc, row, start, end)])
            i = np.flatnonzero(kept)
            i = i[np.argsort(h[i], kind="stable")]
            s = _runs(h[i])
            several = np.repeat(np.minimum.reduceat(doc[i], s[:-1]) != np.maximum.reduceat(doc[i], s[:-1]), np.diff(s))
            i = i[several]
            s = _runs(h[i])
            for i in np.split(i, s[1:-1][np.diff(s[1:] // SLICE) > 0]) if len(i) else []:
                r, a = shared_windows(h[i], doc[i], left[i], right[i], text[i], length, k)
                order = np.lexsort((a, r))
                r, a = r[order], a[order]
                # Windows that follow one another, or touch, make one range.
                s = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (a[1:] - a[:-1] > length)) + 1]) if len(r) else np.zeros(0, np.int64)
                last = np.append(s[1:], len(r)) - 1 if len(r) else s
                r, a, z = i[r[s]], a[s], a[last]
                out.append([doc[r], row[r], off[r] - reach + a, off[r] - reach + z + length])
        columns = dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True))
        wide = columns["end"] - columns["start"] >= length
        columns = {n: c[wide] for n, c in columns.items()}
        give_back()
        return pa.Table.from_batches([_rows(RANGES, part=_spread(columns["doc"], buckets), **columns)])

    return run


def _ranges_of(group: pa.Table) -> pa.Table:
    """A row for each document and text, with its ranges, united, as bytes."""
    doc, row, start, end = _numbers(group, "doc", "row", "start", "end")
    order = np.lexsort((start, row, doc))
    doc, row, at = doc[order], row[order], np.stack([start, end], 1)[order]
    s = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) + 1, [len(doc)]])
    united = [merged(at[x:y]).astype(np.int32).tobytes() for x, y in zip(s, s[1:], strict=False)]
    return pa.table({"doc": pa.array(doc[s[:-1]], pa.int64()), "row": pa.array(row[s[:-1]], pa.int64()), "at": pa.array(united, pa.binary())})


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (start, end), in any order, united where they overlap or touch."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    s = np.flatnonzero(new)
    return np.stack([ranges[s, 0], np.concatenate([reach[s[1:] - 1], reach[-1:]])], 1)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_at_a_time(batches):
        spans, kept = [], []
        for at, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            # Empty bytes stand for the whole text.
            r = np.array([[0, len(text)]]) if at == b"" else np.frombuffer(at or b"", np.int32).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(b)} for a, b in r])
            edges = [0, *r.ravel().tolist(), len(text)]
            kept.append(b"".join(text[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in batch.column(2).to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def substring_dedup(docs: DataFrame, length: int = 50, k: int = 24, bucket_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary) of every row of docs.

    Each byte goes that a string of `length` bytes covers which also starts in a document of a smaller id; all is judged on the input.
    Texts are UTF-8 bytes, null and empty ones have none. A null id counts as larger than any other, equal ids as no smaller than each
    other. Matches don't cross documents. Columns other than the two named aren't read.

    Of equal texts only the smallest document's is looked at: the others are covered whole. Then:
    1. Of every window the smallest k-gram by hash is an anchor, a row each. They meet by hash bucket, and those of several documents are found.
    2. Around these, the surroundings of up to length - k bytes on each side are gathered by anchor. Equal ones collapse: all but the smallest
       document's are covered whole. Where the surroundings of one anchor differ, all suffixes that start in them are sorted (eight bytes at a
       time, then by hash-compared mergesort), neighbours verified by their bytes, and each run of equal `length`-byte prefixes is covered but for its smallest document.
    3. Ranges meet their text again and are cut out.
    Buckets grow in number with the text, not in size, and rows sent don't depend on their number; what many documents share is collapsed
    before it is sent.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    at = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    total = at.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))
    sums = at.where(F.octet_length("text") >= length).select("doc", "row", F.unhex(F.sha2("text", 256)).alias("sha"))
    least = salted_totals(sums, ["sha"], F.struct("doc", "row"), {"first": F.min("doc")}, {"first": F.min("first")})
    copies = cut(least.where("doc > first").select(F.col("doc").alias("__doc"), F.col("row").alias("__row")).distinct(), "copies")
    copies = bounded(copies.withColumn("copy", F.lit(True)), copies.count(), 32)
    long = at.where(F.octet_length("text") >= length).join(copies, (F.col("doc") == F.col("__doc")) & (F.col("row") == F.col("__row")), "left").drop("__doc", "__row")
    whole = long.where("copy").select("id", F.lit(b"").alias("at"), "text")
    long = long.where("copy is null").drop("copy")

    found = long.select("doc", "text").mapInArrow(_find(length, k, buckets), from_arrow_schema(FOUND))
    places = found.groupBy("bucket").applyInArrow(_repeated(buckets), from_arrow_schema(PLACES))
    places = places.groupBy("part").applyInArrow(_places_of, "doc bigint, at binary")
    places = cut(places, "places").withColumnRenamed("doc", "of")
    near = long.join(places, long.doc == places.of).select("doc", "row", "at", "text")
    snips = near.mapInArrow(_snippets(length, k, buckets), from_arrow_schema(SNIPS))
    ranges = snips.groupBy("bucket").applyInArrow(_decide(length, k, buckets), from_arrow_schema(RANGES))
    ranges = ranges.groupBy("part").applyInArrow(_ranges_of, "doc bigint, row bigint, at binary")
    ranges = cut(ranges, "ranges").select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "at")
    both = long.join(ranges, (long.doc == ranges.of) & (long.row == ranges.of_row), "left").select("id", "at", "text")
    short = at.where(F.octet_length("text") < length).select("id", F.lit(None).cast("binary").alias("at"), "text")
    return both.unionByName(whole).unionByName(short).mapInArrow(_apply, f"id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary").withColumnRenamed("id", id_col)
