"""Areas as edges: a polygon is the set of its edges that aren't horizontal, and what is inside has an odd number of them to its left.
Clipping moves edges onto the border of a box, unions are swept slab by slab, and discs are measured as sums over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Edges (x1, y1, x2, y2) swept at once; boxes with more are quartered, so many times at most.
MOST_SWEPT, DEEPEST = 512, 10
#: Pairs of places and edges looked at at once.
AT_ONCE = 1 << 18
#: Slabs of a disc: it is a polygon of twice as many corners.
SLABS = 16

Box = tuple[float, float, float, float]


def upward(edges: np.ndarray) -> np.ndarray:
    """Edges that aren't horizontal, each from its lower end to its upper one."""
    e = edges[edges[:, 1] != edges[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def clip(e: np.ndarray, owner: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray]:
    """The parts of polygons (upward edges, and whose they are) in a box: edges beyond a side are moved onto it, where those of one polygon
    cancel in pairs."""
    x0, y0, x1, y1 = box
    near = (e[:, 1] < y1) & (e[:, 3] > y0)
    e, owner = _cut_y(e[near], y0, y1), owner[near]
    for side, beyond in ((x0, np.less), (x1, np.greater)):
        over1, over2 = beyond(e[:, 0], side), beyond(e[:, 2], side)
        cross, both, none = over1 != over2, over1 & over2, ~(over1 | over2)
        if none.all():
            continue
        part = e[cross]
        at = part[:, 1] + (side - part[:, 0]) * (part[:, 3] - part[:, 1]) / (part[:, 2] - part[:, 0])
        at = np.clip(at, part[:, 1], part[:, 3])
        low, up = np.stack([part[:, 0], part[:, 1], np.full(len(part), side), at], 1), np.stack([np.full(len(part), side), at, part[:, 2], part[:, 3]], 1)
        out1 = over1[cross][:, None]
        inner, outer = np.where(out1, up, low), np.where(out1, low, up)
        ends, whose = np.concatenate([e[both][:, [1, 3]], outer[:, [1, 3]]]).ravel(), np.repeat(np.concatenate([owner[both], owner[cross]]), 2)
        order = np.lexsort((ends, whose))
        ends, whose = ends[order].reshape(-1, 2), whose[order][::2]
        left = ends[:, 0] < ends[:, 1]
        ends, whose, tall = ends[left], whose[left], inner[:, 1] < inner[:, 3]
        border = np.stack([np.full(len(ends), side), ends[:, 0], np.full(len(ends), side), ends[:, 1]], 1)
        e, owner = np.concatenate([e[none], inner[tall], border]), np.concatenate([owner[none], owner[cross][tall], whose])
    return e, owner


def _cut_y(e: np.ndarray, y0: float, y1: float) -> np.ndarray:
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    low, up = np.maximum(e[:, 1], y0), np.minimum(e[:, 3], y1)
    x = lambda y: np.where(y == e[:, 1], e[:, 0], np.where(y == e[:, 3], e[:, 2], e[:, 0] + slope * (y - e[:, 1])))
    return np.stack([x(low), low, x(up), up], 1)


def covered(e: np.ndarray, owner: np.ndarray, box: Box) -> bool:
    """Whether one of the polygons that were clipped to a box fills it."""
    x0, y0, x1, y1 = box
    tall = (e[:, 1] == y0) & (e[:, 3] == y1) & (e[:, 0] == e[:, 2])
    both = np.intersect1d(owner[tall & (e[:, 0] == x0)], owner[tall & (e[:, 0] == x1)])
    return len(both) > 0 and bool((np.bincount(owner)[both] == 2).any())


def whole(box: Box) -> np.ndarray:
    x0, y0, x1, y1 = box
    return np.array([[x0, y0, x0, y1], [x1, y0, x1, y1]])


def by_cell(e: np.ndarray, size: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, edges) of each cell of a grid that a polygon has a part in; halved again and again, so that no cell sees all edges."""
    if not len(e):
        return
    x0, x1 = np.floor([e[:, [0, 2]].min() / size, e[:, [0, 2]].max() / size]).astype(int)
    y0, y1 = np.floor([e[:, 1].min() / size, e[:, 3].max() / size]).astype(int)
    todo = [(x0, y0, x1 + 1, y1 + 1, e)]
    while todo:
        a, b, c, d, own = todo.pop()
        own, _ = clip(own, np.zeros(len(own), int), (a * size, b * size, c * size, d * size))
        if not len(own):
            continue
        if c - a == 1 and d - b == 1:
            yield a, b, own
        elif c - a >= d - b:
            todo += [(a, b, (a + c) // 2, d, own), ((a + c) // 2, b, c, d, own)]
        else:
            todo += [(a, b, c, (b + d) // 2, own), (a, (b + d) // 2, c, d, own)]


def outline(e: np.ndarray, owner: np.ndarray, box: Box, depth: int = 0) -> np.ndarray:
    """Edges of the union of polygons that were clipped to a box, with a sign: (x1, y1, x2, y2, 1 on the right of it, -1 on its left)."""
    if covered(e, owner, box):
        return np.hstack([whole(box), [[-1.0], [1.0]]])
    if len(e) <= MOST_SWEPT or depth == DEEPEST:
        return _swept(e, owner)
    x0, y0, x1, y1 = box
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    return np.concatenate([outline(*clip(e, owner, q), q, depth + 1) for q in ((x0, y0, xm, ym), (xm, y0, x1, ym), (x0, ym, xm, y1), (xm, ym, x1, y1))])


def _swept(e: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Between neighbouring heights of ends and crossings edges keep their order; what begins or ends the union there is kept, and merged
    along each edge."""
    if not len(e):
        return np.zeros((0, 5))
    _, owner = np.unique(owner, return_inverse=True)
    y = np.unique(np.concatenate([e[:, 1], e[:, 3], _crossing_heights(e)]))
    first, last = np.searchsorted(y, e[:, 1]), np.searchsorted(y, e[:, 3])
    n = last - first
    edge = np.repeat(np.arange(len(e)), n)
    slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    x = e[edge, 0] + slope[edge] * ((y[slab] + y[slab + 1]) / 2 - e[edge, 1])
    # Within a slab the edges of one polygon begin and end it in turn.
    order = np.lexsort((x, owner[edge], slab))
    key = slab[order] * (owner.max() + 1) + owner[edge[order]]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, int)
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    step = np.empty(len(key), int)
    step[order] = np.where(rank % 2 == 0, 1, -1)
    order = np.lexsort((-step, x, slab))
    depth = np.cumsum(step[order])
    begins, ends = (depth == 1) & (step[order] == 1), (depth == 0) & (step[order] == -1)
    kept = order[begins | ends]
    sign = -step[kept]
    edge, slab = edge[kept], slab[kept]
    order = np.lexsort((slab, sign, edge))
    edge, slab, sign = edge[order], slab[order], sign[order]
    new = np.concatenate([[True], (edge[1:] != edge[:-1]) | (sign[1:] != sign[:-1]) | (slab[1:] != slab[:-1] + 1)]) if len(edge) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(edge)) - 1
    i, low, up = edge[start], y[slab[start]], y[slab[end] + 1]
    return np.stack([e[i, 0] + slope[i] * (low - e[i, 1]), low, e[i, 0] + slope[i] * (up - e[i, 1]), up, sign[start]], 1)


def _crossing_heights(e: np.ndarray) -> np.ndarray:
    out, slope = [], (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    for i in range(0, len(e), 512):
        a, s = e[i : i + 512, None], slope[i : i + 512, None]
        low, up = np.maximum(a[..., 1], e[:, 1]), np.minimum(a[..., 3], e[:, 3])
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (e[:, 0] - slope * e[:, 1] - a[..., 0] + s * a[..., 1]) / (s - slope)
        out.append(y[(y > low) & (y < up)])
    return np.concatenate(out)


def inside(x: np.ndarray, y: np.ndarray, signed: np.ndarray) -> np.ndarray:
    """Whether places are in a union given by its outline."""
    out = np.zeros(len(x), bool)
    slope = (signed[:, 2] - signed[:, 0]) / (signed[:, 3] - signed[:, 1])
    size = max(1, AT_ONCE // max(1, len(signed)))
    for i in range(0, len(x), size):
        px, py = x[i : i + size, None], y[i : i + size, None]
        left = (signed[:, 1] <= py) & (signed[:, 3] > py) & (signed[:, 0] + slope * (py - signed[:, 1]) <= px)
        out[i : i + size] = (left * signed[:, 4]).sum(1) < 0
    return out


def disc_area(r: float) -> float:
    """Area of the polygon that stands for a disc."""
    return float(SLABS * r * r * np.sin(np.pi / SLABS))


def disc_areas(x: np.ndarray, y: np.ndarray, signed: np.ndarray, r: float) -> np.ndarray:
    """Area of a union (by its outline) in the disc around each place. Over a slab of the disc, of half width h, an edge at x from the middle
    counts its sign times the integral of x kept between -h and h, which is that of (|x + h| - |x - h|) / 2."""
    out = np.zeros(len(x))
    size = max(1, AT_ONCE // max(1, len(signed)))
    slope = (signed[:, 2] - signed[:, 0]) / (signed[:, 3] - signed[:, 1])
    t = np.arange(-SLABS // 2, SLABS // 2 + 1) * np.pi / SLABS
    height, half = r * np.sin(t), np.maximum(r * np.cos(t), 0.0)
    for i in range(0, len(x), size):
        px, py = x[i : i + size], y[i : i + size]
        low, up = signed[:, 1] - py[:, None], signed[:, 3] - py[:, None]
        near, edge = np.nonzero((low < r) & (up > -r))
        low, up = low[near, edge], up[near, edge]
        at, s, sign = signed[edge, 0] - px[near], slope[edge], signed[edge, 4]
        total = np.zeros(len(near))
        for k in range(SLABS):
            a, b = np.maximum(low, height[k]), np.minimum(up, height[k + 1])
            j = np.flatnonzero(b > a)
            a, b = a[j], b[j]
            grow = (half[k + 1] - half[k]) / (height[k + 1] - height[k])
            ha, hb = half[k] + grow * (a - height[k]), half[k] + grow * (b - height[k])
            xa, xb = at[j] + s[j] * (a - low[j]), at[j] + s[j] * (b - low[j])
            total[j] += (_absolute(xa + ha, xb + hb) - _absolute(xa - ha, xb - hb)) * (b - a) / 2
        out[i : i + size] = np.bincount(near, total * sign, minlength=len(px))
    return out


def _absolute(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean of |v| where v goes evenly from a to b."""
    p, q = np.abs(a), np.abs(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = (p * p + q * q) / (2 * (p + q))
    return np.where((a < 0) != (b < 0), np.where(p + q > 0, crossed, 0.0), (p + q) / 2)
