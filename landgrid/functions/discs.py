"""How much lies within discs on the sphere, without looking at each pair: points are sorted by strips of latitude and, in a strip, by
longitude, so that all but the points near a disc's rim are counted by binary search."""

from __future__ import annotations

import numpy as np

from landgrid.functions.geo import EARTH_M

#: Sort keys of neighbouring strips are so many degrees apart, more than longitudes differ by.
APART = 1024.0
#: Longitudes are compared so many degrees (a millimetre) off, as sort keys are rounded; what lies between is measured.
SLACK = 1e-8
#: Elements of the arrays that are worked on at once.
AT_ONCE = 1 << 20


def haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres between points in degrees, by the same formula as functions.geo.haversine."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places as three coordinates on the unit sphere."""
    y, x = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def _half_widths(lat: np.ndarray, at: np.ndarray, angle: float) -> np.ndarray:
    """How far in longitude a disc around lat of that angle reaches at the latitude at: degrees, negative where it doesn't reach."""
    left = np.sin(angle / 2) ** 2 - np.sin(np.radians(at - lat) / 2) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = left / np.maximum(np.cos(np.radians(lat)) * np.cos(np.radians(at)), 1e-300)
    return np.where(left < 0, -1.0, np.degrees(2 * np.arcsin(np.sqrt(np.clip(ratio, 0.0, 1.0)))))


class Strips:
    """Points with weights (None: each counts 1), sorted for discs of a radius."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, weight: np.ndarray | None, radius_m: float) -> None:
        self.radius, self.angle = radius_m, radius_m / EARTH_M
        reach = np.degrees(self.angle)
        self.middle = float(lon[0])
        turned = (lon - self.middle + 180.0) % 360.0 - 180.0
        # Strips as high as leaves about as many points near the rim as there are strips to search.
        wide = max(np.ptp(turned) * np.cos(np.radians(min(89.0, np.abs(lat).max()))), reach)
        density = len(lat) / (max(np.ptp(lat), reach) * wide)
        self.high = float(np.clip(3.0 / np.sqrt(density), reach / 512, reach))
        self.low = float(lat.min())
        strip = np.floor((lat - self.low) / self.high)
        key = strip * APART + turned
        order = np.argsort(key, kind="stable")
        self.key, self.lat, self.lon = key[order], lat[order], lon[order]
        self.place = _on_sphere(self.lat, self.lon)
        # Sums in extended precision: differences of them are as good as sums of the differences.
        self.weight = None if weight is None else weight[order]
        self.sums = None if weight is None else np.concatenate([np.zeros(1, np.longdouble), np.cumsum(self.weight.astype(np.longdouble))])

    def totals(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Weight of the points nearer than the radius to each place."""
        out = np.zeros(len(lat), np.int64 if self.weight is None else np.float64)
        reach = np.degrees(self.angle) * (1 + 1e-9) + SLACK
        order = np.lexsort((lon, np.floor(lat / self.high)))
        strips = int(2 * reach / self.high) + 2
        size = max(1, AT_ONCE // strips)
        for i in range(0, len(lat), size):
            at = order[i : i + size]
            out[at] = self._block(lat[at], lon[at], reach, strips)
        return out

    def _near(self, lat: np.ndarray, lon: np.ndarray, place: np.ndarray, o: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether points p are nearer than the radius to places o: by chords, and by the formula where rounding could decide."""
        chord2 = sum((a[o] - b[p]) ** 2 for a, b in zip(place, self.place, strict=True))
        limit = 4 * np.sin(self.angle / 2) ** 2
        near = chord2 < limit
        unsure = np.flatnonzero(np.abs(chord2 - limit) < 1e-11 * limit + 4e-15 * np.sqrt(limit))
        near[unsure] = haversine(lat[o[unsure]], lon[o[unsure]], self.lat[p[unsure]], self.lon[p[unsure]]) < self.radius
        return near

    def _block(self, lat: np.ndarray, lon: np.ndarray, reach: float, strips: int) -> np.ndarray:
        first = np.floor((lat - reach - self.low) / self.high)
        strip = first + np.arange(strips)[:, None]
        edge = self.low + (first + np.arange(strips + 1)[:, None]) * self.high
        width = _half_widths(lat, edge, self.angle)
        south, north = width[:-1], width[1:]
        inner = np.where((south < 0) | (north < 0), -1.0, np.minimum(south, north) - SLACK)
        with np.errstate(invalid="ignore"):
            # The disc is widest at some latitude, and all round where it holds a pole.
            widest = np.degrees(np.arcsin(np.clip(np.sin(np.radians(lat)) / np.cos(self.angle), -1.0, 1.0)))
        polar = np.abs(lat) + np.degrees(self.angle) >= 90.0
        most = np.where(polar, 180.0, np.degrees(np.arcsin(np.clip(np.sin(self.angle) / np.maximum(np.cos(np.radians(lat)), 1e-300), 0.0, 1.0))))
        peak = polar | ((edge[:-1] <= widest + SLACK) & (edge[1:] >= widest - SLACK))
        # A strip that the disc's top or bottom lies in is reached by less than the widest.
        tip = (south < 0) & (north < 0) & (edge[:-1] <= lat) & (edge[1:] >= lat)
        outer = np.where(peak | tip, most, np.maximum(south, north)) + SLACK
        outer = np.where(peak | tip | (south >= 0) | (north >= 0), outer, -1.0)
        turned = (lon - self.middle + 180.0) % 360.0 - 180.0
        out, place = np.zeros(len(lat), np.int64 if self.weight is None else np.longdouble), _on_sphere(lat, lon)
        for turn in (0.0, 360.0, -360.0):  # a disc may reach across the meridian opposite the points' middle
            here = turned + turn
            reached = outer >= 0
            if turn:
                reached &= np.abs(here) - outer < 180.0
            if not reached.any():
                continue
            base = strip * APART + here
            k, j = np.nonzero(reached)
            b, w, v = base[k, j], outer[k, j], inner[k, j]
            start, stop = np.searchsorted(self.key, b - w, "left"), np.searchsorted(self.key, b + w, "right")
            none = (v < 0) | (stop <= start)
            from_ = np.where(none, stop, np.searchsorted(self.key, b - v, "left"))
            to = np.where(none, stop, np.searchsorted(self.key, b + v, "right"))
            to = np.maximum(from_, to)
            whole = to - from_ if self.weight is None else self.sums[to] - self.sums[from_]
            np.add.at(out, j, whole)
            for x, y in ((start, from_), (to, stop)):
                n = np.maximum(y - x, 0)
                ends = np.cumsum(n)
                done = 0
                while done < len(n):  # in pieces, as a rim may hold very many points
                    before = ends[done - 1] if done else 0
                    until = max(done + 1, int(np.searchsorted(ends, before + 4 * AT_ONCE, "right")))
                    m, o = n[done:until], j[done:until]
                    p = np.arange(m.sum()) + np.repeat(x[done:until] - (np.cumsum(m) - m), m)
                    o = np.repeat(o, m)
                    near = self._near(lat, lon, place, o, p)
                    if self.weight is None:
                        out += np.bincount(o[near], minlength=len(out))
                    else:
                        out += np.bincount(o[near], self.weight[p[near]], minlength=len(out))
                    done = until
        return out
