"""Line simplification that keeps rings valid.

The one recursive operator: Douglas and Peucker's splitting on Arrow batches. Geometries of
few edges are split together, one level of all their shortcuts at a time; larger ones
one by one, with a grid of their edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoremap.functions import geometry as G

#: Geometries of at most TOGETHER edges are simplified in one go, as many as have
#: PAIRS pairs of edges.
TOGETHER, PAIRS = 64, 1 << 20


def _crossing(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the segments pq and ab properly cross."""
    side = lambda o, d, v: d[..., 0] * (v[..., 1] - o[..., 1]) - d[..., 1] * (v[..., 0] - o[..., 0])
    d = q - p
    s1, s2 = side(p, d, a), side(p, d, b)
    e = b - a
    s3, s4 = side(a, e, p), side(a, e, q)
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def _crosses(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the segment pq properly crosses any of the segments ab."""
    return bool(_crossing(p, q, a, b).any())


class EdgeGrid:
    """The edges of all rings of a geometry by the cells of their bounding boxes. An edge
    uses the level whose cells its box fits in, so it lies in four at most; a shortcut
    is held against the edges of the cells that its own box touches."""

    def __init__(self, rings: list[np.ndarray]):
        self.base = np.append(0, np.cumsum([max(len(r) - 1, 0) for r in rings]))
        ends = [(r[:-1], r[1:]) for r in rings if len(r) > 1]
        self.a, self.b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros((0, 2)) for k in (0, 1))
        low, high = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        n = len(self.a)
        self.origin = low.min(axis=0) if n else np.zeros(2)
        side = (high - low).max(axis=1)
        extent = float((high - self.origin).max()) if n else 0.0
        self.unit = max(extent / max(np.sqrt(n), 1.0), extent * 2.0**-40) or 1.0
        level = np.ceil(np.log2(np.maximum(side / self.unit, 1.0))).astype(int)
        self.levels = []
        for k in np.unique(level).tolist():
            mine, cell = np.flatnonzero(level == k), self.unit * 2.0**k
            c0, c1 = (np.floor((v[mine] - self.origin) / cell).astype(np.int64) for v in (low, high))
            which, x, y = [], [], []
            for dx in (0, 1):
                for dy in (0, 1):  # the box of an edge touches two columns and rows at most
                    ok = (c0[:, 0] + dx <= c1[:, 0]) & (c0[:, 1] + dy <= c1[:, 1])
                    which.append(mine[ok])
                    x.append(c0[ok, 0] + dx)
                    y.append(c0[ok, 1] + dy)
            which, x, y = (np.concatenate(v) for v in (which, x, y))
            width = int(x.max()) + 1
            key = y * width + x
            order = np.argsort(key, kind="stable")
            self.levels.append((cell, width, int(y.max()) + 1, key[order], which[order]))

    def near(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Numbers of the edges in the cells that the box of pq touches."""
        low, high, found = np.minimum(p, q) - self.origin, np.maximum(p, q) - self.origin, []
        for cell, width, height, keys, edges in self.levels:
            x0, x1 = max(int(low[0] // cell), 0), min(int(high[0] // cell), width - 1)
            y0, y1 = max(int(low[1] // cell), 0), min(int(high[1] // cell), height - 1)
            if x1 < x0 or y1 < y0:
                continue
            if (y1 - y0 + 1) * 8 > len(keys):  # nearly all of it
                found.append(edges)
                continue
            rows = np.arange(y0, y1 + 1, dtype=np.int64) * width
            first, last = np.searchsorted(keys, rows + x0), np.searchsorted(keys, rows + x1, side="right")
            found += [edges[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True) if j > i]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def crossed(self, p: np.ndarray, q: np.ndarray, skip: tuple[int, int]) -> bool:
        """Whether pq properly crosses an edge that is not numbered from skip[0] to
        skip[1] - 1."""
        e = self.near(p, q)
        e = e[(e < skip[0]) | (e >= skip[1])]
        return len(e) > 0 and _crosses(p, q, self.a[e], self.b[e])


def _farthest(v: np.ndarray, i: int, j: int) -> tuple[int, float]:
    """The vertex between i and j farthest from their segment."""
    d, w = v[j] - v[i], v[i + 1 : j] - v[i]
    length = float((d * d).sum())
    t = np.clip((w * d).sum(axis=1) / length, 0, 1) if length else np.zeros(len(w))
    far = ((w - t[:, None] * d) ** 2).sum(axis=1)
    k = int(far.argmax())
    return i + 1 + k, float(np.sqrt(far[k]))


def simplify_ring(ring: np.ndarray, tolerance: float, grid: EdgeGrid, first: int = 0) -> np.ndarray:
    """A closed subset of the ring's vertices, at least four of them, within the
    tolerance. A shortcut that would cross another edge of the geometry, whose edges
    are in ``grid``, the ring's from number ``first`` on, is split."""
    return ring[_kept(ring, tolerance, grid, first)]


def _kept(ring: np.ndarray, tolerance: float, grid: EdgeGrid, first: int) -> np.ndarray:
    """Which vertices ``simplify_ring`` keeps."""
    n = len(ring)
    if n <= 4 or tolerance <= 0:
        return np.ones(n, bool)
    half = int(((ring[:-1] - ring[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    if 0 < half < n - 1:
        keep[half] = True
        stack = [(0, half), (half, n - 1)]
    else:
        stack = [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        k, far = _farthest(ring, i, j)
        if far > tolerance or grid.crossed(ring[i], ring[j], (first + i, first + j)):
            keep[k] = True
            stack += [(i, k), (k, j)]
    if keep.sum() < 4:  # the farthest vertices on either side of the chord stay too
        for i, j in ((0, half), (half, n - 1)):
            if keep.sum() < 4 and j - i > 1:
                keep[_farthest(ring, i, j)[0]] = True
    return keep if keep.sum() >= 4 else np.ones(n, bool)


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1 ... of each run behind each other, and whose they are."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(first - np.cumsum(count) + count, count)


def _first_largest(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The place of the first largest value of each owner; each of the n has some."""
    most = np.maximum.reduceat(value, np.searchsorted(owner, np.arange(n)))
    hit = np.flatnonzero(value == most[owner])
    return hit[np.searchsorted(owner[hit], np.arange(n))]


def _farthest_each(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_farthest`` for many segments; each has a vertex between its ends."""
    owner, k = _runs(i + 1, j - i - 1)
    d, w = (v[j] - v[i])[owner], v[k] - v[i][owner]
    length = (d * d).sum(axis=1)
    t = np.clip(np.divide((w * d).sum(axis=1), length, out=np.zeros(len(k)), where=length > 0), 0, 1)
    far = ((w - t[:, None] * d) ** 2).sum(axis=1)
    at = _first_largest(owner, far, len(i))
    return k[at], np.sqrt(far[at])


def _kept_together(v: np.ndarray, start: np.ndarray, size: np.ndarray, edges: np.ndarray, first: np.ndarray, count: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay in the rings that begin at ``start`` and have ``size`` > 4
    vertices: what ``simplify_ring`` keeps. ``edges`` are the first vertices of edges;
    ``count`` of them from number ``first`` on are those of a ring's geometry."""
    keep, end, n = np.zeros(len(v), bool), start + size - 1, len(start)
    owner, k = _runs(start, size - 1)
    half = k[_first_largest(owner, ((v[k] - v[start][owner]) ** 2).sum(axis=1), n)]
    keep[start] = keep[half] = keep[end] = True
    r, i, j = np.tile(np.arange(n), 2), np.append(start, half), np.append(half, end)
    while (wide := j - i > 1).any():
        r, i, j = r[wide], i[wide], j[wide]
        k, far = _farthest_each(v, i, j)
        split = far > tolerance
        near = np.flatnonzero(~split)
        owner, e = _runs(first[r[near]], count[r[near]])
        owner, e = near[owner], edges[e]
        other = (e < i[owner]) | (e >= j[owner])
        owner, e = owner[other], e[other]
        split[owner[_crossing(v[i[owner]], v[j[owner]], v[e], v[e + 1])]] = True
        r, i, j, k = r[split], i[split], j[split], k[split]
        keep[k] = True
        r, i, j = np.tile(r, 2), np.append(i, k), np.append(k, j)
    kept = lambda: np.add.reduceat(keep[_runs(start, size)[1]].astype(int), np.cumsum(size) - size)
    for i, j in ((start, half), (half, end)):  # the farthest vertices on either side of the chord stay too
        few = (kept() < 4) & (j - i > 1)
        if few.any():
            keep[_farthest_each(v, i[few], j[few])[0]] = True
    few = kept() < 4
    keep[_runs(start[few], size[few])[1]] = True
    return keep


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int32)


def simplify_polys(polys: pa.Array, tolerance: float) -> pa.Array:
    """The same for geometry -> polygon -> ring -> vertex lists, on one array of
    coordinates; null stays null. Other rings of a geometry are not crossed."""
    parts = polys.flatten()
    rings = parts.flatten()
    vertices = rings.flatten()
    xy = np.column_stack([vertices.field("x").to_numpy(), vertices.field("y").to_numpy()]).reshape(-1, 2)
    sizes = [x.value_lengths().fill_null(0).to_numpy() for x in (polys, parts, rings)]
    of_part, of_ring, of_vertex = (_offsets(n) for n in sizes)
    keep = np.ones(len(xy), bool)
    if tolerance > 0 and len(xy):
        ring_of = of_ring[of_part]  # of a geometry: its first ring, and the next one's
        is_edge = np.ones(len(xy), bool)
        is_edge[of_vertex[1:][sizes[2] > 0] - 1] = False
        before = np.append(0, np.cumsum(is_edge))
        n_edges = np.diff(before[of_vertex[ring_of]])
        odd = np.append(0, np.cumsum(~np.isfinite(xy).all(axis=1)))
        small = (n_edges <= TOGETHER) & (np.diff(odd[of_vertex[ring_of]]) == 0)
        for g in np.flatnonzero(~small).tolist():
            mine = [xy[of_vertex[k] : of_vertex[k + 1]] for k in range(ring_of[g], ring_of[g + 1])]
            grid = EdgeGrid(mine) if any(len(r) > 4 for r in mine) else None
            for i, ring in enumerate(mine if grid else []):
                at = of_vertex[ring_of[g] + i]
                keep[at : at + len(ring)] = _kept(ring, tolerance, grid, int(grid.base[i]))
        geometry = np.repeat(np.arange(len(small)), np.diff(ring_of))
        rings_at = np.flatnonzero(small[geometry] & (sizes[2] > 4))
        edges, start = np.flatnonzero(is_edge), of_vertex[:-1].astype(np.int64)
        work = np.cumsum(sizes[2][rings_at].astype(np.int64) * n_edges[geometry[rings_at]]) // PAIRS
        for some in np.split(rings_at, np.flatnonzero(np.diff(work)) + 1) if len(rings_at) else []:
            g = geometry[some]
            base = of_vertex[ring_of[g[0]]]  # edges of their geometries may lie before and behind
            top = of_vertex[ring_of[g[-1] + 1]]
            found = _kept_together(xy[base:top], start[some] - base, sizes[2][some], edges[before[base] : before[top]] - base, before[of_vertex[ring_of[g]]] - before[base], n_edges[g], tolerance)
            at = _runs(start[some], sizes[2][some])[1]
            keep[at] = found[at - base]
    flat, count = xy[keep], np.append(0, np.cumsum(keep))
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(count[of_vertex].astype(np.int32)), points)
    return pa.ListArray.from_arrays(pa.array(of_part), pa.ListArray.from_arrays(pa.array(of_ring), lists), mask=polys.is_null())


def simplify(geometry: Column, tolerance: float) -> Column:
    """Geometries are taken one by one, so shared borders may part."""

    @F.arrow_udf(G.POLYS)
    def run(polys: pa.Array) -> pa.Array:
        return simplify_polys(polys, tolerance)

    return F.when(geometry.isNotNull(), G.geom(geometry["type"], geometry["srid"], run(geometry["polys"])))
