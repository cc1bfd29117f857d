"""Boolean operations on polygons.

All edges are split where they meet, so that the pieces share end points only. For every piece the
polygons on either side follow from the parity of the pieces beyond it, counted along an axis; a
piece stays where the wanted region lies on one side alone. The pieces that stay are walked
with the region to their left, walks are split where they return to a point, and holes go to the
smallest shell around them. Rings start at their least vertex; shells run clockwise, holes the other way.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np

EPS = 1e-11  # of the greatest coordinate: points nearer than this are one


class _Points:
    """Points that are one if nearer than ``eps``: the first one seen stands for all."""

    def __init__(self, eps: float):
        self.eps, self.cells = eps, defaultdict(list)

    def one(self, p) -> tuple:
        p = tuple(p)
        x, y = (math.floor(v / (2 * self.eps)) for v in p)
        for i in (x - 1, x, x + 1):
            for j in (y - 1, y, y + 1):
                for q in self.cells.get((i, j), ()):
                    if math.dist(p, q) <= self.eps:
                        return q
        self.cells[x, y].append(p)
        return p


def _cuts(a: np.ndarray, b: np.ndarray, points: _Points) -> list[list[tuple]]:
    """For each segment, the points at which others meet it, its ends included."""
    eps = points.eps
    out = [[tuple(p), tuple(q)] for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    d = b - a
    low, high = np.minimum(a, b) - eps, np.maximum(a, b) + eps
    for i in range(len(a)):
        near = np.flatnonzero((low[i + 1 :] <= high[i]).all(1) & (high[i + 1 :] >= low[i]).all(1)) + i + 1
        for j in near.tolist():
            den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
            ends = [(k, p) for k, p in ((i, out[j][0]), (i, out[j][1]), (j, out[i][0]), (j, out[i][1])) if _touches(p, out[k][0], out[k][1], eps)]
            for k, p in ends:
                out[k].append(p)
            if ends or not den:
                continue
            r = a[j] - a[i]
            s, t = (r[0] * d[j, 1] - r[1] * d[j, 0]) / den, (r[0] * d[i, 1] - r[1] * d[i, 0]) / den
            if 0 < s < 1 and 0 < t < 1:
                p = points.one((a[i] + s * d[i]).tolist())
                out[i].append(p)
                out[j].append(p)
    return out


def _touches(p, a, b, eps: float) -> bool:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = math.hypot(dx, dy)
    along = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n
    return -eps <= along <= n + eps and abs(dx * (p[1] - a[1]) - dy * (p[0] - a[0])) / n <= eps


def _pieces(polygons: list) -> dict[tuple, np.ndarray]:
    """(lesser end, greater end) -> how often each polygon has this piece."""
    corners = [p for rings in polygons for ring in rings for p in ring]
    if not corners:
        return {}
    points = _Points(EPS * max(1e-290, *np.abs(corners).max(axis=0).tolist()))
    rings = [(k, list(map(points.one, ring))) for k, rings in enumerate(polygons) for ring in rings]
    rows = [(k, p, q) for k, ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if p != q]
    if not rows:
        return {}
    a, b = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    out: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(len(polygons), np.int64))
    for (k, p, q), met in zip(rows, _cuts(a, b, points), strict=True):
        axis = 0 if abs(q[0] - p[0]) >= abs(q[1] - p[1]) else 1
        met = sorted(set(met), key=lambda x: x[axis])
        for s, t in zip(met, met[1:], strict=False):
            out[min(s, t), max(s, t)][k] += 1
    return out


def _bounds(pieces: dict[tuple, np.ndarray], keep: Callable[[np.ndarray], bool]) -> list[tuple]:
    """The directed pieces with the wanted region on their left and not on their right."""
    ends = list(pieces)
    count = np.array([pieces[e] for e in ends])
    low, high = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    out = []
    for i, (p, q) in enumerate(ends):
        axis = 0 if abs(q[0] - p[0]) >= abs(q[1] - p[1]) else 1  # looking along the other axis
        at, level = (p[axis] + q[axis]) / 2, (p[1 - axis] + q[1 - axis]) / 2
        u, v = low[:, axis], high[:, axis]
        over = np.flatnonzero((u <= at) != (v <= at))
        over = over[over != i]
        w = (at - u[over]) / (v[over] - u[over])
        above = over[low[over, 1 - axis] + w * (high[over, 1 - axis] - low[over, 1 - axis]) > level]
        far = count[above].sum(0) % 2
        near = (far + count[i]) % 2
        a, b = keep(far.astype(bool)), keep(near.astype(bool))
        if a != b:
            # the far side is left of a piece that runs to greater x, and right of one that runs to greater y
            forward = (p[axis] < q[axis]) == (axis == 0)
            out.append((p, q) if forward == a else (q, p))
    return out


def _walks(edges: list[tuple]) -> list[list[tuple]]:
    """Simple loops (without their closing point) of directed pieces."""
    leaving = defaultdict(list)
    for p, q in edges:
        leaving[p].append(q)
    loops = []
    for start in sorted(leaving):
        while leaving[start]:
            at, to, walk = start, leaving[start].pop(), [start]
            while to != start:
                walk.append(to)
                back = math.atan2(at[1] - to[1], at[0] - to[0])
                turn = lambda q: (back - math.atan2(q[1] - to[1], q[0] - to[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                if not leaving[to]:
                    break
                best = min(leaving[to], key=turn)
                leaving[to].remove(best)
                at, to = to, best
            held: list[tuple] = []
            for p in walk:
                if p in held:
                    k = held.index(p)
                    loops.append(held[k:])
                    held = held[:k]
                held.append(p)
            loops.append(held)
    return [x for x in loops if len(x) > 2]


def _twice_area(loop: list) -> float:
    x0, y0 = loop[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(loop, [*loop[1:], loop[0]], strict=True))


def _inside(p, loop: list) -> bool:
    inside = False
    for a, b in zip(loop, [*loop[1:], loop[0]], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _closed(loop: list, given: set) -> list:
    """The ring from its least vertex, without points that only cut a straight stretch."""
    n = len(loop)

    def needed(i: int) -> bool:
        a, p, b = loop[i - 1], loop[i], loop[(i + 1) % n]
        return p in given or not _touches(p, a, b, 1e-9 * math.dist(a, b))

    ring = [p for i, p in enumerate(loop) if needed(i)]
    k = ring.index(min(ring))
    return [*ring[k:], *ring[:k], ring[k]]


def overlay(polygons: list, keep: Callable[[np.ndarray], bool]) -> tuple[int, list]:
    """The multipolygon of all points for which ``keep`` holds of the polygons (lists of rings, even-odd) that contain them."""
    pieces = _pieces(polygons)
    if not pieces:
        return 6, []
    given = {tuple(p) for rings in polygons for ring in rings for p in ring}
    loops = [(_twice_area(x), x) for x in _walks(_bounds(pieces, keep))]
    shells = sorted(((a, x) for a, x in loops if a > 0), key=lambda s: s[0])
    made = [[_closed(x[::-1], given)] for _, x in shells]
    for a, x in loops:
        if a < 0:
            spots = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(x, [*x[1:], x[0]], strict=True)]
            home = next((i for i, (size, shell) in enumerate(shells) if size > -a and sum(_inside(p, shell) for p in spots) * 2 > len(spots)), None)
            if home is not None:
                made[home].append(_closed(x[::-1], given))
    return 6, sorted([m[0], *sorted(m[1:])] for m in made)


def _polygons(g) -> list:
    return [g[1]] if g[0] == 3 and g[1] else list(g[1]) if g[0] == 6 else []


def union(gs: list) -> tuple[int, list]:
    """The union of all polygonal parts; other kinds add nothing."""
    return overlay([p for g in gs for p in _polygons(g)], lambda held: bool(held.any()))


def intersection(a, b) -> tuple[int, list]:
    """The polygonal part of the intersection."""
    n = len(_polygons(a))
    return overlay(_polygons(a) + _polygons(b), lambda held: bool(held[:n].any() and held[n:].any()))


def make_valid(g):
    """Polygons by the even-odd rule of their rings, as a multipolygon; other kinds as they are."""
    return union([g]) if g[0] in (3, 6) else g


def _at(reason: str, p) -> str:
    return f"{reason}[" + " ".join(f"{v:.15g}" for v in p) + "]"


def _nodes(pieces: dict) -> set:
    return {p for e in pieces for p in e}


def invalid(g) -> str | None:
    """Why polygons are not valid, and a point where they are not; None for valid ones and other kinds."""
    polygons = _polygons(g)
    for ring in (r for rings in polygons for r in rings):
        if bad := [p for p in ring if not all(map(math.isfinite, p))]:
            return _at("Invalid Coordinate", bad[0])
        if len(ring) < 4 or tuple(ring[0]) != tuple(ring[-1]):
            return _at("Too few points in geometry component" if len(ring) < 4 else "Ring is not closed", ring[0] if ring else ())
        pieces = _pieces([[ring[:-1]]])
        if met := _nodes(pieces) - set(map(tuple, ring)):
            return _at("Self-intersection", min(met))
        if twice := [e for e, n in pieces.items() if n.max() > 1]:
            return _at("Self-intersection", min(twice)[0])
        ends = [p for e in pieces for p in e]
        if crowded := [p for p in set(ends) if ends.count(p) > 2]:
            return _at("Ring Self-intersection", min(crowded))
    for rings in polygons:
        whole = _pieces([[r] for r in rings])
        given = {tuple(p) for r in rings for p in r}
        for p in _nodes(whole) - given:  # where rings cross, or one's corner touches the other's side
            return _at("Self-intersection", p)
        if shared := [e for e, n in whole.items() if n.sum() > 1]:
            return _at("Self-intersection", min(shared)[0])
        for hole in rings[1:]:
            p, q = hole[0], hole[1]
            if not _inside(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), rings[0][:-1]):
                return _at("Hole lies outside shell", hole[0])
    for i, a in enumerate(polygons):
        for b in polygons[i + 1 :]:
            if intersection((3, a), (3, b))[1]:
                both = _pieces([a, b])
                met = _nodes(both) - {tuple(p) for r in (*a, *b) for p in r} or {p for e, n in both.items() if n.all() for p in e}
                return _at("Self-intersection", min(met)) if met else _at("Nested shells", min(a[0], b[0])[0])
    return None
