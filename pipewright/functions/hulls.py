"""Concave hulls by eroding a Delaunay triangulation from its border, and unions of lines split where they meet."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .overlay import EPS, _cuts, _Points


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(t, p) -> bool:
    """Whether p lies in the circle through the counter-clockwise triangle t."""
    rows = [(q[0] - p[0], q[1] - p[1]) for q in t]
    (ax, ay), (bx, by), (cx, cy) = rows
    a, b, c = (x * x + y * y for x, y in rows)
    return ax * (by * c - b * cy) - ay * (bx * c - b * cx) + a * (bx * cy - by * cx) > 1e-12 * max(a, b, c, 1e-300) ** 2


def triangulate(points: list[tuple]) -> list[tuple]:
    """The counter-clockwise triangles of a Delaunay triangulation, one point inserted after the other."""
    low, high = np.min(points, axis=0), np.max(points, axis=0)
    mid, size = (low + high) / 2, max(float((high - low).max()), 1e-9) * 1e4
    outer = [(mid[0] - size, mid[1] - size), (mid[0] + size, mid[1] - size), (mid[0], mid[1] + size)]
    found = {tuple(outer)}
    for p in points:
        bad = [t for t in found if _in_circle(t, p)]
        edges = {(t[i], t[(i + 1) % 3]) for t in bad for i in range(3)}
        found -= set(bad)
        for a, b in edges:
            if (b, a) not in edges and _turn(a, b, p) > 0:
                found.add((a, b, p))
    return [t for t in found if not any(q in outer for q in t)]


def concave_hull(points: list[tuple], share: float) -> list[tuple]:
    """A closed ring around the points, from its least point counter-clockwise; nothing for points on one line.

    Border edges longer than the shortest edge plus ``share`` (0 to 1) of the way to the longest open the triangle behind
    them, the longest first, as long as the border stays one simple ring.
    """
    points = sorted(set(points))
    triangles = triangulate(points) if len(points) > 2 else []
    of: dict[frozenset, set] = {}
    for t in triangles:
        for i in range(3):
            of.setdefault(frozenset((t[i], t[(i + 1) % 3])), set()).add(t)
    if not of:
        return []
    length = {e: math.dist(*e) for e in of}
    limit = min(length.values()) + share * (max(length.values()) - min(length.values()))
    border = {e for e, own in of.items() if len(own) == 1}
    on = {p for e in border for p in e}
    heap = [(-length[e], sorted(e)) for e in border]
    heapq.heapify(heap)
    while heap:
        size, ends = heapq.heappop(heap)
        if -size <= limit:
            break
        edge = frozenset(ends)
        (triangle,) = of[edge]
        (tip,) = set(triangle) - edge
        if tip in on:
            continue
        border.discard(edge)
        on.add(tip)
        for p in edge:
            side = frozenset((p, tip))
            of[side].discard(triangle)
            border.add(side)
            heapq.heappush(heap, (-length[side], sorted(side)))
    ways: dict[tuple, list] = {}
    for e in border:
        a, b = e
        ways.setdefault(a, []).append(b)
        ways.setdefault(b, []).append(a)
    first = min(ways)
    ring, before, now = [first], None, first
    while True:
        before, now = now, next(q for q in sorted(ways[now]) if q != before)
        ring.append(now)
        if now == first:
            break
    return ring if sum(_turn((0, 0), p, q) for p, q in zip(ring, ring[1:], strict=False)) > 0 else ring[::-1]


def union_of_lines(lines: list[list[tuple]]) -> list[list[tuple]]:
    """The lines split where they meet or cross, with what several share kept once."""
    corners = [p for ps in lines for p in ps]
    if not corners:
        return []
    points = _Points(EPS * max(1e-290, *np.abs(corners).max(axis=0).tolist()))
    lines = [list(map(points.one, ps)) for ps in lines]
    rows = [(k, p, q) for k, ps in enumerate(lines) for p, q in zip(ps, ps[1:], strict=False) if p != q]
    if not rows:
        return []
    met = _cuts(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), points)
    paths: dict[int, list[tuple]] = {}
    for (k, p, _), own in zip(rows, met, strict=True):
        steps = sorted(set(own), key=lambda x: math.dist(p, x))
        paths[k] = paths[k] + steps[1:] if k in paths else steps
    around: dict[tuple, set] = {}
    for path in paths.values():
        for p, q in zip(path, path[1:], strict=False):
            around.setdefault(p, set()).add(q)
            around.setdefault(q, set()).add(p)
    nodes = {p for p, own in around.items() if len(own) != 2} | {p for path in paths.values() for p in (path[0], path[-1])}
    out, seen = [], set()
    for path in paths.values():
        now = [path[0]]
        for p, q in zip(path, path[1:], strict=False):
            piece = (min(p, q), max(p, q))
            if piece in seen:
                if len(now) > 1:
                    out.append(now)
                now = [q]
                continue
            seen.add(piece)
            now.append(q)
            if q in nodes:
                out.append(now)
                now = [q]
        if len(now) > 1:
            out.append(now)
    return out
