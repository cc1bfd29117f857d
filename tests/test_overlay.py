"""Polygon overlays against the even-odd rule at random points, and against their areas."""

import random

import pytest

from pipewright.functions import geometry as G
from pipewright.functions import overlay as O


def read(text):
    return G.load(G.wkb_of_wkt(text, "multipolygon" if text.startswith("MULTI") else "polygon"))


def size(g):
    return sum(sum(abs(O._twice_area(r[:-1])) * (1 if i == 0 else -1) for i, r in enumerate(rings)) for rings in g[1]) / 2


def holds(g, p):
    return any(sum(O._inside(p, r[:-1]) for r in rings) % 2 for rings in g[1])


@pytest.mark.parametrize("grid", [0, 6])
def test_random_polygons(grid):
    rng = random.Random(grid)
    for _ in range(100):
        gs = []
        for _ in range(2):
            ring = [(rng.randint(0, grid), rng.randint(0, grid)) if grid else (rng.random(), rng.random()) for _ in range(rng.randint(3, 8))]
            gs.append((3, [ring + ring[:1]]))
        valid, both, common = [O.make_valid(g) for g in gs], O.union(gs), O.intersection(*gs)
        assert not any(map(O.invalid, (*valid, both, common)))
        assert size(valid[0]) + size(valid[1]) == pytest.approx(size(both) + size(common))
        for _ in range(20):
            p = (rng.random() * (grid or 1), rng.random() * (grid or 1))
            inside = [O._inside(p, g[1][0][:-1]) for g in gs]
            assert (holds(both, p), holds(common, p)) == (any(inside), all(inside))


def test_shapes():
    frame, inner = read("POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1))"), read("POLYGON ((2 2, 3 2, 3 3, 2 3, 2 2))")
    assert G.wkt(O.union([frame, inner])) == "MULTIPOLYGON (((0 0, 0 6, 6 6, 6 0, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1)), ((2 2, 2 3, 3 3, 3 2, 2 2)))"
    assert G.wkt(O.make_valid(read("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"))) == "MULTIPOLYGON (((0 0, 0 2, 1 1, 0 0)), ((1 1, 2 2, 2 0, 1 1)))"
    assert O.intersection(frame, inner) == (6, []) and O.union([]) == (6, [])


@pytest.mark.parametrize("text,reason", [
    ("POLYGON ((0 0, 1 0, 1 1, 0 0))", None),
    ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "Self-intersection[1 1]"),
    ("MULTIPOLYGON (((1 1, 2 1, 2 2, 1 2, 1 1)), ((1 1, 2 1, 2 2, 1 2, 1 1)))", "Self-intersection[1 1]"),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 5))", "Hole lies outside shell[5 5]"),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))", None),
])
def test_invalid(text, reason):
    assert O.invalid(read(text)) == reason
