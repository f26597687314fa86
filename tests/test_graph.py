"""Components across tiles, borders with holes, and the order of paths, against plain loops."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.operators import graph, raster

SHAPES = st.sets(st.tuples(st.integers(0, 11), st.integers(0, 9)), min_size=1, max_size=90)


def parts(cells, near):
    """Connected parts of a set of cells, by their first cells in raster order."""
    left, out = set(cells), []
    for c in sorted(cells, key=lambda c: c[::-1]):
        if c in left:
            part, todo = set(), [c]
            while todo:
                x, y = todo.pop()
                if (x, y) in left:
                    left.remove((x, y))
                    part.add((x, y))
                    todo += [(x + dx, y + dy) for dx, dy in near]
            out.append(part)
    return out


def test_components_are_joined_across_tiles(spark):
    r, rows, want = random.Random(6), [], {}
    for s in range(8):
        cells = {(r.randrange(-9, 30), r.randrange(-5, 25)) for _ in range(r.choice([1, 60, 250, 420]))}
        if s == 0:  # a spiral, which no tile holds more than a part of
            cells, at, d = set(), (0, 0), 0
            for n in range(40, 0, -2):
                dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[d % 4]
                cells |= {(at[0] + dx * k, at[1] + dy * k) for k in range(n)}
                at, d = (at[0] + dx * (n - 1), at[1] + dy * (n - 1)), d + 1
        rows += [(s, 1, x, y) for x, y in cells for _ in range(1 + (x == y))]
        want |= {(s, x, y): k + 1 for k, part in enumerate(parts(cells, raster.EIGHT)) for x, y in part}
    table = spark.createDataFrame(rows, "scene_id long, rank long, x int, y int")
    for tile in (3, 7, 128):
        got = {(c.scene_id, c.col, c.row): c.component for c in raster.grid_components(table, 1, tile).collect()}
        assert got == want


def test_least_labels_of_chains_stars_and_rings(spark):
    links = [(1, k + 1, k) for k in range(1, 200)] + [(2, 5, k) for k in range(300)] + [(3, k, (k + 1) % 50 + 1) for k in range(1, 50)] + [(4, 7, 7), (5, 9, 8), (5, 8, 9)]
    got = {(r.key, r.label): r.least for r in graph.least_labels(spark.createDataFrame(links, "key long, a long, b long"), ["key"]).collect()}
    assert got == {(1, k): 1 for k in range(2, 201)} | {(2, k): 0 for k in range(1, 300)} | {(3, k): 2 - k % 2 for k in range(3, 51)} | {(5, 9): 8}
    assert graph.least_labels(spark.createDataFrame([], "key long, a long, b long"), ["key"]).collect() == []


@settings(max_examples=300, deadline=None)
@given(SHAPES)
def test_borders_are_those_of_every_empty_part(shape):
    """Of each component and each empty part beside it there is one border, and it holds just the cells beside that part."""
    empty = {(x, y) for x in range(-1, 13) for y in range(-1, 11)} - shape
    beside = lambda cells, hole: frozenset(c for c in cells if any((c[0] + dx, c[1] + dy) in hole for dx, dy in raster.FOUR))
    want = [b for cells in parts(shape, raster.EIGHT) for hole in parts(empty, raster.FOUR) if (b := beside(cells, hole))]
    got = []
    for cells in parts(shape, raster.EIGHT):
        x, y = np.array(sorted(cells)).T
        for walk in raster.borders(x, y):
            got.append(frozenset(walk))
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(walk, walk[1:] + walk[:1], strict=True)) or len(walk) == 1
    assert sorted(map(sorted, got)) == sorted(map(sorted, want))


def test_a_ring_has_a_path_inside(spark):
    ring = {(x, y) for x in range(2, 30) for y in range(2, 26)} - {(x, y) for x in range(8, 24) for y in range(8, 20)}
    table = spark.createDataFrame([(1, 0, x, y) for x, y in ring], "scene_id long, rank long, x int, y int")
    walks = raster.component_borders(raster.grid_components(table)).orderBy("border").collect()
    assert [(w.component, w.border) for w in walks] == [(1, 0), (1, 1)]
    assert {tuple(p) for p in walks[1].p} == {c for c in ring if any((c[0] + dx, c[1] + dy) in {(x, y) for x in range(8, 24) for y in range(8, 20)} for dx, dy in raster.FOUR)}
    assert [p.component for p in raster.traced_paths(table, 40, 40).orderBy("component").collect()] == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-9, 9) | st.integers(-2000, 2000)] * 4), max_size=40))
def test_the_tour_takes_the_nearest_end(ends):
    left, pen, want = list(range(len(ends))), None, []
    while left:
        if pen is None:
            i, back = min(left, key=lambda i: (ends[i][1], ends[i][0])), False
        else:
            far = [(math.dist(pen, ends[i][:2]), math.dist(pen, ends[i][2:])) for i in left]
            k = min(range(len(left)), key=lambda k: min(far[k]))
            i, back = left[k], far[k][1] < far[k][0]
        left.remove(i)
        want.append((i, back))
        pen = ends[i][:2] if back else ends[i][2:]
    assert raster.tour(np.array(ends).reshape(-1, 4)) == want
