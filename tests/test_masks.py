"""Masks on tiles against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_scenes import ELEMENT, element

from cuewright.operators import masks



def inside(points, x, y):
    """Whether a polygon covers the middle of a cell, by counting the edges to its right and looking for one that it lies on."""
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if turn == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (turn > 0) == (by > ay):
            odd = not odd
    return odd


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 24), st.integers(-6, 18)), min_size=0, max_size=9), st.integers(-4, 6), st.integers(-4, 6))
def test_filled_windows(points, left, top):
    got = masks.filled(np.array(points).reshape(-1, 2), 14, 9, left, top)
    assert got.tolist() == [[len(points) > 2 and inside(points, left + x, top + y) for x in range(14)] for y in range(9)]


def cells_by_hand(rows, width, height):
    """Own and kept cells of (element row, contour) in their order, one scene."""
    box = lambda r, pad=0: {(x, y) for x in range(max(0, r[0] - pad), min(width, r[0] + r[2] + pad)) for y in range(max(0, r[1] - pad), min(height, r[1] + r[3] + pad))}
    grid = [(x, y) for x in range(width) for y in range(height)]
    body = [{c for c in grid if inside(p, *c)} if p else box(e[4]) for e, p in rows]
    out = []
    for k, (e, p) in enumerate(rows):
        pad = e[12]
        own = {(x, y) for a, b in body[k] for x in range(max(0, a - pad), min(width, a + pad + 1)) for y in range(max(0, b - pad), min(height, b + pad + 1))} if p else box(e[4], pad)
        kept = set(own)
        if e[8] == "subtract-later":
            kept -= set().union(*body[k + 1 :])
        if e[8] != "none":
            kept -= set().union(*(box(r) for r in e[11]))
        out.append((own, kept))
    return out


@pytest.mark.parametrize("tile", [5, 16, 256])
def test_tiles_of_any_size_give_the_same_cells(spark, tile):
    r = random.Random(tile)
    width, height, scenes = 38, 23, {}
    spot = lambda: (r.randint(-5, width + 4), r.randint(-5, height + 4))
    for s in range(12):
        scenes[s] = []
        for k in range(r.randint(1, 7)):
            region = lambda: (r.randrange(width), r.randrange(height), r.randint(1, 20), r.randint(1, 12))
            contour = [spot() for _ in range(r.randint(3, 6))] if r.random() < 0.6 else None
            scenes[s].append((element(s, k, f"e{k}", k + 1, region(), policy=r.choice(masks.KEYS), protected=[region() for _ in range(r.randint(0, 2))], pad=r.randint(0, 3), canvas=(width, height)), contour))
    scenes[12] = [(element(12, 0, "far", 1, (90, 90, 4, 4), canvas=(width, height)), None), (element(12, 1, "out", 2, (1, 1, 2, 2), pad=1, canvas=(width, height)), [(90, 90), (99, 90), (99, 99)])]
    rows = [(*e, p and [(float(x), float(y)) for x, y in p]) for own in scenes.values() for e, p in own]
    drawn = masks.drawing_elements(spark.createDataFrame(rows, f"{ELEMENT}, contour array<struct<x:double,y:double>>"))
    areas = {(a.scene_id, a.rank): (a.area, a.left) for a in masks.areas(drawn, tile).collect()}
    got = {}
    for p in masks.pieces(drawn, tile).collect():
        for kept in (False, True)[: 1 + p.kept]:
            cells = got.setdefault((p.scene_id, p.rank, kept), [])
            cells += [(x, p.y0) for x in range(p.x0, p.x1)]
    for s, own in scenes.items():
        for k, (cells, kept) in enumerate(cells_by_hand(own, width, height)):
            assert areas[s, k] == (len(cells), len(kept))
            assert sorted(got.get((s, k, False), [])) == sorted(cells) and sorted(got.get((s, k, True), [])) == sorted(kept)


def test_a_large_canvas_of_500_contours(spark):
    """Areas of diamonds on 8,000 x 8,000 cells, each painted over by the next one's rectangle in part."""
    r = random.Random(2)
    side, rows, want = 8000, [], {}
    for k in range(500):
        x, y, d = (k % 20) * 400 + 150, (k // 20) * 320 + 150, r.randint(5, 140)
        rows.append((*element(1, k, f"e{k}", k + 1, (x, y, 1, 1), canvas=(side, side)), [(float(x), float(y - d)), (float(x + d), float(y)), (float(x), float(y + d)), (float(x - d), float(y))]))
        want[k] = 2 * d * d + 2 * d + 1
    got = masks.areas(masks.drawing_elements(spark.createDataFrame(rows, f"{ELEMENT}, contour array<struct<x:double,y:double>>"))).collect()
    assert {a.rank: (a.area, a.left) for a in got} == {k: (n, n) for k, n in want.items()}


def test_canvases_without_cells(spark):
    drawn = masks.drawing_elements(spark.createDataFrame([element(1, 0, "a", 1, (0, 0, 5, 5), canvas=(0, 9)), element(2, 0, "a", 1, (0, 0, 5, 5), canvas=(9, 0))], ELEMENT))
    assert sorted(map(tuple, masks.areas(drawn).collect())) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert masks.pieces(drawn).collect() == [] and masks.areas(drawn.limit(0)).collect() == []
