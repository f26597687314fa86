"""Components, skeletons, borders and paths of elements whose canvas fits one tile of masks.

Such an element's cells are painted in one piece, so they never leave the task that
painted them: patch lies above patch in one array, with empty cells around each, and
a step works on all of them at once. Elements on larger canvases are put together
from several tiles by raster's operators, which give the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import masks, raster
from .masks import owners
from .raster import AROUND, tour
from .raster import TILE as SIDE

#: Squares of a stack, about.
SQUARES = 1 << 20
NONE = np.iinfo(np.int32).max


class Stack:
    """Patches of squares above one another: `full`, whether a square is taken; a patch k has gh[k] rows from row top[k] on, its first square is (c0, r0)."""

    def __init__(self, k, col, row, bounds):
        self.c0, self.r0, c1, r1 = bounds.T
        self.gw, self.gh = c1 - self.c0, r1 - self.r0
        self.top = np.cumsum(self.gh + 2) - self.gh - 1
        self.stride = int(self.gw.max()) + 2
        self.full = np.zeros((int((self.gh + 2).sum()), self.stride), bool)
        self.full[self.top[k] + row - self.r0[k], 1 + col - self.c0[k]] = True

    def places(self, at: np.ndarray):
        """Patch, column and row of places in the flat stack."""
        r, c = np.divmod(at, self.stride)
        k = np.searchsorted(self.top - 1, r, "right") - 1
        return k, c - 1 + self.c0[k], r - self.top[k] + self.r0[k]

    def _borders_of_tiles(self, tile: int):
        """Whether a tile ends with a column, of each row of the stack, and whether one ends with a row."""
        k = np.repeat(np.arange(len(self.top)), self.gh + 2)
        rows = np.arange(len(k)) - self.top[k] + self.r0[k]
        return (self.c0[k][:, None] + np.arange(self.stride) - 1) % tile == tile - 1, rows % tile == tile - 1

    def labels(self, tile: int) -> np.ndarray:
        """Of each taken square, in order, the place of its component's first one: components are found inside tiles first, and linked across their borders."""
        return _linked(self.full, *_within(self.full, *self._borders_of_tiles(tile)))

    def numbers(self, label: np.ndarray):
        """Of each taken square the patch, the component's number from 1, the column and the row."""
        at = np.flatnonzero(self.full)
        k, col, row = self.places(at)
        first = label == at
        count = np.cumsum(first)
        number = np.zeros(self.full.size, np.int32)
        number[at[first]] = count[first] - (count - first)[np.searchsorted(k, k[first])]
        return k, number[label], col, row

    def skeletons(self, width: int, height: int) -> np.ndarray:
        """raster.skeleton() of each patch of cells on a canvas of width x height."""
        edge = np.zeros_like(self.full)
        k, i = owners(self.gh)
        y = self.top[k] + i
        edge[y, 0] |= (self.c0 == 0)[k]
        edge[y, self.gw[k] + 1] |= (self.c0 + self.gw >= width)[k]
        edge[self.top[self.r0 <= 0] - 1] = True
        edge[(self.top + self.gh)[self.r0 + self.gh >= height]] = True
        out, source = np.zeros_like(self.full), self.full
        while source.any():
            near = source | edge
            thin = np.zeros_like(source)
            thin[1:-1, 1:-1] = source[1:-1, 1:-1] & near[:-2, 1:-1] & near[2:, 1:-1] & near[1:-1, :-2] & near[1:-1, 2:]
            wide = thin.copy()
            wide[1:-1, 1:-1] |= thin[:-2, 1:-1] | thin[2:, 1:-1] | thin[1:-1, :-2] | thin[1:-1, 2:]
            out |= source & ~wide
            source = thin
        return out

    def holes(self) -> np.ndarray:
        """The first squares of all holes, empty parts that are connected by their sides and have no way out."""
        empty = ~self.full
        none = np.zeros(self.full.shape, bool), np.zeros(len(self.full), bool)
        at, label = _within(empty, *none, diagonal=False)
        return np.unique(label[label != 0])  # what surrounds the patches is one part, from place 0 on

    def with_holes(self, components: np.ndarray) -> np.ndarray:
        """Whether patches of so many components have holes, by what blocks of 2 x 2 squares hold."""
        f = self.full.astype(np.int8)
        n = f[:-1, :-1] + f[:-1, 1:] + f[1:, :-1] + f[1:, 1:]
        diagonal = (n == 2) & (f[:-1, :-1] == f[1:, 1:])
        by_row = (n == 1).sum(1) - (n == 3).sum(1) - 2 * diagonal.sum(1)
        return np.add.reduceat(by_row, self.top - 1) // 4 != components


def _within(full, ends_col, ends_row, diagonal: bool = True):
    """Places of taken squares, their labels inside tiles, and where tiles end."""
    at = np.flatnonzero(full)
    least = np.full(full.shape, NONE, np.int32)
    flat = least.reshape(-1)
    flat[at] = at
    cols, rows = ends_col[:, :-1] & ends_col.any(), ends_row[:-1]
    some, any_row = bool(cols.any()), bool(rows.any())
    while True:
        low = least.copy()
        right, left = least[:, 1:], least[:, :-1]
        np.minimum(low[:, :-1], np.where(cols, NONE, right) if some else right, out=low[:, :-1])
        np.minimum(low[:, 1:], np.where(cols, NONE, left) if some else left, out=low[:, 1:])
        source = low.copy() if diagonal else least
        down, up = source[1:], source[:-1]
        np.minimum(low[:-1], np.where(rows[:, None], NONE, down) if any_row else down, out=low[:-1])
        np.minimum(low[1:], np.where(rows[:, None], NONE, up) if any_row else up, out=low[1:])
        new = low.reshape(-1)[at]
        new = np.minimum(new, flat[new])
        if (new == flat[at]).all():
            return (at, new) if not diagonal else (at, new, cols if some else None, rows if any_row else None)
        flat[at] = new


def _linked(full, at, label, cols, rows):
    """Labels when those that touch across the ends of tiles are one."""
    if cols is None and rows is None:
        return label
    lab = np.full(full.shape, -1, np.int32)
    lab.reshape(-1)[at] = label
    pairs = []
    for a, b, end in (
        (lab[:, :-1], lab[:, 1:], cols),
        (lab[:-1], lab[1:], None if rows is None else rows[:, None]),
        (lab[:-1, :-1], lab[1:, 1:], (False if rows is None else rows[:, None]) | (False if cols is None else cols[:-1])),
        (lab[:-1, 1:], lab[1:, :-1], (False if rows is None else rows[:, None]) | (False if cols is None else cols[:-1])),
    ):
        if end is not None:
            y, x = np.nonzero((a >= 0) & (b >= 0) & end)
            pairs.append(a[y, x] * np.int64(full.size) + b[y, x])
    a, b = np.divmod(np.unique(np.concatenate(pairs)), full.size)
    root = np.arange(full.size, dtype=np.int32)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root[label]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        ends = np.concatenate([a, b])
        while (root[root[ends]] != root[ends]).any():
            root[ends] = root[root[ends]]
        root[label] = root[root[label]]


def _turns() -> np.ndarray:
    """The direction in which a walk goes on, by the squares around (bits in the order of AROUND) and the direction it came from; -1 if there is none."""
    return np.array([[next((k for k in ((came + 1 + i) % 8 for i in range(8)) if m >> k & 1), -1) for came in range(8)] for m in range(256)])


def walks(stack: Stack, begin: np.ndarray, came: np.ndarray):
    """raster.outline() from all beginnings at once: whose each place is, and the places in order."""
    turns, step = _turns(), np.array([dy * stack.stride + dx for dx, dy in AROUND])
    flat = stack.full.reshape(-1)
    n, ids, at, came = len(begin), np.arange(len(begin)), begin.copy(), came.copy()
    second = np.full(n, -1)
    whose, places, final = [ids], [at], np.ones(n, np.int64)
    t = 0
    while len(ids):
        around = sum(flat[at + d].astype(np.int64) << k for k, d in enumerate(step))
        turn = turns[around, came]
        new = at + step[turn]
        done = (turn < 0) | ((t > 0) & (at == begin[ids]) & (new == second[ids]))
        final[ids[done]] = np.where(turn[done] < 0, t + 1, t)
        go = ~done
        ids, at, came = ids[go], new[go], (turn[go] + 4) % 8
        if t == 0:
            second[ids] = at
        whose.append(ids)
        places.append(at)
        t += 1
    when = np.concatenate([np.full(len(w), i) for i, w in enumerate(whose)])
    whose, places = np.concatenate(whose), np.concatenate(places)
    real = when < final[whose]
    order = np.lexsort((when[real], whose[real]))
    return whose[real][order], places[real][order]


def _cut(cells, k, col, row, edge, run):
    """run(Stack, patches) for stacks of about SQUARES squares, narrow patches apart from wide ones."""
    p = cells.rects // edge
    bounds = np.concatenate([p[:, :2], (cells.rects[:, 2:] - 1) // edge + 1], 1)
    there = np.flatnonzero(np.bincount(k, minlength=len(bounds)) > 0)
    if not len(there):
        return
    wide = np.ceil(np.log2(bounds[there, 2] - bounds[there, 0] + 2)).astype(int)
    for w in np.unique(wide):
        own = there[wide == w]
        cost = np.cumsum((bounds[own, 3] - bounds[own, 1] + 2) * 2**w) // SQUARES
        for part in np.split(own, np.flatnonzero(np.diff(cost)) + 1):
            at = np.full(len(bounds), -1)
            at[part] = np.arange(len(part))
            use = at[k] >= 0
            yield run(Stack(at[k[use]], col[use], row[use], bounds[part]), part)


def _stacked(elements: DataFrame, kinds: str, edge: int, run) -> DataFrame:
    """scene_id, rank and `kinds` that run(Stack) gives of the kept cells' squares: patches, and an array for each column."""
    import pyarrow as pa

    def emit(p, _):
        k, col, row = p.k[p.kept], p.x[p.kept] // edge, p.y[p.kept] // edge

        def each(stack, part):
            which, *columns = run(stack)
            return part[which], *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)

        found = list(_cut(p, k, col, row, edge, each))
        if not found:
            return (np.zeros(0, np.int64),)
        which, *columns = zip(*found, strict=True)
        return np.concatenate(which), *(pa.concat_arrays(c) for c in columns)

    return masks.painted(elements, masks.TILE, kinds, emit)


def _split(elements: DataFrame, small, large) -> DataFrame:
    """small() of the elements whose canvas fits one tile and large() of the cells of the others, if there are any."""
    over = (F.col("grid_width") > masks.TILE) | (F.col("grid_height") > masks.TILE)
    rest = elements.where(over)
    if rest.select("grid_width").limit(1).isEmpty():
        return small(elements)
    # a scene has one canvas, so its elements stay together
    return small(elements.where(~over)).unionByName(large(masks.cells(masks.pieces(rest))))


def components(elements: DataFrame, edge: int = 1, tile: int = SIDE) -> DataFrame:
    """raster.grid_components() of the cells that masks.drawing_elements() keep."""

    def run(stack):
        k, number, col, row = stack.numbers(stack.labels(tile))
        return k, number.astype(np.int32), col.astype(np.int32), row.astype(np.int32)

    return _split(elements, lambda e: _stacked(e, "component int, col int, row int", edge, run), lambda c: raster.grid_components(c, edge, tile))


def skeletons(elements: DataFrame, width: int, height: int) -> DataFrame:
    """raster.skeleton_cells() of the cells that masks.drawing_elements() keep, on a canvas of width x height."""

    def run(stack):
        k, x, y = stack.places(np.flatnonzero(stack.skeletons(width, height)))
        return k, x.astype(np.int32), y.astype(np.int32)

    return _split(elements, lambda e: _stacked(e, "x int, y int", 1, run), lambda c: raster.skeleton_cells(c, width, height))


def _points(n, x, y):
    """An Arrow array of lists of n points each."""
    import pyarrow as pa

    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v, np.int32)) for v in (x, y)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)


def borders(elements: DataFrame) -> DataFrame:
    """raster.component_borders() of the components of cells that masks.drawing_elements() keep."""

    def run(stack):
        label = stack.labels(SIDE)
        k, number, _, _ = stack.numbers(label)
        at = np.flatnonzero(stack.full)
        first = label == at
        begin, came = at[first], np.zeros(int(first.sum()), np.int64)
        holed = stack.with_holes(np.bincount(k[first], minlength=len(stack.top)))
        if holed.any():
            inside = stack.holes()
            begin, came = np.concatenate([begin, inside - 1]), np.concatenate([came, np.full(len(inside), 4)])
        number_at = np.zeros(stack.full.size, np.int32)
        number_at[at] = number
        whose, places = walks(stack, begin, came)
        n = np.bincount(whose, minlength=len(begin))
        _, x, y = stack.places(places)
        patch, component = stack.places(begin)[0], number_at[begin]
        # a component's borders: the outer one, then those of its holes in raster order
        order = np.lexsort((np.arange(len(begin)), component, patch))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(patch[order]) != 0) | (np.diff(component[order]) != 0)
        border = np.zeros(len(order), np.int32)
        border[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return patch, component, border, _points(n, x, y)

    kinds = "component int, border int, p array<struct<x:int,y:int>>"
    return _split(elements, lambda e: _stacked(e, kinds, 1, run), lambda c: raster.component_borders(raster.grid_components(c)))


def stroke_paths(elements: DataFrame, edge: int, width: int, height: int) -> DataFrame:
    """raster.stroke_paths() along raster.serpentine() through the squares of the cells that masks.drawing_elements() keep."""
    import pyarrow as pa

    def run(stack):
        k, number, col, row = stack.numbers(stack.labels(SIDE))
        count = np.zeros(len(stack.top), np.int64)
        np.maximum.at(count, k, number)
        own = np.cumsum(count) - count  # a patch's first component among all
        part = own[k] + number - 1
        order = np.argsort(part, kind="stable")
        part, col, row = part[order], col[order], row[order]
        begins = np.ones(len(part), bool)
        begins[1:] = (np.diff(part) != 0) | (np.diff(row) != 0)
        first, line = np.flatnonzero(begins), np.cumsum(begins) - 1
        size = np.bincount(part, minlength=int(count.sum()))
        start = np.cumsum(size) - size
        i = np.arange(len(part)) - first[line]
        long = np.diff(np.append(first, len(part)))[line]
        odd = (line - line[start][part]) % 2 == 1
        at = first[line] + np.where(odd, long - 1 - i, i)
        x, y = (np.minimum(most - 1, v[at] * edge + edge // 2) for v, most in ((col, width), (row, height)))
        turn, back = np.arange(len(size)), np.zeros(len(size), bool)
        ends = np.stack([x[start], y[start], x[start + size - 1], y[start + size - 1]], 1)
        for p in np.flatnonzero(count > 1).tolist():
            lo = int(own[p])
            for nth, (component, backwards) in enumerate(tour(ends[lo : lo + int(count[p])])):
                turn[lo + nth], back[lo + nth] = lo + component, backwards
        c, i = owners(size[turn])
        at = start[turn][c] + np.where(back[c], size[turn][c] - 1 - i, i)
        n = np.add.reduceat(size, own)
        before = np.cumsum(size[turn]) - size[turn]
        lift = before - np.repeat(before[own], count)
        later = np.ones(len(size), bool)
        later[own] = False
        lifts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32)), pa.array(lift[later].astype(np.int32)))
        return np.arange(len(stack.top)), _points(n, x[at], y[at]), lifts

    kinds = "points array<struct<x:int,y:int>>, pen_lifts array<int>"
    large = lambda c: raster.stroke_paths(raster.serpentine(raster.grid_components(c, edge), edge, width, height))
    return _split(elements, lambda e: _stacked(e, kinds, edge, run), large)
