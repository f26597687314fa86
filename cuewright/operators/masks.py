"""Mask algebra: which part of the canvas each element may draw on.

An element owns its padded region, or its filled contour grown by the padding,
less later elements' regions or contours without padding (policy subtract-later)
and its protected regions (unless the policy is none).

A canvas is cut into tiles of TILE x TILE cells, and an element goes to the tiles
that its own bounds touch. A tile's elements pass in a stream from the last to the
first, with one mask of what later ones cover: an element keeps the cells of its own
that none before it has covered. The elements of a stretch of the stream are painted
at once, tile beside tile in one array. A task holds such a stretch, about CELLS
cells, whatever the size of the canvas or the number of elements. The tiles of a
canvas of up to SHARED cells are painted where its elements were ranked, so that
these are not shuffled again; larger canvases are dealt out tile by tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import fitted

KEYS = ("subtract-later", "explicit", "none")
RECT = ("x0", "y0", "x1", "y1")


def scaled(region: Column, sx: Column, sy: Column, width: Column, height: Column, padding: Column | int = 0) -> Column:
    """A region on a grid of width x height as half-open x0, y0, x1, y1, rounded half to even and clamped."""
    pad = padding if isinstance(padding, Column) else F.lit(padding)
    edge = lambda v, s, p, most: F.greatest(F.lit(0), F.least(most, F.rint(v * s).cast("int") + p)).cast("int")
    return F.struct(
        edge(region["x"], sx, -pad, width).alias("x0"),
        edge(region["y"], sy, -pad, height).alias("y0"),
        edge(region["x"] + region["width"], sx, pad, width).alias("x1"),
        edge(region["y"] + region["height"], sy, pad, height).alias("y1"),
    )


def in_bounds(region: Column, width: Column, height: Column) -> Column:
    """Whether a region has a positive size and lies on the canvas; false for nulls."""
    x, y, w, h = (region[k] for k in ("x", "y", "width", "height"))
    return F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height), F.lit(False))


def filled(points: np.ndarray, width: int, height: int, left: int = 0, top: int = 0) -> np.ndarray:
    """Cells whose middle a polygon of whole-number (x, y) rows covers, edges included; none for fewer than three points.

    The cells are those of a window of width x height, whose first cell is (left,
    top). Each edge flips the cells right of it in the rows that it crosses.
    """
    if len(points) < 3:
        return np.zeros((height, width), bool)
    a = np.asarray(points, np.int64)
    b = np.roll(a, -1, axis=0)
    steps = np.gcd(*np.abs(b - a).T)
    low, high = np.where((a[:, 1] <= b[:, 1])[:, None], a, b), np.where((a[:, 1] <= b[:, 1])[:, None], b, a)
    first, end = np.maximum(low[:, 1], top), np.minimum(high[:, 1], top + height)
    n = np.maximum(end - first, 0)
    edge = np.repeat(np.arange(len(a)), n)
    y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    run, rise = (high - low)[edge].T
    x = low[edge, 0] - -(run * (y - low[edge, 1])) // np.maximum(rise, 1)  # the first cell that the edge doesn't have to its right
    flips = np.zeros((height, width + 1), np.int32)
    np.add.at(flips, (y - top, np.clip(x - left, 0, width)), 1)
    out = (np.cumsum(flips, axis=1)[:, :width] & 1).astype(bool)
    # cells that lie on an edge
    edge = np.repeat(np.arange(len(a)), steps + 1)
    k = np.arange(len(edge)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    on = a[edge] + (b - a)[edge] * k[:, None] // np.maximum(steps, 1)[edge][:, None] - (left, top)
    on = on[((on >= 0) & (on < (width, height))).all(1)]
    out[on[:, 1], on[:, 0]] = True
    return out


def grown(mask: np.ndarray, by: int) -> np.ndarray:
    """A mask and all cells within `by` columns and rows of it."""
    for axis in (0, 1):
        near = np.cumsum(np.pad(mask.astype(np.int32), [(by + 1, by) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        far = np.take(near, range(2 * by + 1, near.shape[axis]), axis)
        mask = far - np.take(near, range(near.shape[axis] - 2 * by - 1), axis) > 0
    return mask


def drawing_elements(elements: DataFrame, *, scale: float = 1.0, cap: int | None = None, policy: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Elements as the renderer takes them: order (sequence, start_ms), own regions padded; `policy` overrides, and columns to `keep` follow.

    scene_id, grid_width, grid_height, rank, name, direction, policy, own, cover,
    shields, outline, grow. The canvas is scaled to a long side of `cap` and even
    sides, or else by `scale`. A column `contour` of three points or more takes the
    place of the region.
    """
    order = Window.partitionBy("scene_id").orderBy("sequence", "start_ms", "position")
    if cap is None:
        w, h = (F.rint(F.col(f"canvas_{k}") * scale).cast("int") for k in ("width", "height"))
        sx = sy = F.lit(float(scale))
    else:
        fit = fitted(F.col("canvas_width"), F.col("canvas_height"), cap)
        w, h, sx, sy = (fit[k] for k in ("width", "height", "sx", "sy"))
    rect = lambda r, pad=0: scaled(r, sx, sy, w, h, pad)
    pad = F.rint(F.col("padding") * (sx + sy) / 2).cast("int")
    none = F.array().cast("array<struct<x:int,y:int>>")
    points = F.transform("contour", lambda p: F.struct(F.rint(p["x"] * sx).cast("int").alias("x"), F.rint(p["y"] * sy).cast("int").alias("y"))) if "contour" in elements.columns else none
    return elements.select(
        "scene_id",
        w.alias("grid_width"),
        h.alias("grid_height"),
        (F.row_number().over(order) - 1).cast("long").alias("rank"),
        F.col("element_id").alias("name"),
        "direction",
        (F.lit(policy) if policy else F.coalesce("policy", F.lit(KEYS[0]))).alias("policy"),
        rect(F.col("region"), pad).alias("own"),
        rect(F.col("region")).alias("cover"),
        F.transform("protected", lambda r: rect(r)).alias("shields"),
        F.when(F.size(points) >= 3, points).otherwise(none).alias("outline"),
        pad.alias("grow"),
        *keep,
    )


#: Side of a tile in cells.
TILE = 256
#: Cells that are painted at once, about; an element on one tile may have more.
CELLS = 1 << 20
#: Cells of a canvas beyond which its tiles are shared out over tasks.
SHARED = TILE * TILE


def owners(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of things with n units each: whose each unit is, and its place there."""
    n = np.asarray(n, np.int64)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


def boxed(rects: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rectangles (x0, y0, x1, y1): whose each cell is, and its x and y, row by row."""
    x0, y0, x1, y1 = rects.T
    n = np.maximum(x1 - x0, 0)
    k, y = owners(np.where(n > 0, np.maximum(y1 - y0, 0), 0))
    row, x = owners(n[k])
    return k[row], x + x0[k][row], (y + y0[k])[row]


def clipped(rects: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Rectangles cut to boxes; what is left of one that is outside is empty."""
    low = np.maximum(rects[:, :2], box[:, :2])
    return np.concatenate([low, np.maximum(low, np.minimum(rects[:, 2:], box[:, 2:]))], 1)


def _fills(points: np.ndarray, owner: np.ndarray, after: np.ndarray, window: np.ndarray) -> np.ndarray:
    """filled() of many polygons at once, each in a window of its own: the windows' cells one after another.

    A point's polygon is in `owner`, and the point after it in `after`.
    """
    left, top = window[:, 0], window[:, 1]
    width, height = window[:, 2] - left, window[:, 3] - top
    a, b = points, points[after]
    steps = np.gcd(*np.abs(b - a).T)
    up = (a[:, 1] <= b[:, 1])[:, None]
    low, high = np.where(up, a, b), np.where(up, b, a)
    first, end = np.maximum(low[:, 1], top[owner]), np.minimum(high[:, 1], (top + height)[owner])
    edge, y = owners(np.maximum(end - first, 0))
    y += first[edge]
    run, rise = (high - low)[edge].T
    x = low[edge, 0] - -(run * (y - low[edge, 1])) // np.maximum(rise, 1)
    at, wide = owner[edge], width + 1
    base = np.cumsum(wide * height) - wide * height
    flips = np.bincount(base[at] + (y - top[at]) * wide[at] + np.clip(x - left[at], 0, width[at]), minlength=int((wide * height).sum()))
    # a closed line crosses a row an even number of times, so each row begins outside
    inside = np.bitwise_xor.accumulate((flips & 1).astype(np.uint8)).astype(bool)
    rows = np.repeat(wide, height)
    real = np.ones(len(inside), bool)
    real[np.cumsum(rows) - 1] = False
    out = inside[real]
    edge, k = owners(steps + 1)
    at = owner[edge]
    on = a[edge] + (b - a)[edge] * k[:, None] // np.maximum(steps, 1)[edge][:, None] - window[at, :2]
    ok = ((on >= 0) & (on < np.stack([width[at], height[at]], 1))).all(1)
    base = np.cumsum(width * height) - width * height
    out[base[at[ok]] + on[ok, 1] * width[at[ok]] + on[ok, 0]] = True
    return out


def _growths(mask: np.ndarray, width: np.ndarray, height: np.ndarray, by: np.ndarray) -> np.ndarray:
    """grown() of many masks at once, each by its own measure, less the margin of that width around each."""
    sums = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    w, h = width - 2 * by, height - 2 * by
    near, base = sums(mask), np.cumsum(width * height) - width * height
    k, x, y = boxed(np.stack([0 * w, 0 * w, w, height], 1))
    at = base[k] + y * width[k] + x
    flat = near[at + 2 * by[k] + 1] > near[at]
    base = np.cumsum(w * height) - w * height
    k, y, x = boxed(np.stack([0 * w, 0 * w, height, w], 1))  # column by column
    near = sums(flat[base[k] + y * w[k] + x])
    k, x, y = boxed(np.stack([0 * w, 0 * w, w, h], 1))
    at = base[k] + x * height[k] + y
    return near[at + 2 * by[k] + 1] > near[at]


class _Parts:
    """An Arrow struct of policy, own, cover, shields, outline and grow, as arrays."""

    def __init__(self, field):
        rects = lambda c: np.stack([c.field(k).fill_null(0).to_numpy(False) for k in RECT], 1).astype(np.int64)
        cut = lambda c: c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()
        policy = field("policy").to_numpy(False)
        self.later, self.free = policy == "subtract-later", policy == "none"
        self.grow = np.maximum(field("grow").fill_null(0).to_numpy(False).astype(np.int64), 0)
        self.own, self.cover = rects(field("own")), rects(field("cover"))
        self.cover[~field("cover").is_valid().to_numpy(False)] = 0
        self.shields, self.shield_cut = rects(field("shields").flatten()), cut(field("shields"))
        points = field("outline").flatten()
        self.points, self.point_cut = np.stack([points.field(k).to_numpy(False) for k in ("x", "y")], 1).astype(np.int64), cut(field("outline"))


class Painted:
    """The own cells of a stretch of elements on their tiles, row by row: `k`, whose each is, x, y, `cells`, whether it is one, and `kept`.

    `rects` are the bounds of the elements' cells, and `start` where they begin. The
    stretch's tiles lie one after another in one array: `tiles` has the first element,
    the place and the box of each, `spots` each cell's place, and the first tile may be
    the last one of the stretch before (`goes_on`).
    """

    def __init__(self, rows: slice, rects, k, x, y, cells, kept):
        self.rows, self.rects, self.k, self.x, self.y, self.cells, self.kept = rows, rects, k, x, y, cells, kept
        n = (rects[:, 2] - rects[:, 0]) * (rects[:, 3] - rects[:, 1])
        self.start = np.cumsum(n) - n

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Of each element how many of its cells have a flag."""
        return np.bincount(self.k, flags, len(self.rects)).astype(np.int64)


class _Painter:
    """Paints elements that come from the last to the first of a tile, stretch by stretch; what covers the last tile is kept for the next stretch."""

    def __init__(self):
        self.tile, self.covered = None, None

    def paint(self, tiles: list[np.ndarray], box: np.ndarray, size: np.ndarray, parts: _Parts):
        """Painted of all rows: tiles (arrays of what tells them apart) and boxes, sizes of the canvases and parts."""
        box = np.concatenate([box[:, :2], np.maximum(box[:, :2], np.minimum(box[:, 2:], size))], 1)
        n_points = np.diff(parts.point_cut)
        outlined = n_points > 0
        rects = clipped(parts.own, box)
        if outlined.any():
            cut, some = parts.point_cut[:-1][outlined], outlined.nonzero()[0]
            ends = [np.stack([f.reduceat(parts.points[:, c], cut) for c in (0, 1)], 1) for f in (np.minimum, np.maximum)]
            by = parts.grow[some][:, None]
            rects[some] = clipped(np.concatenate([ends[0] - by, ends[1] + by + 1], 1), box[some])
        new = np.ones(len(box), bool)
        new[1:] = np.logical_or.reduce([t[1:] != t[:-1] for t in tiles])
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        margin = 2 * parts.grow * outlined
        cost = (rects[:, 2] - rects[:, 0] + margin + 1) * (rects[:, 3] - rects[:, 1] + margin) + np.where(new, area, 0)
        stretch = np.cumsum(cost) // CELLS
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(box)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield self._stretch(slice(lo, hi), tiles, new, box, area, size, parts, rects, outlined)

    def _stretch(self, rows, tiles, new, box, area, size, parts, rects, outlined):
        lo, hi = rows.start, rows.stop
        new, box, area, rects, outlined, size = new[rows].copy(), box[rows], area[rows], rects[rows], outlined[rows], size[rows]
        new[0] = True
        group = np.cumsum(new) - 1
        base = np.cumsum(area[new]) - area[new]
        wide, begin = box[:, 2] - box[:, 0], base[group] - box[:, 0] - box[:, 1] * (box[:, 2] - box[:, 0])
        spot = lambda k, x, y: begin[k] + y * wide[k] + x
        covered = np.full(int(area[new].sum()), hi - lo, np.int32)  # the first row here that covers a cell
        goes_on = self.tile is not None and self.tile == tuple(t[lo] for t in tiles)
        if goes_on:
            covered[: len(self.covered)][self.covered] = -1
        k, x, y = boxed(rects)
        cells = np.ones(len(k), bool)
        cover = clipped(parts.cover[rows], box)
        cover[outlined] = 0
        ck, cx, cy = boxed(cover)
        if outlined.any():
            some = outlined.nonzero()[0]
            by = parts.grow[rows][some]
            window = rects[some] + np.stack([-by, -by, by, by], 1)
            empty = (rects[some][:, 2:] <= rects[some][:, :2]).any(1)
            window[empty] = 0
            by = np.where(empty, 0, by)
            n = np.diff(parts.point_cut)[rows][some]
            owner, place = owners(n)
            first = parts.point_cut[rows][some]
            points = parts.points[first[owner] + place]
            after = np.arange(len(points)) + 1
            after[np.cumsum(n) - 1] = np.cumsum(n) - n
            wide_mask = _fills(points, owner, after, window)
            wk, wx, wy = boxed(window)
            wide_mask &= (wx >= 0) & (wy >= 0) & (wx < size[some][wk, 0]) & (wy < size[some][wk, 1])  # what lies outside the canvas doesn't grow into it
            cells[outlined[k]] = _growths(wide_mask, window[:, 2] - window[:, 0], window[:, 3] - window[:, 1], by)
            body = rects[some]
            real = wide_mask & (wx >= body[wk, 0]) & (wx < body[wk, 2]) & (wy >= body[wk, 1]) & (wy < body[wk, 3])
            ck, cx, cy = np.concatenate([ck, some[wk[real]]]), np.concatenate([cx, wx[real]]), np.concatenate([cy, wy[real]])
            order = np.argsort(ck, kind="stable")
            ck, cx, cy = ck[order], cx[order], cy[order]
        at = spot(ck, cx, cy)[::-1]
        covered[at] = np.minimum(ck[::-1], covered[at])  # of equal places the last one written stays, the first row
        out_spots = spot(k, x, y)
        kept = cells & ~(parts.later[rows][k] & (covered[out_spots] < k))
        out = Painted(rows, rects, k, x, y, cells, kept)
        out.tiles, out.goes_on = (np.flatnonzero(new), base, box[new]), goes_on
        out.spots = out_spots
        sk, place = owners(np.diff(parts.shield_cut)[rows] * ~parts.free[rows])
        if len(sk):
            held = clipped(parts.shields[parts.shield_cut[rows][sk] + place], rects[sk])
            i, hx, hy = boxed(held)
            i = sk[i]
            kept[out.start[i] + (hy - rects[i, 1]) * (rects[i, 2] - rects[i, 0]) + hx - rects[i, 0]] = False
        self.tile, self.covered = tuple(t[hi - 1] for t in tiles), covered[base[-1] :] < hi - lo
        return out


def counted(scenes: DataFrame) -> DataFrame:
    """scenes (grid_width, grid_height, parts, others) with `areas`, the own and the kept cells (area, left) of each part, in place of the grid and the parts.

    For grids that are small by their rules and regions alone: a scene is one row, its
    parts an array in their order of structs as drawing_elements() has them.
    """
    import pyarrow as pa

    rest = [c for c in scenes.columns if c not in ("grid_width", "grid_height", "parts")]
    kinds = ", ".join(f"`{c}` {scenes.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for b in batches:
            parts = b.column(2)
            cut = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            scene, _ = owners(np.diff(cut))
            last = pa.array(np.arange(len(scene))[::-1].copy())  # the last part first
            flat = parts.flatten().take(last)
            size = np.stack([b.column(k).to_numpy(False) for k in (0, 1)], 1).astype(np.int64)[scene[::-1]]
            got = np.zeros((len(scene), 2), np.int64)
            for p in _Painter().paint([scene[::-1]], np.concatenate([np.zeros_like(size), size], 1), size, _Parts(flat.field)):
                got[p.rows] = np.stack([p.sums(p.cells), p.sums(p.kept)], 1)
            areas = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[::-1, k])) for k in (0, 1)], ["area", "left"])
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), areas)], [*rest, "areas"])

    return scenes.select("grid_width", "grid_height", "parts", *rest).mapInArrow(run, f"{kinds}, areas array<struct<area:bigint,left:bigint>>")


def _tiled(elements: DataFrame, tile: int, keep: tuple[str, ...] = (), late: Column | None = None) -> DataFrame:
    """drawing_elements() once for each tile that they touch, in partitions of whole tiles, a tile's elements from the last to the first, `tile_place` from 1 on.

    `late` is a struct of the columns of `elements` that is worked out when the rows lie
    in this order, so that neither shuffles nor sorts carry it; its fields follow as columns.
    """
    bound = lambda k, pick, at, side: F.when(F.size("outline") > 0, pick(F.col(f"outline.{k}"))).otherwise(at(F.col(f"own.{side}"), F.coalesce(F.col(f"cover.{side}"), F.col(f"own.{side}"))))
    tiles = {}
    for k, size, axis in (("x", "grid_width", "tile_x"), ("y", "grid_height", "tile_y")):
        held = lambda v, size=size: F.greatest(F.lit(0), F.least(F.col(size) - 1, v))
        reach = F.when(F.size("outline") > 0, F.greatest(F.lit(0), F.coalesce("grow", F.lit(0)))).otherwise(0)
        low, high = bound(k, F.array_min, F.least, f"{k}0") - reach, F.when(F.size("outline") > 0, F.array_max(f"outline.{k}")).otherwise(F.greatest(F.col(f"own.{k}1"), F.coalesce(F.col(f"cover.{k}1"), F.lit(0))) - 1) + reach
        tiles[axis] = F.sequence(F.floor(held(low) / tile).cast("int"), F.floor(F.greatest(held(low), held(high)) / tile).cast("int"))
    key = ["scene_id", "tile_y", "tile_x"]
    fixed = [*key, "tile_place", "rank", "grid_width", "grid_height", "policy", "own", "cover", "shields", "outline", "grow"]
    fixed += [c for c in keep if c not in fixed]

    def placed(rows: DataFrame, shared: bool) -> DataFrame:
        for axis, numbers in tiles.items():
            rows = rows.withColumn(axis, F.explode(numbers))
        # the window needs a tile's rows in one task, which rows that lie scene by scene are already
        return (rows.repartition(*key) if shared else rows).withColumn("tile_place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("rank"))))

    rows = elements.fillna(0, ["grid_width", "grid_height"])
    large = F.col("grid_width").cast("long") * F.col("grid_height") > SHARED
    rows = placed(rows.where(~large), False).unionByName(placed(rows.where(large), True))
    return rows.select(*fixed) if late is None else rows.select(*fixed, late.alias("late")).select(*fixed, "late.*")


def _stretches(batches, names: list[str], tile: int):
    """Painted and its rows by name as Arrow arrays, stretch by stretch, of batches of _tiled()."""
    painter, last = _Painter(), 0
    for b in batches:
        if not b.num_rows:
            continue
        column = dict(zip(names, b.columns, strict=True))
        number = last + np.cumsum(column["tile_place"].to_numpy(False) == 1)
        last = number[-1]
        at = np.stack([column[k].to_numpy(False) for k in ("tile_x", "tile_y")], 1).astype(np.int64)
        size = np.stack([column[k].to_numpy(False) for k in ("grid_width", "grid_height")], 1).astype(np.int64)
        for p in painter.paint([number], np.concatenate([at * tile, at * tile + tile], 1), size, _Parts(column.__getitem__)):
            yield p, {k: v.slice(p.rows.start, p.rows.stop - p.rows.start) for k, v in column.items()}


def painted(elements: DataFrame, tile: int, kinds: str, emit, keep: tuple[str, ...] = (), late: Column | None = None) -> DataFrame:
    """scene_id, rank and the columns `kinds` that emit(Painted, columns) gives for the own cells of drawing_elements() on each tile.

    columns are a stretch's rows by name as Arrow arrays, with those of `elements` to
    keep and the fields of `late` (see _tiled); emit returns which of these rows each
    row of its is of, and an array for each column.
    """
    import pyarrow as pa

    rows = _tiled(elements, tile, keep, late)
    names = rows.columns
    kind = rows.schema["scene_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"scene_id {kind}, rank long, {kinds}")

    def run(batches):
        for p, own in _stretches(batches, names, tile):
            which, *got = emit(p, own)
            if len(which):
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([own["scene_id"].take(which), own["rank"].take(which), *(v if isinstance(v, pa.Array) else pa.array(v) for v in got)], schema.names)

    return rows.mapInArrow(run, schema)


def hidden(elements: DataFrame, tile: int = TILE) -> DataFrame:
    """The cells that elements own and none keeps, in runs along a row of a tile: scene_id, x0, x1, y."""
    import pyarrow as pa

    rows = _tiled(elements, tile)
    names = rows.columns

    def runs(state, base, box):
        """Tile, x0, x1 and y of the runs of owned cells that are not kept."""
        at = np.flatnonzero(state == 1)
        k = np.searchsorted(base, at, "right") - 1
        y, x = np.divmod(at - base[k], (box[:, 2] - box[:, 0])[k])
        begins = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (x == 0))
        n = np.diff(np.append(begins, len(at)))
        k, x = k[begins], x[begins] + box[k[begins], 0]
        return k, x, x + n, y[begins] + box[k, 1]

    def batch(scenes, found):
        k, *columns = found
        return pa.RecordBatch.from_arrays([scenes.take(pa.array(k)), *(pa.array(c.astype(np.int32)) for c in columns)], ["scene_id", "x0", "x1", "y"])

    def run(batches):
        left = None  # the last tile: its scene, state and box
        for p, own in _stretches(batches, names, tile):
            first, base, box = p.tiles
            state = np.zeros(int(base[-1] + (box[-1, 2] - box[-1, 0]) * (box[-1, 3] - box[-1, 1])), np.int8)
            if p.goes_on:
                state[: len(left[1])] = left[1]
            elif left is not None:
                yield batch(left[0], runs(left[1], np.zeros(1, np.int64), left[2]))
            state[p.spots[p.cells]] |= 1
            state[p.spots[p.kept]] |= 2
            yield batch(own["scene_id"].take(pa.array(first)), runs(state[: base[-1]], base, box))
            left = own["scene_id"].slice(first[-1], 1), state[base[-1] :], box[-1:]
        if left is not None:
            yield batch(left[0], runs(left[1], np.zeros(1, np.int64), left[2]))

    kind = rows.schema["scene_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"scene_id {kind}, x0 int, x1 int, y int")


def areas(elements: DataFrame, tile: int = TILE) -> DataFrame:
    """scene_id, rank, area, left: the cells of each of drawing_elements(), and those that it keeps."""
    each = painted(elements, tile, "area long, left long", lambda p, _: (np.arange(len(p.rects)), p.sums(p.cells), p.sums(p.kept)))
    return each.groupBy("scene_id", "rank").agg(F.sum("area").alias("area"), F.sum("left").alias("left"))


def _runs(p: Painted, keep: list[str], columns: dict):
    """x0, y0, x1, y1, kept of the runs along rows of cells, and the columns to keep; 0 is outside, 1 own, 2 kept, and a run begins where that changes."""
    state = p.cells.astype(np.int8) + p.kept
    begins = np.flatnonzero((p.x == p.rects[p.k, 0]) | (np.diff(state, prepend=-1) != 0))
    ends = np.append(begins[1:], len(state))
    use = state[begins] > 0
    at, n = begins[use], (ends - begins)[use]
    import pyarrow as pa

    whose = pa.array(p.k[at])
    cell = lambda v: v.astype(np.int32)
    return p.k[at], cell(p.x[at]), cell(p.y[at]), cell(p.x[at] + n), cell(p.y[at] + 1), state[at] == 2, *(columns[c].take(whose) for c in keep)


def pieces(elements: DataFrame, tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each element's own cells in runs along a row of a tile, and whether it keeps them: scene_id, rank, x0, y0, x1, y1, kept, and columns of `elements` to keep."""
    kinds = ", ".join([*(f"{c} int" for c in RECT), "kept boolean", *(f"{c} {elements.schema[c].dataType.simpleString()}" for c in keep)])
    return painted(elements, tile, kinds, lambda p, columns: _runs(p, keep, columns), keep)


def cells(piece_rows: DataFrame) -> DataFrame:
    """Single cells (scene_id, rank, x, y) of the pieces kept, with the pieces' other columns; for small canvases and for reveals."""
    rest = [c for c in piece_rows.columns if c not in ("scene_id", "rank", *RECT, "kept")]
    return piece_rows.where("kept").select("scene_id", "rank", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), F.col("y0").alias("y"), *rest)
