import random

import pytest
from pyspark.sql import functions as F
from test_scenes import ELEMENT, element

from cuewright.operators import masks, patches, raster, reveal


@pytest.fixture(scope="module")
def drawn(spark):
    """Elements with protected regions, which cut holes, on small canvases and one that needs several tiles."""
    r, rows = random.Random(5), []
    for s, canvas in enumerate([(40, 24)] * 12 + [(300, 20)]):
        box = lambda most, canvas=canvas: (r.randrange(canvas[0] - 8), r.randrange(canvas[1] - 8), r.randint(1, most), r.randint(1, 8))
        for k in range(6):
            rows.append(element(s, k, f"e{k}", k + 1, box(260 if s == 12 else 14), 100 * k, policy=r.choice(masks.KEYS), protected=[box(4) for _ in range(3)], pad=r.randint(0, 3), canvas=canvas))
    ring = [(3, 3, 4, 4), (12, 3, 1, 1), (14, 8, 3, 2)]
    rows.append(element(20, 0, "ring", 1, (1, 1, 20, 12), policy="explicit", protected=ring, canvas=(40, 24)))
    return masks.drawing_elements(spark.createDataFrame(rows, ELEMENT).withColumn("path", F.array(F.struct(F.lit(2).alias("x"), F.lit(2).alias("y")))), keep=("path",))


def same(a, b):
    rows = lambda t: sorted(map(str, (r.asDict(recursive=True) for r in t.select(*sorted(t.columns)).collect())))
    got, want = rows(a), rows(b)
    assert got == want and got


def test_patches_beside_one_another_give_what_each_gives_alone(drawn):
    cells = masks.cells(masks.pieces(drawn))
    cells.cache()
    for edge, tile in ((1, 4), (2, 128)):
        same(patches.components(drawn, edge, tile), raster.grid_components(cells, edge, tile))
    same(patches.skeletons(drawn, 300, 24), raster.skeleton_cells(cells, 300, 24))
    same(patches.borders(drawn), raster.component_borders(raster.grid_components(cells)))
    assert patches.borders(drawn).where("scene_id = 20").count() == 4
    same(patches.stroke_paths(drawn, 2, 40, 24), raster.stroke_paths(raster.serpentine(raster.grid_components(cells, 2), 2, 40, 24)))


@pytest.mark.parametrize("tile", [7, 256])
def test_reveals_where_cells_are_painted(drawn, tile):
    cells = masks.cells(masks.pieces(drawn))
    point = lambda x, y: F.struct((F.col("own.x0") + x).cast("int").alias("x"), (F.col("own.y0") + y).cast("int").alias("y"))
    path = F.when(F.col("rank") % 3 != 0, F.array(point(0, 0), point(9, 2), point(4, 6), point(2, 2)))
    e = drawn.withColumns({"points": path, "pen_lifts": F.array(F.lit(2)), "frames": (F.col("rank") + 1).cast("int")})
    paths = e.where("points is not null").select("scene_id", "rank", "points", "pen_lifts", "frames")
    same(reveal.inked(e, 2, tile), reveal.ink_frames(cells, paths, 2))
    same(reveal.brushed(e, 3, tile), reveal.brush_frames(cells, paths, 3))
    rects = drawn.select("scene_id", "rank", "direction", F.col("cover").alias("rect"))
    same(reveal.wiped_frames(drawn, 6, tile), reveal.wipe_frames(cells, rects, 6))
    p = masks.pieces(drawn, tile)
    content = p.select("scene_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), F.col("y0").alias("y"))
    written = drawn.groupBy("scene_id").agg(F.max("rank").alias("written"))
    same(reveal.finish_runs(masks.hidden(drawn, tile), written, "fade-full", 3), reveal.finish_cells(content, masks.cells(p), written, "fade-full", 3))
