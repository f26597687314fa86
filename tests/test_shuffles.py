"""What goes over the disk: tables are shuffled once, and the rows are the same however canvases are shared out."""

import random

import pytest
from pyspark.sql import functions as F
from test_patches import same
from test_scenes import ELEMENT, element

from cuewright.operators import masks, reveal
from cuewright.plans import queries

D = "/root/testdata/sf0.001"


def exchanges(df):
    """By what a plan deals its rows out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1].split("(")[0] for line in plan.splitlines() if "Exchange " in line]


@pytest.mark.parametrize("name, sums", [("ink_cells", 0), ("brush_cells", 0), ("contour_masks", 1)])
def test_elements_are_shuffled_once(spark, name, sums):
    """And each element's sums over its tiles, if there are any."""
    assert exchanges(queries.QUERIES[name](spark, D)) == ["hashpartitioning"] * (1 + sums)


@pytest.fixture(scope="module")
def mixed(spark):
    """Scenes on canvases of several sizes, one without cells, with what paths are made of."""
    r, rows = random.Random(8), []
    for s, canvas in enumerate([(40, 24)] * 8 + [(0, 9), (300, 260), (70, 50), (300, 20)]):
        box = lambda most, canvas=canvas: (r.randrange(max(1, canvas[0] - 8)), r.randrange(max(1, canvas[1] - 8)), r.randint(1, most), r.randint(1, 12))
        rows += [element(s, k, f"e{k}", r.randint(1, 4), box(260 if canvas[0] == 300 else 14), 100 * r.randint(0, 2), policy=r.choice(masks.KEYS), protected=[box(4)], pad=r.randint(0, 3), canvas=canvas) for k in range(7)]
    return masks.drawing_elements(spark.createDataFrame(rows, ELEMENT), keep=("region", "position"))


@pytest.mark.parametrize("shared", [0, 1 << 40])
def test_canvases_are_shared_out_or_not_with_the_same_rows(mixed, monkeypatch, shared, tile=7):
    point = lambda x, y: F.struct((F.col("region.x") + x).cast("int").alias("x"), (F.col("region.y") + y).cast("int").alias("y"))
    path = F.when(F.col("position") % 3 != 0, F.struct(F.array(point(0, 0), point(9, 2), point(4, 6), point(2, 2)).alias("points"), F.array(F.lit(2)).alias("pen_lifts")))
    e = mixed.withColumn("frames", (F.col("rank") + 1).cast("int"))
    columns = e.withColumns({"points": path["points"], "pen_lifts": path["pen_lifts"]})
    want = masks.areas(mixed), masks.cells(masks.pieces(mixed)), reveal.inked(columns, 2), reveal.brushed(columns, 3)
    monkeypatch.setattr(masks, "SHARED", shared)
    same(masks.areas(mixed, tile), want[0])
    same(masks.cells(masks.pieces(mixed, tile)), want[1])
    same(reveal.inked(e, 2, tile, path), want[2])
    same(reveal.brushed(e, 3, tile, path), want[3])
