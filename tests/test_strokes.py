import random

from pyspark.sql import functions as F

from cuewright.operators import strokes
from cuewright.plans import queries

OUTLINE = "scene_id long, char_pos long, contour_pos long, pts array<struct<x:double,y:double>>"


def square(x, side, turned=False):
    pts = [(x, 0.0), (x + side, 0.0), (x + side, side), (x, side)]
    return pts[::-1] if turned else pts


def test_counts_without_a_join_are_those_of_the_strokes(spark):
    pick = random.Random(7)
    rows = [(s, c, k, square(float(k), pick.choice((0.0, 1.0, 3.0, 4.0, 4.0, 9.0)), pick.random() < 0.5)) for s in range(40) for c in range(3) for k in range(pick.randrange(1, 6))]
    outlines = spark.createDataFrame(rows, OUTLINE)
    ch = F.when(F.col("char_pos") == 1, "y").otherwise("x")
    chars = outlines.select("scene_id", "char_pos").distinct().withColumn("ch", ch)
    want = strokes.strokes_per_char(strokes.strokes(outlines, width=320, height=180, size=60), chars)
    got = strokes.last_counts(strokes.stroke_counts(outlines).withColumn("ch", ch))
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r.strokes for r in got.collect()} >= {0, 1, 2}


def test_strokes_of_characters_sorts_its_outlines_once(spark):
    plan = queries.strokes_of_characters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Window [") == 1 and "Join" not in plan, plan
