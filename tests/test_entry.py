import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("plain_cues", "scene_rollup", "event_scenes", "parse_warnings", "annotation_report", "scene_frames", "allowed_areas", "replaced_subjects", "stroke_order")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, con, name):
    got = entry.queries()[name](spark, D)
    names = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, rows))
