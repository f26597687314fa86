"""The pipeline's stages, each against what its operator decides, on the smallest tables."""

import corpus_pipeline as pipeline
import pytest

from cuewright.llm import decontaminate, jaccard_join, mixing, toxicity
from cuewright.llm.common import durable

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = durable(spark.read.parquet(f"{D}/documents.parquet"))
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = durable(stage(spark, docs, D))
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "copy"]


def test_toxic_documents_go(spark, stages):
    scored = toxicity.classify(stages[0], spark.read.parquet(f"{D}/labels.parquet")).collect()
    assert ids(stages[1]) == sorted(r.doc_id for r in scored if not r.predicted)


def test_lines_go_by_brute_force(stages):
    from test_dedup import lines_left

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == {i: (t, len(t)) for i, t in lines_left(rows).items()}


def test_one_of_each_group_stays(stages):
    joined = jaccard_join.join(stages[2]).collect()
    assert ids(stages[3]) == sorted(r.doc_id for r in joined if r.doc_id == r.class_id)


def test_leaks_go(spark, stages):
    bad = {r.doc_id for r in decontaminate.contaminated(stages[3], spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert ids(stages[4]) == [i for i in ids(stages[3]) if i not in bad]


def test_the_mix_takes_its_copies(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[4]).collect()}
    assert ids(stages[5]) == sorted(i for i, c in copies.items() for _ in range(c))


def test_run_gives_the_last_stage(spark, stages):
    assert ids(pipeline.run(spark, D)) == ids(stages[5])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows):
    out = str(folder)
    spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_nulls_empty_texts_and_repeated_rows_pass_through(spark, tmp_path):
    plain = "some words of a text that nobody else has written here"
    rows = [(1, plain, "a"), (2, None, "a"), (3, "", None), (4, " ", "b"), (5, "says one two three four five six seven eight again", "b"), (6, f"{plain} at all", "b"), (7, "x y\nx y", None), (7, "x y\nx y", None), (None, "a null id\twith a tab", "a"), (8, "word " * 300_000, "c")]
    d = tables(spark, tmp_path, rows)
    out = pipeline.run(spark, d).collect()
    kept = {r.doc_id: r.text for r in out}
    # without models all documents pass; the near copy loses its line, the leak goes, and what has no words isn't taken
    assert {1, 7, None} <= set(kept) <= {1, 6, 7, 8, None} and 5 not in kept and kept[1] == plain and kept[7] == "x y"


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    out = pipeline.run(spark, tables(spark, tmp_path, []))
    assert out.collect() == [] and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
