"""Queries beside their SQL, and the pipeline beside its operators done by hand."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from pagelens.llm import op1, op3, op7, op9, op10
from pagelens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(ORACLE) < set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(map(repr, (tuple(r) for r in frame.select(columns).collect())))
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert got == sorted(repr(tuple(r)) for r in result.fetchall())


def test_pipeline_is_its_stages(spark):
    """Each stage keeps the rows that its operator's answers say, with all columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    def ids(frame):
        return sorted(r.doc_id for r in frame.select("doc_id").collect())

    good = stages[0](spark, docs, SF).cache()
    scored = op7.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == docs.columns
    assert ids(good) == ids(scored.where("score >= 0.5")) and good.count() < docs.count()
    known = stages[1](spark, good, SF).cache()
    assert known.columns == docs.columns
    learnt = op10.learn(good.where("crc32(cast(doc_id AS string)) % 5 != 0"))
    assert ids(known) == ids(op10.identify(good, learnt).where("lang_pred != 'und'"))
    single = stages[2](spark, known, SF).cache()
    assert ids(single) == ids(op1.exact_copies(known).where("kept"))
    apart = stages[3](spark, single, SF).cache()
    assert apart.columns == docs.columns
    assert ids(apart) == ids(op3.near_copies(single).where("kept"))
    assert apart.count() < single.count() < known.count()
    packed = stages[4](spark, apart, SF)
    assert sorted(tuple(r)[:5] for r in packed.collect()) == sorted(
        tuple(r)[:5] for r in op9.pack(apart).collect()
    )
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r[:5] for r in whole) == sorted(r[:5] for r in packed.collect())


def test_pipeline_of_hard_rows(spark, hard, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs, least in ((hard, 1), (nothing, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == hard.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.count() >= least
