"""Every registered query against its SQL, and the plans behind them."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.oracle import ORACLE
from checks.queries import QUERIES
from pagelens import schemas
from pagelens.session import scratch_path

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    got = [tuple(row) for row in frame.select(columns).collect()]
    assert got
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["url_domain", "frontier_batches", "domain_boost"])
def test_scans_read_only_what_is_used(spark, name):
    text = plan(QUERIES[name](spark, str(DATA)))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


@needs_data
def test_outcomes_prune_the_html(spark):
    assert "html:string" not in plan(QUERIES["frontier_outcomes"](spark, str(DATA)))


def test_scratch_goes_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one.startswith(shared) and one != two


def test_scratch_without_a_folder_is_refused(spark, monkeypatch):
    monkeypatch.setattr("pagelens.session.CHECKPOINT_DIR", "pagelens.unset.dir")
    with pytest.raises(ValueError, match="shared|folder"):
        scratch_path(spark, "x")


def test_files_of_a_stream_grow_with_its_rows(spark):
    """A few files a batch would keep a few cores busy, however large the table."""
    cores = spark.sparkContext.defaultParallelism
    for rows, want in ((30, 2), (10_000, min(cores, 10_000 // (3 * queries.FILE_ROWS)))):
        frame = spark.range(rows).select(F.col("id").cast("string").alias("url"))
        path, a_batch = queries._files(frame, "files")
        found = spark.read.parquet(path)
        assert a_batch == max(2, want) and len(found.inputFiles()) == 3 * a_batch
        assert found.exceptAll(frame).isEmpty() and found.count() == rows


@pytest.mark.parametrize("file_rows", [queries.FILE_ROWS, 1])
def test_stream_resume_does_each_page_once(spark, tmp_path, monkeypatch, file_rows):
    """Two batches, and two more when it is started again, of few files and of many."""
    scratch = {}

    def path_of(session, label):
        return scratch.setdefault(label, scratch_path(session, label))

    monkeypatch.setattr(queries, "FILE_ROWS", file_rows)
    monkeypatch.setattr(queries, "scratch_path", path_of)
    hosts = ("http://www.a.org", "http://b.org", "https://blog.c.org")
    urls = [f"{host}/{n:0{n}}{end}" for host in hosts for n in range(1, 11) for end in ("", ".html")]
    rows = [(n, url, "<title>der</title>") for n, url in enumerate(urls)]
    spark.createDataFrame(rows, schemas.PAGE).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["stream_resume"](spark, str(tmp_path))
    want = {"SUCCESS": 10, "ERROR": 30, "completed": 10, "failed": 30}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    batches = {p.name for p in Path(scratch["stream"], "out", "results").iterdir()}
    assert batches == {f"batch={n}" for n in range(4)}
    files = [p for p in Path(scratch["fetch-files"]).iterdir() if p.suffix == ".parquet"]
    assert (len(files) > 8) == (file_rows == 1)
