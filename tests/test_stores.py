"""The index of seen URLs and the fetch store: equal answers, and what they read."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.defaults import DEFAULT_CATEGORIES
from pagelens.operators import frontier
from pagelens.operators.fetches import one_per_url
from pagelens.operators.model import fit
from pagelens.plans import runs
from pagelens.sources import fetch_store, queue_log, seen_index, sinks
from pagelens.sources.categories import categories_frame
from pagelens.streaming import runs as R


@pytest.fixture(scope="module")
def model(spark):
    return fit(categories_frame(spark, DEFAULT_CATEGORIES))


def urls(spark, numbers):
    return spark.range(0).select("id").unionByName(
        spark.createDataFrame([(n,) for n in numbers], "id long")
    ).select(F.concat(F.lit("http://u.test/"), "id").alias("url"))


def numbers(frame):
    return sorted(int(r.url.rsplit("/", 1)[1]) for r in frame.collect())


def test_index_over_segments_and_compaction(spark, tmp_path):
    path = str(tmp_path / "index")
    seen_index.create_index(spark, path, buckets=8)
    asked = urls(spark, range(0, 400, 5))
    assert numbers(seen_index.unseen(asked, path)) == list(range(0, 400, 5))
    # Segments of different sizes have filters of different widths; one is empty.
    for segment, part in enumerate([range(0, 100), [], range(90, 300), [305]]):
        seen_index.add_segment(urls(spark, part), path, segment)
    want = [n for n in range(0, 400, 5) if n >= 300 and n != 305]
    assert len(set(seen_index._segments(spark, path).values())) > 1
    assert numbers(seen_index.unseen(asked, path)) == want
    seen_index.compact(spark, path)
    assert list(seen_index._segments(spark, path)) == [3]
    assert numbers(seen_index.unseen(asked, path)) == want
    seen_index.add_segment(urls(spark, [300]), path, 4)
    seen_index.compact(spark, path)
    assert numbers(seen_index.unseen(asked, path)) == [n for n in want if n != 300]
    with pytest.raises(ValueError, match="not behind"):
        seen_index.add_segment(urls(spark, [1]), path, 4)


def test_tidy_keeps_few_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    seen_index.create_index(spark, path, buckets=1)
    for segment in range(6):
        seen_index.add_segment(urls(spark, range(segment * 8, segment * 8 + 8)), path, segment)
        seen_index.tidy(spark, path)
    # Each segment is larger than the one behind it.
    widths = [w for _, w in sorted(seen_index._segments(spark, path).items())]
    assert widths == sorted(widths, reverse=True) and len(set(widths)) == len(widths) < 4
    assert seen_index.last_segment(spark, path) == 5
    assert numbers(seen_index.unseen(urls(spark, range(44, 52)), path)) == [48, 49, 50, 51]


def test_stream_indexes_earlier_batches_and_not_its_own(spark, model, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "run")
    state = spark.createDataFrame([("seen", "http://u.test/0", 0)], schemas.QUEUE)

    def go():
        stream = spark.readStream.schema(schemas.FETCH).option("maxFilesPerTrigger", 1).parquet(source)
        checkpoint = str(tmp_path / "cp")
        R.run_stream(stream, model, path, checkpoint, state, buckets=2).awaitTermination()
        return sorted((r.url, r.batch) for r in R.stream_outcomes(spark, path).collect())

    for n in (2, 4):
        fetches(spark, n).coalesce(1).write.mode("append").parquet(source)
        got = go()
    name = "http://u.test/"
    assert got == [(f"{name}1", 0), (f"{name}2", 1), (f"{name}3", 1)]
    # The last batch is not in the index, so that it can be replayed.
    assert numbers(seen_index.unseen(urls(spark, [1, 2, 3]), f"{path}/seen")) == [2, 3]
    R._index_batches(spark, path, f"{path}/seen", 1)
    assert numbers(seen_index.unseen(urls(spark, [1, 2, 3]), f"{path}/seen")) == [2, 3]


def test_index_of_no_urls(spark, tmp_path):
    path = str(tmp_path / "index")
    seen_index.create_index(spark, path, buckets=4)
    seen_index.add_segment(urls(spark, []), path, 0)
    assert numbers(seen_index.unseen(urls(spark, [1, 2]), path)) == [1, 2]
    assert seen_index.unseen(urls(spark, []), path).count() == 0


def test_new_urls_read_few_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    seen_index.create_index(spark, path, buckets=64)
    seen_index.add_segment(urls(spark, range(20_000)), path, 0)
    # Forty new URLs lie in some 30 buckets; hardly one passes its filter.
    new = urls(spark, range(10**6, 10**6 + 40))
    assert len(seen_index.buckets_read(new, path)) <= 3
    # One that was seen is read in its bucket, from the one file that holds it.
    both = new.union(urls(spark, [77]))
    assert numbers(seen_index.unseen(both, path)) == numbers(new)
    bucket = seen_index.buckets_read(urls(spark, [77]), path)
    held = seen_index._read(spark, path, "urls", seen_index.URL, bucket)
    assert len(bucket) == 1 and len({r[0] for r in held.select(F.input_file_name()).collect()}) == 1
    text = held._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in text[text.index("PartitionFilters") :].split("]")[0]
    # The filters pass few of many others.
    many = urls(spark, range(10**6, 10**6 + 20_000))
    assert seen_index.possible(many, path).count() < 400


def test_what_a_failure_left_in_the_index_is_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    seen_index.create_index(spark, path, buckets=4)
    seen_index.add_segment(urls(spark, range(5)), path, 0)
    # Written, and not committed.
    rest = urls(spark, [7, 8]).withColumn("bucket", F.lit(1))
    rest.write.partitionBy("bucket").parquet(f"{path}/urls/segment=1/base=1")
    asked = urls(spark, range(10))
    assert numbers(seen_index.unseen(asked, path)) == [5, 6, 7, 8, 9]
    seen_index.add_segment(urls(spark, [6]), path, 1)
    assert numbers(seen_index.unseen(asked, path)) == [5, 7, 8, 9]


def fetches(spark, n, prefix="http://u.test/"):
    return spark.createDataFrame(
        [
            (
                f"{prefix}{i}", None, 500 if i % 4 == 3 else 200, "text/html", None, None,
                f"<title>hospital doctor</title><p>page {i}</p>", dt.datetime(2026, 1, 1),
            )
            for i in range(n)
        ],
        schemas.FETCH,
    )


def lines(spark, part):
    rows = [(f" http://u.test/{n}/ ", i) for i, n in enumerate(part)]
    return spark.createDataFrame([*rows, ("# no", 900), ("ftp://x", 901)], "value string, seq long")


def test_logged_runs_agree_with_and_without_an_index(spark, model, tmp_path):
    nothing = spark.createDataFrame([], schemas.QUEUE)
    answers = []
    for name, index in (("plain", None), ("indexed", str(tmp_path / "index"))):
        log = str(tmp_path / f"log-{name}")
        queue_log.create_log(nothing, log)
        if index:
            seen_index.create_index(spark, index, buckets=4)
        got = []
        for i, part in enumerate([[0, 1, 1, 2, 50], [2, 3, 0, 60], [4, 60, 61]]):
            path = str(tmp_path / f"{name}-{i}")
            state = runs.run_logged(
                lines(spark, part), fetches(spark, 10), model, path, log, index=index
            )
            counters = spark.read.json(f"{path}/counters").first()
            got.append((sorted(map(tuple, state.collect()), key=str), sorted(counters.asDict().items())))
            if i == 1:
                queue_log.compact(spark, log)
        answers.append(got)
    assert answers[0] == answers[1]
    assert answers[0][0][1] == [("added", 4), ("duplicate", 1), ("invalid", 1)]
    # The index follows the log: behind it by the last run, which the next one adds.
    assert seen_index.last_segment(spark, index) == 2
    seen_index.follow(spark, index, log)
    assert seen_index.last_segment(spark, index) == 3
    assert numbers(seen_index.unseen(urls(spark, [61, 62]), index)) == [62]


def test_lines_are_read_once(spark, tmp_path):
    once = frontier.line_counts(frontier.parse_lines(lines(spark, [1, 1, 2])))
    assert once._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    parsed = frontier.parse_lines(lines(spark, [1, 1, 2, 3]))
    seen = urls(spark, [3])
    counts = frontier.line_counts(parsed)
    fresh = frontier.counted_urls(counts).join(seen, "url", "left_anti")
    assert frontier.counters_of(counts, fresh).collect() == frontier.load_counters(parsed, seen).collect()
    assert sorted(fresh.collect()) == sorted(frontier.new_urls(parsed, seen).select("url", "seq").collect())


def test_store_meets_a_large_queue_without_moving_html(spark, model, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    fetch_store.write_fetch_store(fetches(spark, 12), path, buckets=4)
    stored = fetch_store.read_fetch_store(spark, path)
    assert fetch_store.store_buckets(spark, path) == 4 and stored.count() == 12
    pending = urls(spark, [1, 3, 8, 99])
    monkeypatch.setattr(runs, "BROADCAST_BYTES", 0)
    plain = runs.results_for(fetches(spark, 12), pending, model, 10)
    found = runs.results_for(stored, pending, model, 10, fetch_buckets=4)
    columns = sorted(plain.columns)
    want = sorted(plain.select(columns).collect(), key=str)
    assert sorted(found.select(columns).collect(), key=str) == want and len(want) == 3

    # Above the scan of HTML there is no exchange: the only ones deal the queue.
    chosen = fetch_store.pick(stored, pending, 4)
    wide = one_per_url(runs.categorise_fetches(chosen, model))
    text = wide._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "Bucketed: true" in text
    rows = text.splitlines()
    scan = next(i for i, row in enumerate(rows) if "FileScan parquet" in row)
    assert not any("Exchange" in row for row in rows[: scan + 1])


def test_store_keeps_one_fetch_a_url_and_takes_more(spark, model, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    day = F.expr("INTERVAL 1 DAY")
    late = fetches(spark, 3).withColumn("http_code", F.lit(404)).withColumn(
        "crawled_at", F.col("crawled_at") + day
    )
    slashed = late.withColumn("url", F.concat("url", F.lit("/")))
    broken = fetches(spark, 2, "ftp://no/").unionByName(
        fetches(spark, 1).withColumn("url", F.lit(None).cast("string"))
    )
    fetch_store.write_fetch_store(fetches(spark, 5).unionByName(slashed).unionByName(broken), path, 4)
    stored = fetch_store.read_fetch_store(spark, path)
    got = sorted((r.url, r.http_code) for r in stored.select("url", "http_code").collect())
    codes = [404, 404, 404, 500, 200]
    assert got == [(f"http://u.test/{i}", c) for i, c in enumerate(codes)]

    # A session that does not know the table finds it by its path.
    spark.sql(f"DROP TABLE {fetch_store._table(path)}")
    newer = fetches(spark, 1).withColumn("crawled_at", F.col("crawled_at") + 2 * day)
    fetch_store.append_fetches(newer, path)
    stored = fetch_store.read_fetch_store(spark, path)
    assert stored.count() == 6
    monkeypatch.setattr(runs, "BROADCAST_BYTES", 0)
    state = runs.run(
        lines(spark, range(5)), stored, model, str(tmp_path / "run"), fetch_buckets=4
    )
    stats = frontier.frontier_stats(state).first()
    assert (stats.pending, stats.completed, stats.failed) == (0, 2, 3)
    assert sinks.read_report(spark, str(tmp_path / "run" / "report")).count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        fetch_store.write_fetch_store(fetches(spark, 1), path, 4)


def test_store_without_fetches(spark, model, tmp_path):
    path = str(tmp_path / "store")
    fetch_store.write_fetch_store(fetches(spark, 0), path, 2)
    stored = fetch_store.read_fetch_store(spark, path)
    assert stored.count() == 0
    assert fetch_store.pick(stored, urls(spark, [1]), 2).count() == 0
