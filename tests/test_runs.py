"""Whole runs, in batch and as streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.defaults import DEFAULT_CATEGORIES
from pagelens.operators import frontier, summary
from pagelens.operators.model import fit
from pagelens.plans.runs import (
    Steps,
    batched_results,
    categorise_pages,
    queue_lines,
    results_for,
    run,
    run_logged,
)
from pagelens.sources import queue_log, sinks
from pagelens.sources.categories import categories_frame
from pagelens.streaming import pages as S
from pagelens.streaming import runs as R

WORDS = ["software cloud", "hospital doctor", "stock market", "hello", "hotel flight"]


def html(i):
    return f"<title>{WORDS[i % 5]}</title><p>{WORDS[i % 5]} page {i}</p>"


@pytest.fixture(scope="module")
def model(spark):
    return fit(categories_frame(spark, DEFAULT_CATEGORIES))


@pytest.fixture(scope="module")
def page_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows = [(i, f"http://www.site{i % 7}.org/{i // 2}/", html(i)) for i in range(60)]
    spark.createDataFrame(rows, schemas.PAGE).repartition(6).write.parquet(path)
    return path


def fetches(spark, n):
    return spark.createDataFrame(
        [
            (
                f"http://x.org/{i}", None, 500 if i % 4 == 3 else 200, "text/html",
                None, None, html(i), dt.datetime(2026, 1, 1),
            )
            for i in range(n)
        ],
        schemas.FETCH,
    )


def lines(spark, numbers):
    rows = [(f" http://x.org/{n}/ ", i) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "value string, seq long")


def test_run_then_resume(spark, model, tmp_path):
    def go(numbers, fetched, name, state=None, **options):
        path = str(tmp_path / name)
        return run(lines(spark, numbers), fetches(spark, fetched), model, path, state, **options)

    state = go([0, 1, 1, 3], 10, "one", json_export=True)
    assert frontier.frontier_stats(state).first().asDict() == {
        "pending": 0, "completed": 2, "failed": 1, "total_seen": 3, "is_empty": True,
    }
    report = sinks.read_report(spark, str(tmp_path / "one" / "report"))
    got = {r.url: (r.category, r.status, r.error) for r in report.collect()}
    assert got == {
        "http://x.org/0": ("Technology", "SUCCESS", ""),
        "http://x.org/1": ("Healthcare", "SUCCESS", ""),
        "http://x.org/3": ("Uncategorized", "ERROR", "HTTP 500"),
    }

    # Seen URLs are not redone, the failed one included; pending ones stay queued.
    state = go([3, 0, 4, 99], 10, "two", state)
    counters = spark.read.json(str(tmp_path / "two" / "counters")).first()
    assert (counters.added, counters.invalid, counters.duplicate) == (2, 0, 2)
    stats = frontier.frontier_stats(state).first()
    assert (stats.pending, stats.completed, stats.total_seen) == (1, 3, 5)

    state = go([0], 100, "three", state)
    assert frontier.frontier_stats(state).first().is_empty
    with pytest.raises(ValueError, match="no valid URLs"):
        go([0], 10, "four", state)


def test_both_ways_of_matching_agree(spark, model):
    begun, _ = queue_lines(lines(spark, [1, 2, 50]))
    pending = begun.filter("list = 'pending'")
    small = results_for(fetches(spark, 10), pending, model, 3)
    large = results_for(fetches(spark, 10), pending, model, 10**12)
    assert sorted(small.collect(), key=str) == sorted(large.select(small.columns).collect(), key=str)
    assert sorted(r.url for r in small.collect()) == ["http://x.org/1", "http://x.org/2"]
    # The large way must not carry HTML through the join.
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("html")


def test_run_matches_fetches_by_normalised_url(spark, model, tmp_path):
    stored = fetches(spark, 4).withColumn("url", F.concat("url", F.lit("/")))
    state = run(lines(spark, range(4)), stored, model, str(tmp_path / "r"))
    assert frontier.frontier_stats(state).first().pending == 0


def test_batches_of_a_run(spark, model):
    begun, _ = queue_lines(lines(spark, range(10)))
    queue = begun.filter("list = 'pending'")
    results = results_for(fetches(spark, 10), queue, model, 10)
    rows = summary.batch_progress(batched_results(results, queue, 4)).orderBy("batch").collect()
    assert [(r.urls, r.succeeded, r.processed) for r in rows] == [(4, 3, 4), (4, 3, 8), (2, 2, 10)]


@pytest.fixture(scope="module")
def large(spark):
    return fit(categories_frame(spark, DEFAULT_CATEGORIES), inline_entries=0)


@pytest.mark.parametrize("form", ["model", "large"])
def test_stream_equals_batch(spark, request, form, page_files, tmp_path):
    model = request.getfixturevalue(form)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        stream = S.read_page_stream(spark, page_files, files_per_trigger=2)
        query = R.categorise_stream(stream, model, out, checkpoint)
        S.drain(query)
        return query

    assert len(go().recentProgress) >= 3
    batch = categorise_pages(spark.read.schema(schemas.PAGE).parquet(page_files), model)
    got = spark.read.schema(batch.schema).parquet(out).drop("batch")
    assert sorted(got.collect()) == sorted(batch.collect())

    # A restart with nothing new adds nothing.
    go()
    assert spark.read.schema(batch.schema).parquet(out).count() == 60


def test_run_stream_stops_and_goes_on(spark, model, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))
    state = frontier.start_state(
        frontier.distinct_urls(frontier.parse_lines(lines(spark, range(20))))
    )
    known = state.where("url = 'http://x.org/2'")

    def go():
        stream = S.read_page_stream(spark, source, schemas.FETCH, files_per_trigger=1)
        S.drain(R.run_stream(stream, model, out, checkpoint, known))
        counts = {r.status: r.n for r in R.stream_counters(spark, out).collect()}
        return counts, sorted(r.url for r in R.stream_report(spark, out).collect())

    fetches(spark, 6).repartition(3, "url").write.parquet(source)
    assert go() == ({"SUCCESS": 4, "ERROR": 1}, [f"http://x.org/{i}" for i in (0, 1, 3, 4, 5)])
    # The first ones come again, with a slash; only the rest is done.
    again = fetches(spark, 12).withColumn("url", F.concat("url", F.lit("/")))
    again.repartition(3, "url").write.mode("append").parquet(source)
    counts, urls = go()
    assert counts == {"SUCCESS": 8, "ERROR": 3} and len(urls) == len(set(urls)) == 11
    queue = frontier.frontier_stats(R.stream_queue(spark, out, state)).first()
    assert (queue.pending, queue.completed, queue.failed) == (9, 8, 3)


def test_stream_deduplicates_across_batches(spark, page_files, tmp_path):
    stream = S.read_page_stream(spark, page_files, files_per_trigger=2)
    out = str(tmp_path / "urls")
    S.drain(S.append_stream(S.distinct_url_stream(stream, "page_id"), out, str(tmp_path / "cp")))
    got = [r.url for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == len({(i % 7, i // 2) for i in range(60)})
    assert not any(u.endswith("/") for u in got)


def test_stream_deduplicates_within_watermark(spark, tmp_path):
    source = str(tmp_path / "src")
    moment = dt.datetime(2026, 1, 1)
    rows = [(f"http://a.org/{i % 3}", i, moment) for i in range(30)]
    schema = "url string, page_id long, crawled_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    unique = S.distinct_url_stream(stream, "page_id", "crawled_at", "1 hour")
    S.drain(S.append_stream(unique, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_running_counts(spark, page_files, tmp_path):
    stream = S.read_page_stream(spark, page_files, files_per_trigger=2)
    marked = stream.withColumn(
        "status", F.when(F.col("page_id") < 20, "ERROR").otherwise("SUCCESS")
    )
    out = str(tmp_path / "counts")
    S.drain(S.count_stream(S.status_counts(marked), out, str(tmp_path / "cp")))
    got = {r.status: r.n for r in S.latest_counts(spark, out).collect()}
    assert got == {"ERROR": 20, "SUCCESS": 40}
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3


def repeated(spark, order):
    """A page that came late, one that failed late, one with equal times, one without any."""
    at = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    rows = [
        ("http://x.org/0", 500, at[0], 0), ("http://x.org/0/", 200, at[1], 1),
        ("http://x.org/1/", 200, at[1], 2), ("http://x.org/1", 404, at[2], 3),
        ("http://x.org/2", 404, at[1], 4), ("http://x.org/2/", 200, at[1], 0),
        ("http://x.org/3", 200, None, 1), ("http://x.org/3", 404, at[0], 2),
        *[("http://x.org/4", 200, at[0], n) for n in range(5)],
    ]
    rows = [
        (url, None, code, "text/html", None, None, html(n), when) for url, code, when, n in rows
    ]
    return spark.createDataFrame(order(rows), schemas.FETCH).coalesce(1)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_repeated_urls_have_one_result_in_any_order(spark, model, tmp_path, monkeypatch, limit):
    monkeypatch.setattr("pagelens.plans.runs.BROADCAST_BYTES", limit)
    found = set()
    for n, order in enumerate((list, lambda rows: rows[::-1], lambda rows: rows[3:] + rows[:3])):
        fetched = repeated(spark, order)
        state = run(lines(spark, range(5)), fetched, model, str(tmp_path / f"run{n}"))
        report = sinks.read_report(spark, str(tmp_path / f"run{n}" / "report"))
        fetched.write.parquet(str(tmp_path / f"files{n}"))
        stream = S.read_page_stream(spark, str(tmp_path / f"files{n}"), schemas.FETCH)
        out = str(tmp_path / f"stream{n}")
        S.drain(R.run_stream(stream, model, out, str(tmp_path / f"checkpoint{n}")))
        for rows in (report, R.stream_report(spark, out)):
            found.add(tuple(sorted((r.url, r.status, r.title, r.error) for r in rows.collect())))
        done = state.where("list IN ('completed', 'failed')").select("list", "url")
        outcomes = R.stream_outcomes(spark, out).select("list", "url")
        assert sorted(map(tuple, done.collect())) == sorted(map(tuple, outcomes.collect()))
        assert done.count() == 5
    assert len(found) == 1
    assert [r[1] for r in next(iter(found))] == ["SUCCESS", "ERROR", "SUCCESS", "ERROR", "SUCCESS"]


def folded(spark, log):
    return sorted(map(repr, map(tuple, queue_log.read_log(spark, log).collect())))


def written(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_the_log_folds_to_the_state_of_plain_runs(spark, model, tmp_path):
    """Two runs; the second does what the first left, and writes its own changes only."""
    log = str(tmp_path / "log")
    nothing = spark.createDataFrame([], schemas.QUEUE)
    queue_log.create_log(nothing, log)
    state = nothing
    for n, (numbers, count) in enumerate([(range(2000), 1500), ([0, 1, 1501, 1501, 3000], 1502)]):
        given = (lines(spark, numbers), fetches(spark, count), model)
        state = run(*given, str(tmp_path / f"plain{n}"), state)
        after = run_logged(*given, str(tmp_path / f"logged{n}"), log)
        want = sorted(map(repr, map(tuple, state.select("list", "url").collect())))
        assert sorted(map(repr, map(tuple, after.select("list", "url").collect()))) == want
        order = lambda frame: [
            r.url for r in frame.where("list = 'pending'").orderBy("seq", "url").collect()
        ]
        assert order(after) == order(state)
    small = written(tmp_path / "log" / "deltas" / "run=2")
    assert small < written(tmp_path / "log" / "deltas" / "run=1") / 4
    before = folded(spark, log)
    queue_log.compact(spark, log)
    assert queue_log.last_runs(spark, log) == (2, 2) and folded(spark, log) == before
    queue_log.compact(spark, log)
    assert folded(spark, log) == before


def test_what_a_failure_left_in_the_log_is_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    state = spark.createDataFrame([("pending", "a", 1), ("seen", "a", 1)], schemas.QUEUE)
    queue_log.create_log(state, log)
    before = folded(spark, log)
    results = spark.createDataFrame([("a", "SUCCESS")], "url string, status string")
    fresh = spark.createDataFrame([("b", 2)], "url string, seq long")
    changes = queue_log.run_changes(fresh, results)
    for run_of in (1, 7):
        changes.write.parquet(f"{log}/deltas/run={run_of}")
    assert folded(spark, log) == before
    queue_log.append_changes(changes, log, 1)
    after = folded(spark, log)
    assert after != before and len(after) == 4
    with pytest.raises(ValueError, match="not behind"):
        queue_log.append_changes(changes, log, 1)
    queue_log.append_changes(queue_log.run_changes(fresh.limit(0), results), log, 2)
    assert folded(spark, log) == after


class Stopped(Exception):
    pass


@pytest.mark.parametrize("logged", [False, True])
def test_a_run_goes_on_behind_its_last_finished_step(spark, model, tmp_path, monkeypatch, logged):
    """Stopped before each step in turn and started again, each step is done once."""
    given = (lines(spark, [0, 1, 3, 9]), fetches(spark, 5), model)
    log = str(tmp_path / "log")
    queue_log.create_log(spark.createDataFrame([], schemas.QUEUE), log)

    def go(name):
        path = str(tmp_path / name)
        if logged:
            return run_logged(*given, path, log, json_export=True)
        return run(*given, path, json_export=True, resume=True)

    once, begun = Steps.once, []

    def stopping(self, name, step):
        def noted():
            begun.append(name)
            step()

        if name not in self.done and name not in stopped:
            stopped.append(name)
            raise Stopped
        once(self, name, noted)

    stopped: list[str] = []
    monkeypatch.setattr(Steps, "once", stopping)
    for _ in range(5):
        with pytest.raises(Stopped):
            go("one")
    state = go("one")
    assert begun == ["queue", "results", "report", "export", "log" if logged else "state"]
    assert frontier.frontier_stats(state).first().asDict() == {
        "pending": 1, "completed": 2, "failed": 1, "total_seen": 4, "is_empty": False,
    }
    again = go("one")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, state.collect()))
    assert len(begun) == 5
