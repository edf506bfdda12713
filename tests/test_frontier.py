"""URL queue: loading, counting, batching, resuming."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.operators import frontier as Q
from pagelens.operators.ranks import running_total
from pagelens.sources import tables


def lines(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, seq long")


def urls(frame):
    return [r.url for r in frame.orderBy("seq").collect()]


def stats(state):
    return Q.frontier_stats(state).first().asDict()


def test_lines_of_a_file_are_counted_by_kind(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("http://one.test/a\n\n   # later: http://two.test\nHTTP://two.test/b/\r\n#\nwww.three\n")
    parsed = Q.parse_lines(tables.read_url_list(spark, str(path)))
    assert Q.load_counters(parsed).first().asDict() == {"added": 2, "invalid": 1, "duplicate": 0}
    assert stats(Q.start_state(Q.new_urls(parsed)))["pending"] == 2


def test_spellings_of_a_url_are_one(spark):
    spellings = ["http://one.test/a//", " http://one.test/a", "http://one.test/b", "http://one.test/a/"]
    parsed = Q.parse_lines(lines(spark, spellings))
    assert urls(Q.new_urls(parsed)) == ["http://one.test/a", "http://one.test/b"]
    assert Q.load_counters(parsed).first().asDict() == {"added": 2, "invalid": 0, "duplicate": 2}


def test_new_urls_stand_behind_stored_ones(spark):
    def parsed(letter, n):
        return Q.parse_lines(lines(spark, [f"http://{letter}.test/{i}" for i in range(n)]))

    state = Q.start_state(Q.new_urls(parsed("old", 6)))
    both = Q.start_state(Q.new_urls(parsed("new", 6)), state).filter("list = 'pending'")
    assert urls(Q.pop_batch(both, 4)[0]) == [f"http://old.test/{i}" for i in range(4)]
    sizes = Counter(r.batch for r in Q.assign_batches(both, 5).collect())
    assert sizes == {1: 5, 2: 5, 3: 2}


def test_equal_positions_do_not_share_a_rank(spark):
    frame = spark.createDataFrame([(f"u{i}", i // 4) for i in range(20)], "url string, seq long")
    assert Counter(r.batch for r in Q.assign_batches(frame, 6).collect()) == {1: 6, 2: 6, 3: 6, 4: 2}


def test_order_is_first_occurrence(spark):
    values = ["http://b.x", "http://a.x", "http://b.x/", "http://c.x", "http://a.x"]
    parsed = Q.parse_lines(lines(spark, values).repartition(3))
    assert urls(Q.new_urls(parsed)) == ["http://b.x", "http://a.x", "http://c.x"]


def test_a_popped_batch_leaves_the_rest(spark):
    queue = spark.createDataFrame([(f"http://{c}.test", i * 9) for i, c in enumerate("zyxwv")], "url string, seq long")
    batch, rest = Q.pop_batch(queue, 3)
    assert urls(batch) == [f"http://{c}.test" for c in "zyx"]
    assert urls(rest) == [f"http://{c}.test" for c in "wv"]


def test_outcomes_and_resume(spark):
    parsed = Q.parse_lines(lines(spark, ["https://a.com", "https://b.com", "https://c.com"]))
    state = Q.start_state(Q.new_urls(parsed))
    results = spark.createDataFrame(
        [("https://a.com", "SUCCESS"), ("https://a.com", "SUCCESS"), ("https://b.com", "ERROR")],
        "url string, status string",
    )
    state = Q.advance_state(state, results)
    assert stats(state) == {
        "pending": 1, "completed": 1, "failed": 1, "total_seen": 3, "is_empty": False,
    }
    again = Q.parse_lines(lines(spark, ["https://a.com/", "https://b.com", "https://d.com"]))
    seen = state.filter("list = 'seen'")
    assert urls(Q.new_urls(again, seen)) == ["https://d.com"]
    assert Q.load_counters(again, seen).first().asDict() == {
        "added": 1, "invalid": 0, "duplicate": 2,
    }


def test_queue_round_trip(spark, tmp_path):
    state = Q.start_state(Q.distinct_urls(Q.parse_lines(lines(spark, ["http://a.b", "http://c.d"]))))
    tables.write_queue(state, str(tmp_path / "q"))
    back = tables.read_queue(spark, str(tmp_path / "q"))
    assert sorted(back.collect()) == sorted(state.collect())


def test_queue_document_import(spark, tmp_path):
    path = tmp_path / "queue.json"
    path.write_text(json.dumps({"pending": ["u2", "u3"], "seen": ["u1", "u2", "u3"]}, indent=2))
    state = tables.read_queue_document(spark, str(path))
    assert stats(state) == {
        "pending": 2, "completed": 0, "failed": 0, "total_seen": 3, "is_empty": False,
    }
    assert urls(state.filter("list = 'pending'")) == ["u2", "u3"]


def test_empty_queue(spark):
    state = Q.start_state(Q.distinct_urls(Q.parse_lines(lines(spark, ["", "#", "nope"]))))
    assert stats(state)["is_empty"] is True


@pytest.mark.parametrize("width", [3, 7, 1 << 20])
def test_batches_are_exact_whatever_the_chunks(spark, width):
    # Sparse positions, as deduplication and scan splits leave them.
    seqs = [i * i + (i % 5 << 33) for i in range(100)]
    frame = spark.createDataFrame([(f"u{i}", s) for i, s in enumerate(seqs)], "url string, seq long")
    got = {r.seq: r.batch for r in Q.assign_batches(frame, 7, width).collect()}
    assert got == {s: rank // 7 + 1 for rank, s in enumerate(sorted(seqs))}


def test_running_total(spark):
    frame = spark.range(50).withColumn("v", F.col("id") % 4)
    rows = running_total(frame, "id", F.col("v"), "total", 8).orderBy("id").collect()
    total = 0
    for row in rows:
        total += row.v
        assert row.total == total


def test_hot_url_costs_one_row_per_task(spark):
    parsed = Q.parse_lines(
        spark.range(0, 60_000, 1, 4).select(
            F.when(F.col("id") % 3 == 0, "http://hot.example")
            .otherwise(F.concat(F.lit("http://x/"), F.col("id").cast("string")))
            .alias("value"),
            F.col("id").alias("seq"),
        )
    )
    plan = Q.distinct_urls(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert Q.load_counters(parsed).first().asDict() == {
        "added": 40_001, "invalid": 0, "duplicate": 19_999,
    }
