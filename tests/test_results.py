"""Fetch outcomes, summaries, evaluation and sinks."""

from __future__ import annotations

import csv
import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.operators import evaluate as E
from pagelens.operators import summary
from pagelens.operators.fetches import normalise_outcomes, page_results
from pagelens.sources import sinks, tables

MOMENT = dt.datetime(2026, 1, 31, 8, 15, 0, 123456)
GOOD = "text/html; charset=utf-8"


def fetch(url, code=200, kind=GOOD, failure=None, text=None, final=None):
    return (url, final, code, kind, failure, text, "<title>T</title>", MOMENT)


@pytest.fixture(scope="module")
def fetches(spark):
    return spark.createDataFrame(
        [
            fetch("u0", final="u0/landed"),
            fetch("u1", code=404),
            fetch("u2", code=503, kind="application/pdf"),
            fetch("u3", kind="application/pdf"),
            fetch("u4", kind=None),
            fetch("u5", kind="Text/HTML"),
            fetch("u6", kind="application/xhtml+xml"),
            fetch("u7", code=None, failure="timeout", text="ignored"),
            fetch("u8", code=None, failure="redirects"),
            fetch("u9", code=None, failure="connection", text="refused"),
            fetch("u10", code=None, failure="other", text="boom"),
            fetch("u11", code=600),
            fetch("u12", code=399),
        ],
        schemas.FETCH,
    )


def test_outcomes(fetches):
    got = {r.url: r for r in normalise_outcomes(fetches).collect()}
    errors = {u: r.error for u, r in got.items() if r.status == "ERROR"}
    assert errors == {
        "u1": "HTTP 404",
        "u2": "HTTP 503",
        "u3": "Non-HTML content-type: application/pdf",
        "u4": "Non-HTML content-type: ",
        "u5": "Non-HTML content-type: Text/HTML",
        "u7": "Timeout",
        "u8": "Too many redirects",
        "u9": "Connection error: refused",
        "u10": "boom",
    }
    assert got["u0"].final_url == "u0/landed" and got["u0"].http_code == 200
    assert got["u1"].final_url == "u1" and got["u1"].http_code is None
    assert got["u12"].status == got["u11"].status == "SUCCESS" and got["u0"].error is None


def test_error_rows_have_blank_signals(fetches):
    rows = {r.url: r for r in page_results(fetches).collect()}
    assert rows["u0"].title == "T" and rows["u1"].title == rows["u1"].combined_text == ""


@pytest.fixture(scope="module")
def results(spark, fetches):
    return page_results(fetches).withColumns(
        {"category": F.lit('A, "B"'), "confidence": F.lit(0.25)}
    )


def test_summaries(spark, results):
    assert summary.run_summary(results).first().asDict() == {
        "total": 13, "successful": 4, "failed": 9,
    }
    batched = results.withColumn(
        "batch", F.floor(F.regexp_extract("url", r"\d+", 0).cast("int") / 5) + 1
    )
    rows = summary.batch_progress(batched, chunk_width=2).orderBy("batch").collect()
    assert [(r.batch, r.urls, r.succeeded, r.processed) for r in rows] == [
        (1, 5, 1, 5), (2, 5, 1, 10), (3, 3, 2, 13),
    ]


def test_distribution(spark):
    frame = spark.createDataFrame(
        [("SUCCESS", c) for c in "AABAC"] + [("ERROR", "A")], "status string, category string"
    )
    rows = [tuple(r) for r in summary.category_distribution(frame).collect()]
    assert rows == [("A", 3, 60.0), ("B", 1, 20.0), ("C", 1, 20.0)]


def read_csv_folder(path):
    rows = []
    for part in sorted(path.glob("*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_report_is_plain_csv(results, tmp_path):
    path = tmp_path / "report"
    tricky = results.withColumn(
        "title", F.when(F.col("url") == "u0", F.lit(' say "hi",\nnow \\ é ')).otherwise("")
    )
    sinks.write_report(tricky, str(path))
    rows = {r["url"]: r for r in read_csv_folder(path)}
    assert list(rows["u0"]) == schemas.REPORT_COLUMNS
    assert rows["u0"] == {
        "url": "u0",
        "final_url": "u0/landed",
        "category": 'A, "B"',
        "confidence": "0.25",
        "status": "SUCCESS",
        "http_code": "200",
        "title": ' say "hi",\nnow \\ é ',
        "description": "",
        "crawled_at": "2026-01-31T08:15:00.123456+00:00",
        "error": "",
    }
    assert rows["u9"]["error"] == "Connection error: refused" and rows["u9"]["http_code"] == ""
    back = sinks.read_report(results.sparkSession, str(path))
    assert {r.url: r.asDict() for r in back.collect()} == rows


def test_report_append_and_missing_columns(spark, results, tmp_path):
    path = tmp_path / "report"
    sinks.write_report(results, str(path))
    sinks.write_report(spark.createDataFrame([("late",)], "url string"), str(path), append=True)
    rows = read_csv_folder(path)
    assert len(rows) == 14
    assert [set(r.values()) for r in rows if r["url"] == "late"] == [{"late", ""}]
    sinks.write_report(results, str(path))
    assert len(read_csv_folder(path)) == 13


def test_json_export(spark, results, tmp_path):
    sinks.write_json_export(results, str(tmp_path / "x"))
    rows, manifest = sinks.read_json_export(
        spark, str(tmp_path / "x"), results.drop("crawled_at").schema
    )
    assert rows.count() == manifest.first().total_urls == 13
    assert manifest.first().generated_at.endswith("+00:00")
    line = next((tmp_path / "x" / "results").glob("*.json")).read_text().splitlines()[0]
    assert set(json.loads(line)) == set(results.columns)


# Evaluation

PRED = [("a", "X"), ("b/", "X"), ("c", "Y"), ("d", None), ("e", "Z"), ("a", "Y"), (None, "X")]
TRUE = [(" a ", "X"), ("b", "Y"), ("c", "Y"), ("d", ""), ("f", "X"), ("a", "X"), (None, "X")]


def brute_scores(pred, true):
    pairs = []
    for u, p in pred:
        for v, t in true:
            if u == v:
                pairs.append((t or "Uncategorized", p or "Uncategorized"))
    scores = {}
    for label in {x for pair in pairs for x in pair}:
        tp = sum(t == p == label for t, p in pairs)
        predicted = sum(p == label for _, p in pairs)
        support = sum(t == label for t, _ in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        scores[label] = (round(precision, 4), round(recall, 4), round(f1, 4), support)
    accuracy = sum(t == p for t, p in pairs) / len(pairs)
    return pairs, scores, accuracy


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    def null_blank(rows):
        return [(u, c or None) for u, c in rows]

    pred = spark.createDataFrame(null_blank(PRED), "url string, category string")
    true = spark.createDataFrame(null_blank(TRUE), "url string, category string")
    return E.confusion(pred, true)


def clean(rows):
    return [(u.strip().rstrip("/") if u else None, c) for u, c in rows]


def test_confusion_multiplies_repeats(matrix):
    pairs, _, _ = brute_scores(clean(PRED), clean(TRUE))
    assert {(r.true_label, r.pred_label): r.n for r in matrix.collect()} == Counter(pairs)


def test_scores(matrix):
    pairs, scores, accuracy = brute_scores(clean(PRED), clean(TRUE))
    got = {r.label: tuple(r)[1:] for r in E.per_class(matrix).collect()}
    assert got == scores
    row = E.overall(matrix).first()
    assert row.matched_urls == len(pairs) and row.accuracy == round(accuracy, 4)
    n = len(scores)
    assert row.macro_f1 == pytest.approx(sum(s[2] for s in scores.values()) / n, abs=1e-4)
    assert [r.label for r in E.report_rows(matrix).collect()] == sorted(scores)


def test_no_match_gives_an_empty_report(spark):
    one = spark.createDataFrame([("a", "X")], "url string, category string")
    two = spark.createDataFrame([("b", "X")], "url string, category string")
    assert E.overall(E.confusion(one, two)).count() == 0
    assert E.per_class(E.confusion(one, two)).count() == 0


def test_hot_url_on_both_sides_builds_no_pairs(spark):
    hot = spark.range(0, 200_000, 1, 4).select(
        F.lit("http://hot").alias("url"), F.lit("X").alias("category")
    )
    rows = E.confusion(hot, hot).collect()
    assert [tuple(r) for r in rows] == [("X", "X", 200_000 * 200_000)]


def test_labels_with_missing_cells(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text('note,url,category\nx,http://a,NA\ny,"http://b,c","K ""q"""\nz,http://d,\n')
    rows = [tuple(r) for r in tables.read_labels(spark, str(path)).collect()]
    assert rows == [("http://a", None), ("http://b,c", 'K "q"'), ("http://d", None)]
