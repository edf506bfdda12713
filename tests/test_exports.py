"""A JSON document in parts, and reports that are cut by lines."""

from __future__ import annotations

import json

import pytest

from pagelens.sources import sinks
from pagelens.sources.envelope import read_json_document, write_json_document

ROWS = [
    ("https://one.test/", ",led by a comma", 1.5, None),
    ("https://two.test/", 'quotes " and \\n and\na line', 0.0, "é 漢字"),
    ("https://three.test/", "", None, "]}"),
    ("https://two.test/", 'quotes " and \\n and\na line', 0.0, "é 漢字"),
]
SCHEMA = "url string, title string, confidence double, error string"


def whole(path):
    """The document as plain concatenation gives it."""
    return "".join(
        f.read_text(encoding="utf-8") for f in sorted(path.glob("[012]-*/part-*"))
    )


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_parts_concatenate_to_one_document(spark, tmp_path, parts):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    write_json_document(frame, str(tmp_path / "x"))
    text = whole(tmp_path / "x")
    document = json.loads(text)
    assert list(document) == ["generated_at", "total_urls", "results"]
    assert document["total_urls"] == len(ROWS)
    assert document["generated_at"].endswith("+00:00")
    got = [tuple(r.values()) for r in document["results"]]
    assert sorted(got, key=repr) == sorted(ROWS, key=repr)
    assert all(list(r) == frame.columns for r in document["results"])
    assert "漢字" in text
    rows, manifest = read_json_document(spark, str(tmp_path / "x"), frame.schema)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(ROWS, key=repr)
    assert manifest.first()["total_urls"] == len(ROWS)


def test_document_of_nothing_and_rewritten(spark, tmp_path):
    path = tmp_path / "x"
    write_json_document(spark.createDataFrame(ROWS, SCHEMA), str(path))
    write_json_document(spark.createDataFrame([], SCHEMA), str(path))
    assert json.loads(whole(path))["results"] == []
    rows, manifest = read_json_document(spark, str(path), spark.createDataFrame([], SCHEMA).schema)
    assert rows.count() == 0 and manifest.first()["total_urls"] == 0


TRICKY = [
    "plain", "", "a\nb", "a\r\nb\rc", "back\\slash", "\\n", "\\s", "\\\\n\n", 'say "x",\n"y"',
    "  blanks  ", "\n", "\\", "tab\there", "#x",
]


def test_report_without_line_breaks_is_cut_by_lines(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    rows = [(f"https://x.test/{i}", cell) for i, cell in enumerate(TRICKY * 300)]
    frame = spark.createDataFrame(rows, "url string, error string").coalesce(1)
    sinks.write_report(frame, path, one_line=True)
    files = list((tmp_path / "report").glob("part-*"))
    lines = sum(len(f.read_bytes().splitlines()) for f in files)
    assert len(files) == 1 and lines == len(rows) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = sinks.read_report(spark, path, one_line=True)
        assert back.rdd.getNumPartitions() > 2
        assert sorted((r.url, r.error) for r in back.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    more = spark.createDataFrame([("late", "x\ny")], "url string, error string")
    sinks.write_report(more, path, append=True, one_line=True)
    assert sinks.read_report(spark, path, one_line=True).count() == len(rows) + 1
