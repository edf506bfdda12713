"""URL functions against the standard library's parser."""

from __future__ import annotations

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from pagelens.functions import urls

CASES = [
    "http://example.com",
    "https://github.com/someone",
    "github.com",
    "ftp://files.example.com",
    "",
    "http://",
    "http:",
    "HTTPS://Example.COM/x",
    "https://a b.com/x",
    "http://user:pw@host.org:8080/p?q#f",
    "https://www.www.example.org",
    "//www.example.org/x",
    "1http://x.org",
    "ht\ttp://tab.org",
    "http://[::1]/x",
    "http://[::1",
    "http://a]b/",
    "http://[1:2:3:4:5:6:7:8]:80/",
    "http://[1:2:3:4:5:6:7:8:9]/",
    "http://[::ffff:1.2.3.4]/",
    "http://[::ffff:1.2.3.444]/",
    "http://[1::2::3]/",
    "http://[v1.abc]/",
    "http://[1.2.3.4]/",
    "http://u@[fe80::1%eth0]:1/",
    "http://ex／ample.com",
    "http://exämple.com",
    "https:///nohost",
    "https://?q",
    "mailto:a@b.c",
    "http://WWW.Shouting.ORG",
    "http:// ",
    "http://\u3000",
    " \u3000http://padded.org ",
    "\x00http://control.org",
    "http://\t",
    "http://\n/x",
    "http://a@b@c.org/",
    "http://a＠b.org/",
    "http://[]/",
]


def parsed_valid(url):
    try:
        parsed = urlparse(url.strip())
        return parsed.scheme in ("http", "https") and parsed.netloc != ""
    except ValueError:
        return False


def parsed_domain(url):
    try:
        return urlparse(url).netloc.lower().removeprefix("www.")
    except ValueError:
        return ""


def evaluate(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in frame.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_validity(spark):
    got = dict(zip(CASES, evaluate(spark, CASES, urls.is_valid_url)))
    assert got == {c: parsed_valid(c) for c in CASES}


def test_domain(spark):
    got = dict(zip(CASES, evaluate(spark, CASES, urls.registered_domain)))
    assert got == {c: parsed_domain(c) for c in CASES}


def test_null_is_invalid_and_has_no_domain(spark):
    assert evaluate(spark, [None], urls.is_valid_url) == [False]
    assert evaluate(spark, [None], urls.registered_domain) == [""]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://example.com/", "https://example.com"),
        ("  https://example.com  ", "https://example.com"),
        ("https://example.com///", "https://example.com"),
        ("http://", "http:"),
        ("x /", "x "),
        (" http://a.b/\n", "http://a.b"),
        ("http://a.b/?q=/", "http://a.b/?q="),
        ("HTTP://A.b/C#d", "HTTP://A.b/C#d"),
    ],
)
def test_normalise(spark, raw, expected):
    assert evaluate(spark, [raw], urls.normalise_url) == [expected]
