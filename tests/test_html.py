"""Signals from hand-made HTML."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelens.operators.signals import extract_signals
from pagelens.schemas import SIGNAL_COLUMNS

CASES = [
    ("<h1>foo<b>bar</b></h1>", {"h1": "foobar", "body_text": "foo bar"}),
    ("<header><h1>Top</h1></header><p>x</p>", {"h1": "Top", "body_text": "x"}),
    ("<title>T</title><p>x</p>", {"title": "T", "body_text": "T x"}),
    (
        '<meta name="twitter:description" content="a"><meta name="description" content="b">',
        {"description": "a"},
    ),
    (
        '<meta name="description" content=""><meta property="og:description" content="o">',
        {"description": "o"},
    ),
    (
        '<meta name="description" content="  "><meta property="og:description" content="o">',
        {"description": ""},
    ),
    (
        "<META content='k1, k2' NAME=news_keywords><meta name=Keywords content=late>",
        {"keywords": "k1, k2"},
    ),
    (
        '<meta property="og:description" content="o &amp; &quot;p&quot;">',
        {"description": 'o & "p"'},
    ),
    (
        "<meta content=\"name='description'\" property=x><meta name=description content=yes>",
        {"description": "yes"},
    ),
    (None, {"title": "", "body_text": "", "combined_text": ""}),
    ("", {"title": "", "body_text": "", "combined_text": ""}),
    (
        "<title>A</title><h1>B</h1>",
        {"title": "A", "h1": "B", "combined_text": "A A A A A B B B A B"},
    ),
    # Markup inside comments and scripts is not markup.
    (
        "<!-- <title>no</title> --><script>var a='<h1>no</h1>';</script><title>yes</title>",
        {"title": "yes", "h1": "", "body_text": "yes"},
    ),
    ("<script>x = '<!--';</script><p>kept</p><!-- gone -->", {"body_text": "kept"}),
    ("<h1>a<!-- c -->b</h1>", {"h1": "ab", "body_text": "a b"}),
    # Nested and mixed noise.
    ("<nav>a<nav>b</nav>c</nav>d", {"body_text": "d"}),
    ("<header><nav>a</nav>b</header>c<footer>d</footer>e", {"body_text": "c e"}),
    ("<nav><aside>x</nav>y", {"body_text": "y"}),
    ("</nav>a<nav/>b<NAV class='q'>c</NAV >d", {"body_text": "a b d"}),
    ("a<nav>b", {"body_text": "a"}),
    ("<nav-bar>kept</nav-bar><head></head>", {"body_text": "kept"}),
    ("<noscript><h2>n</h2></noscript>z", {"h2": "n", "body_text": "z"}),
    # Attributes holding '>' or apostrophes.
    ('<a title="x > y">t</a>', {"body_text": "t"}),
    ("<a alt=don't>t</a> it's <b>u</b>", {"body_text": "t it's u"}),
    ("<p>1 < 2 and 3 > 2</p>", {"body_text": "1 < 2 and 3 > 2"}),
    ("a<p class='open", {"body_text": "a"}),
    # Headings.
    ("<h2> one </h2><h2></h2><h2>two\n three</h2>", {"h2": "one two three"}),
    ("<h1>one<p>two</p>", {"h1": "one", "body_text": "one two"}),
    ("<h3>x<h2>y</h2></h3>", {"h3": "x", "h2": "y"}),
    # Character references.
    ("<p>&amp;lt; &lt;b&gt; &copy; &eacute;</p>", {"body_text": "&lt; <b> © é"}),
    ("<p>&#65;&#x42;&#X43; &#x1F600; &#0;|&#xD800;|&#99999999;</p>", {"body_text": "ABC 😀 ||"}),
    ("<p>AT&T &unknown; &copy 2 &</p>", {"body_text": "AT&T &unknown; &copy 2 &"}),
    ("<p>a&nbsp;&nbsp;b</p>", {"body_text": "a b"}),
]


@pytest.fixture(scope="module")
def extracted(spark):
    frame = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)], "i int, html string")
    return {r.i: r.asDict() for r in extract_signals(frame).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(extracted, i):
    expected = CASES[i][1]
    assert {k: extracted[i][k] for k in expected} == expected


def test_body_limit_counts_characters_after_cleaning(spark):
    html = "<p>" + "é \n " * 3000 + "</p>"
    frame = spark.createDataFrame([(html,)], "html string")
    whole = ("é " * 3000).strip()
    assert extract_signals(frame).first().body_text == whole
    assert extract_signals(frame, body_limit=2000).first().body_text == whole[:2000]


def test_apostrophe_by_name(spark):
    frame = spark.createDataFrame([("<title>don&apos;t</title>",)], "html string")
    assert extract_signals(frame).first().title == "don't"


def test_large_hostile_pages_finish(spark):
    pages = [
        "<nav" * 50_000,
        "<a title='" * 50_000,
        "<!--" * 50_000,
        "&" * 200_000,
        "<" * 200_000,
        "<h1>" * 20_000,
        "<script>" * 20_000,
        "<p a=\"b\" " * 30_000,
        "<nav>" * 3_000 + "x" + "</nav>" * 3_000 + "tail",
        "<header>some text here</header>and some more outside it" * 20_000,
        "<aside/>" * 50_000,
    ]
    frame = spark.createDataFrame([(p,) for p in pages], "html string")
    # Lengths of all signals, so that none of the work can be left out.
    lengths = sum(F.length(c) for c in SIGNAL_COLUMNS)
    got = extract_signals(frame).agg(F.count_if(lengths >= 0), F.sum(lengths)).first()
    assert got[0] == len(pages) and got[1] > 1_000_000
