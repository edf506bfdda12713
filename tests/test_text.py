"""Text functions against plain Python."""

from __future__ import annotations

import re
import sys
import time
import unicodedata

from pyspark.sql import functions as F

from pagelens.functions import text, unicode_rules
from pagelens.functions.formats import iso_timestamp


def fold(value: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)
    )


def column(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in frame.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_strip_accents_equals_nfkd_for_every_character(spark):
    # 256 code points to a row, so that rows mix plain, rare and combining ones.
    codes = [c for c in range(sys.maxunicode + 1) if c and not 0xD800 <= c <= 0xDFFF]
    rows = ["".join(map(chr, codes[i : i + 256])) for i in range(0, 0x30000, 256)]
    got = column(spark, rows, text.strip_accents)
    assert [g == fold(r) for g, r in zip(got, rows)].count(False) == 0


def test_lower_runs_before_accents(spark):
    words = ["ÉCOLE", "İstanbul", "Straße", "ﬁne ½ ™", "각 한국", "ｆｕｌｌ", "ΑΣ"]
    assert column(spark, words, text.normalise_text) == [fold(w.lower()) for w in words]


def test_clean_matches_python_whitespace(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = ["a" + "".join(spaces) + "b", "  x  ", "\x1c\x1fz\n", "", None, " \t "]
    expected = [re.sub(r"\s+", " ", v or "").strip() for v in values]
    assert column(spark, values, text.clean) == expected
    assert column(spark, values[:4], text.strip_whitespace) == [v.strip() for v in values[:4]]


def test_strip_whitespace_is_linear_on_long_runs(spark):
    value = "a" + " " * 300_000 + "b"
    assert column(spark, [value], text.strip_whitespace) == [value]


def test_folding_is_linear_in_distinct_characters(spark):
    """Every Hangul syllable and every wide character, many times over."""
    syllables = "".join(chr(0xAC00 + i % 11172) for i in range(100_000))
    wide = "".join(c for c in map(chr, range(0x80, 0x30000)) if c.isprintable() and len(fold(c)) > 1)

    def seconds(value):
        started = time.perf_counter()
        assert column(spark, [value], text.strip_accents) == [fold(value)]
        return time.perf_counter() - started

    seconds(syllables[:100])
    once, thrice = seconds(syllables), seconds(syllables * 3)
    assert once < 5 and thrice < 6 * once + 1
    assert seconds(wide * 10) < 5


def words(value: str) -> list[str]:
    stop = set(text.ENGLISH_STOP_WORDS)
    return [w for w in re.findall(r"(?u)\b\w\w+\b", fold(value.lower())) if w not in stop]


def test_tokens_and_ngrams(spark):
    values = [
        "Interest rate bill",
        "a b c",
        "",
        "one-two_three 42 x7 machine  learning, machine LEARNING",
        "Café ñandú und größe",
        "single",
        "मिठाई का स्वाद １２ 中文字",
    ]
    expected = [words(v) for v in values]
    assert column(spark, values, text.tokens) == expected
    got = column(spark, values, lambda c: text.ngrams(text.tokens(c)))
    assert got == [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in expected]


def test_stop_list_size():
    assert len(text.ENGLISH_STOP_WORDS) == len(set(text.ENGLISH_STOP_WORDS)) == 318


def test_iso_timestamp(spark):
    frame = spark.sql(
        "select timestamp'2026-01-31 08:15:00.123456' a, timestamp'2026-01-31 08:15:00' b"
    )
    row = frame.select(iso_timestamp(F.col("a")).alias("a"), iso_timestamp(F.col("b")).alias("b"))
    assert row.first() == ("2026-01-31T08:15:00.123456+00:00", "2026-01-31T08:15:00+00:00")


def test_few_ranges_hold_all_expanding_characters():
    """Letters of common alphabets stay outside; the pattern is tried at all of theirs."""
    rules = unicode_rules.folding()
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), rules.expanding))
    assert rules.expanding.count("-") <= unicode_rules.RANGES
    for code in range(0x80, 0x30000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.combining(char):
            continue
        kept = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        assert len(kept) < 2 or pattern.match(char)
    assert not pattern.search("éèüßñçøåœÉÑŠžαβγωабвгдЯאבגدبت中文字")
