"""Fitting and scoring, in both forms, against fixed answers and brute force."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from brute import Model, terms
from pyspark.sql import functions as F

from pagelens.defaults import DEFAULT_CATEGORIES
from pagelens.operators import model as M
from pagelens.operators.classify import classify, similarities, term_weights
from pagelens.sources.categories import categories_frame, read_categories, write_categories

TEXTS = [
    ("software cloud database", "", "Technology", 0.2342),
    ("government policy", "", "Government & Legal", 0.1704),
    ("research", "", "Education", 0.1167),
    ("Interest rate bill", "", "Finance", 0.1377),
    ("price discount cart checkout delivery", "", "E-Commerce", 0.4201),
    ("travel tourism hotel flight software", "", "Travel & Tourism", 0.3536),
    ("hello", "https://github.com/x", "Technology", 0.25),
    ("hospital doctor", "https://www.github.com", "Technology", None),
    ("hello", "https://github.com:443/x", "Uncategorized", 0.0),
    ("hello there", "", "Uncategorized", 0.0),
    ("", "https://github.com", "Uncategorized", 0.0),
    (" \n ", "https://github.com", "Uncategorized", 0.0),
    (None, "https://github.com", "Uncategorized", 0.0),
    ("health " * 400 + "mental health clinic", "http://who.int/", "Healthcare", None),
    ("Gouvernement ministère", None, "Uncategorized", 0.0),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, text, url) for i, (text, url, _, _) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "page_id long, combined_text string, url string")


@pytest.fixture(scope="module")
def categories(spark):
    return categories_frame(spark, DEFAULT_CATEGORIES)


@pytest.fixture(scope="module")
def inline(categories):
    return M.fit(categories)


@pytest.fixture(scope="module")
def tables(categories):
    return M.fit(categories, inline_entries=0)


@pytest.fixture(scope="module")
def brute():
    return Model(DEFAULT_CATEGORIES)


def expected(brute):
    answers = []
    for text, url, _, _ in TEXTS:
        domain = (url or "").split("//")[-1].split("/")[0].removeprefix("www.")
        answers.append(brute.classify(text or "", domain))
    return answers


def test_vocabulary_size_and_idf(inline, tables, brute):
    assert inline.vocabulary_size == tables.vocabulary_size == len(brute.idf) == 403
    got = {r.term: round(r.idf, 6) for r in inline.vocab.collect()}
    assert {t for t, v in got.items() if v == 2.098612} == {
        "learning",
        "policy",
        "research",
        "government",
    }
    assert set(got.values()) == {2.504077, 2.098612}


def test_profiles(inline, brute):
    rows = inline.profiles.collect()
    assert [Counter(r.cat_idx for r in rows)[i] for i in range(8)] == [
        55, 53, 52, 49, 51, 49, 49, 49,
    ]
    for row in rows:
        assert row.weight == pytest.approx(brute.profiles[row.cat_idx][row.term], rel=1e-12)


def test_repeated_terms(categories):
    counts = M.term_counts(M.category_corpus(categories), "cat_idx").filter("tf > 1")
    assert sorted((r.cat_idx, r.term, r.tf) for r in counts.collect()) == [
        (2, "health", 2),
        (3, "course", 2),
        (3, "learning", 2),
    ]


@pytest.mark.parametrize("form", ["inline", "tables"])
def test_answers(form, request, pages, brute):
    model = request.getfixturevalue(form)
    rows = classify(pages, model).orderBy("page_id").collect()
    got = [(r.category, r.confidence) for r in rows]
    assert got == expected(brute)
    for (category, confidence), (_, _, name, score) in zip(got, TEXTS):
        assert category == name
        assert score is None or confidence == score


def test_table_form_with_salted_lookups(monkeypatch, pages, tables, brute):
    from pagelens.operators import lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", -1)
    rows = classify(pages, tables).orderBy("page_id").collect()
    assert [(r.category, r.confidence) for r in rows] == expected(brute)


def test_similarities_are_cosines(pages, inline, brute):
    row = pages.filter("page_id = 5").select(
        similarities(F.col("combined_text"), inline).alias("s")
    ).first()
    page = brute.vector(Counter(terms(TEXTS[5][0])))
    for got, profile in zip(row.s, brute.profiles):
        assert got == pytest.approx(sum(w * profile.get(t, 0) for t, w in page.items()))


def test_term_weights_agree_between_forms(pages, inline, tables):
    def rows(model):
        frame = term_weights(pages, model, "page_id", "combined_text")
        return {(r.page_id, r.term): round(r.weight, 12) for r in frame.collect()}

    got = rows(inline)
    assert got == rows(tables)
    by_page = Counter()
    for (page, _), weight in got.items():
        by_page[page] += weight * weight
    assert all(total == pytest.approx(1) for total in by_page.values())


def test_long_texts_are_scored_in_linear_time(spark, inline, brute):
    text = "health research policy market hotel news " * 100_000
    page = spark.createDataFrame([(text, "")], "combined_text string, url string")
    row = classify(page, inline).first()
    assert (row.category, row.confidence) == brute.classify(text)


def test_inline_plan_has_no_shuffle_and_no_parsing(pages, inline):
    plan = classify(pages, inline)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert "from_json" not in plan
    assert "INSET" in plan


def test_a_model_of_many_terms_stays_inline_or_not_by_size(categories):
    assert M.fit(categories, inline_entries=8 * 403).inline is not None
    assert M.fit(categories, inline_entries=8 * 403 - 1).inline is None


def test_max_features_keeps_frequent_then_alphabetical(spark):
    config = [
        {"name": "A", "keywords": ["red", "red blue", "green"]},
        {"name": "B", "keywords": ["blue", "yellow"]},
    ]
    fitted = M.fit(categories_frame(spark, config), max_features=3)
    assert fitted.inline_terms == ("blue", "blue green", "red")
    assert set(Model(config, 3).idf) == set(fitted.inline_terms)


def test_last_category_wins_a_shared_domain(spark):
    config = [
        {"name": "A", "keywords": ["red"], "domains": ["X.org"]},
        {"name": "B", "keywords": ["blue"], "domains": ["x.org"]},
    ]
    fitted = M.fit(categories_frame(spark, config))
    assert [tuple(r) for r in fitted.domains.collect()] == [("x.org", 1)]


def test_ties_go_to_the_first_category(spark):
    config = [{"name": n, "keywords": ["zebra"]} for n in ("Z", "A")]
    fitted = M.fit(categories_frame(spark, config))
    page = spark.createDataFrame([(1, "zebra", "")], "page_id int, combined_text string, url string")
    assert classify(page, fitted).first().category == "Z"


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="empty vocabulary"):
        M.fit(categories_frame(spark, [{"name": "A", "keywords": ["the", "a"]}]))


def test_repeated_and_null_rows_get_equal_answers_in_both_forms(spark, inline, tables):
    rows = [(None, "software cloud", None), (1, "hospital", "u"), (1, "hotel flight", "u")] * 2
    pages = spark.createDataFrame(rows, "page_id long, combined_text string, url string")
    pages = pages.withColumns({"term": F.lit("x"), "score": F.lit(1), "cat_idx": F.lit(2)})
    assert sorted(map(str, classify(pages, inline).collect())) == sorted(
        map(str, classify(pages, tables).collect())
    )


def test_model_round_trip(spark, pages, inline, tables, tmp_path):
    for name, model in (("inline", inline), ("tables", tables)):
        path = str(tmp_path / name)
        M.write_model(model, path)
        back = M.read_model(spark, path)
        assert back.inline == model.inline and back.stop_words == model.stop_words
        assert sorted(map(str, classify(pages, back).collect())) == sorted(
            map(str, classify(pages, model).collect())
        )


def test_classifying_reads_no_corpus(spark, categories, pages, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [(i % 8, f"word{i} software hospital") for i in range(40)]
    spark.createDataFrame(rows, "cat_idx int, text string").write.parquet(path)
    fitted = M.fit(categories, corpus=spark.read.parquet(path), inline_entries=0)
    plan = classify(pages, fitted)._jdf.queryExecution().toString()
    assert path not in plan


def test_categories_without_terms_count_as_documents(spark):
    corpus = spark.createDataFrame([(0, "red"), (1, ""), (2, None)], "cat_idx int, text string")
    idf, _ = M.fit_tables(corpus)
    assert idf.first().idf == pytest.approx(1 + math.log(4 / 2))


def test_category_file_round_trip(spark, tmp_path):
    config = [
        {"name": "A", "keywords": ["x", "y"], "domains": ["d"]},
        {"name": "B", "keywords": []},
    ]
    frame = categories_frame(spark, config)
    write_categories(frame, str(tmp_path / "c"))
    assert read_categories(spark, str(tmp_path / "c")).collect() == frame.collect()


def test_category_file_as_written_by_hand(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"categories": [\n {"name": "A",\n "keywords": ["k"]}\n]}')
    assert [tuple(r) for r in read_categories(spark, str(path)).collect()] == [(0, "A", ["k"], [])]
    path.write_text('{"categories": [{"keywords": ["k"]}]}')
    with pytest.raises(Exception, match="without a name"):
        read_categories(spark, str(path)).collect()


def test_corpus_with_many_rows_per_category(spark):
    config = [{"name": "A", "keywords": []}, {"name": "B", "keywords": []}]
    corpus = spark.createDataFrame(
        [(0, "apple pear"), (0, "apple"), (1, "pear plum")], "cat_idx int, text string"
    )
    fitted = M.fit(categories_frame(spark, config), corpus=corpus)
    counts = {(r.cat_idx, r.term): r.tf for r in M.term_counts(corpus, "cat_idx").collect()}
    assert counts[(0, "apple")] == 2 and (0, "pear apple") not in counts
    assert fitted.vocabulary_size == 5


def test_profiles_of_all_terms_join_no_vocabulary(spark):
    """A term's ``idf`` comes with its counts, those of rows without a category too."""
    rows = [(0, "red red blue"), (1, "blue"), (None, "blue green"), (0, None)]
    corpus = spark.createDataFrame(rows, "cat_idx int, text string")
    idf, profiles = M.fit_tables(corpus)
    known = {r.term: (r.corpus_count, r.df, r.idf) for r in idf.collect()}
    assert known["blue"][:2] == (3, 3) and known["green"][:2] == (1, 1)
    found = profiles.collect()
    assert {(r.cat_idx, r.term) for r in found} == {
        (0, "red"), (0, "blue"), (0, "red red"), (0, "red blue"), (1, "blue"),
    }
    assert all(r.idf == pytest.approx(known[r.term][2]) for r in found)
    plan = profiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # with the categories' lengths
