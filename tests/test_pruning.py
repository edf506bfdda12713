"""Scoring that leaves out categories which cannot be the best."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import classify as C
from pagelens.operators import pruning as P
from pagelens.operators.model import fit
from pagelens.sources.categories import categories_frame

COMMON = [f"common{i}" for i in range(12)]


def many_categories(count, seed=1):
    """Each has words of its own, words shared with a few, and most of the common ones."""
    rng = random.Random(seed)
    return [
        {
            "name": f"c{i}",
            "keywords": [f"own{i}", f"own{i}", f"pair{i // 2}", f"group{i // 50}"]
            + rng.sample(COMMON, 8)
            + [f"own{i} {rng.choice(COMMON)}"],
            "domains": [f"site{i}.org"] if i % 7 == 0 else [],
        }
        for i in range(count)
    ]


def some_pages(spark, count, categories, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        c = rng.randrange(categories)
        words = rng.choices([f"own{c}", f"pair{c // 2}", f"group{c // 50}", "other"], k=rng.randrange(5))
        words += rng.choices(COMMON, k=rng.randrange(12))
        rng.shuffle(words)
        rows.append((i, f"http://site{rng.randrange(categories)}.org/{i}", " ".join(words)))
    rows += [(-1, None, "x"), (-2, "http://site0.org", ""), (-3, "http://site0.org/a", None)]
    rows += [(-4, "http://site7.org", "nothing known"), (-5, "http://b.org", " ".join(COMMON))]
    return spark.createDataFrame(rows, "page_id long, url string, combined_text string")


@pytest.fixture(scope="module")
def large(spark):
    return fit(categories_frame(spark, many_categories(10_000)), inline_entries=0)


def answers(frame):
    return {r.page_id: (r.category, r.confidence) for r in frame.collect()}


def test_answers_are_those_of_all_categories(spark, large):
    pages = some_pages(spark, 120, 10_000)
    pruned = answers(C.classify(pages, large, prune=True))
    assert pruned == answers(C.classify(pages, large, prune=False))
    assert len({c for c, _ in pruned.values()}) > 50


def test_few_rows_meet_the_lists(spark, large):
    """Of 10,000 categories, less than a tenth of the rows that scoring all would join."""
    pages = some_pages(spark, 60, 10_000).withColumn("text", F.col("combined_text"))
    weights = C._table_weights(pages.select("page_id", "text"), large, "page_id").cache()
    lists = P.tiered_lists(large)
    needed = P.needed_lists(weights, lists, "page_id")
    pruned = P.partial_scores(needed, lists, "page_id").count()
    every = C.table_similarities(weights, large, "page_id").count()
    assert 0 < pruned < every / 10
    best = P.candidates(P.partial_scores(needed, lists, "page_id"), "page_id")
    assert best.count() < pruned


@pytest.mark.parametrize("seed", range(3))
def test_small_models_too(spark, seed):
    model = fit(categories_frame(spark, many_categories(9, seed)), inline_entries=0)
    pages = some_pages(spark, 80, 9, seed)
    found = answers(C.classify(pages, model, prune=True))
    assert found == answers(C.classify(pages, model, prune=False))


def test_tiers_cover_all_weights(spark):
    rows = spark.createDataFrame([(2.0**-i,) for i in range(40)] + [(0.7,), (1.0,)], "w double")
    tiers = [r[0] for r in rows.select(P._tier(F.col("w"))).collect()]
    assert min(tiers) == 0 and max(tiers) == P.TIERS


def test_no_pages(spark, large):
    assert C.classify(some_pages(spark, 1, 9).limit(0), large, prune=True).count() == 0
