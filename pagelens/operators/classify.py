"""Score pages against category profiles and pick the best category.

Two forms give the same answers. The row-local form evaluates a small model
inside each row: no shuffle, no state. The table form joins a model of any size; it
stores the pages with a number of its own for each row, so that it reads them twice at
no cost, and rows need no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.binding import bind
from pagelens.functions.text import NOT_SPACE, ngrams, tokens
from pagelens.functions.urls import registered_domain
from pagelens.operators import lookup
from pagelens.operators.model import (
    CONFIDENCE_THRESHOLD,
    DOMAIN_BOOST,
    UNCATEGORIZED,
    CategoryModel,
    explode_terms,
    inline_bucket,
    sublinear,
)
from pagelens.operators.pruning import pruned_similarities
from pagelens.sources.tables import store

#: With more categories, those that cannot be a page's best are not scored.
PRUNED_CATEGORIES = 64


# Row-local form


def _vectors(model: CategoryModel) -> Column:
    """The model as a literal; the optimizer folds the parsing away."""
    return F.from_json(F.lit(model.inline), "array<map<string,struct<idf:double,w:array<double>>>>")


def _find(vectors: Column, term: Column) -> Column:
    return F.try_element_at(F.get(vectors, inline_bucket(term)), term)


def _page_terms(text: Column, model: CategoryModel, vectors: Column) -> Column:
    """Vocabulary terms of a text with repeats; all others drop out by lookup.

    A pair is joined only when its words start and end pairs of the vocabulary,
    which spares building most of a text's pairs.
    """
    pairs = [term.split(" ") for term in model.inline_terms if " " in term]
    first = sorted({left for left, _ in pairs})
    second = sorted({right for _, right in pairs})

    def known(term: Column) -> Column:
        return _find(vectors, term).isNotNull()

    def select(words: Column) -> Column:
        singles = F.filter(words, known)
        if not pairs:
            return singles
        joined = F.zip_with(
            words,
            F.slice(words, 2, F.size(words)),
            lambda left, right: F.when(
                left.isin(first) & right.isin(second), F.concat(left, F.lit(" "), right)
            ),
        )
        return F.concat(singles, F.filter(joined, lambda pair: pair.isNotNull() & known(pair)))

    return bind(tokens(text, model.stop_words), select)


def _counted(terms: Column) -> Column:
    """Distinct terms with their number, as ``(term, tf)``.

    Sorting puts equal terms side by side, and a count is the distance between
    two starts. Counting each term by a search would be quadratic on long texts.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        bounds = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i == 0) | (i == size) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(bounds, lambda starts: counts(ordered, starts))

    def counts(ordered: Column, starts: Column) -> Column:
        pairs = F.zip_with(
            starts,
            F.slice(starts, 2, F.size(starts)),
            lambda start, end: F.struct(
                F.get(ordered, start).alias("term"), (end - start).alias("tf")
            ),
        )
        # The last bound ends the last run and starts none.
        return F.filter(pairs, lambda pair: pair["tf"].isNotNull())

    return bind(F.sort_array(terms), runs)


def page_weights(text: Column, model: CategoryModel) -> Column:
    """Unnormalised page vector: array of ``(term, weight, w)``.

    ``w`` holds the term's weight in every category.
    """

    def weigh(vectors: Column) -> Column:
        def entry(counted: Column) -> Column:
            return bind(
                _find(vectors, counted["term"]),
                lambda vector: F.struct(
                    counted["term"].alias("term"),
                    (sublinear(counted["tf"]) * vector["idf"]).alias("weight"),
                    vector["w"].alias("w"),
                ),
            )

        return F.transform(_counted(_page_terms(text, model, vectors)), entry)

    return bind(_vectors(model), weigh)


def _length(weights: Column) -> Column:
    return F.sqrt(
        F.aggregate(weights, F.lit(0.0), lambda total, x: total + x["weight"] * x["weight"])
    )


def term_weights(pages: DataFrame, model: CategoryModel, key: str, text_col: str) -> DataFrame:
    """Unit page vectors as ``(key, term, weight)``, computed within each row."""
    if model.inline is None:
        return _table_weights(pages.select(key, F.col(text_col).alias("text")), model, key)
    unit = bind(
        page_weights(F.col(text_col), model),
        lambda vector: bind(
            _length(vector),
            lambda length: F.transform(
                vector,
                lambda x: F.struct(
                    x["term"].alias("term"), (x["weight"] / length).alias("weight")
                ),
            ),
        ),
    )
    return pages.select(key, F.inline(unit))


def similarities(text: Column, model: CategoryModel) -> Column:
    """Cosine similarity to every category, in category order."""
    count = len(model.inline_names)

    def score(vector: Column) -> Column:
        def cosines(length: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda i: F.when(
                    length > 0,
                    F.aggregate(
                        vector, F.lit(0.0), lambda total, x: total + x["weight"] * F.get(x["w"], i)
                    )
                    / length,
                ).otherwise(F.lit(0.0)),
            )

        return bind(_length(vector), cosines)

    return bind(page_weights(text, model), score)


def _decide(score: Column, name: Column, blank: Column) -> dict[str, Column]:
    """Threshold the unrounded score, then round it."""
    return {
        "category": F.when(blank | (score < CONFIDENCE_THRESHOLD), F.lit(UNCATEGORIZED)).otherwise(
            name
        ),
        "confidence": F.when(blank, F.lit(0.0)).otherwise(F.round(score, 4)),
    }


def _is_blank(text: Column) -> Column:
    """No character but whitespace; the search stops at the first one that is not."""
    return ~F.coalesce(text, F.lit("")).rlike(NOT_SPACE)


def classify(
    pages: DataFrame,
    model: CategoryModel,
    text_col: str = "combined_text",
    url_col: str = "url",
    prune: bool | None = None,
) -> DataFrame:
    """Add ``category`` and ``confidence`` to every page, whatever the model's size.

    ``prune`` says whether the table form leaves out categories that cannot be a page's
    best; by default it does with more than ``PRUNED_CATEGORIES``. Answers are the same.
    """
    if model.inline is None:
        if prune is None:
            prune = model.category_rows > PRUNED_CATEGORIES
        return _classify_tables(pages, model, text_col, url_col, prune)

    boosted = with_boost_index(pages, model, url_col).withColumn(
        "_scores",
        bind(
            similarities(F.col(text_col), model),
            lambda scores: F.transform(scores, _boost),
        ),
    )
    names = F.array(*map(F.lit, model.inline_names))
    best = F.array_max("_scores")
    # The first position of the highest score: the lowest index wins a tie.
    name = F.get(names, F.array_position("_scores", best).cast("int") - 1)
    return boosted.withColumns(_decide(best, name, _is_blank(F.col(text_col)))).select(
        *pages.columns, "category", "confidence"
    )


def _boost(score: Column, i: Column) -> Column:
    return F.when(i == F.col("boost_idx"), F.least(score + DOMAIN_BOOST, F.lit(1.0))).otherwise(
        score
    )


def with_boost_index(pages: DataFrame, model: CategoryModel, url_col: str) -> DataFrame:
    """Add ``boost_idx``, the category of the page's domain, or null.

    The requested URL decides, not the one a redirect ended at.
    """
    keyed = pages.withColumn("_domain", registered_domain(F.col(url_col)))
    domains = model.domains.withColumnRenamed("domain", "_domain")
    joined = lookup.lookup_join(keyed, domains, "_domain", model.domain_rows, url_col, "left")
    return joined.select(*pages.columns, "boost_idx")


# Table form


def _table_weights(texts: DataFrame, model: CategoryModel, key: str) -> DataFrame:
    """Unit page vectors by joins.

    A vocabulary of broadcast size first drops all other terms, so that only
    known terms are shuffled. Beyond that size terms are counted per page before
    the join, which collapses a term that fills its page.
    """
    terms = explode_terms(texts, key, ngrams(tokens(F.col("text"), model.stop_words)))
    if model.vocabulary_size <= lookup.BROADCAST_ROWS:
        counts = (
            terms.join(model.vocab, "term")
            .groupBy(key, "term", "idf")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
    else:
        counted = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        counts = lookup.lookup_join(counted, model.vocab, "term", model.vocabulary_size, key)
    weighted = counts.select(
        key, "term", (sublinear(F.col("tf")) * F.col("idf")).alias("weight")
    )
    # A row's terms are of its own text, so a row bounds the window.
    length = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.col("weight") / length)


def table_similarities(weights: DataFrame, model: CategoryModel, key: str) -> DataFrame:
    """Terms of the cosine sums as ``(key, cat_idx, part)``."""
    profiles = model.profiles.withColumnRenamed("weight", "_profile")
    rows = model.vocabulary_size * model.category_rows
    return lookup.lookup_join(weights, profiles, "term", rows, key).select(
        key, "cat_idx", (F.col("weight") * F.col("_profile")).alias("part")
    )


def _classify_tables(
    pages: DataFrame, model: CategoryModel, text_col: str, url_col: str, prune: bool
) -> DataFrame:
    key = "_row"
    pages = store(pages.withColumn(key, F.monotonically_increasing_id()), "pages")
    # Blank pages need no filter here: they have no terms, and a boost of theirs
    # is overruled at the end. Only the first of these two reads the text.
    weights = _table_weights(pages.select(key, F.col(text_col).alias("text")), model, key)
    # A boost counts even for a page that shares no term with the category.
    boosts = (
        with_boost_index(pages.select(key, F.col(url_col).alias("url")), model, "url")
        .filter("boost_idx is not null")
        .select(
            key,
            F.col("boost_idx").alias("cat_idx"),
            F.lit(0.0).alias("part"),
            F.lit(True).alias("boosted"),
        )
    )
    if prune:
        parts = pruned_similarities(weights, model, key, boosts)
    else:
        parts = table_similarities(weights, model, key)
    scores = (
        parts.withColumn("boosted", F.lit(False)).unionByName(boosts)
        .groupBy(key, "cat_idx")
        .agg(F.sum("part").alias("score"), F.bool_or("boosted").alias("boosted"))
        .withColumn(
            "score",
            F.when(F.col("boosted"), F.least(F.col("score") + DOMAIN_BOOST, F.lit(1.0))).otherwise(
                F.col("score")
            ),
        )
    )
    best = scores.groupBy(key).agg(
        F.max_by(F.struct("cat_idx", "score"), F.struct("score", -F.col("cat_idx"))).alias("_best")
    )
    named = lookup.lookup_join(
        best.select(key, "_best.cat_idx", "_best.score"),
        model.names.withColumnRenamed("name", "_name"),
        "cat_idx",
        model.category_rows,
        key,
    )
    named = named.select(key, "_name", F.col("score").alias("_score"))
    joined = pages.join(named, key, "left")
    score = F.coalesce("_score", F.lit(0.0))
    blank = _is_blank(F.col(text_col))
    kept = [c for c in pages.columns if c != key]
    return joined.withColumns(_decide(score, F.col("_name"), blank)).select(
        *kept, "category", "confidence"
    )
