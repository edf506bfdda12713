"""Category profiles: vocabulary, inverse document frequency, unit vectors.

Fitting is a chain of DataFrame aggregations over a corpus of ``(cat_idx, text)``
rows. A category may have any number of rows, so a corpus can be far larger than
a keyword list. Counts combine before the shuffle; no category's text is ever
gathered in one place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.text import ENGLISH_STOP_WORDS, ngrams, tokens
from pagelens.sources.tables import store

# Fixed values.
DOMAIN_BOOST = 0.25
CONFIDENCE_THRESHOLD = 0.05
UNCATEGORIZED = "Uncategorized"

# Above these sizes the model is joined as tables and not put into the plan.
INLINE_ENTRIES = 200_000
INLINE_CATEGORIES = 256
# Inline vectors are spread over buckets by hash: a map is searched end to end.
INLINE_BUCKETS = 1024


def category_corpus(categories: DataFrame) -> DataFrame:
    """A category's document is its keywords joined by spaces.

    Word pairs therefore bridge neighbouring keywords.
    """
    return categories.select("cat_idx", F.array_join("keywords", " ").alias("text"))


def term_counts(
    texts: DataFrame,
    key: str,
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Occurrences of each word and word pair per key: ``(key, term, tf)``."""
    terms = explode_terms(texts, key, ngrams(tokens(F.col(text_col), stop_words)))
    # Never null. A join adds this filter below its own copy of the counts only,
    # and then the two copies would not share a shuffle.
    terms = terms.filter(F.col("term").isNotNull())
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def explode_terms(texts: DataFrame, key: str, terms: Column) -> DataFrame:
    """One row per term.

    The array is built inside the generator on purpose. As a column of its own it
    would also be computed by the "is not empty" filter Spark puts below it.
    """
    return texts.select(key, F.explode(terms).alias("term"))


def vocabulary(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """The terms of the corpus: ``(term, corpus_count, df)``.

    ``max_features`` keeps the most frequent, first by count and then by term; its bounded
    sort holds that many rows per task.
    """
    terms = counts.groupBy("term").agg(
        F.sum("tf").alias("corpus_count"), F.count(F.lit(1)).alias("df")
    )
    if max_features is None:
        return terms
    return terms.orderBy(F.desc("corpus_count"), "term").limit(max_features)


def with_df(counts: DataFrame) -> DataFrame:
    """``counts`` with each term's ``df``, as in the vocabulary of all terms.

    A term's rows, one a category, meet in one shuffle; no vocabulary is joined to them.
    """
    return counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))


def with_idf(vocab: DataFrame, documents: Column) -> DataFrame:
    """Smoothed inverse document frequency, ``ln((1 + n) / (1 + df)) + 1``."""
    return vocab.withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)


def sublinear(tf: Column) -> Column:
    return F.log(tf) + 1


def category_profiles(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Unit vector per category as ``(cat_idx, term, weight)``, with each term's ``idf``.

    A category's length is a sum that combines before the shuffle; its terms, of any
    number, are never gathered. A zero vector has no rows.
    """
    return unit_vectors(counts.join(idf.select("term", "idf"), "term"))


def unit_vectors(counted: DataFrame) -> DataFrame:
    """The same of ``(cat_idx, term, tf, idf)``, which is read twice."""
    weighted = counted.select(
        "cat_idx", "term", "idf", (sublinear(F.col("tf")) * F.col("idf")).alias("weight")
    )
    lengths = weighted.groupBy("cat_idx").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    return weighted.join(lengths, "cat_idx").select(
        "cat_idx", "term", "idf", (F.col("weight") / F.col("length")).alias("weight")
    )


def fit_tables(
    corpus: DataFrame,
    max_features: int | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """``(term, corpus_count, df, idf)`` and ``(cat_idx, term, weight)`` of a corpus.

    The corpus is read once, to count its terms; both tables come from the stored counts.
    A limited vocabulary is stored too; otherwise each table is made as it is read.
    An empty term marks each text, so that categories without a term are counted too.
    """
    marked = F.concat(ngrams(tokens(F.col("text"), stop_words)), F.array(F.lit("")))
    terms = explode_terms(corpus, "cat_idx", F.coalesce(marked, F.array(F.lit(""))))
    counted = terms.groupBy("cat_idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = store(counted, "term-counts")
    documents = counted.where("term = '' AND cat_idx IS NOT NULL").agg(F.count(F.lit(1))).scalar()
    counts = counted.where("term <> ''")
    idf = with_idf(vocabulary(counts, max_features), documents)
    if max_features is None:
        return idf, unit_vectors(with_idf(with_df(counts), documents))
    idf = store(idf, "idf")
    return idf, category_profiles(counts, idf)


def domain_index(categories: DataFrame) -> DataFrame:
    """Lower-cased domain to category; the last category naming it wins."""
    return (
        categories.select("cat_idx", F.explode("domains").alias("domain"))
        .groupBy(F.lower("domain").alias("domain"))
        .agg(F.max("cat_idx").alias("boost_idx"))
    )


@dataclass(frozen=True)
class CategoryModel:
    """A fitted model. Categories are numbered from 0 without gaps.

    The tables are always there, as stored files. ``inline`` holds the same vectors as
    one JSON text when they are small enough to travel inside the plan. Which form is used
    changes the plan and nothing else.
    """

    names: DataFrame  # cat_idx, name
    vocab: DataFrame  # term, idf
    profiles: DataFrame  # cat_idx, term, weight
    domains: DataFrame  # domain, boost_idx
    stop_words: tuple[str, ...]
    category_rows: int
    vocabulary_size: int
    domain_rows: int
    inline_names: tuple[str, ...] | None = None
    inline_terms: tuple[str, ...] | None = None
    inline: str | None = None


MODEL_TABLES = {
    "names": "cat_idx int, name string",
    "vocab": "term string, idf double",
    "profiles": "cat_idx int, term string, weight double",
    "domains": "domain string, boost_idx int",
}
MODEL_VALUES = (
    "stop_words",
    "category_rows",
    "vocabulary_size",
    "domain_rows",
    "inline_names",
    "inline_terms",
    "inline",
)


def fit(
    categories: DataFrame,
    corpus: DataFrame | None = None,
    max_features: int | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    inline_entries: int = INLINE_ENTRIES,
) -> CategoryModel:
    """Fit profiles on the categories' keywords, or on a given corpus.

    Sizes are counted before any vector comes to the driver. The tables are written
    once; no later use fits anything again.
    """
    corpus = category_corpus(categories) if corpus is None else corpus
    idf, profiles = fit_tables(corpus, max_features, stop_words)
    if max_features is None:
        idf = store(idf, "idf")
    profiles = store(profiles, "profiles")

    sizes = categories.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("cat_idx").alias("last"),
        F.coalesce(F.sum(F.size("domains")), F.lit(0)).alias("domains"),
        F.count_if(F.col("cat_idx") < 0).alias("negative"),
        F.countDistinct("cat_idx").alias("indices"),
    ).first()
    if not sizes["rows"] == sizes["indices"] == (sizes["last"] or 0) + 1 or sizes["negative"]:
        raise ValueError("categories must be numbered from 0 without gaps or repeats")

    tables = {
        "names": store(categories.select("cat_idx", "name"), "names"),
        "vocab": idf.select("term", "idf"),
        "profiles": profiles.select("cat_idx", "term", "weight"),
        "domains": store(domain_index(categories), "domains"),
        "stop_words": tuple(stop_words),
        "category_rows": sizes["rows"],
        "domain_rows": sizes["domains"],
    }
    # One row more than fits is enough to know that the vectors are too many.
    most_terms = inline_entries // sizes["rows"] if sizes["rows"] <= INLINE_CATEGORIES else 0
    vectors = (
        profiles.groupBy("term", "idf")
        .agg(F.map_from_entries(F.collect_list(F.struct("cat_idx", "weight"))).alias("weights"))
        .withColumn("bucket", inline_bucket(F.col("term")))
        .limit(most_terms + 1)
    )
    rows = vectors.collect() if most_terms else []
    if not most_terms or len(rows) > most_terms:
        return CategoryModel(vocabulary_size=_require_terms(idf.count()), **tables)

    buckets: list[dict] = [{} for _ in range(INLINE_BUCKETS)]
    for row in rows:
        weights = [row["weights"].get(i, 0.0) for i in range(sizes["rows"])]
        buckets[row["bucket"]][row["term"]] = {"idf": row["idf"], "w": weights}
    return CategoryModel(
        vocabulary_size=_require_terms(len(rows)),
        inline_names=tuple(row["name"] for row in sorted(tables["names"].collect())),
        inline_terms=tuple(sorted(row["term"] for row in rows)),
        inline=json.dumps(buckets, ensure_ascii=False),
        **tables,
    )


def write_model(model: CategoryModel, path: str) -> None:
    """Save a fitted model as tables and one line of JSON below ``path``."""
    for name in MODEL_TABLES:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    values = {name: getattr(model, name) for name in MODEL_VALUES}
    line = model.names.sparkSession.createDataFrame([(json.dumps(values),)], "value string")
    line.write.mode("overwrite").text(f"{path}/values")


def read_model(spark: SparkSession, path: str) -> CategoryModel:
    """A model that ``write_model`` saved."""
    values = json.loads(spark.read.text(f"{path}/values").first()["value"])
    for name in ("stop_words", "inline_names", "inline_terms"):
        values[name] = None if values[name] is None else tuple(values[name])
    tables = {
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in MODEL_TABLES.items()
    }
    return CategoryModel(**tables, **values)


def inline_bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(INLINE_BUCKETS))


def _require_terms(size: int) -> int:
    if size == 0:
        raise ValueError("empty vocabulary: the categories hold no words besides stop words")
    return size
