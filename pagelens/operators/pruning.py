"""The best category of a page without scoring every category.

A term that many categories share costs a row for each of them, though most cannot win.
Each term's category list is cut into tiers by weight, and a tier's largest weight bounds
what it can add to a score (upper-bound pruning, as MaxScore does it). The lists' leaders
give a score that some category surely reaches. The tiers that together stay below it need
not be read to find candidates: a category found in no other tier cannot be the best.
Candidates that cannot reach the best partial score any more go too; those that are left
are scored over all their terms, so the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators import lookup
from pagelens.operators.model import CategoryModel
from pagelens.sources.tables import store

#: Weights halve from tier to tier; the last one holds all that is left.
TIERS = 12
#: Sums in another order may differ by so much, relatively.
SLACK = 1e-9


def _tier(weight: Column) -> Column:
    return F.least(F.floor(-F.log2(weight)), F.lit(TIERS)).cast("int")


def _list(term: str = "term", tier: str = "tier") -> Column:
    """The name of a tier's list; no term holds a tab."""
    return F.concat(F.col(term), F.lit("\t"), F.col(tier).cast("string")).alias("list")


def tiered_lists(model: CategoryModel) -> DataFrame:
    """``(list, term, tier, cat_idx, _profile)``: the profiles, dealt into tiers."""
    rows = model.profiles.where("weight > 0").select(
        "term", "cat_idx", F.col("weight").alias("_profile"), _tier(F.col("weight")).alias("tier")
    )
    return store(rows.select(_list(), "term", "tier", "cat_idx", "_profile"), "lists")


def needed_lists(weights: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """``(key, list, weight, rest)``: the lists that can hold a page's best category.

    ``weights(key, term, weight)`` are page vectors. ``rest`` is the most that the lists
    left out can add to a score.
    """
    bounds = lists.groupBy("term", "tier").agg(
        F.max("_profile").alias("most"), F.max_by("cat_idx", "_profile").alias("leader")
    )
    bounds = store(bounds, "list-bounds")
    found = lookup.lookup_join(weights, bounds, "term", bounds.count(), key)
    found = found.withColumn("impact", F.col("weight") * F.col("most")).repartition(key)
    # Of a term, one tier counts: a higher one takes the place of the one below it.
    lower = F.lag("impact", 1, 0.0).over(Window.partitionBy(key, "term").orderBy("impact"))
    reached = F.sum("impact").over(Window.partitionBy(key, "leader"))
    found = found.withColumns({"rise": F.col("impact") - lower, "reached": reached})
    upward = Window.partitionBy(key).orderBy("impact", "term", "tier")
    below = F.sum("rise").over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(key)
    found = found.withColumns({"below": below, "sure": F.max("reached").over(whole)})
    small = F.col("below") * (1 + SLACK) < F.col("sure")
    rest = F.coalesce(F.max(F.when(small, F.col("below"))).over(whole), F.lit(0.0))
    return found.withColumns({"rest": rest, "small": small}).where("NOT small").select(
        key, _list(), "weight", "rest"
    )


def partial_scores(needed: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """``(key, cat_idx, part, rest)``: a row for each category of each needed list."""
    entries = lists.select("list", "cat_idx", "_profile")
    joined = lookup.lookup_join(needed, entries, "list", lists.count(), key)
    return joined.select(
        key, "cat_idx", (F.col("weight") * F.col("_profile")).alias("part"), "rest"
    )


def candidates(parts: DataFrame, key: str) -> DataFrame:
    """``(key, cat_idx)`` of the categories that can still be a page's best."""
    sums = parts.groupBy(key, "cat_idx").agg(
        F.sum("part").alias("partial"), F.first("rest").alias("rest")
    )
    best = F.max("partial").over(Window.partitionBy(key))
    reach = (F.col("partial") + F.col("rest")) * (1 + SLACK)
    return sums.withColumn("best", best).where(reach >= F.col("best")).select(key, "cat_idx")


def pruned_similarities(
    weights: DataFrame, model: CategoryModel, key: str, boosts: DataFrame
) -> DataFrame:
    """Terms of the cosine sums as ``(key, cat_idx, part)``, for categories that may be best.

    ``boosts(key, cat_idx)`` are scored whatever their terms.
    """
    weights = store(weights, "page-weights")
    lists = tiered_lists(model)
    parts = partial_scores(needed_lists(weights, lists, key), lists, key)
    kept = candidates(parts, key).union(boosts.select(key, "cat_idx")).distinct()
    scored = store(kept, "candidates").join(weights, key)
    return scored.join(lists.select("term", "cat_idx", "_profile"), ["term", "cat_idx"]).select(
        key, "cat_idx", (F.col("weight") * F.col("_profile")).alias("part")
    )
