"""Step reviews and rewards: normalised judge output, trajectory rewards, search trees as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scores import coerce_score
from tracemill.functions.text import strip

NEUTRAL = 5


def normalize_review(categories: Column, scores: Column, candidates: Column | None = None, least: int = 3, most: int = 5) -> Column:
    """struct<categories, scores, normalized, mean> of one step review.

    Categories are stripped, blank and repeated ones go; scores become whole numbers of 1 to 10 (5 where missing); too
    few categories are filled up from the candidates, too many cut off; the mean of none is 0.
    """
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.filter(F.transform(F.coalesce(categories, none), strip), lambda c: c.isNotNull() & (c != "")))
    spare = F.array_except(F.filter(F.coalesce(candidates, none), lambda c: c.isNotNull() & (c != "")), own) if candidates is not None else none
    filled = F.concat(own, F.slice(spare, F.lit(1), F.greatest(F.lit(0), least - F.size(own))))
    kept = F.slice(filled, 1, most)
    value = lambda c: F.coalesce(coerce_score(F.try_element_at(scores, c)), F.lit(NEUTRAL))
    rated = F.transform(kept, lambda c: value(c))
    shares = F.transform(rated, lambda v: (v - 1) / F.lit(9.0))
    mean = F.when(F.size(kept) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(kept) > 0, F.size(kept))).otherwise(0.0)
    return F.struct(kept.alias("categories"), F.map_from_arrays(kept, rated).alias("scores"), F.map_from_arrays(kept, shares).alias("normalized"), mean.alias("mean"))


def normalize_reviews(steps: DataFrame, reviews: DataFrame, key: str, least: int = 3, most: int = 5) -> DataFrame:
    """(key, step_index, step_text, selected_parent, review): every review, and a filled-in one for each step without.

    ``steps`` is (key, step_index, step_text, selected_parent, candidates), ``reviews`` (key, step_index, step_text,
    selected_parent, categories, scores); reviews without a step index stay, last in order. Missing criteria are named
    ``Generic Criterion k``.
    """
    s = steps.select(key, "step_index", F.col("step_text").alias("s_text"), F.col("selected_parent").alias("s_parent"), "candidates")
    r = reviews.select(key, "step_index", F.col("step_text").alias("r_text"), F.col("selected_parent").alias("r_parent"), "categories", "scores").withColumn("reviewed", F.lit(True))
    joined = s.join(r, [key, "step_index"], "full_outer")
    generic = F.transform(F.sequence(F.lit(1), F.lit(least)), lambda k: F.concat(F.lit("Generic Criterion "), k.cast("string")))
    base = F.slice(F.coalesce("candidates", F.array().cast("array<string>")), 1, most)
    fallback = F.concat(base, F.filter(generic, lambda g, i: i >= F.size(base)))
    own = normalize_review(F.col("categories"), F.col("scores"), F.col("candidates"), least, most)
    filled = normalize_review(fallback, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), None, 0, most)
    text, parent = F.coalesce(F.when(F.col("r_text") != "", F.col("r_text")), "s_text", F.lit("")), F.coalesce(F.when(F.col("r_parent") != "", F.col("r_parent")), "s_parent")
    return joined.select(key, "step_index", text.alias("step_text"), parent.alias("selected_parent"), F.when(F.coalesce("reviewed", F.lit(False)), own).otherwise(filled).alias("review"))


def trajectory_rewards(steps: DataFrame, item: str, vector: str, dimensions: int) -> DataFrame:
    """(item, reward): per dimension the mean over a trajectory's steps with a vector; 0.5 in all where no step has one."""
    means = [F.avg(F.get(F.col(vector), F.lit(i))) for i in range(dimensions)]
    return steps.groupBy(item).agg(F.array(*(F.round(F.coalesce(m, F.lit(0.5)), 6) for m in means)).alias("reward"))


def leaf_candidates(nodes: DataFrame, tree: str, node: str, parent: str, depth: str, terminal: Column | None = None) -> DataFrame:
    """Nodes below the root without children, or terminal; the whole tree below the root where it has none."""
    parents = nodes.select(F.col(tree).alias("t"), F.col(parent).alias("p")).where("p IS NOT NULL").distinct()
    marked = nodes.join(parents, (F.col(tree) == F.col("t")) & (F.col(node) == F.col("p")), "left")
    leaf = F.col("p").isNull() | (terminal if terminal is not None else F.lit(False))
    below = marked.where(F.col(depth) > 0).withColumn("leaf", leaf).drop("t", "p")
    some = F.max("leaf").over(Window.partitionBy(tree))
    return below.withColumn("some", some).where(F.col("leaf") | ~F.col("some")).drop("leaf", "some")


def best_candidate(candidates: DataFrame, item: str, score: str, order: str) -> DataFrame:
    """The row of the best score per item, the first in order among equals; a top-1, so it is cut before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(score), F.asc(order)))
    return candidates.withColumn("rn", rn).where("rn = 1").drop("rn")


def backpropagate(simulations: DataFrame, path: str, value: str) -> DataFrame:
    """(node, visits, value_sum) from simulations that name the nodes on their way."""
    return simulations.select(F.explode(path).alias("node"), value).groupBy("node").agg(F.count("*").alias("visits"), F.sum(value).alias("value_sum"))


def prm_step_scores(df: DataFrame, key: str, scores: str, n_steps: str) -> DataFrame:
    """(key, step_scores, answer_score) where there is a score for each step and one for the answer."""
    right = df.where(F.size(scores) == F.col(n_steps) + 1)
    return right.select(key, F.slice(scores, F.lit(1), F.col(n_steps)).alias("step_scores"), F.element_at(scores, -1).alias("answer_score"))


def reward_margins(df: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    """One row of means over pairs: both rewards, the share of pairs in the right order, and the margin."""
    both = df.select(chosen.alias("c"), rejected.alias("r")).where("c IS NOT NULL AND r IS NOT NULL")
    mean = lambda x: F.round(F.avg(x), 6)
    return both.agg(F.count("*").alias("n_pairs"), mean("c").alias("reward_chosen"), mean("r").alias("reward_rejected"), mean((F.col("c") > F.col("r")).cast("double")).alias("accuracy"), mean(F.col("c") - F.col("r")).alias("margin"))


def in_step_order(reviews: Column) -> Column:
    """Reviews (array of structs with ``step_index``) by step index, those without one last, in their own order."""
    numbered = F.transform(reviews, lambda r, i: F.struct(r["step_index"].isNull().alias("none"), r["step_index"].alias("at"), i.alias("i"), r.alias("r")))
    # maps inside a review have no order, so only the sort keys are compared
    keys = F.array_sort(F.transform(numbered, lambda x: F.struct(x["none"], x["at"], x["i"])))
    return F.transform(keys, lambda k: F.get(reviews, k["i"]))


def categories_by_id(judgments: DataFrame, key: str, good: str, bad: str) -> DataFrame:
    """(key, good, bad): all reward categories of both sides' reviews, in order, repeats kept; null reviews have none."""
    none = F.array().cast("array<string>")
    side = lambda c: F.coalesce(F.flatten(F.transform(c, lambda r: F.coalesce(r["reward_categories"], none))), none)
    return judgments.select(key, side(good).alias("good"), side(bad).alias("bad"))


def category_index(lists: DataFrame, key: str) -> DataFrame:
    """(mode, category, support): in how many ids a category occurs, among good ones, bad ones and all."""
    entry = lambda c, mode: F.transform(c, lambda x: F.struct(F.lit(mode).alias("mode"), x.alias("category")))
    both = F.array_distinct(F.concat(entry("good", "good"), entry("bad", "bad"), entry("good", "all"), entry("bad", "all")))
    rows = lists.select(key, F.explode(both).alias("e")).where("e.category IS NOT NULL").select(key, "e.mode", "e.category").distinct()
    return rows.groupBy("mode", "category").agg(F.count("*").alias("support"))


def first_distinct(values: Column, most: int) -> Column:
    """The first ``most`` different values in their order."""
    return F.slice(F.array_distinct(values), 1, most)
