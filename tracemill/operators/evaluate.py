"""Benchmark evaluation: joins of predictions with gold answers, accuracies by facet and in roll-ups, vote and edit scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, score: Column, answered: Column | None = None) -> DataFrame:
    """One row (asked, answered, correct, acc_answered, acc_asked); predictions that cannot be read count as asked only."""
    given = score.isNotNull() if answered is None else answered
    total = F.coalesce(F.sum(F.when(given, score.cast("double"))), F.lit(0.0))
    sums = df.agg(F.count("*").alias("asked"), F.count_if(given).alias("answered"), F.round(total, 6).alias("correct"))
    share = lambda n: F.round(F.try_divide(F.col("correct"), F.col(n)), 6)
    return sums.select("*", share("answered").alias("acc_answered"), share("asked").alias("acc_asked"))


def accuracy_by_facet(df: DataFrame, facets: list[str], score: Column) -> DataFrame:
    """(facet, value, n, acc) for each value of each facet; an array facet counts in each of its values. One pass over the rows."""
    kinds = dict(df.dtypes)

    def entry(f: str) -> Column:
        values = F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))
        return F.transform(values, lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))

    entries = [entry(f) for f in facets]
    exploded = df.select(score.cast("double").alias("score"), F.explode(F.concat(*(F.coalesce(e, F.array().cast("array<struct<facet:string,value:string>>")) for e in entries))).alias("e"))
    return exploded.groupBy("e.facet", "e.value").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("acc"))


def accuracy_rollup(df: DataFrame, domain: str, category: str, score: Column) -> DataFrame:
    """(domain, category, n, acc, level) of categories, domains and the whole: level 0, 1 and 3."""
    rolled = df.select(domain, category, score.cast("double").alias("score")).rollup(domain, category)
    return rolled.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("acc"), F.grouping_id().cast("int").alias("level"))


def validate_submission(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One row (n_predictions, n_gold, missing, unknown, repeated, valid) of a submission against the gold ids."""
    p = predictions.groupBy(key).agg(F.count("*").alias("np"))
    g = gold.groupBy(key).agg(F.count("*").alias("ng"))
    both = p.join(g, key, "full_outer")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(zero("np").alias("n_predictions"), zero("ng").alias("n_gold"), F.count_if(F.col("np").isNull()).alias("missing"), F.count_if(F.col("ng").isNull()).alias("unknown"), F.count_if(F.col("np") > 1).alias("repeated"))
    return out.withColumn("valid", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))


def join_gold(predictions: DataFrame, gold: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Predictions with their gold columns, an inner join; ``strict`` raises when a prediction has no gold row."""
    if not strict:
        return predictions.join(gold, key)
    joined = predictions.join(gold.withColumn("__g", F.lit(True)), key, "left")
    checked = F.assert_true(F.col("__g").isNotNull(), F.lit(f"a prediction has no gold row for its {key}"))
    return joined.where(checked.isNull()).drop("__g")


def gain(scores: DataFrame, baseline: DataFrame, keys: list[str], score: str = "acc", strict: bool = False) -> DataFrame:
    """Scores with the baseline of their keys and the difference, rounded to two places; ``strict`` raises where a baseline is missing."""
    known = baseline.select(*keys, F.col(score).alias("baseline"), F.lit(True).alias("__b"))
    joined = scores.join(known, keys, "left" if strict else "inner")
    if strict:
        joined = joined.where(F.assert_true(F.coalesce("__b", F.lit(False)), F.lit("a score has no baseline")).isNull())
    return joined.drop("__b").withColumn("gain", F.round(F.col(score) - F.col("baseline"), 2))


def vote_counts(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, answer, votes)."""
    return answers.groupBy(key, answer).agg(F.count("*").alias("votes"))


def ngram_repetition(df: DataFrame, key: str, text: Column, n: int = 10) -> DataFrame:
    """(key, n_grams, ratio): distinct n-grams that occur more than once over all n-grams, 0 for short texts."""
    from tracemill.functions.text import tokens

    def ratio(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " ")))
        # sorted, equal n-grams are neighbours: one pass counts those that equal the one before, each run once
        start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(False).alias("counted"), F.lit(0).alias("r"))

        def step(acc: Column, g: Column) -> Column:
            same = F.coalesce(g == acc["last"], F.lit(False))
            return F.struct(g.alias("last"), same.alias("counted"), (acc["r"] + F.when(same & ~acc["counted"], 1).otherwise(0)).alias("r"))

        repeated = F.aggregate(F.array_sort(grams), start, step)["r"]
        return F.struct(F.greatest(F.lit(0), F.size(words) - n + 1).alias("n"), F.when(F.size(words) >= n, repeated).otherwise(0).alias("r"))

    # the words are a lambda's variable, or every n-gram would split the text anew
    found = df.select(key, F.get(F.transform(F.array(tokens(text)), ratio), F.lit(0)).alias("x"))
    return found.select(key, F.col("x.n").alias("n_grams"), F.round(F.when(F.col("x.n") > 0, F.col("x.r") / F.when(F.col("x.n") > 0, F.col("x.n"))).otherwise(0.0), 6).alias("ratio"))


def bleu4(df: DataFrame, key: str, candidate: Column, reference: Column) -> DataFrame:
    """(key, bleu): BLEU-4 of a text against one reference, clipped n-gram precisions with brevity penalty; 0 where one order has no match.

    Keys are unique. N-grams are rows and are counted by aggregates, so the work grows with the texts' lengths.
    """
    from tracemill.functions.text import tokens

    def grams(words: Column, n: int, side: str) -> Column:
        last = F.size(words) - n
        made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice(words, i + 1, n), " ")).alias("gram"), F.lit(side).alias("side")))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<n:int,gram:bigint,side:string>>"))

    said = df.select(key, tokens(F.lower(candidate)).alias("__c"), tokens(F.lower(reference)).alias("__r"))
    sizes = said.select(key, F.size("__c").alias("nc"), F.size("__r").alias("nr"))
    rows = said.select(key, F.explode(F.concat(*(grams(F.col(c), n, c) for n in range(1, 5) for c in ("__c", "__r")))).alias("g"))
    counts = rows.groupBy(key, "g.n", "g.gram").agg(F.count_if(F.col("g.side") == "__c").alias("c"), F.count_if(F.col("g.side") == "__r").alias("r"))
    orders = counts.groupBy(key, "n").agg(F.sum(F.least("c", "r")).alias("hits"), F.sum("c").alias("all"))
    logs = orders.where("hits > 0").groupBy(key).agg(F.sum(F.ln(F.col("hits") / F.col("all")) / 4).alias("logs"), F.count("*").alias("found"))
    brevity = F.when(F.col("nc") >= F.col("nr"), 0.0).otherwise(1 - F.col("nr") / F.when(F.col("nc") > 0, F.col("nc")))
    joined = sizes.join(logs, key, "left")
    return joined.select(key, F.when(F.col("found") == 4, F.exp(F.col("logs") + brevity)).otherwise(0.0).alias("bleu"))


def best_annotation(score: Callable[[Column], Column], annotations: Column) -> Column:
    """The greatest score over an answer's annotations (array<string>); null without any."""
    return F.array_max(F.transform(annotations, lambda a: score(a).cast("double")))


def eval_multi_choice(gold: Column, prediction: Column) -> Column:
    """Whether the prediction is one of the right choices, character for character; gold is array<string> (one entry for a single answer)."""
    return F.coalesce(F.array_contains(gold, prediction), F.lit(False))


def with_gold_default(problems: DataFrame, gold: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """Problems with their answer: their own, else that of the gold rows, else an empty string."""
    joined = problems.join(gold.select(key, F.col(answer).alias("__gold")), key, "left")
    return joined.withColumn(answer, F.coalesce(answer, "__gold", F.lit(""))).drop("__gold")


def category_of(ident: Column) -> Column:
    """The category inside an id ``part_Category_Name_number``: the middle parts."""
    parts = F.split(ident, "_")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), "_")


def align_by_category(outputs: DataFrame, answers: DataFrame, key: str, categories: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Outputs with their answers, of categories that both sides have; an id without answer in such a category raises if ``strict``.

    ``categories`` leaves others out.
    """
    o, a = (df.withColumn("category", category_of(F.col(key))) for df in (outputs, answers))
    shared = a.select("category").distinct()
    if categories is not None:
        shared = shared.where(F.col("category").isin(categories))
    found = o.join(shared, "category", "left_semi").join(a.drop("category").withColumn("__there", F.lit(True)), key, "left")
    if not strict:
        return found.where("__there").drop("__there")
    # no second filter may stand beside the check, or it would decide first
    checked = F.assert_true(F.coalesce("__there", F.lit(False)), F.concat(F.lit("no answer for "), key))
    return found.where(checked.isNull()).drop("__there")


def full_denominator(scored: DataFrame, gold: DataFrame, key: str, score: str, excluded: list | None = None) -> DataFrame:
    """One row (n, mean): the mean score over all gold ids but the excluded; ids that were not answered score 0."""
    ids = gold.select(key).distinct()
    if excluded:
        ids = ids.where(~F.col(key).isin(excluded))
    return ids.join(scored.select(key, score), key, "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(score, F.lit(0.0))), 6).alias("mean"))


def percent(correct: Column, total: Column) -> Column:
    """100 x correct / total with two places, as text without needless zeros but one: 66.67, 50.0."""
    value = F.round(100.0 * correct / F.when(total > 0, total), 2)
    return value.cast("string")


def title_equal(a: Column, b: Column) -> Column:
    """Equality of title-cased texts, which is equality but for case."""
    return F.lower(a) == F.lower(b)


def report_lines(metrics: DataFrame, facet: str, value: str, score: str) -> DataFrame:
    """(facet, lines): a metric report, one text a facet with its values in order."""
    entry = F.struct(F.col(value).alias("v"), F.concat_ws(": ", F.col(value), F.format_string("%.4f", F.col(score))).alias("line"))
    return metrics.groupBy(facet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]), "\n").alias("lines"))
