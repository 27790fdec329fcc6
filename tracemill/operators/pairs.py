"""Chosen and rejected pairs: from correctness, from margins, with their statistics and resumption.

Hash order stands for random order everywhere: rows are ordered by the md5 of their id and a seed, so that a sample is
the same on every run and in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*columns: Column | str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


def pairs_per_key(lines: DataFrame, usual: int = 15, few: int = 3, many_lines: int = 500_000) -> int:
    """The number of pairs a key may give: 15, or 3 where there are more than 500,000 lines."""
    return few if lines.count() > many_lines else usual


def pos_neg_pairs(positives: DataFrame, negatives: DataFrame, keys: list[str], id_col: str, answer_col: str, most: int = 15, seed: int = 0, salts: int = 16) -> DataFrame:
    """(keys, chosen_id, rejected_id): at most ``most`` pairs per key whose negative answer does not hold the positive one.

    Pairs are taken in the order of (the later of both hashes, the positive's, the negative's). Rows of a key with the
    same answer pass the test alike, and in this order a row never goes before one of them with a smaller hash; so
    ``most`` rows of each (key, answer) are all that can be part of the result, and a key's full product is never made.
    A key with many different answers is dealt to ``salts`` parts by its negatives, each of which keeps its first pairs
    before they meet. Null answers hold nothing and are held by nothing.
    """

    def first(df: DataFrame, name: str) -> DataFrame:
        hashed = df.select(*keys, F.col(id_col).alias(f"{name}_id"), F.lower(answer_col).alias(f"{name}_answer"), hash_order(id_col, seed=seed).alias(f"{name}_hash"))
        order = Window.partitionBy(*keys, f"{name}_answer").orderBy(f"{name}_hash", f"{name}_id")
        return hashed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")

    spread = first(negatives, "rejected").withColumn("__salt", F.pmod(F.xxhash64("rejected_id"), F.lit(salts)).cast("int"))
    copied = first(positives, "chosen").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = copied.join(spread, [*keys, "__salt"])
    joined = joined.where(~F.coalesce(F.contains("rejected_answer", "chosen_answer"), F.lit(False))).drop("rejected_answer", "chosen_answer")

    def best(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.greatest("chosen_hash", "rejected_hash"), "chosen_hash", "rejected_hash", "chosen_id", "rejected_id")
        return df.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most).drop("rk")

    return best(best(joined, *keys, "__salt"), *keys).select(*keys, "chosen_id", "rejected_id")


def pair_rows(found: DataFrame, rows: DataFrame, keys: list[str], id_col: str, *columns: str) -> DataFrame:
    """The pairs with both rows' columns: the first one as chosen and rejected, others as chosen_x and rejected_x."""
    name = lambda side, k, c: side if k == 0 else f"{side}_{c}"
    out = found
    for side in ("chosen", "rejected"):
        out = out.join(rows.select(F.col(id_col).alias(f"{side}_id"), *(F.col(c).alias(name(side, k, c)) for k, c in enumerate(columns))), f"{side}_id")
    return out


def pairing_stats(scored: DataFrame, keys: list[str], correct: Column, answer_col: str) -> DataFrame:
    """One row about keys and possible pairs.

    only_in_pos, only_in_neg, in_both: keys with correct, wrong and both kinds of answers; max_possible_pairs; n_pos, n_neg;
    entail_skip: possible pairs whose negative answer holds the positive one; key_without_pairs: keys that have both kinds
    but no pair beyond these. Answers are counted per key and spelling before they meet, so equal ones meet once.
    """
    kinds = scored.groupBy(*keys, F.lower(answer_col).alias("__a")).agg(F.count_if(correct).alias("p"), F.count_if(~correct).alias("n"))
    positive = kinds.where("p > 0 AND __a IS NOT NULL").select(*keys, F.col("__a").alias("__pa"), "p")
    negative = kinds.where("n > 0 AND __a IS NOT NULL").select(*keys, F.col("__a").alias("__na"), "n")
    entailed = positive.join(negative, keys).where(F.contains("__na", "__pa")).groupBy(*keys).agg(F.sum(F.col("p") * F.col("n")).alias("skipped"))
    per_key = kinds.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).join(entailed, keys, "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    pos, neg, possible = F.col("p") > 0, F.col("n") > 0, F.col("p") * F.col("n")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(
        F.count_if(pos & ~neg).alias("only_in_pos"), F.count_if(neg & ~pos).alias("only_in_neg"), F.count_if(pos & neg).alias("in_both"),
        zero(possible).alias("max_possible_pairs"), zero("p").alias("n_pos"), zero("n").alias("n_neg"),
        zero("skipped").alias("entail_skip"), F.count_if((possible > 0) & (possible == F.col("skipped"))).alias("key_without_pairs"),
    )


def key_set_ops(rows: DataFrame, keys: list[str], positive: Column, negative: Column) -> DataFrame:
    """(op, n): how many keys are in one set only, in both and in either, from one aggregate over the rows."""
    kinds = rows.groupBy(*keys).agg(F.max(positive.cast("int")).alias("p"), F.max(negative.cast("int")).alias("n"))
    p, n = F.col("p") == 1, F.col("n") == 1
    counts = kinds.agg(F.count_if(p & ~n).alias("pos_minus_neg"), F.count_if(n & ~p).alias("neg_minus_pos"), F.count_if(p & n).alias("intersection"), F.count_if(p | n).alias("union"))
    return counts.unpivot([], ["pos_minus_neg", "neg_minus_pos", "intersection", "union"], "op", "n")


def gt_augment(positives: DataFrame, gold: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """The positives, and the gold rows of keys without one (of all keys if ``force``)."""
    added = gold if force else gold.join(positives.select(*keys).distinct(), keys, "left_anti")
    return positives.unionByName(added)


def margin_pairs(candidates: DataFrame, item: str, candidate: str, score: str, margin: float = 0.05, most: int = 1) -> DataFrame:
    """(item, chosen, rejected, margin): per item the pairs whose scores differ by the margin, best chosen and worst rejected first.

    Candidates rank by score, ties by id. Whatever pairs are wanted first, they consist of the ``most`` best and the
    ``most`` worst candidates, so each side is a top-k per item that is cut before the shuffle, and no item's candidates
    are joined with each other. Null scores take no part.
    """

    def top(best: bool) -> DataFrame:
        order = (F.desc(score), F.asc(candidate)) if best else (F.asc(score), F.desc(candidate))
        rn = F.row_number().over(Window.partitionBy(item).orderBy(*order))
        name = "chosen" if best else "rejected"
        ranked = candidates.where(F.col(score).isNotNull()).withColumn("rn", rn).where(F.col("rn") <= most)
        return ranked.select(item, F.col(candidate).alias(name), F.col(score).alias(f"{name}_score"), F.col("rn").alias(f"{name}_rank"))

    joined = top(True).join(top(False), item)
    gap = F.col("chosen_score") - F.col("rejected_score")
    before = (gap > 0) | ((gap == 0) & (F.col("chosen") < F.col("rejected")))
    order = Window.partitionBy(item).orderBy("chosen_rank", "rejected_rank")
    best = joined.where(before & (gap >= margin)).withColumn("k", F.row_number().over(order))
    return best.where(F.col("k") <= most).select(item, "chosen", "rejected", F.round(gap, 6).alias("margin"))


def resume_deficit(wanted: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n_done, needed) of keys that have fewer than ``n`` results."""
    counts = done.groupBy(key).agg(F.count("*").alias("n_done"))
    joined = wanted.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n_done", F.lit(0)).alias("n_done"))
    return joined.withColumn("needed", F.lit(n) - F.col("n_done")).where("needed > 0")


def distinct_pairs(pairs: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per pair; the one that arrived last wins."""
    order = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
