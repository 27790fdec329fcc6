"""Problem 6: repetition inside single values.

Each value of at least ``least_words`` words has four statistics: the share of repeated runs of five words, that of
repeated word pairs (square root), that of repeated sentences, and the logarithm of distinct words to all. Per language
and source their centre and covariance are the minimum-covariance-determinant estimates: from three starts (medians and
median deviations, all values, an eighth of them) concentration steps keep the half of the group that is nearest and
estimate again, all starts in one aggregate over all rows a step; the smallest determinant wins. Values whose robust Mahalanobis distance is beyond the chi-squared quantile are rejected, and a rejected
value is reported if its exact share of repeated runs reaches the limit.

A distance is never smaller than that of one coordinate alone, so in a group whose centre of repeated runs is at most
``SAFE_CENTRE`` with a deviation of at most (limit - SAFE_CENTRE) / sqrt(quantile), every value at the limit is rejected.
Groups that do not give this promise (most of their values repeat, say) reject all their values, so none is lost. Groups
of fewer than ``least_group`` values are joined with the other small ones of their language, then with all small ones.

Every value has a share: 0 where it has fewer than five words, null where it is null. Values of fewer than
``least_words`` words take no part in the estimates, have no distance and are not reported; re-delivered records count
once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import WordIds, ids_of, language_of, shingle_hashes, words_of
from tracemill.session import cut, table

LEAST_WORDS, RUN, LIMIT = 20, 5, 0.3
LEAST_GROUP, STEPS, SAFE_CENTRE = 60, 4, 0.1
#: The 0.975 quantile of chi-squared with four degrees of freedom, and the least standard deviations of the statistics.
QUANTILE = 11.143
FLOORS = (0.03, 0.1, 0.06, 0.12)
NAMES = ("runs", "pairs", "sentences", "variety")
_SENTENCE = re.compile(r"[.!?。！？\n]+")


def repeated_share(words: list[str], width: int) -> float:
    """1 - distinct / all runs of ``width`` words, 0 without any."""
    n = len(words) - width + 1
    return 1 - len({tuple(words[i : i + width]) for i in range(n)}) / n if n > 0 else 0.0


def values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, turn_pos, source, text) of every conversation turn, chosen and rejected."""
    turns = table(spark, sf_dir, "conversation_record").select("conv_id", "ds_name", F.posexplode("conversations").alias("turn_pos", "turn"))
    said = turns.select(F.lit("conversations.value").alias("field_name"), F.col("conv_id").alias("record_id"), "turn_pos", F.col("ds_name").alias("source"), F.col("turn.value").alias("text"))
    pairs = table(spark, sf_dir, "preference_pair").select("pair_id", "ds_name", F.explode(F.array(F.struct(F.lit("chosen").alias("f"), F.col("chosen").alias("t")), F.struct(F.lit("rejected").alias("f"), F.col("rejected").alias("t")))).alias("v"))
    return said.unionByName(pairs.select(F.col("v.f").alias("field_name"), F.col("pair_id").alias("record_id"), F.lit(-1).alias("turn_pos"), F.col("ds_name").alias("source"), F.col("v.t").alias("text")))


def statistics(values: DataFrame, least_words: int = LEAST_WORDS, every: bool = False) -> DataFrame:
    """(field_name, record_id, turn_pos, source, lang, n_words, share, runs, pairs, sentences, variety).

    Shorter values are left out, or with ``every`` have ``n_words`` and ``share`` only.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text) if text and (every or len(text) >= 2 * least_words - 1) else []
                if len(words) < least_words:
                    if every:
                        at.append(i)
                        rows.append((None, len(words), None if text is None else repeated_share(words, RUN), *[None] * 4))
                    continue
                coded = ids_of(words, ids)
                shares = []
                for width in (RUN, 2):
                    runs = shingle_hashes(coded, width)
                    shares.append(1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0)
                parts = [s.strip().lower() for s in _SENTENCE.split(text)]
                parts = [s for s in parts if len(s) > 8]
                at.append(i)
                rows.append((language_of(text, words) or "none", len(words), shares[0], shares[0], shares[1] ** 0.5, 1 - len(set(parts)) / len(parts) if parts else 0.0, float(np.log(len(set(words)) / len(words)))))
            taken = pa.array(at, pa.int32())
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ("field_name", "record_id", "turn_pos", "source")), *(pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), *[pa.float64()] * 5)))], ["field_name", "record_id", "turn_pos", "source", "lang", "n_words", "share", *NAMES])

    schema = "field_name string, record_id bigint, turn_pos int, source string, lang string, n_words int, share double, " + ", ".join(f"{x} double" for x in NAMES)
    return values.select("field_name", "record_id", "turn_pos", "source", "text").mapInArrow(make, schema).dropDuplicates(["field_name", "record_id", "turn_pos"])


def _grouped(rows: DataFrame, least_group: int) -> DataFrame:
    """Adds ``grp``: language and source, or what small groups are joined to."""
    source = F.coalesce("source", F.lit(""))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < least_group)
    rest = sizes.where("small").groupBy("lang").agg((F.sum("n") < least_group).alias("few"))
    named = sizes.join(rest, "lang", "left").select("lang", "source", F.when(~F.col("small"), F.concat_ws("\u0001", "lang", source)).when(~F.col("few"), F.col("lang")).otherwise(F.lit("*")).alias("grp"))
    joined = rows.withColumn("s", source).join(named.select(F.col("lang").alias("l"), F.coalesce("source", F.lit("")).alias("t"), "grp").distinct(), (F.col("lang") == F.col("l")) & (F.col("s") == F.col("t")))
    return joined.drop("l", "t", "s")


def _invert(moments: DataFrame, best: bool = False) -> DataFrame:
    """(grp, centre, inverse, deviation), an entry a start, from per-group means and products; one small row a group.

    With ``best`` only the entry of the smallest covariance determinant is left.
    """
    p = len(NAMES)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.to_pydict()
            out = []
            for all_means, all_products in zip(b["means"], b["products"]):
                fits = []
                for means, products in zip(all_means, all_products):
                    if None in means or None in products:  # a start without values
                        continue
                    c, raw = np.array(means), np.zeros((p, p))
                    raw[np.triu_indices(p)] = products
                    cov = raw + np.triu(raw, 1).T - np.outer(c, c) + np.diag(np.square(FLOORS))
                    fits.append((float(np.linalg.det(cov)), c.tolist(), np.linalg.inv(cov).ravel().tolist(), float(cov[0, 0] ** 0.5)))
                fits = [min(fits)] if best else fits + fits[:1] * (STARTS - len(fits))
                out.append([[f[k] for f in fits] for k in (1, 2, 3)])
            lists = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([x[0] for x in out], lists), pa.array([x[1] for x in out], lists), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["grp", "centre", "inverse", "deviation"])

    return moments.mapInArrow(invert, "grp string, centre array<array<double>>, inverse array<array<double>>, deviation array<double>")


def _distance(start: int = 0) -> F.Column:
    p = len(NAMES)
    off = [F.col(x) - F.col("centre")[start][i] for i, x in enumerate(NAMES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + F.col("inverse")[start][i * p + j] * off[i] * off[j] * (1.0 if i == j else 2.0)
    return total


_UPPER = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
#: Starts of the concentration steps: medians and median deviations, all values, and an eighth of them.
STARTS = 3


def _moments(chosen: list[F.Column]) -> list[F.Column]:
    """Means and products of the rows that each condition chooses."""
    means = F.array(*(F.array(*(F.avg(F.when(c, F.col(x))) for x in NAMES)) for c in chosen))
    products = F.array(*(F.array(*(F.avg(F.when(c, F.col(a) * F.col(b))) for a, b in _UPPER)) for c in chosen))
    return [means.alias("means"), products.alias("products")]


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(grp, centre, inverse, deviation) by concentration steps on the nearer half of every group.

    All starts take their steps in the same aggregates; the one whose half has the smallest determinant wins.
    """
    eighth = F.pmod(F.xxhash64("field_name", "record_id", "turn_pos"), F.lit(8)) == 0
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"m_{x}") for x in NAMES), *_moments([F.lit(True), eighth]))
    spread = rows.join(middle, "grp").groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 10_000).alias(f"d_{x}") for x in NAMES))
    first = middle.join(spread, "grp")
    means = F.array(*(F.col(f"m_{x}") for x in NAMES))
    # products about the median: centre product plus the squared deviation on the diagonal
    products = F.array(*(F.col(f"m_{a}") * F.col(f"m_{b}") + (F.pow(1.4826 * F.col(f"d_{a}"), 2) if a == b else F.lit(0.0)) for a, b in _UPPER))
    now = cut(_invert(first.select("grp", F.concat(F.array(means), "means").alias("means"), F.concat(F.array(products), "products").alias("products"))))
    for step in range(steps):
        measured = rows.join(now, "grp").select("grp", *NAMES, *(_distance(k).alias(f"d{k}") for k in range(STARTS)))
        half = measured.groupBy("grp").agg(*(F.percentile_approx(f"d{k}", 0.5, 10_000).alias(f"h{k}") for k in range(STARTS)))
        sums = measured.join(half, "grp").groupBy("grp").agg(*_moments([F.col(f"d{k}") <= F.col(f"h{k}") for k in range(STARTS)]))
        now = cut(_invert(sums, best=step == steps - 1))
    return now


def _consistency(p: int) -> float:
    """Variance of the nearer half of a normal sample in ``p`` (even) dimensions, against the whole sample's.

    Twice the probability that chi-squared with p + 2 degrees of freedom is below the median of that with p.
    """
    below = lambda x, k: 1 - np.exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))
    low, high = 0.0, 10.0 * p
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, p) < 0.5 else (low, middle)
    return float(2 * below(low, p + 2))


CONSISTENCY = _consistency(len(NAMES))


def reject(values: DataFrame, least_words: int = LEAST_WORDS, limit: float = LIMIT, least_group: int = LEAST_GROUP) -> DataFrame:
    """(field_name, record_id, turn_pos, source, lang, n_words, share, distance, outlier, rejected) of every value of enough words."""
    return judge(cut(statistics(values, least_words)), limit, least_group)


def judge(measured: DataFrame, limit: float = LIMIT, least_group: int = LEAST_GROUP) -> DataFrame:
    """What ``reject`` gives, from the statistics of values of enough words.

    ``outlier`` says that the distance is beyond the quantile, ``rejected`` that it is or that the group gives no promise.
    """
    rows = cut(_grouped(measured, least_group))
    judged = rows.join(robust_estimates(rows), "grp").withColumn("distance", _distance() * CONSISTENCY)
    promise = (F.col("centre")[0][0] <= SAFE_CENTRE) & (F.col("deviation")[0] / CONSISTENCY**0.5 <= (limit - SAFE_CENTRE) / QUANTILE**0.5)
    outlier = F.col("distance") > QUANTILE
    return judged.select("field_name", "record_id", "turn_pos", "source", "lang", "n_words", "share", "distance", outlier.alias("outlier"), (outlier | ~promise).alias("rejected"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, turn_pos) of rejected values whose share of repeated runs is at the limit."""
    return reject(values_of(spark, sf_dir)).where(F.col("rejected") & (F.col("share") >= LIMIT - 1e-12)).select("field_name", "record_id", "turn_pos")


def shares(values: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(field_name, record_id, turn_pos, n_words, share, distance, outlier, flagged) of every value.

    ``outlier``: its statistics are far from its group's, by repetition of any kind or by lack of it; ``flagged``: its
    share is at the limit. Short values have no distance and are neither.
    """
    measured = cut(statistics(values, least_words, every=True))
    judged = judge(measured.where(F.col("n_words") >= least_words))
    flagged = F.col("rejected") & (F.col("share") >= LIMIT - 1e-12)
    short = measured.where(F.col("n_words") < least_words).withColumns({"distance": F.lit(None).cast("double"), "rejected": F.lit(False), "outlier": F.lit(False)})
    columns = ["field_name", "record_id", "turn_pos", "n_words", F.round("share", 9).alias("share"), F.round("distance", 3).alias("distance"), "outlier", F.coalesce(flagged, F.lit(False)).alias("flagged")]
    return judged.select(*columns).unionByName(short.select(*columns))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every value, with its distance (null for values of few words), whether it is an outlier and whether it is flagged."""
    return shares(values_of(spark, sf_dir))
