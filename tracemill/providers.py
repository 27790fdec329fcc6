"""Models as providers: columns in, columns out, with deterministic stand-ins that need no model.

A provider maps a batch of texts (or prompts) to values. ``apply_provider`` runs it once per different input, in Arrow
batches, with bounded retries; ``HashProvider`` and the heuristics below are the defaults everywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Anything that maps a list of inputs to a list of as many results."""

    def __call__(self, inputs: list[str]) -> list: ...


class HashEmbedding:
    """Unit vectors from hashed character trigrams: equal texts get equal vectors, similar ones similar vectors."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def __call__(self, inputs: list[str]) -> list[list[float]]:
        out = []
        for text in inputs:
            v = [0.0] * self.dimensions
            padded = f"  {(text or '').lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


class HashSteps:
    """Candidate steps drawn by hash from a prompt: a stand-in for a generating model."""

    #: Openings of candidate steps.
    OPENINGS = ("Since the figure shows", "Therefore", "Check the value", "The answer is", "Compare both", "Because of the chart")

    def __call__(self, inputs: list[str]) -> list[str]:
        out = []
        for text in inputs:
            h = hashlib.blake2b(text.encode(), digest_size=8).digest()
            out.append(f"{self.OPENINGS[h[0] % len(self.OPENINGS)]} {int.from_bytes(h[1:3], 'big') % 100}.")
        return out


def with_retries(provider: Callable[[list[str]], list], valid: Callable[[object], bool], attempts: int = 3) -> Callable[[list[str]], list]:
    """The provider, asked again for inputs whose result is not valid, ``attempts`` times at most; then null."""

    def run(inputs: list[str]) -> list:
        results: list = [None] * len(inputs)
        waiting = list(range(len(inputs)))
        for _ in range(attempts):
            if not waiting:
                break
            for i, r in zip(waiting, provider([inputs[i] for i in waiting])):
                results[i] = r if valid(r) else None
            waiting = [i for i in waiting if results[i] is None]
        return results

    return run


def apply_provider(df: DataFrame, column: str, provider: Provider, result: str, result_type: str, tasks: int | None = None) -> DataFrame:
    """Adds ``result``: the provider's value of ``column``, computed once per different value; null stays null."""
    wanted = df.select(F.col(column).alias("__in")).where("__in IS NOT NULL").distinct()
    wanted = wanted.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__in"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"__in": frame["__in"], "__out": provider(list(frame["__in"]))})

    made = wanted.mapInPandas(run, f"__in string, __out {result_type}")
    return df.join(made, df[column] == made["__in"], "left").drop("__in").withColumnRenamed("__out", result)


class HashChat:
    """Replies that follow from the prompt alone: a stand-in for any model that answers text with text."""

    def __init__(self, replies: tuple[str, ...] = ("Final answer: A", "Final answer: B", "The answer is 7.", "It cannot be seen.")):
        self.replies = replies

    def __call__(self, inputs: list[str]) -> list[str]:
        return [self.replies[hashlib.blake2b(x.encode(), digest_size=2).digest()[0] % len(self.replies)] for x in inputs]


class HashJudge:
    """Judge replies as JSON, with the criteria named in the prompt behind ``Criteria:``; a stand-in for a judging model."""

    def __call__(self, inputs: list[str]) -> list[str]:
        out = []
        for text in inputs:
            names = [x.strip() for x in text.rpartition("Criteria:")[2].splitlines()[0].split(";") if x.strip()] if "Criteria:" in text else []
            score = lambda n: 1 + hashlib.blake2b((text + n).encode(), digest_size=2).digest()[0] % 10  # noqa: B023, E731
            out.append(json.dumps({"step_index": 1, "reward_categories": names, "reward_scores": {n: score(n) for n in names}}))
        return out


class HashLogits:
    """(good, bad) logits of every step mark in a trace: a stand-in for a step-scoring model."""

    def __init__(self, mark: str = "ки"):
        self.mark = mark

    def __call__(self, inputs: list[str]) -> list[list[list[float]]]:
        out = []
        for text in inputs:
            parts = text.split(self.mark)[:-1]
            digest = [hashlib.blake2b("".join(parts[: k + 1]).encode(), digest_size=2).digest() for k in range(len(parts))]
            out.append([[d[0] / 32.0, d[1] / 32.0] for d in digest])
        return out


def waits(attempt: int, most: float = 60.0) -> float:
    """Seconds before the next attempt: doubling, up to ``most``."""
    return min(most, 2.0 ** min(attempt, 6))


def with_backoff(provider: Provider, valid: Callable[[object], bool], attempts: int = 5, sleep: Callable[[float], None] | None = None) -> Callable[[list[str]], list]:
    """As ``with_retries``, waiting longer between attempts; an attempt that raises counts as one without valid results."""
    import time

    pause = sleep or time.sleep

    def run(inputs: list[str]) -> list:
        results: list = [None] * len(inputs)
        waiting = list(range(len(inputs)))
        for n in range(attempts):
            if n:
                pause(waits(n))
            try:
                made = provider([inputs[i] for i in waiting])
            except Exception:  # noqa: BLE001  a model's failure is its own
                continue
            for i, r in zip(waiting, made):
                results[i] = r if valid(r) else None
            waiting = [i for i in waiting if results[i] is None]
            if not waiting:
                break
        return results

    return run


def shortening(provider: Provider, too_long: Callable[[str], bool], keep: float = 0.9, attempts: int = 20) -> Callable[[list[str]], list]:
    """The provider, asked with the last ``keep`` of a prompt as long as it is too long."""

    def run(inputs: list[str]) -> list:
        fitted = []
        for x in inputs:
            for _ in range(attempts):
                if not too_long(x):
                    break
                x = x[len(x) - int(len(x) * keep) :]
            fitted.append(x)
        return provider(fitted)

    return run


def generate_criteria(df: DataFrame, prompt: str, provider: Provider, result: str = "criteria", most: int = 5) -> DataFrame:
    """Adds array<string>: the criteria a model names for a prompt, a line each or separated by ; or ,, trimmed, each once, ``most`` at most."""
    made = apply_provider(df, prompt, provider, "__reply", "string")
    lines = F.transform(F.split(F.coalesce("__reply", F.lit("")), r"[\n;,、；]"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", ""))
    return made.withColumn(result, F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, most)).drop("__reply")


def judge_steps(df: DataFrame, question: str, step: str, criteria: str, provider: Provider, result: str = "review") -> DataFrame:
    """Adds a struct of what a judge says about a step: index, categories and scores, from its JSON; null where none can be read."""
    from tracemill.sources.io import json_repaired

    prompt = F.concat(F.lit("Judge this step as JSON.\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nStep: "), F.coalesce(step, F.lit("")), F.lit("\nCriteria: "), F.array_join(criteria, "; "), F.lit("\n"))
    made = apply_provider(df.withColumn("__prompt", prompt), "__prompt", provider, "__reply", "string")
    return made.withColumn(result, json_repaired(F.col("__reply"), "step_index int, reward_categories array<string>, reward_scores map<string,int>")).drop("__prompt", "__reply")


def sample_responses(df: DataFrame, key: str, prompt: str, n: int, provider: Provider) -> DataFrame:
    """(key, k, response): ``n`` responses to each prompt; the number of the sample is part of what the model sees as its seed."""
    asked = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), prompt).withColumn("__p", F.concat(F.col("k").cast("string"), F.lit("|"), prompt))
    return apply_provider(asked, "__p", provider, "response", "string").select(key, "k", "response")


def continue_prefixes(df: DataFrame, key: str, question: str, prefix: str, n: int, provider: Provider) -> DataFrame:
    """(key, k, rejected): each prefix carried on ``n`` times by a model; rejected is prefix and continuation."""
    asked = df.select(key, prefix, F.concat(F.coalesce(question, F.lit("")), F.lit("\n"), prefix).alias("__q")).where(F.col(prefix).isNotNull())
    made = sample_responses(asked, key, "__q", n, provider)
    return made.join(asked.select(key, prefix), key).select(key, "k", F.concat(F.col(prefix), F.col("response")).alias("rejected"))


def score_traces(df: DataFrame, trace: str, provider: Provider, result: str = "step_scores") -> DataFrame:
    """Adds array<double>: the probability of a good step at every step mark of a trace, from a model's two logits."""
    from tracemill.functions.scores import prm_probability

    made = apply_provider(df, trace, provider, "__logits", "array<array<double>>")
    return made.withColumn(result, F.transform("__logits", lambda x: prm_probability(F.get(x, F.lit(0)), F.get(x, F.lit(1))))).drop("__logits")


def name_clusters(members: DataFrame, cluster: str, name: str, provider: Provider, most_shown: int = 200) -> DataFrame:
    """(cluster, name, children): a model's name for each cluster of two members or more, from its members in order.

    A cluster of one member passes through without a name of its own. A model sees the first ``most_shown`` members.
    """
    lists = members.groupBy(cluster).agg(F.array_sort(F.collect_set(name)).alias("children"))
    many = lists.where(F.size("children") > 1).withColumn("__p", F.concat(F.lit("Name this group: "), F.array_join(F.slice("children", 1, most_shown), "; ")))
    named = apply_provider(many, "__p", provider, "__n", "string").select(cluster, F.trim("__n").alias("name"), "children")
    return named.unionByName(lists.where(F.size("children") == 1).select(cluster, F.get("children", F.lit(0)).alias("name"), "children"))


def chat(df: DataFrame, key: str, prompt: str, provider: Provider) -> DataFrame:
    """(key, reply) of every prompt."""
    return apply_provider(df.select(key, prompt), prompt, provider, "reply", "string").select(key, "reply")
