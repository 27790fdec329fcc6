"""Tree search per question under a worst-dimension reward: one task works on whole questions, questions are spread.

Select by UCT, expand by a provider's steps (repeated texts are one child), score by a step scorer, and send the fused
value of guidance and answer back along the way; the ideal point follows the vectors. All draws come from the provider,
so a seeded one makes the search repeatable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tracemill.functions.scores import LOGIC, VISUAL
from tracemill.providers import HashSteps, Provider


@dataclass
class Node:
    text: str
    depth: int
    parent: Node | None = None
    vector: list[float] | None = None
    visits: int = 0
    total: float = 0.0
    terminal: bool = False
    children: list[Node] = field(default_factory=list)

    def path(self) -> list[Node]:
        return [*(self.parent.path() if self.parent else []), self]


def _augmented(vector: list[float], ideal: list[float], rho: float) -> float:
    gaps = [z - v for z, v in zip(ideal, vector)]
    return -max(gaps) - rho * sum(gaps)


_FIGURES = re.compile(r"\d|=|\+|-|\*|/|°|angle")


def step_vector(text: str) -> list[float]:
    """The usual five dimensions of a step as 0 to 1, by the rules of ``scores.heuristic_scores``, for one text in a task."""
    bare, low = text.strip(), text.strip().lower()
    count = max(1, len(bare.split()))
    if not bare or "i don't know" in low or "cannot" in low:
        raw = [3.0] * 5
    else:
        correct = 6.5 if _FIGURES.search(low) else 5.5
        raw = [7.0 if any(w in low for w in VISUAL) else 5.0, 7.0 if any(w in low for w in LOGIC) else 5.5, correct, correct, 8.0 if count <= 80 else 6.0 if count <= 180 else 4.0]
    return [(x - 1) / 9 for x in raw]


def is_terminal(text: str) -> bool:
    return "<|reasoning_end|>" in text or "final answer" in text.lower() or "the answer is" in text.lower()


def search(question: str, answer: str | None, provider: Provider, scorer: Callable[[str], list[float]] = step_vector, simulations: int = 30, branching: int = 3, depth: int = 10, eta: float = 0.5, rho: float = 0.1, c: float = 1.4) -> list[dict]:
    """The candidates of one question, best first: text, score, guidance, answer reward, vector, depth and visits."""
    dimensions = len(scorer(""))
    ideal = [1.0] * dimensions
    root = Node(question, 0)

    def mean_vector(node: Node) -> list[float]:
        vectors = [n.vector for n in node.path() if n.vector is not None]
        return [sum(v[j] for v in vectors) / len(vectors) for j in range(dimensions)] if vectors else [0.5] * dimensions

    def answered(node: Node) -> float:
        text = "".join(n.text for n in node.path()[1:])[-2000:].lower()
        return 1.0 if answer and "".join(answer.lower().split()) in "".join(text.split()) else 0.0

    def value(node: Node) -> tuple[float, float, float]:
        g, a = _augmented(mean_vector(node), ideal, rho), answered(node)
        return eta * g + (1 - eta) * a, g, a

    def uct(child: Node, visits: int) -> float:
        own = _augmented(child.vector, ideal, rho) if child.visits == 0 and child.vector else child.total / max(1, child.visits)
        return own + c * math.sqrt(math.log(max(visits, 1) + 1.0) / (child.visits + 1.0))

    for turn in range(simulations):
        node = root
        while node.children and not node.terminal and len(node.children) >= branching:
            node = max(node.children, key=lambda x: uct(x, node.visits))
        if not node.terminal and node.depth < depth:
            prompts = [f"{turn}|{k}|" + "\n".join(n.text for n in node.path()) for k in range(branching - len(node.children))]
            for text in provider(prompts):
                if text and all(text != x.text for x in node.children):
                    node.children.append(Node(text, node.depth + 1, node, scorer(text), terminal=is_terminal(text)))
            if node.children:
                node = max(node.children, key=lambda x: uct(x, node.visits))
        if node.vector is not None:
            gap = max(z - v for z, v in zip(ideal, node.vector))
            ideal = [gap] * dimensions
        reward = value(node)[0]
        for n in node.path():
            n.visits += 1
            n.total += reward

    every, stack = [], list(root.children)
    while stack:
        n = stack.pop()
        every.append(n)
        stack += n.children
    leaves = [n for n in every if n.terminal or not n.children] or every
    rows = []
    for n in leaves:
        score, g, a = value(n)
        rows.append({"text": "\n".join(x.text for x in n.path()[1:]), "score": score, "guidance": g, "answer_reward": a, "vector": mean_vector(n), "depth": n.depth, "visits": n.visits})
    return sorted(rows, key=lambda r: (-r["score"], r["text"]))


def mcts_search(questions: DataFrame, key: str, question: str, answer: str, provider: Provider | None = None, tasks: int | None = None, **options) -> DataFrame:
    """(key, rank, text, score, guidance, answer_reward, vector, depth, visits): the candidates of every question."""
    steps = provider or HashSteps()
    key_type = questions.schema[key].dataType.simpleString()
    rows = questions.select(key, question, answer)
    # each question takes long for few bytes
    rows = rows.repartition(tasks or int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, q, a in frame.itertuples(index=False):
                for rank, r in enumerate(search(q or "", a, steps, **options)):
                    out.append({"key": k, "rank": rank, **r})
            yield pd.DataFrame(out, columns=["key", "rank", "text", "score", "guidance", "answer_reward", "vector", "depth", "visits"])

    schema = f"key {key_type}, rank int, text string, score double, guidance double, answer_reward double, vector array<double>, depth int, visits int"
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)
