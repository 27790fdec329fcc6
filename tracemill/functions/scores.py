"""Scores of answers, steps and traces as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.answers import evalai_normalize, normalize_answer
from tracemill.functions.text import SPACE, strip, to_double


def _relative(target: Column, prediction: Column, tolerance: float, raw_target: Column, raw_prediction: Column) -> Column:
    numeric = prediction.isNotNull() & (F.coalesce(target, F.lit(0.0)) != 0)
    return F.when(numeric, F.abs(prediction - target) / F.abs(F.when(target != 0, target)) <= tolerance).otherwise(F.lower(raw_prediction) == F.lower(raw_target))


def _percent(c: Column, divide: bool) -> Column:
    value = to_double(F.regexp_replace(c, "%+$", ""))
    return F.when(F.endswith(c, F.lit("%")), value / 100 if divide else value).otherwise(to_double(c))


def relaxed_correctness(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """Numbers within the tolerance of the target (percentages as parts of one), else equality without case."""
    return _relative(_percent(target, True), _percent(prediction, True), tolerance, target, prediction)


def relaxed_correctness_year(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """As above with percentages as they stand; four characters that start with 20 are a year and have to be equal."""
    year = (F.length(target) == 4) & F.startswith(target, F.lit("20"))
    return F.when(year, F.lower(prediction) == F.lower(target)).otherwise(_relative(_percent(target, False), _percent(prediction, False), tolerance, target, prediction))


#: What is taken off a quantity before it is read as a number.
_UNITS = r"degrees|degree|\\angle|°|%|cm"


def math_score(target: Column, prediction: Column, tolerance: float = 1e-3) -> Column:
    number = lambda c: to_double(F.regexp_replace(c, _UNITS, ""))
    return _relative(number(target), number(prediction), tolerance, target, prediction)


def multi_choice_score(prediction: Column, gold: Column) -> Column:
    """Equality without case, ``B.`` and ``(B)`` counting as B."""
    p, g = strip(prediction), strip(gold)
    dotted = F.when((F.length(p) >= 2) & (F.substring(p, 2, 1) == "."), F.substring(p, 1, 1)).otherwise(p)
    bracket = F.when((F.length(dotted) >= 3) & (F.substring(dotted, 1, 1) == "(") & (F.substring(dotted, 3, 1) == ")"), F.substring(dotted, 2, 1)).otherwise(dotted)
    return (F.lower(p) == F.lower(g)) | (F.lower(bracket) == F.lower(g))


def anls_one(prediction: Column, gold: Column, threshold: float = 0.5) -> Column:
    """1 - edit distance / longer raw length, 0 below the threshold; two empty texts give 1."""
    flat = lambda c: F.regexp_replace(F.lower(strip(c)), rf"{SPACE}+", " ")
    longest = F.greatest(F.length(prediction), F.length(gold))
    value = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(flat(prediction), flat(gold)) / F.when(longest > 0, longest))
    return F.when(value < threshold, 0.0).otherwise(value)


def anls(prediction: Column, golds: Column, threshold: float = 0.5) -> Column:
    """The best score over all gold answers; null without any."""
    return F.array_max(F.transform(golds, lambda g: anls_one(prediction, g, threshold)))


def closest_choice(text: Column, choices: Column) -> Column:
    """The choice of least edit distance, the first of equals; null without choices."""
    return F.array_min(F.transform(choices, lambda c, i: F.struct(F.levenshtein(text, c).alias("d"), i.alias("i"), c.alias("c"))))["c"]


def consensus(matches: Column, of: int = 10) -> Column:
    """Vote score of an answer that ``matches`` of ``of`` annotators gave: the mean, leaving out one vote at a time, of min(1, votes / 3)."""
    m = matches.cast("double")
    return F.when(matches == 0, 0.0).otherwise((m * F.least(F.lit(1.0), (m - 1) / 3) + (of - m) * F.least(F.lit(1.0), m / 3)) / of)


def vqa_score(prediction: Column, answers: Column) -> Column:
    """Consensus score of a prediction against ten answers, all brought to the common form."""
    p = evalai_normalize(prediction)
    return consensus(F.size(F.filter(F.transform(answers, evalai_normalize), lambda a: a == p)))


def check_answer(prediction: Column, gold: Column, modes: Column, compat: bool = False) -> Column:
    """1 if the answers are equal without case or a metric of ``modes`` says more than 0.9.

    ``compat`` keeps two known slips of the original recipe: the edit-distance metric scores the distance itself, and
    the numeric metric takes the prediction for the target.
    """
    flat = lambda c: F.regexp_replace(F.lower(strip(c)), rf"{SPACE}+", " ")
    longest = F.greatest(F.length(prediction), F.length(gold), F.lit(1))
    distance = F.levenshtein(flat(gold), flat(prediction)) / longest
    p, g = evalai_normalize(prediction), evalai_normalize(gold)
    has = lambda m: F.array_contains(modes, m)
    numeric = math_score(prediction, gold) if compat else math_score(gold, prediction)
    passed = [
        has("vqa_score") & (p == g) & (p != ""),
        has("relaxed_accuracy") & relaxed_correctness_year(gold, prediction),
        has("anls") & ((distance if compat else 1 - distance) > 0.9),
        has("mc_score") & multi_choice_score(prediction, gold),
        has("math_score") & numeric,
    ]
    return F.when(F.lower(prediction) == F.lower(gold), 1).when(reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in passed)), 1).otherwise(0)


#: Which metrics a data set's name asks for; the first rule that applies counts.
MODE_RULES = ((("chartqa",), ("relaxed_accuracy",)), (("docvqa", "infographics"), ("anls",)), (("SROIE", "CLEVR_math", "geos", "geometry"), ("relaxed_accuracy", "vqa_score", "mc_score")))
DEFAULT_MODES = ("vqa_score", "mc_score", "math_score")


def metric_modes(ds_name: Column) -> Column:
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    out = lit(DEFAULT_MODES)
    for words, modes in reversed(MODE_RULES):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(ds_name, F.lit(w)) for w in words)), lit(modes)).otherwise(out)
    return out


def answer_reward(reasoning: Column, answer: Column) -> Column:
    """1 if the common form of the answer stands in that of the last 2000 characters."""
    gold = normalize_answer(answer)
    return F.when(gold.isNull() | (gold == "") | (strip(answer) == ""), 0.0).when(F.contains(normalize_answer(F.right(reasoning, F.lit(2000))), gold), 1.0).otherwise(0.0)


def normalize_score(score: Column) -> Column:
    """A raw score of 1 to 10 as 0 to 1; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(score.isNotNull(), (F.least(F.lit(10.0), F.greatest(F.lit(1.0), score.cast("double"))) - 1) / 9)


def coerce_score(value: Column) -> Column:
    """The nearest whole score of 1 to 10 (halves to even), 5 for what is no number."""
    whole = F.coalesce(F.bround(to_double(value.cast("string")), 0).cast("int"), F.lit(5))
    return F.least(F.lit(10), F.greatest(F.lit(1), whole))


def _gaps(ideal: Column, vector: Column) -> Column:
    return F.zip_with(ideal, vector, lambda z, v: z - v)


def chebyshev(vector: Column, ideal: Column, rho: float = 0.1) -> Column:
    """Augmented Chebyshev value: minus the largest gap to the ideal, minus rho times all gaps."""
    gaps = _gaps(ideal, vector)
    return -F.array_max(gaps) - rho * F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)


def next_ideal(vector: Column, ideal: Column) -> Column:
    """The ideal point after a vector: its largest gap in every dimension."""
    return F.transform(ideal, lambda _: F.array_max(_gaps(ideal, vector)))


def fused(guided: Column, answer: Column, eta: float = 0.5) -> Column:
    return eta * guided + (1 - eta) * answer


def uct(exploitation: Column, visits: Column, parent_visits: Column, c: float = 1.4) -> Column:
    return exploitation + c * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1)) + 1.0) / (visits + 1.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Words the heuristic step scorer looks for, as parts of words too.
VISUAL = ("image", "figure", "diagram", "chart", "graph", "table", "angle", "line", "point", "axis", "bar", "color", "shown", "visible", "intersect", "triangle", "circle")
LOGIC = ("because", "therefore", "since", "so", "thus", "implies", "hence", "then", "as a result")
DIMENSIONS = ("visual grounding", "logical coherence", "mathematical correctness", "semantic consistency", "conciseness")


def heuristic_scores(text: Column) -> Column:
    """Raw scores of a step in the five usual dimensions, by word lists and length; 3 in all of them for refusals and blank steps."""
    bare = strip(text)
    low, count = F.lower(bare), F.greatest(F.lit(1), F.size(F.filter(F.split(bare, rf"{SPACE}+"), lambda x: x != "")))
    has = lambda words: low.rlike("|".join(words))
    correct = F.when(low.rlike(r"\d|=|\+|-|\*|/|°|angle"), 6.5).otherwise(5.5)
    scores = [F.when(has(VISUAL), 7.0).otherwise(5.0), F.when(has(LOGIC), 7.0).otherwise(5.5), correct, correct, F.when(count <= 80, 8.0).when(count <= 180, 6.0).otherwise(4.0)]
    refused = (bare == "") | F.contains(low, F.lit("i don't know")) | F.contains(low, F.lit("cannot"))
    return F.when(refused, F.array(*(F.lit(3.0) for _ in scores))).otherwise(F.array(*scores))


def judge_scores(text: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Scores of 1 to 10 from ``Name: [[7.5]]`` marks, in the order of the dimensions; 5 where one is missing.

    A name belongs to the dimension of the same letters, else to the first that holds it or that it holds; the last
    score of a dimension counts.
    """
    pattern = r"([^:\n\-–]+):\s*\[\[\s*([0-9]+(?:\.[0-9]+)?)\s*\]\]"
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: x.cast("double"))
    letters = ["".join(ch for ch in d.lower() if ch.isalnum()) for d in dimensions]

    def dimension(n: Column) -> Column:
        exact = [F.when(n == x, i) for i, x in enumerate(letters)]
        near = [F.when((n != "") & (F.contains(F.lit(x), n) | F.contains(n, F.lit(x))), i) for i, x in enumerate(letters)]
        return F.coalesce(*exact, *near)

    scored = F.arrays_zip(F.transform(names, dimension).alias("d"), values.alias("v"))
    clip = lambda v: F.least(F.lit(10.0), F.greatest(F.lit(1.0), v))
    return F.array(*(clip(F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(F.filter(scored, lambda e: e["d"] == i), lambda e: e["v"])), -1), F.lit(5.0))) for i in range(len(dimensions))))


def loss_weight(length: Column, kind: str = "square") -> Column:
    """The weight of a token in the loss: 1 by token, 1 / n by sample, 1 / sqrt(n) in between."""
    n = F.when(length > 0, length)
    return {"token": F.lit(1.0), "sample": 1.0 / n, "square": 1.0 / F.sqrt(n)}[kind]


def prm_probability(good: Column, bad: Column) -> Column:
    return F.round(1 / (1 + F.exp(bad - good)), 3)


def safe_equal(a: Column, b: Column) -> Column:
    """Equality of values of any kind: false where kinds differ or one is null, true for two nulls."""
    return a.eqNullSafe(b)


def raw_vector(raw: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Raw scores (map<dimension, double>) as 0 to 1, in the order of the dimensions; 5 where one is missing."""
    return F.array(*(normalize_score(F.coalesce(F.try_element_at(raw, F.lit(d)), F.lit(5.0))) for d in dimensions))


def step_scores(backend: Column, text: Column, judged: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Raw scores of a step by backend: ``heuristic``, ``neutral`` (5 each), or what a judge wrote; words decide where it wrote no score."""
    neutral = F.array(*(F.lit(5.0) for _ in dimensions))
    own = F.when(F.coalesce(judged, F.lit("")).rlike(r"[^:\n\-–]+:\s*\[\[\s*[0-9]+(?:\.[0-9]+)?\s*\]\]"), judge_scores(judged, dimensions)).otherwise(heuristic_scores(text))
    return F.when(backend == "heuristic", heuristic_scores(text)).when(backend == "neutral", neutral).otherwise(own)


def step_loss(probability: Column, label: Column, epsilon: float = 1e-9) -> Column:
    """Two-class cross entropy of one step, over both classes: twice that of the good one's clamped probability."""
    p = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), probability))
    return -2 * (label * F.ln(p) + (1 - label) * F.ln(1 - p))


def preference_loss(margins: Column, nll: Column, weights: dict[str, float], alpha: float | None = None, beta: float = 0.1) -> Column:
    """Weighted sum of preference losses of a log-probability margin, and alpha times the likelihood term.

    ``weights`` by kind: ``sigmoid`` -ln s(beta m), ``hinge`` max(0, 1 - beta m), ``ipo`` (m - 1 / (2 beta))^2.
    """
    kinds = {
        "sigmoid": F.log1p(F.exp(-beta * margins)),
        "hinge": F.greatest(F.lit(0.0), 1 - beta * margins),
        "ipo": F.pow(margins - 1 / (2 * beta), 2),
    }
    total = reduce(lambda a, b: a + b, (kinds[k] * w for k, w in weights.items()))
    return total if alpha is None else total + nll * alpha


def sequence_logp(logps: Column, labels: Column, ignored: int = -100) -> Column:
    """struct<total, mean, n> of the log-probabilities of the labels that count; the mean of none is null."""
    kept = F.transform(F.filter(F.arrays_zip(logps.alias("p"), labels.alias("l")), lambda e: F.coalesce(e["l"] != ignored, F.lit(False))), lambda e: e["p"])
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.struct(total.alias("total"), (total / F.when(F.size(kept) > 0, F.size(kept))).alias("mean"), F.size(kept).alias("n"))
