"""Columns against expectations worked out by hand, and against plain Python twins."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import geometry as V
from tracemill.functions import prompts as M
from tracemill.functions import scores as S
from tracemill.functions import text as X
from tracemill.functions import trace as T


def one(spark, column, **values):
    """The value of a column over one row."""
    kinds = {k: v if isinstance(v, tuple) else (v, "string") for k, v in values.items()}
    df = spark.createDataFrame([tuple(v for v, _ in kinds.values())], ", ".join(f"{k} {t}" for k, (_, t) in kinds.items())) if kinds else spark.range(1)
    return df.select(column.alias("x")).first().x


STEP = "<|reasoning_step_start|>{}<|reasoning_step_end|>"


@pytest.mark.parametrize("text, expected", [
    (None, ""), ("", ""), ("no marks", "no marks"), ("a<|reasoning_start|>b", "a<|reasoning_start|>b"),
    ("x<|reasoning_end|>y<|reasoning_start|>z", "x<|reasoning_end|>y<|reasoning_start|>z"),
    ("x<|reasoning_start|>one<|reasoning_end|>y<|reasoning_start|>two<|reasoning_end|>", "one"),
])
def test_extract_reasoning(spark, text, expected):
    assert one(spark, T.extract_reasoning(F.col("t")), t=text) == expected


def test_parse_steps(spark):
    text = STEP.format("\n<|reasoning_step_name_start|> A\n B <|reasoning_step_name_end|>") + STEP.format("  bare ") + STEP.format("<|reasoning_step_thought_start|><|reasoning_step_thought_end|>")
    steps = [tuple(s) for s in one(spark, T.parse_steps(F.col("t")), t=text)]
    assert steps[0] == ("A\n B", None, None, None)
    assert steps[1] == (None, None, None, "bare")
    assert steps[2][1] == "" and steps[2][3].startswith("<|reasoning_step_thought_start|>")
    assert one(spark, T.parse_steps(F.col("t")), t=None) == []
    assert one(spark, T.parse_steps(F.col("t")), t="") == []


def test_step_texts(spark):
    assert one(spark, T.extract_steps(F.col("t")), t="a\n\n  b \n") == ["a", "b"]
    assert one(spark, T.extract_steps(F.col("t")), t=None) == []


@pytest.mark.parametrize("text, expected", [("a\nb", "a"), (" x ", "x"), ("s<|reasoning_step_end|>t", "s<|reasoning_step_end|>"), ("s<|reasoning_proceed|>t", "s"), ("s<|reasoning_step_end|>t<|reasoning_end|>u", "s<|reasoning_step_end|>t<|reasoning_end|>")])
def test_single_step(spark, text, expected):
    assert one(spark, T.single_step(F.col("t")), t=text) == expected


def test_final_answer(spark):
    parse = lambda t: one(spark, A.parse_final_answer(F.col("t")), t=t)
    assert tuple(parse("why\nso\nFinal answer: 5 ")) == ("why\nso", "5")
    assert parse("Final answer: 5") is None and parse("a\n\nFinal answer: 1\nmore") is None and parse("\n\nFinal answer: 1") is None and parse(None) is None
    assert tuple(parse("Final answer: 1\n\nFinal answer: 2")) == ("Final answer: 1", "2")


def test_numbers(spark):
    text = "1,234 and 5e3 or -7.5, then 12"
    assert one(spark, A.extract_numbers(F.col("t")), t=text) == [x for p in (A._COMMAS, A._SCIENTIFIC, A._PLAIN) for x in re.findall(p, text)]
    assert one(spark, X.to_double(F.col("t")), t="1_000") is None
    assert one(spark, X.to_double(F.col("t")), t="12d") is None
    assert one(spark, X.to_double(F.col("t")), t=" -1.5e2 ") == -150.0


@pytest.mark.parametrize("target, prediction, plain, year", [("100", "104", True, True), ("100", "106", False, False), ("5%", "0.05", True, False), ("abc", "ABC", True, True), ("0", "0", True, True), ("0", "0.0", False, False), ("2010", "2011", True, False)])
def test_relaxed(spark, target, prediction, plain, year):
    assert one(spark, S.relaxed_correctness(F.col("t"), F.col("p")), t=target, p=prediction) is plain
    assert one(spark, S.relaxed_correctness_year(F.col("t"), F.col("p")), t=target, p=prediction) is year


def test_consensus_is_the_loop(spark):
    """The closed form is the mean over annotators left out one at a time."""
    for m in range(11):
        answers = ["x"] * m + [f"y{i}" for i in range(10 - m)]
        loop = sum(min(1, sum(a == "x" for j, a in enumerate(answers) if j != i) / 3) for i in range(10)) / 10 if m else 0.0
        assert math.isclose(one(spark, S.consensus(F.col("m")), m=(m, "int")), loop, abs_tol=1e-12)


def evalai_twin(text):
    """The normaliser in plain Python, from its description."""
    t = text.lower().replace(",", "").replace("?", "").replace("'s", " 's").strip().replace("\n", " ").replace("\t", " ").strip()
    out = t
    for sign in A.SIGNS:
        out = out.replace(sign, "" if sign + " " in t or " " + sign in t or re.search(r"\d,+\d", t) else " ")
    out = re.sub(r"\.(?!\d)", "", out)
    words = [A.NUMBER_WORDS.get(w, w) for w in out.lower().split()]
    return " ".join(A.CONTRACTIONS.get(w, w) for w in words if w not in A.ARTICLES)


@pytest.mark.parametrize("text", ["The two dogs", "it isnt a cat's toy", "a/b - c", "3.5 cm.", "(x) [y]", "one, two?", "", "  ", "well-known", "A", "e.g. this", "10 - 2 = 8"])
def test_evalai(spark, text):
    assert one(spark, A.evalai_normalize(F.col("t")), t=text) == evalai_twin(text)


def test_check_answer_modes_and_compat(spark):
    modes = F.array(F.lit("anls"))
    assert one(spark, S.check_answer(F.col("p"), F.col("g"), modes), p="abcdefghij", g="abcdefghijk") == 1
    assert one(spark, S.check_answer(F.col("p"), F.col("g"), modes), p="zzzzzzzzzz", g="abcdefghij") == 0
    assert one(spark, S.check_answer(F.col("p"), F.col("g"), modes, compat=True), p="zzzzzzzzzz", g="abcdefghij") == 1
    assert one(spark, S.check_answer(F.col("p"), F.col("g"), F.array(F.lit("vqa_score"))), p="The two", g="2") == 1
    assert one(spark, F.array_join(S.metric_modes(F.col("d")), "|"), d="my_docvqa") == "anls"


def test_chebyshev(spark):
    v, z = F.array(F.lit(0.7), F.lit(0.4)), F.array(F.lit(1.0), F.lit(1.0))
    assert math.isclose(one(spark, S.chebyshev(v, z)), -0.6 - 0.1 * 0.9)
    assert [round(x, 6) for x in one(spark, S.next_ideal(v, z))] == [0.6, 0.6]


def test_scores_of_null_and_noise(spark):
    assert one(spark, S.coerce_score(F.col("t")), t="2.5") == 2 and one(spark, S.coerce_score(F.col("t")), t="x") == 5 and one(spark, S.coerce_score(F.col("t")), t="99") == 10
    assert one(spark, S.normalize_score(F.col("t")), t=(None, "double")) is None
    assert one(spark, S.judge_scores(F.col("t")), t="Logical Coherence: [[11]]\nvisual: [[2]]\nvisual grounding: [[3]]") == [3.0, 10.0, 5.0, 5.0, 5.0]
    assert one(spark, S.heuristic_scores(F.col("t")), t="") == [3.0] * 5
    assert one(spark, S.closest_choice(F.lit("bat"), F.array(F.lit("cat"), F.lit("hat"), F.lit("x")))) == "cat"


def test_normalize_extracted(spark):
    choices = F.array(F.lit("red"), F.lit("blue"))
    run = lambda t, q="multi_choice", a="text": one(spark, A.normalize_extracted(F.col("t"), choices, F.lit(q), F.lit(a), F.lit(1)), t=t)
    assert run("(B) because") == "blue" and run("A") == "red" and run("blu") == "blue"
    assert run("3.9", "free_form", "integer") == "3" and run("x", "free_form", "integer") is None and run("-3.9", "free_form", "integer") == "-3"


def test_fix_answer(spark):
    fixed = one(spark, A.fix_answer(F.col("r"), F.col("p"), F.col("g")), r="so\n**Final answer: 30,594 km", p="30,594 km", g="30594")
    assert fixed == "so\nFinal answer: 30594"


def test_templates(spark):
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).cast("string").alias("text")) for r, t in (("human", "hi"), ("gpt", "yo"), ("human", None))))
    run = lambda t: one(spark, M.render(turns, t))
    assert run(M.Template("add_colon_single", message="S")) == "S\nUSER: hi\nASSISTANT: yo\nUSER:"
    assert run(M.Template("chatglm", message="S")) == "S\n[Round 0]\nUSER：hi\nASSISTANT：yo\n[Round 1]\nUSER："
    assert run(M.Template("phoenix", message="S")) == "SUSER: <s>hi</s>ASSISTANT: <s>yo</s>USER: <s>"
    assert run(M.Template("dolly", message="S", first="|", second="#")) == "SUSER:\nhi|ASSISTANT:\nyo#\n\nUSER:\n"
    assert run(M.TEMPLATES["bilingual_colon"]) == " <human>: hi <bot>: yo</s><human>:"
    assert len({run(M.Template(s, second="##")) for s in M.STYLES}) >= 15


def test_labels_and_images(spark):
    segments = F.array(F.struct(F.lit("human").alias("role"), F.array(F.lit(1), F.lit(2)).alias("ids")), F.struct(F.lit("gpt").alias("role"), F.array(F.lit(3), F.lit(4), F.lit(5)).alias("ids")), F.struct(F.lit("gpt").alias("role"), F.array().cast("array<int>").alias("ids")))
    assert one(spark, M.mask_labels(segments)) == [-100, -100, -100, 4, -100]
    assert one(spark, M.expand_image_tokens(F.col("t"), F.array(F.lit(1)), 2), t="a<image>b<image>") == "a<img><IMG_CONTEXT><IMG_CONTEXT></img>b<img></img>"
    assert M.image_tokens() == 256


def test_geometry(spark):
    assert one(spark, V.frame_indices_middle(F.lit(3), F.lit(5))) == [0, 1, 2, 2, 2]
    assert one(spark, V.frame_indices_middle(F.lit(0), F.lit(2))) in ([], [0, 0])
    assert tuple(one(spark, V.closest_ratio(F.lit(800.0), F.lit(400.0), V.ratios(1, 6)))) in ((2, 1), (4, 2))
    assert [tuple(b) for b in one(spark, V.tile_boxes(F.lit(2), F.lit(1), 10))] == [(0, 0, 10, 10), (10, 0, 20, 10)]


def bleu_twin(c, r):
    c, r = c.lower().split(), r.lower().split()
    total = 0.0
    for n in range(1, 5):
        cg, rg = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
        hits = sum((cg & rg).values())
        if not hits:
            return 0.0
        total += math.log(hits / sum(cg.values())) / 4
    return math.exp(total + (0 if len(c) >= len(r) else 1 - len(r) / len(c)))


@pytest.mark.parametrize("c, r", [("a b c d e", "a b c d e"), ("a b c d x", "a b c d e f"), ("", "a"), ("a a a a a", "a a a a")])
def test_bleu(spark, c, r):
    from tracemill.operators.evaluate import bleu4

    df = spark.createDataFrame([(1, c, r)], "k int, c string, r string")
    assert math.isclose(bleu4(df, "k", F.col("c"), F.col("r")).first().bleu, bleu_twin(c, r), abs_tol=1e-9)
