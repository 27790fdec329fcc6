"""Operators without SQL against plain Python on the small tables, and evaluation joins on hand-worked cases."""

import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import scores as S
from tracemill.functions.inputs import multi_choice_index
from tracemill.operators import evaluate as E
from tracemill.operators import hierarchy as H
from tracemill.operators import pairs as P
from tracemill.operators import rewards as R
from tracemill.operators.search import step_vector
from tracemill.plans import catalog
from tracemill.session import records, table
from tracemill.sources import io

QUERIES = catalog.queries()


def stripped(x):
    return re.sub(r"^\s+|\s+$", "", x)


def numbers(text):
    return [m.group() for p in (A._COMMAS, A._SCIENTIFIC, A._PLAIN) for m in re.finditer(p, text)]


def open_forms(text):
    body = re.sub(r"^\.+|\.+$", "", stripped(text)).lower()
    lines, parts = body.split("\n"), []
    for i, line in enumerate(lines):
        tails = [stripped(line.split(w)[-1]) for w in A.KEY_WORDS if w in line]
        tails += [stripped(line.split("=")[-1])] if "=" in line and i == len(lines) - 1 else []
        tails = [t for t in tails if t]
        if tails and (best := min(tails, key=len)) not in (":", ",", ".", "!", "?", ";", "'"):
            parts.append(best)
    parts = parts or [body]
    out = set()
    for x in parts + [n for p in parts for n in numbers(p)]:
        bare = stripped(x).replace(",", "")
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bare, re.ASCII):
            out.add(float(Decimal(repr(float(bare))).quantize(Decimal("0.01"), ROUND_HALF_UP)))
        else:
            low = stripped(x).lower()
            out |= {" " + low, low + " "} if len(low) == 1 else {low}
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return {r.response_id: (r.response, r.answer) for r in records(table(spark, SMALL, "sampled_response"), "response_id", "response", "answer").collect()}


def test_all_numbers(spark, texts):
    got = {r.response_id: r.numbers for r in QUERIES["all_numbers"](spark, SMALL).collect()}
    for i, (t, _) in texts.items():
        assert got[i] == (None if t is None else "|".join(numbers(t)))
    assert any(got.values())


def test_open_answers(spark, texts):
    got = {}
    for r in QUERIES["parse_open"](spark, SMALL).collect():
        got.setdefault(r.response_id, set()).add(r.text if r.number is None else r.number)
    right = {r.response_id: r.correct for r in QUERIES["eval_open"](spark, SMALL).collect()}
    for i, (t, a) in texts.items():
        if t is None:
            continue
        want = open_forms(t)
        assert got[i] == want, t
        bare = stripped(a).replace(",", "")
        gold = {float(bare)} if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bare, re.ASCII) else {" " + a.lower(), a.lower() + " "} if len(a) == 1 else {stripped(a).lower()}
        assert right[i] == any((g in p) if isinstance(g, str) and isinstance(p, str) else g == p for p in want for g in gold)


def test_choice_letters_against_python(spark):
    cases = ["(B) it is", "I say C here", " a or B.", "the answer must be the red one, as all of it shows", "nothing", "(A) or (C)", "B", ""]
    choices = ["blue one", "green", "red one"]

    def plain(text):
        body = text
        for ch in (",", ".", "!", "?", ";", ":", "'"):
            body = body.strip(ch)
        body = f" {body} "
        for needles in ([f"({x})" for x in "ABC"], [f" {x} " for x in "ABC"]):
            there = [(body.rfind(n), -k) for k, n in enumerate(needles) if n in body]
            if there:
                return "ABC"[-max(there)[1]]
        there = [(body.lower().rfind(c), -k) for k, c in enumerate(choices) if c in body.lower()]
        return "ABC"[-max(there)[1]] if len(body.split()) > 5 and there else None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id long, t string")
    got = {r.id: r.x for r in df.select("id", multi_choice_index(F.col("t"), F.array(*(F.lit(c) for c in choices)), F.col("id")).alias("x")).collect()}
    for i, t in enumerate(cases):
        assert got[i] == plain(t) or plain(t) is None and got[i] in "ABC", t


def test_step_vector_is_the_columns(spark):
    cases = ["Therefore the chart shows 12.", "I don't know", "", "word " * 90, "word " * 200 + "since", "The ANGLE is so", "plain text here"]
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.heuristic_scores(F.col("t")).alias("s"))
    for r in df.collect():
        assert [(x - 1) / 9 for x in r.s] == pytest.approx(step_vector(r.t))


def test_step_scores(spark):
    df = spark.createDataFrame([("heuristic", "Since the chart shows 12", None), ("neutral", "x", None), ("self", "x", "Conciseness: [[9]]"), ("self", "Since the chart shows 12", "no marks"), ("self", "x", None)], "b string, t string, j string")
    got = [r.s for r in df.select(S.step_scores(F.col("b"), F.col("t"), F.col("j")).alias("s")).collect()]
    assert got == [[7.0, 7.0, 6.5, 6.5, 8.0], [5.0] * 5, [5.0, 5.0, 5.0, 5.0, 9.0], [7.0, 7.0, 6.5, 6.5, 8.0], [5.0, 5.5, 5.5, 5.5, 8.0]]


def test_evaluation_joins(spark):
    outputs = spark.createDataFrame([("v_Art_Theory_1", "A"), ("v_Art_Theory_2", "B"), ("v_Math_1", "C")], "id string, p string")
    answers = spark.createDataFrame([("v_Art_Theory_1", "A"), ("v_Art_Theory_2", "C"), ("v_Music_1", "C")], "id string, a string")
    assert {tuple(r) for r in E.align_by_category(outputs, answers, "id").select("id", "category", "p", "a").collect()} == {("v_Art_Theory_1", "Art_Theory", "A", "A"), ("v_Art_Theory_2", "Art_Theory", "B", "C")}
    with pytest.raises(PySparkException):
        E.align_by_category(outputs, answers.where("id <> 'v_Art_Theory_2'"), "id").collect()
    assert E.align_by_category(outputs, answers.where("id <> 'v_Art_Theory_2'"), "id", strict=False).count() == 1
    assert E.align_by_category(outputs, answers, "id", ["Music"]).count() == 0
    base = spark.createDataFrame([("a", 0.5)], "k string, acc double")
    scores = spark.createDataFrame([("a", 0.75), ("b", 0.1)], "k string, acc double")
    assert [tuple(r) for r in E.gain(scores, base, ["k"]).collect()] == [("a", 0.75, 0.5, 0.25)]
    with pytest.raises(PySparkException):
        E.gain(scores, base, ["k"], strict=True).collect()
    assert E.full_denominator(scores.where("k = 'a'"), scores, "k", "acc").first().mean == 0.375
    none = spark.createDataFrame([(None, ["x"]), ("x", None), ("x", ["y", "x"])], "p string, g array<string>")
    assert [r.c for r in none.select(E.eval_multi_choice(F.col("g"), F.col("p")).alias("c")).collect()] == [False, False, True]


def test_pairs_keep_pictures_apart(spark):
    rows = [(1, "cat", "q", "5", "5", 1), (2, "dog", "q", "5", "6", 0), (3, "cat", "q", "5", "7", 0), (4, "cat", "q", "5", "15", 0), (5, "cow", "q", "5", "5", 1), (6, "cow", "q", "5", "55", 0)]
    df = spark.createDataFrame(rows, "id long, image string, question string, answer string, pred string, ok int")
    keys = ["image", "question", "answer"]
    found = P.pos_neg_pairs(df.where("ok = 1"), df.where("ok = 0"), keys, "id", "pred")
    assert {(r.chosen_id, r.rejected_id) for r in found.collect()} == {(1, 3)}  # not 2: another picture; 15 and 55 hold the 5
    stats = P.pairing_stats(df, keys, F.col("ok") == 1, "pred").first().asDict()
    assert stats == {"only_in_pos": 0, "only_in_neg": 1, "in_both": 2, "max_possible_pairs": 3, "n_pos": 2, "n_neg": 4, "entail_skip": 2, "key_without_pairs": 1}
    made = P.pair_rows(found, df, keys, "id", "pred", "ok").first()
    assert (made.chosen, made.rejected, made.chosen_ok, made.rejected_ok) == ("5", "7", 1, 0)
    assert {r.op: r.n for r in P.key_set_ops(df, keys, F.col("ok") == 1, F.col("ok") == 0).collect()} == {"pos_minus_neg": 0, "neg_minus_pos": 1, "intersection": 2, "union": 3}


def test_trees_and_leaves(spark, tmp_path):
    rows = [("root", None, 0.5, 3), ("x", "root", 0.2, 2), ("a", "x", 0.0, 1), ("b", "x", 0.0, 1), ("c", "root", 0.0, 1)]
    tree = io.nested_tree(rows)
    assert [c["name"] for c in tree["children"]] == ["x", "c"] and [c["name"] for c in tree["children"][0]["children"]] == ["a", "b"]
    io.write_tree(rows, str(tmp_path / "tree.json"))
    with pytest.raises(ValueError):
        io.nested_tree(rows[1:] + [("y", None, 0.0, 1), ("root", None, 0.0, 1)])
    leaves = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1)], "category string, leaf int")
    distances = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.3), ("c", "d", 0.0), ("d", "e", 0.19)], "a string, b string, distance double")
    support = spark.createDataFrame([("a", 1), ("b", 5), ("d", 2)], "category string, support int")
    out = {(r.leaf, r.representative, r["size"]) for r in H.leaf_clusters(leaves, distances, support, "category").collect()}
    assert out == {(0, "b", 2), (0, "c", 1), (1, "d", 2)}
    with pytest.raises(ValueError):
        H.average_linkage(distances, [str(k) for k in range(9)], most=5)
    vectors = spark.createDataFrame([(1, [1.0] * 100)], "id int, v array<double>")
    with pytest.raises(ValueError):
        H.scored_parents(vectors, vectors, "v", "id", "v", most_bytes=100)


def test_reviews_in_order(spark):
    review = "array<struct<step_index:int,reward_categories:array<string>>>"
    df = spark.createDataFrame([(1, [(None, ["z"]), (2, None), (1, ["a", None, "a"])], None), (2, None, [])], f"id int, good {review}, bad {review}")
    got = df.select("id", F.transform(R.in_step_order(F.col("good")), lambda r: r["step_index"]).alias("i")).collect()
    assert [r.i for r in got] == [[1, 2, None], None]
    lists = R.categories_by_id(df, "id", "good", "bad")
    assert {r.id: (r.good, r.bad) for r in lists.collect()} == {1: (["z", "a", None, "a"], []), 2: ([], [])}
    assert {tuple(r) for r in R.category_index(lists, "id").collect()} == {("good", "z", 1), ("good", "a", 1), ("all", "z", 1), ("all", "a", 1)}


def test_image_lists(spark):
    df = spark.createDataFrame([(["a"], [("u", None), (None, "p")], "b")], "image array<string>, images array<struct<url:string,path:string>>, img string")
    assert df.select(io.image_list(df).alias("x")).first().x == ["a", "u", "p", "b"]
