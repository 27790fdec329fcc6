"""Problems 3, 4, 5 and 6: defects, cuts, near-copies and repetition on written cases and against brute force."""

import random

import pytest

from tracemill.llm import defects as D
from tracemill.llm import neardup as N
from tracemill.llm import repetition as R
from tracemill.llm import truncation as U
from tracemill.llm.common import language_of, words_of
from tracemill.llm.endings import cut_reason, still_open, terminality

Q = "What is the mean of Norba, Vesk and Luma?\nGive one short value."


@pytest.mark.parametrize("text, question, defect", [
    (None, Q, "empty"), ("", Q, "empty"), ("​\n", Q, "empty"), ("N/A", Q, "empty"), ("...", Q, "empty"), ("<|answer_start|> <|answer_end|>", Q, "empty"), ("Answer:\n<|answer_start|>\n<|answer_end|>", Q, "empty"),
    ("No", Q, None), ("B", Q, None), ("not determined", Q, None), ("42 cm", Q, None), ("-7", Q, None),
    ("What is the mean of Norba, Vesk and Luma?", Q, "copy"), ("WHAT IS THE MEAN OF NORBA, VESK AND LUMA ?", Q, "copy"), ("Q: What is mean of Norba, Vesk and Luma", Q, "copy"),
    ("What is the mean of Norba, Vesk and Luma?\nIt is 12.", Q, None), ("What is the mean of Norba, Vesk and Luma?", None, None),
    ("I'm sorry, but I can't help with that.", Q, "refusal"), ("Das kann ich leider nicht beantworten.", "Wie groß ist der Wert von Norba?", "refusal"), ("Je préfère ne pas répondre.", Q, "refusal"), ("No puedo ayudar con esto.", None, "refusal"),
    ("My training prevents me from answering that.", Q, "refusal"), ("My rules forbid me to answer this.", Q, "refusal"), ("Ma formation m'interdit de répondre.", "Combien vaut la barre ?", "refusal"),
    ("I'm sorry, but I cannot help with this request. " + "It touches on matters that I would rather leave to people who know the field and who can look at the picture in front of them. " * 5, Q, "refusal"),
    ("I cannot see the inset clearly, yet the tick fixes it at 35. The flow stays below 8.", Q, None), ("\u200b" * 500, Q, "empty"), (" \u2060\ufeff" * 300, Q, "empty"),
    ("I cannot be sure, but the figure shows 12 and 14, so the mean is 13.\nFinal answer: 13", Q, None),
    ("The sum is 12. Dividing it by th", Q, "truncated"), ("The sum is 12. Dividing it by three gives 4.", Q, None), ("The sum of the two is 12.\nThe answer is", Q, "truncated"), ("The sum of the two is 12.\nThe answer is 4", Q, None),
    ("La somme de 3 et 4 donne 7. Il faut donc garder la valeur de la barre.", Q, "wrong_language"), ("La somme de 3 et 4 donne 7. Il faut donc garder la valeur.", Q.split("\n")[0] + " Please reply in French.", None),
    ("因为甲超过乙，所以保持不变。我们把三和四相加。", Q, "wrong_language"), ('The caption says "la somme de la barre est dans le cadre" and the value of it is 4.', Q, None),
])
def test_defects(text, question, defect):
    assert D.defect_of(text, question) == defect


STEP = "<|reasoning_start|>\n<|reasoning_step_start|>\n<|reasoning_step_thought_start|>The bar ends at 12.<|reasoning_step_thought_end|>\n<|reasoning_step_end|>\n"


@pytest.mark.parametrize("text, cut", [
    (None, False), ("", False), ("   ", False), (STEP + "<|reasoning_end|>\nAnswer:\n<|answer_start|>12<|answer_end|>", False), (STEP + "Answer:\n<|answer_start|>12<|answer_end|>", False),
    (STEP + "<|reasoning_pro", True), (STEP + "<|reasoning_step_start|>\n<|reasoning_step_thought_start|>Then the ba", True), (STEP.replace("12.", "tw") + "<|reasoning_end|>\nAnswer:\n<|answer_start|>12<|answer_end|>", True),
    ("The bar ends near the�", True), ("The bar ends near the l...", True), ("The value is twelve…", True), ("Well, that is all …", True), ("1. Read the chart: It is 12.\n$$\\boxed{12", True), ("1. Read the chart: It is 12.\n$$\\boxed{12}$$", False),
    ("We run this:\n```python\nprint(1).", True), ("We run this:\n```python\nprint(1)\n```\nThat prints 1.", False), ('He said "the value is near twelve.', True), ("The points are (34, 20.", True), ("We list the values (first\nsecond and\nthird.", True),
    ("1. Do this.\n2. Then that.\n3.", True), ("- a thing\n- another\n-", True), ("Final answer:\n12.", False), ("The set is [0, 1) here.", False), ("We have a) one and b) two.", False), ('The caption reads "x here. Row 332 is fine.', False), ('It is 5" long.', False),
    ("\\begin{align} x = 1.", True), ("\\begin{align} x = 1 \\end{align} holds.", False), ("The point (-7, Norba lies to the left of the red bar.", False),
    ("It is 12.\n(Result: 12", True), ("It is 12.\n(Result: 12)", False), ("It is 12.\n**Answer:** B", False), ("Therefore, 12 cm.", False), ("x" * 100_000 + ".", False),
])
def test_endings(text, cut):
    assert bool(cut_reason(text)) is cut


def test_terminality():
    score = lambda t: terminality(t, cut_reason(t))
    assert score("It ends here.") == 1.0 > score("It is so.\nFinal answer: 12") > score("12 cm") > 0.5 > score("It ends at the bar of red") > score("It ends at the bar of the")
    assert score(None) is score("  ") is None


def test_pushdown():
    assert still_open("a (b [c") == ["(", "["] and still_open("```\n(x") == ["```"] and still_open('say "x" (y)') == []
    assert still_open("<b>x <i>y</i>") == ["<b>"] and still_open("\\[ x") == ["\\["] and still_open("$$x$$ **y") == ["**"] and still_open("“a «b» ( c”") == []


def test_aligned_cut():
    body = "the first bar of the chart ends at eleven units while the second one ends at "
    assert U.aligned_cut(body + "16.", body + "16.85 units. So it is larger.") is True
    assert U.aligned_cut(body + "six", body + "sixteen units. So it is larger.") is True
    assert U.aligned_cut(body + "sixteen units.", body + "sixteen units. So it is larger.") is False
    assert U.aligned_cut("something else entirely that shares no words with it at all here now", body + "x") is None


def values(spark, rows):
    return spark.createDataFrame([(f, i, "src", None, t, 1) for f, i, t in rows], "field int, id long, ds_name string, question string, text string, class int")


def test_cut_values(spark):
    body = "the first bar of the chart ends at eleven units while the second one ends at "
    rows = [(2, 1, body + "16.85 units. So it is larger."), (2, 2, body + "16."), (2, 3, None), (2, 4, ""), (2, 4, ""), (0, 2, body + "16."), (2, 5, "The bar of th" * 3)]
    got = {(r.field, r.id): r.reason for r in U.cut_values(values(spark, rows)).collect()}
    assert len(got) == 6 and got[2, 2] == "alignment ends early" and got[2, 1] is None and got[0, 2] is None and got[2, 3] is None and got[2, 5]
    assert U.cut_values(values(spark, rows).where("false")).count() == 0


def test_cut_from_a_value_that_is_not_the_longest(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: rng.choice(["bar", "chart", "line", "label", "unit", "axis"]) + rng.choice("abcdefgh")
    start, middle = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(18))
    longest = start + " " + " ".join(word() for _ in range(160)) + "."
    original = f"{start} {middle} at 16.85 units. " + " ".join(word() for _ in range(40)) + "."
    named = f"{start} {middle}.\nFinal answer: sixteen"
    rows = [(2, 1, longest), (2, 2, original), (2, 3, f"{start} {middle} at 16."), (2, 4, named), (2, 5, named[:-4]), (2, 6, f"{start} {middle} at 17."), (0, 3, f"{start} {middle} at 16.")]
    got = {(r.field, r.id): r.reason for r in U.cut_values(values(spark, rows)).collect()}
    assert {k for k, r in got.items() if r} == {(2, 3), (2, 5)} and len(got) == 7
    # problem 3 has the cases of problem 4
    spark.createDataFrame([(i, "s", "Which value is shown?", t) for _, i, t in rows[:6]], "response_id long, ds_name string, question string, response string").write.parquet(f"{tmp_path}/sampled_response.parquet")
    spark.createDataFrame([], "pair_id long, ds_name string, question string, prompt string, chosen string, rejected string").write.parquet(f"{tmp_path}/preference_pair.parquet")
    assert {r.record_id for r in D.p3_found(spark, str(tmp_path)).where("defect = 'truncated'").collect()} == {3, 5} == {r.record_id for r in U.p4_found(spark, str(tmp_path)).collect()}


def test_recall_of_alignment(spark):
    """Values cut inside a closing word or number, which look whole, from originals that are edited, shared, and never the longest."""
    rng = random.Random(21)
    word = lambda: rng.choice(["bar", "chart", "line", "label", "unit", "axis", "tick", "curve"]) + rng.choice("abcdefghijklmnop")
    rows, planted = [], set()
    for k in range(60):
        start = [word() for _ in range(rng.randint(25, 220))]
        edited = list(start)
        for _ in range(len(start) // 40):
            edited[rng.randrange(len(start) - 8)] = word()
        end = [f"Final answer: {word()}{word()}", f"It ends at {rng.randint(10, 99)}.{rng.randint(10, 99)} units."][k % 2]
        cut_at = end.index(".") + 1 if k % 2 else len(end) - rng.randint(3, 5)
        longest = start + [word() for _ in range(400)]
        rows += [(2, 10 * k, " ".join(start) + ".\n" + end), (2, 10 * k + 1, " ".join(edited) + ".\n" + end[:cut_at]), (2, 10 * k + 2, " ".join(longest) + ".")]
        rows += [(2, 10 * k + 3, " ".join(start) + ".\nFinal answer: 12")]
        planted.add((2, 10 * k + 1))
    df = values(spark, rows)
    assert not any(cut_reason(t) for _, i, t in rows)
    got = {(r.field, r.id) for r in U.cut_values(df).where("reason IS NOT NULL").collect()}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_flags_of_empty_and_repeated_tables(spark):
    df = values(spark, [(0, 1, ""), (0, 1, ""), (1, 1, "fine.")])
    assert [(r.field, r.id, r.defect) for r in D.flag_defects(df).collect()] == [(0, 1, "empty")]
    assert D.flag_defects(df.where("false")).count() == 0


def test_near_classes_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(25, 90))
        for edits in (0, 0, 1, 3, 8):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i % 3 // 2, i, t) for i, t in enumerate(texts)] + [(0, 900, None), (0, 901, ""), (0, 902, "short"), (0, 0, texts[0]), (0, 903, "z " * 50_000)]

    def found(exact):
        members, pairs = N.near_classes(values(spark, rows), exact=exact)
        classes = {}
        for r in members.collect():
            classes.setdefault((r.field, r.rep), []).append(r.id)
        got = {(f, *sorted((a, b))) for (f, _), ids in classes.items() for a in ids for b in ids if a < b}
        for p in pairs.collect():
            got |= {(p.field, *sorted((a, b))) for a in classes[p.field, p.rep_a] for b in classes[p.field, p.rep_b]}
        return got

    got = found(False)
    sets = {(f, i): {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for f, i, t in rows for w in [words_of(t)] if len(w) >= 30}
    want = {(f, a, b) for (f, a) in sets for (g, b) in sets if f == g and a < b and len(sets[f, a] & sets[f, b]) >= 0.6 * len(sets[f, a] | sets[f, b])}
    assert got <= want and len(got) >= 0.99 * len(want) and want
    assert found(True) == want
    members, pairs = N.near_classes(values(spark, rows).where("false"))
    assert members.count() == pairs.count() == 0


def test_equal_halves(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    rows += [(a, a ^ (0xF << 4 * k)) for k, (a, _) in enumerate(rows[:15])] + [(0, 0), (-1, 0), (-1, -1)]
    for r in spark.createDataFrame(rows, "a long, b long").withColumn("n", N._equal_halves("a", "b")).collect():
        assert r.n == sum((r.a ^ r.b) >> 4 * k & 15 == 0 for k in range(16))


def repeated(spark, rows):
    return spark.createDataFrame([("chosen", i, -1, s, t, 0) for i, s, t in rows], "field_name string, record_id long, turn_pos int, source string, text string, lang int")


def test_repetition(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randint(15, 60))
        if i % 9 == 0:
            words = words[:8] * rng.randint(2, 9)
        rows.append((i, f"s{i % 2}", " ".join(words)))
    rows += [(1000 + i, "only repeats", "a b c d e f g h " * 9) for i in range(80)] + [(2000, None, None), (2001, None, ""), (2002, "s0", "x " * 30_000), rows[0]]
    got = {r.record_id for r in R.reject(repeated(spark, rows)).where("rejected AND share >= 0.3").collect()}
    want = {i for i, _, t in rows if len(words_of(t)) >= 20 and R.repeated_share(words_of(t), 5) >= 0.3}
    assert got == want and len(want) > 100
    assert R.reject(repeated(spark, rows).where("false")).count() == 0


def test_every_value_has_a_share(spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = [(i, "s", " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(200)]
    rows += [(300, "s", "a b c d e f " * 3), (301, None, None), (302, "s", " \n"), (303, "s", "one word"), (304, "s", "a b c d e f g h " * 9), rows[0]]
    out = R.shares(repeated(spark, rows)).collect()
    got = {r.record_id: r for r in out}
    assert len(out) == len(got) == 205
    for i, _, t in rows:
        words = words_of(t)
        assert got[i].n_words == len(words) and got[i].share == (None if t is None else round(R.repeated_share(words, 5), 9))
        assert (got[i].distance is None) is (len(words) < 20) and got[i].flagged is (i == 304)
    assert got[300].share > 0.3


def test_estimates_are_those_of_the_clean_half(spark):
    """A seventh of a group is far away: distances of the rest are those of chi-squared, and the far ones are outliers."""
    import numpy as np

    rng = np.random.default_rng(4)
    assert abs(R.CONSISTENCY - 0.4742) < 1e-3
    clean = rng.normal([0.05, 0.3, 0.1, -0.4], [0.3, 0.5, 0.4, 0.6], (1000, 4))
    far = rng.normal([4.0, 5.0, 4.0, -6.0], 0.1, (150, 4))
    rows = [("chosen", i, -1, "s", "en", 40, 0.0, *map(float, x)) for i, x in enumerate(np.concatenate([clean, far]))]
    names = ["field_name", "record_id", "turn_pos", "source", "lang", "n_words", "share", *R.NAMES]
    out = R.judge(spark.createDataFrame(rows, names)).toPandas().set_index("record_id").sort_index()
    assert out.outlier[1000:].all() and out.outlier[:1000].mean() < 0.08
    assert 2.3 < out.distance[:1000].median() < 4.2  # 3.36 for chi-squared with four degrees of freedom, over the whole clean part


def test_robust_distance_of_usual_values_is_small(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(i, "s", " ".join(rng.choices(vocabulary, k=40))) for i in range(200)]
    out = R.reject(repeated(spark, rows)).toPandas()
    assert out.rejected.mean() < 0.1


def test_languages():
    assert language_of("Die Summe aus 3 und 4 ergibt 7.") == "de" and language_of("La suma de los dos es 7.") == "es" and language_of("12 34") is None
