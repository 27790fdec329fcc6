"""Queries that read whole values, against brute force on the small tables."""

import re

from conftest import SMALL

from tracemill.functions import answers as A
from tracemill.functions import inputs as I
from tracemill.operators.search import search
from tracemill.plans import catalog
from tracemill.providers import HashSteps
from tracemill.session import table

QUERIES = catalog.queries()


def test_numbers_of_whole_texts(spark):
    texts = dict(table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_grouped, r.n_scientific, r.n_plain) for r in QUERIES["numbers_by_kind"](spark, SMALL).collect()}
    assert got == {i: tuple(len(re.findall(p, t or "")) for p in (A._COMMAS, A._SCIENTIFIC, A._PLAIN)) for i, t in texts.items()}
    assert any(re.search(A._PLAIN, t[200:]) for t in texts.values() if t)


def trimmed(response):
    out = re.split("[.,!]", response.strip())[0].lower()
    for word in ("is ", "are ", "a ", "an ", "the "):
        if word in out:
            out = out.split(word)[1]
    return out.split(" of")[0].strip()


def test_phrases_of_long_responses(spark):
    responses = dict(table(spark, SMALL, "sampled_response").select("response_id", "response").collect())
    got = dict(QUERIES["trimmed_phrase"](spark, SMALL).collect())
    assert got == {i: None if t is None else trimmed(t) for i, t in responses.items()}
    assert any(len(t) >= 200 and got[i] for i, t in responses.items() if t)


def final_answer(text):
    trigger = next((t for t in A.TRIGGERS if t in text), None)
    if trigger is None or text.count(trigger) > 2 or text.count("\n") < 2:
        return None
    rationale, answer = (x.strip() for x in text.rsplit(trigger, 1))
    return (rationale, answer) if rationale and "\n" not in answer else None


def test_final_answers_and_labels_of_whole_texts(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text", "n_chars").collect()
    want = {}
    for i, t, _ in rows:
        t = t or ""
        want[i] = final_answer((f"{t}\nso\nFinal answer: {i}", f"{t}\n\nFinal Answer: x{i}\ny", f"Final answer: {i}", f"{t}\n\n答案: {i} ", t)[i % 5])
    got = {r.doc_id: (r.rationale, r.answer) for r in QUERIES["parse_final_answer"](spark, SMALL).collect()}
    assert got == {i: x for i, x in want.items() if x} and any(len(x[0]) > 80 for x in got.values())
    labels = {r.doc_id: (r.body, r.labels) for r in QUERIES["split_labels"](spark, SMALL).collect()}
    assert labels == {i: (t or "", None if n is None else str(n)) for i, t, n in rows}


def test_paths_of_deep_trees(spark):
    nodes = [(1, i, i - 1 if i > 1 else None) for i in range(1, 71)] + [(2, 1, None), (2, 2, 1), (3, 1, 2), (3, 2, 1), (4, 5, 9)]
    df = spark.createDataFrame(nodes, "tree long, node int, parent int")
    got = {(r.tree, r.node): r.path for r in I.ancestor_paths(df, "tree", "node", "parent").collect()}
    assert len(got) == len(nodes) and all(got[1, i] == list(range(1, i + 1)) for i in range(1, 71))
    assert got[2, 2] == [1, 2] and got[3, 1] is None and got[4, 5] == [5]
    assert I.ancestor_paths(df.where("false"), "tree", "node", "parent").count() == 0


def test_search_has_the_defaults_of_the_operator(spark):
    pairs = {r.pair_id: r for r in table(spark, SMALL, "preference_pair").select("pair_id", "question", "prompt", "chosen").collect()}
    got = {}
    for r in QUERIES["mcts_search"](spark, SMALL).collect():
        got.setdefault(r.pair_id, {})[r.rank] = r.text
    alias = [i for i, r in pairs.items() if not r.question and r.prompt]
    assert alias and set(got) == set(pairs)
    for i in [*alias, *sorted(pairs)[:5]]:
        gold = re.search(r"<\|answer_start\|>([^<]*)", pairs[i].chosen or "")
        want = search(pairs[i].question or pairs[i].prompt or "", gold.group(1) if gold else "", HashSteps())
        assert [got[i][k] for k in sorted(got[i])] == [x["text"] for x in want]
