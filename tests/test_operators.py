"""Operators against brute force on small tables, with nulls, ties, repeated rows and empty tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import evaluate as E
from tracemill.operators import hierarchy as H
from tracemill.operators import packing as K
from tracemill.operators import pairs as P
from tracemill.operators import rewards as R
from tracemill.operators import sampling as M
from tracemill.operators.components import connected_components
from tracemill.operators.search import mcts_search
from tracemill.providers import HashEmbedding, apply_provider, with_retries
from tracemill.sources import io
from tracemill.streaming.packing import stream_packed


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(60)] + [(None, 5), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("margin, most", [(0.0, 2), (0.2, 3), (0.2, 1)])
def test_margin_pairs(spark, margin, most):
    rng = random.Random(1)
    rows = [(i % 4, i, rng.choice([0.0, 0.1, 0.5, 0.5, 0.9])) for i in range(40)] + [(9, 99, None), (9, 98, 0.3)]
    got = {(r.item, r.chosen, r.rejected) for r in P.margin_pairs(spark.createDataFrame(rows, "item int, c int, s double"), "item", "c", "s", margin, most).collect()}
    want = set()
    for item in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == item and r[2] is not None), key=lambda r: (-r[2], r[1]))
        pairs = [(item, a[1], b[1]) for i, a in enumerate(ranked) for b in reversed(ranked[i + 1 :]) if a[2] - b[2] >= margin - 1e-12]
        want |= set(pairs[:most])
    assert got == want


def test_pos_neg_pairs_hot_key(spark):
    rows = [("q", i, f"a{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "q string, id int, ans string")
    pairs = P.pos_neg_pairs(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["q"], "id", "ans", 15).collect()
    assert len(pairs) == 15 and all(rows[p.chosen_id][2] != rows[p.rejected_id][2] for p in pairs)
    assert P.pos_neg_pairs(df.where("false"), df, ["q"], "id", "ans").count() == 0


def test_numbered_and_shards(spark):
    df = spark.createDataFrame([(x * x,) for x in range(103)], "k long")
    got = {r.k: r.rn for r in M.numbered(df, "k").collect()}
    assert got == {x * x: x for x in range(103)}
    sizes = sorted(r["count"] for r in M.rank_shards(df, "k", 4).groupBy("shard").count().collect())
    assert sizes == [25, 26, 26, 26]
    assert M.numbered(df.where("false"), "k").count() == 0


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "k int, w double")
    counts = {r.k: r["count"] for r in M.weighted_sample(df, "k", "w", 4000, 1).groupBy("k").count().collect()}
    assert sum(counts.values()) == 4000 and 3 not in counts and abs(counts[2] / 4000 - 0.75) < 0.05


def test_length_grouped_chunks_are_even(spark):
    df = spark.createDataFrame([(i, (i * 37) % 200) for i in range(400)], "k long, n int")
    rows = M.length_grouped(df, "k", "n", 5, 4, megabatch=5).toPandas()
    assert len(rows) == 400
    for _, mega in rows.groupby("mega"):
        sums = mega.groupby("chunk").n.sum()
        assert sums.max() - sums.min() <= 200


def test_accuracy_of_nothing(spark):
    empty = spark.createDataFrame([], "s double")
    row = E.accuracy(empty, F.col("s")).first()
    assert (row.asked, row.answered, row.acc_answered) == (0, 0, None)


def test_ngram_repetition(spark):
    rows = [(1, "a b a b a b"), (2, None), (3, ""), (4, "x"), (5, "a " * 50)]
    got = {r.k: (r.n_grams, r.ratio) for r in E.ngram_repetition(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), 2).collect()}
    assert got == {1: (5, 0.4), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (49, round(1 / 49, 6))}


def test_join_gold_strict(spark):
    p, g = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, a string")
    assert E.join_gold(p, g, "k").count() == 1
    with pytest.raises(Exception, match="no gold row"):
        E.join_gold(p, g, "k", strict=True).collect()


def test_normalize_reviews(spark):
    steps = spark.createDataFrame([(1, 1, "s1", "P", ["c1", "c2", "c3", "c4"]), (1, 2, "s2", None, [])], "id int, step_index int, step_text string, selected_parent string, candidates array<string>")
    reviews = spark.createDataFrame([(1, 1, "", None, [" a ", "a", "", None], {"a": 12}), (1, None, "x", "Q", ["z"], {"z": 1})], "id int, step_index int, step_text string, selected_parent string, categories array<string>, scores map<string,int>")
    rows = {(r.step_index, r.step_text): r for r in R.normalize_reviews(steps, reviews, "id").collect()}
    a = rows[1, "s1"]
    assert a.selected_parent == "P" and a.review.categories == ["a", "c1", "c2"] and a.review.scores == {"a": 10, "c1": 5, "c2": 5}
    assert rows[2, "s2"].review.categories == ["Generic Criterion 1", "Generic Criterion 2", "Generic Criterion 3"]
    assert round(rows[2, "s2"].review["mean"], 6) == round(4 / 9, 6)
    assert rows[None, "x"].review.categories == ["z"]


def test_average_linkage():
    import pandas as pd

    merges = H.average_linkage(pd.DataFrame([("a", "b", 0.1), ("c", "d", 0.2), ("a", "c", 0.6)], columns=["a", "b", "distance"]), ["a", "b", "c", "d"])
    assert merges[["left", "right"]].values.tolist() == [[0, 1], [2, 3], [4, 5]]
    assert np.allclose(merges.distance, [0.1, 0.2, (0.6 + 3) / 4])
    tree = H.linkage_tree(merges, ["a", "b", "c", "d"])
    assert tree[tree.parent.isna()].name.tolist() == ["cluster_6"]


def test_birch_separates(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.05, (60, 2)), rng.normal(5, 0.05, (60, 2))])
    leaves = H.birch_leaves(points, 0.5, branching=4)
    assert not set(leaves[:60]) & set(leaves[60:])


def test_packing_keeps_the_budget(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, rng.randint(0, 900), rng.randint(0, 9), i) for i in range(500)] + [(0, 1000, 9000, 0, None), (0, 1001, None, None, None)]
    out = K.pack_samples(spark.createDataFrame(rows, "w int, s long, t int, m int, o long"), "w", "s", "t", "m", "o", 1000, 10, 4, lanes=2).toPandas()
    assert sorted(out["sample"]) == sorted(r[1] for r in rows)
    groups = out.groupby(["worker", "lane", "buffer"]).agg(t=("tokens", "sum"), m=("images", "sum"), n=("sample", "count"))
    assert ((groups.t <= 1000) | (groups.n == 1)).all() and (groups.m <= 10).all()
    assert K.split_at(25, [8, 12], 10) == [(0, 8), (8, 18), (18, 25)]


def test_positions_and_padding(spark):
    df = spark.createDataFrame([([0, 1, 1], [1, 2]), ([], [])], "m array<int>, n array<int>")
    rows = df.select(K.position_ids(F.col("m")).alias("p"), K.cu_seqlens(F.col("n")).alias("c")).collect()
    assert sorted((tuple(r.p), tuple(r.c)) for r in rows) == [((), (0,)), ((1, 0, 1), (0, 1, 3))]


def test_search_is_repeatable(spark):
    q = spark.createDataFrame([(1, "how many", "7"), (2, None, None)], "k long, q string, a string")
    run = lambda: mcts_search(q, "k", "q", "a", simulations=6, depth=3).toPandas()
    a, b = run(), run()
    assert a.sort_values(["k", "rank"]).text.tolist() == b.sort_values(["k", "rank"]).text.tolist() and set(a.k) == {1, 2}


def test_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    rows = {r.k: r.v for r in apply_provider(df, "t", HashEmbedding(4), "v", "array<double>").collect()}
    assert rows[1] == rows[2] and rows[3] is None
    calls = []
    flaky = with_retries(lambda xs: [calls.append(x) or (x if len(calls) > 1 else None) for x in xs], lambda r: r is not None)
    assert flaky(["q"]) == ["q"] and with_retries(lambda xs: [None for _ in xs], bool, 2)(["q"]) == [None]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"k": 1},\n\n{"k": 2}\nbroken {\n')
    assert sorted(r.k for r in io.read_jsonl(spark, str(path), "k int", "drop").collect()) == [1, 2]
    kept = io.read_jsonl(spark, str(path), "k int", "keep").collect()
    assert len(kept) == 3 and [r._corrupt_record for r in kept if r.k is None] == ["broken {"]
    with pytest.raises(Exception, match="malformed"):
        io.read_jsonl(spark, str(path), "k int").collect()


def test_aliases_images_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("", "q", "c", '["a","b","a"]', None), (None, None, "c", "one", ["z"])], "query string, question string, accept string, image string, images array<string>")
    rows = io.coalesce_aliases(df).select("question", "chosen", io.image_list(df).alias("i")).collect()
    assert [(r.question, r.chosen, r.i) for r in rows] == [("q", "c", ["a", "b"]), (None, "c", ["one", "z"])]
    (tmp_path / "r.json").write_text(json.dumps({"d1": {"root": "r", "annotation": "a.jsonl", "repeat_time": 2, "data_augment": False}}))
    assert io.read_registry(spark, str(tmp_path / "r.json")).first().repeat_time == 2.0


def test_criteria_pairs_last_line_wins(spark):
    lines = spark.createDataFrame([(1, "P：a、b、a"), (2, "Q: x; y"), (3, "P:c"), (4, "no pair"), (5, None)], "line_no int, value string")
    assert {r.parent: r.children for r in io.criteria_pairs(lines).collect()} == {"P": ["c"], "Q": ["x", "y"]}


def test_streamed_packing(spark, tmp_path):
    rows = [(i % 2, i, 300, 1) for i in range(40)]
    spark.createDataFrame(rows, "worker int, sample long, tokens int, images int").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("worker int, sample long, tokens int, images int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_packed(stream, max_tokens=600, most=3).writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.sql("SELECT * FROM packed").toPandas()
    assert len(out) >= 32 and not out["sample"].duplicated().any()
    assert (out.groupby(["worker", "buffer"]).tokens.sum() <= 600).all()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "k string, n int")
    io.write_counts(df, "k", "n", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["c\t5", "a\t1", "b\t1"]
    io.write_jsonl(df, str(tmp_path / "j"))
    io.write_jsonl(df, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 6
