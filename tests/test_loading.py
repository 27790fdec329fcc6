"""The packing loader, label masks, providers and readers on hand-worked cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill import providers as X
from tracemill.functions import inputs as I
from tracemill.operators import loader as L
from tracemill.operators import masking as K
from tracemill.operators import packing as B
from tracemill.operators import sampling as P
from tracemill.sources import io as S

IMG = [L.IMAGE_START, L.IMAGE_TOKEN, L.IMAGE_TOKEN, L.IMAGE_END]


def pack(ids, images):
    return L.Pack().add(ids, ids, images)


def test_split_pack():
    assert [p.ids for p in L.split_pack(pack([1, 2, 3], 0), 5)] == [[1, 2, 3]]  # short: as it is
    # the cut would fall inside the second image, so it moves to its start
    parts = L.split_pack(pack([1] + IMG + [2, 3] + IMG + [4], 2), 9)
    assert [(p.ids, p.images) for p in parts] == [([1] + IMG + [2, 3], 1), (IMG + [4], 1)]
    # a cut in text: the next part begins with the next image, what is between is dropped
    parts = L.split_pack(pack(IMG + [1, 2, 3, 4, 5] + IMG + [6], 2), 6)
    assert [(p.ids, p.images) for p in parts] == [(IMG + [1, 2], 1), (IMG + [6], 1)]
    # the rest has no image
    assert [p.ids for p in L.split_pack(pack(IMG + [1, 2, 3, 4], 1), 6)] == [IMG + [1, 2]]
    # labels that are all ignored teach nothing; an image that alone exceeds the capacity ends the split
    assert L.split_pack(L.Pack().add(IMG + [1, 2, 3], [-100] * 7, 1), 5) == []
    assert L.split_pack(pack([L.IMAGE_START] + [L.IMAGE_TOKEN] * 9 + [L.IMAGE_END], 1), 5) == []


def test_packer_finds_overflows_and_flushes():
    packer = L.Packer(10, 3, 4, False)
    assert packer.add([1] * 6, [1] * 6, 1) == [] and packer.add([2] * 6, [2] * 6, 2) == []
    assert [p.images for p in packer.open] == [2, 1]  # by falling number of images
    done = packer.add([3] * 4, [3] * 4, 1)  # fits the first: 10 tokens, 3 images
    assert [(p.ids, p.images, p.index) for p in done] == [([2] * 6 + [3] * 4, 3, [0] * 6 + [1] * 4)]
    for k in range(5):
        done = packer.add([k] * 9, [k] * 9, 1)
    assert len(done) == 1 and len(packer.open) == 4 and len(packer.flush()) == 4 and packer.open == []
    over = L.Packer(8, 9, 2, True)
    over.add(IMG + [1, 1], IMG + [1, 1], 1)
    done = over.add(IMG + [2, 2], IMG + [2, 2], 1)  # half of the places are taken: joined and split
    assert done == [] and sorted(len(p.ids) for p in over.open) == [6, 6]


def test_load_packs(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, IMG * rng.randint(0, 2) + [7] * rng.randint(0, 9), "x") for i in range(120)] + [(900, 1, None, "x"), (901, 1, [], "x")]
    df = spark.createDataFrame(rows, "id long, w int, ids array<int>, lane string").withColumn("images", F.size(F.filter("ids", lambda x: x == L.IMAGE_START)))
    for lanes in (1, 5):
        out = L.load_packs(df, "w", "id", "ids", None, "images", 40, 6, 4, False, lanes).toPandas()
        assert sum(out.n_samples) == sum(bool(r[2]) for r in rows) and sum(map(len, out.input_ids)) == sum(len(r[2] or []) for r in rows)
        assert (out.input_ids.map(len) <= 40).all() and (out.n_images <= 6).all()
        assert all(list(x) == sorted(x) and x[0] == 0 for x in out.data_index) and not out.duplicated(["worker", "lane", "pack"]).any()
    assert L.load_packs(df.where("false"), "w", "id", "ids", None, "images").count() == 0
    packs = spark.createDataFrame([(0, [1, 2, 3], [0, 0, 1], 1), (0, [4], [0], 2), (1, [], [], 0)], "b int, input_ids array<int>, data_index array<int>, n_images int")
    assert {tuple(r) for r in L.collate_stats(packs, "b", 5, 3).collect()} == {(0, 3, 6, 3), (1, 0, 5, 3)}
    places = spark.createDataFrame([([0, 0, 1, 1, 1, 3],), ([],), (None,)], "x array<int>").select(L.sub_positions("x").alias("p"))
    assert [r.p for r in places.collect()] == [[0, 1, 0, 1, 2, 0], [], None]


def test_interleaved_order_follows_weights(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 2000, "a").otherwise("b").alias("s"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "s string, weight double")
    first = L.interleaved(rows, "s", "id", weights).orderBy("turn").limit(800).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 800 for r in first}
    assert 0.68 < share["a"] < 0.82


WORDS = K.WordTokenizer()


def spoken(ids, labels):
    return [i for i, x in zip(ids, labels) if x != K.IGNORED]


def test_masks():
    turns = [("system", "Be kind."), ("human", "What is it?"), ("gpt", "It is 12."), ("human", "Why?"), ("gpt", "Count them.")]
    ids, labels = K.mask_segments(turns, WORDS, 500)
    assert len(ids) == len(labels) and spoken(ids, labels) == WORDS.encode("It is 12.<|im_end|>") + WORDS.encode("Count them.<|im_end|>")
    ids, labels = K.mask_pieces(K.pieces("chat", turns, "Be kind."), WORDS, 500)
    assert spoken(ids, labels) == WORDS.encode("It is 12.<|im_end|>Count them.<|im_end|>") and ids == WORDS.encode("".join(t for t, _ in K.pieces("chat", turns, "Be kind.")))
    ids, labels = K.mask_pieces(K.pieces("strict_chat", [("human", " a "), ("gpt", " b c ")]), WORDS, 500)
    assert spoken(ids, labels) == WORDS.encode("b c<|im_end|>")
    ids, labels = K.mask_pieces(K.pieces("generic", [("gpt", "left out"), ("human", "a"), ("gpt", "b")], roles=("user", "assistant"), end="\n"), WORDS, 500)
    assert spoken(ids, labels) == WORDS.encode("b\n")
    # truncated and filled up; a first token of its own
    ids, labels = K.mask_pieces([("a b", False), (" c d", True)], K.WordTokenizer(bos=9), 5, True)
    assert ids == [9] + WORDS.encode("a b c d")[:4] and len(labels) == 5 and labels[0] == K.IGNORED
    ids, labels = K.mask_segments([("human", "a")], WORDS, 30, fill=True)
    assert len(ids) == len(labels) == 30 and ids[-1] == 0 and set(labels) == {K.IGNORED}


def test_mismatch_ignores_everything():
    class Merging(K.WordTokenizer):
        def encode(self, text):
            return super().encode(text.replace("ab", "X"))

    ids, labels = K.mask_pieces([("a", False), ("b", True)], Merging(), 50)
    assert ids == Merging().encode("ab") and labels == [K.IGNORED] * len(ids)


def test_images_in_masks(spark):
    assert K.with_images([("human", "<image> or <image>?"), ("gpt", "<image>"), ("human", "<image>")], [1, 2], 2) == [
        ("human", "<img><IMG_CONTEXT><IMG_CONTEXT></img> or <img>" + "<IMG_CONTEXT>" * 4 + "</img>?"), ("gpt", "<image>"), ("human", "<image>")]
    turn = "array<struct<sender:string,value:string>>"
    df = spark.createDataFrame([(1, [("human", "<image> hi"), ("gpt", "yes")], [1], 5), (2, None, None, 5), (3, [], [], 5), (4, [("human", None), ("gpt", None)], None, 5)], f"id long, c {turn}, tiles array<int>, labels int")
    out = {r.id: r for r in K.masked(df, "id", "c", tiles="tiles", per_tile=3).collect()}
    assert len(out) == 4 and out[2].input_ids == out[3].labels == [] and len(out[1].input_ids) == len(out[1].labels) == len(out[1].attention_mask)
    assert spoken(out[1].input_ids, out[1].labels) == WORDS.encode("yes<|im_end|>")
    with pytest.raises(ValueError):
        K.masked(df, "id", "c", style="other")


def test_joined_sides(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3], [4]), (2, 0, [5], [6, 7])], "id int, b int, c array<int>, r array<int>")
    out = {(r.id, r.side): (r.ids, r.attention_mask) for r in B.join_sides(df, "b", "c", "r").collect()}
    assert out == {(1, 0): ([1, 2, 3], [1, 1, 1]), (1, 1): ([4, 0, 0], [1, 0, 0]), (2, 0): ([5, 0, 0], [1, 0, 0]), (2, 1): ([6, 7, 0], [1, 1, 0])}
    rows = spark.createDataFrame([(0, 2, "b", 1.0), (0, 1, "a", None), (1, 1, "c", 2.0)], "k int, o int, t string, v double")
    assert {r.k: (r.t, r.v) for r in B.collate(rows, "k", "o", "t", "v").collect()} == {0: (["a", "b"], [None, 1.0]), 1: (["c"], [2.0])}


def test_ranks_and_shards(spark):
    rows = spark.range(500).select((F.col("id") * 7 - 100).alias("id"), (F.col("id") % 3).alias("s"))
    ranked = P.hash_ranked(rows, "id", "s", digits=1).toPandas()
    for _, part in ranked.groupby("s"):
        assert sorted(part["__rank"]) == list(range(len(part))) and set(part["__n"]) == {len(part)}
    big = spark.createDataFrame([(2**60 + k,) for k in range(40)], "id long")
    assert [r.id for r in P.numbered(big, "id", rows_per_range=5).orderBy("rn").collect()] == [2**60 + k for k in range(40)]
    assert {r.worker for r in P.round_robin(big, "id", 3).collect()} == {0, 1, 2} and P.even_shards(big, "id", 7).count() == 35
    groups = P.length_grouped(rows.withColumn("n", F.col("id") % 50), "id", "n", 2, 4, 5).toPandas()
    assert len(groups) == 500 and sorted(groups.mega.value_counts())[-1] == 40 and (groups.mega.value_counts() == 40).sum() == 12
    shots = P.few_shots(big, "id", rows, "id", 3).collect()
    assert len(shots) == 40 and all(len(set(r.shots)) == 3 for r in shots) and len({tuple(r.shots) for r in shots}) > 5


def test_providers(spark):
    calls = []

    def flaky(inputs):
        calls.append(list(inputs))
        if len(calls) == 1:
            raise RuntimeError("busy")
        return ["ok" if len(calls) > 2 or x == "a" else "" for x in inputs]

    slept = []
    assert X.with_backoff(flaky, bool, 5, slept.append)(["a", "b"]) == ["ok", "ok"] and calls == [["a", "b"], ["a", "b"], ["b"]] and slept == [2.0, 4.0]
    assert X.with_backoff(lambda x: [None] * len(x), bool, 3, slept.append)(["a"]) == [None] and X.waits(9) == 60.0
    assert X.shortening(lambda xs: xs, lambda t: len(t) > 50)(["x" * 40 + "end" * 10, "short"]) == [("x" * 40 + "end" * 10)[-50:], "short"]
    df = spark.createDataFrame([(1, "one", "p"), (2, None, None)], "id int, question string, prefix string")
    made = {r.id: r.criteria for r in X.generate_criteria(df, "question", X.HashChat(("- A; B\n2. C; A; D, E; F",))).collect()}
    assert made == {1: ["A", "B", "C", "D", "E"], 2: []}
    judged = X.judge_steps(df.withColumn("c", F.array(F.lit("Clarity"), F.lit("Order"))), "question", "prefix", "c", X.HashJudge()).collect()
    assert all(r.review.reward_categories == ["Clarity", "Order"] and set(r.review.reward_scores) == {"Clarity", "Order"} for r in judged)
    assert X.judge_steps(df.withColumn("c", F.array(F.lit("x"))), "question", "prefix", "c", X.HashChat(("no json",))).where("review IS NULL").count() == 2
    carried = X.continue_prefixes(df, "id", "question", "prefix", 3, X.HashChat((" and on",))).collect()
    assert [(r.id, r.rejected) for r in carried] == [(1, "p and on")] * 3 and {r.k for r in carried} == {0, 1, 2}
    scored = X.score_traces(spark.createDataFrame([("s1ки s2ки",), ("none",), (None,)], "t string"), "t", X.HashLogits()).collect()
    assert sorted(len(r.step_scores or []) for r in scored) == [0, 0, 2]
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, n string")
    assert {r.g: (r.name, r.children) for r in X.name_clusters(groups, "g", "n", X.HashChat((" Both ",))).collect()} == {1: ("Both", ["a", "b"]), 2: ("c", ["c"])}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1, "t": "a"}, {"id": 2}]))
    (tmp_path / "object.json").write_text(json.dumps({"x": {"id": 1, "t": "a"}, "y": {"id": 2}}))
    assert sorted((r.id, r.t) for r in S.read_json_array(spark, str(tmp_path / "array.json"), "id int, t string").collect()) == [(1, "a"), (2, None)]
    S.json_array_to_lines(spark, str(tmp_path / "array.json"), "id int, t string", str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    assert sorted((r.key, r.id) for r in S.read_json_object(spark, str(tmp_path / "object.json"), "id int, t string").collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "t.csv").write_text('id,t\n1,"a\nb"\n2,"c ""d"""\n')
    assert sorted((r.id, r.t) for r in S.read_csv(spark, str(tmp_path / "t.csv"), "id int, t string").collect()) == [(1, "a\nb"), (2, 'c "d"')]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert S.read_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2},\n')
    assert tuple(S.count_lines(spark, str(tmp_path / "bad.jsonl")).first()) == (3, 2, 1)
    folder = tmp_path / "media" / "clip"
    folder.mkdir(parents=True)
    for name in ("f_2.jpg", "f_10.jpg", "cover.jpg", "notes.txt"):
        (folder / name).write_bytes(b"x")
    assert S.read_media(spark, str(tmp_path / "media")).count() == 3
    assert sorted((r.video, r.frame) for r in S.read_frames(spark, str(tmp_path / "media")).collect()) == [("clip", -1), ("clip", 2), ("clip", 10)]
    df = spark.createDataFrame([(1, "v", [0, 1], "video"), (2, "bad", [0], "image")], "id int, v string, i array<int>, data_type string")
    fetch = lambda v, i: [b"%d" % k for k in i] if v == "v" else 1 / 0
    assert {r.id: r.frames for r in S.fetch_frames(df, "id", "v", "i", fetch).collect()} == {1: [bytearray(b"0"), bytearray(b"1")], 2: None}
    assert [r.id for r in S.of_kind(df, "video").collect()] == [1]
    S.write_parts(df, str(tmp_path / "parts"), 2, "id")
    assert spark.read.json(str(tmp_path / "parts")).count() == 2
    S.write_many(df, {"all": [F.col("id")], "videos": [F.col("v")]}, str(tmp_path / "many"), {"videos": F.col("data_type") == "video"})
    assert spark.read.json(str(tmp_path / "many/all")).count() == 2 and [r.v for r in spark.read.json(str(tmp_path / "many/videos")).collect()] == ["v"]
    assert S.caption_lines(df.limit(1), "v", "data_type").first().value == '{"v":"video"}'
    good, bad = S.valid_or_logged(df, F.col("v") == "v", F.lit("no video"))
    assert good.count() == 1 and [(r.id, r.reason) for r in bad.collect()] == [(2, "no video")]
    assert [r.n for r in spark.createDataFrame([("a_7.jpg",), ("a.jpg",), (None,)], "x string").select(I.frame_number(F.col("x")).alias("n")).collect()] == [7, -1, -1]
    assert spark.createDataFrame([("<img='a.png'> and <img='b.png'>",)], "x string").select(I.image_paths(F.col("x")).alias("p")).first().p == ["a.png", "b.png"]
    scenes = spark.createDataFrame([({"a": {"b_c": 2}, "a_b": {"c": 1}},)], "s map<string, map<string, int>>")
    assert [tuple(r) for r in S.scene_frames(scenes, "s").collect()] == [("a_b_c", 2)]
