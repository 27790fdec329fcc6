"""Problems 7, 8 and 9: encoding, leaks and pieces against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import leakage as L
from tracemill.llm.common import WordIds
from tracemill.llm import splitting as S
from tracemill.llm import tokens as T
from tracemill.llm.common import words_of

TEXTS = [None, "", " ", "\n\n", "don't we'll 'll x", "a" * 5000, "x " * 3000, "中文没有空格" * 400, "tab\t\tend  \n\n\nnew para ", "é́ 🙂🙂 mixed ½ ٣", "<|reasoning_start|> <|endoftext|>", "'" * 700 + "ll"]


@pytest.mark.parametrize("chunk, overlap", [(16384, 512), (200, 20), (64, 5)])
def test_encoding_is_the_whole_texts(spark, chunk, overlap):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice(["foo", " ", "\n", "'s", "12", "é", "  ", "!?", "中"]) for _ in range(900)) for _ in range(8)]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in enumerate(texts)], "doc_id long, text string, id string, row int")
    got = {r.doc_id: r.ids for r in T.encode_documents(df, chunk_chars=chunk, overlap=overlap).collect()}
    enc = T.encoding()
    for i, x in enumerate(texts):
        assert got[i] == (None if x is None else enc.encode_ordinary(x)), (i, chunk)
        assert T.decode(got[i]) == x


def test_encoding_keeps_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x " * 300), (1, "x " * 300), (2, "y")], "doc_id long, text string")
    assert T.encode_documents(df, chunk_chars=100, overlap=10).count() == 3
    assert T.encode_documents(df.where("false")).count() == 0


@given(st.lists(st.integers(-1, 5), min_size=1, max_size=300), st.integers(10, 60), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_spans_cover_and_overlap(strengths, most, overlap):
    cuts = S.spans(np.array(strengths, np.int8), most, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(strengths)
    assert all(b - a <= most for a, b in cuts)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert 1 <= b - c <= overlap and c > a and d > b


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
@settings(max_examples=60, deadline=None)
def test_sparse_table(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    array = np.array(values)
    top = max(values[low : high + 1])
    places = [i for i in range(low, high + 1) if values[i] == top]
    assert S.SparseTable(array, 128).best(low, high) == places[-1]
    assert S.SparseTable(array, 128, rightmost=False).best(low, high) == places[0]


def test_pieces(spark):
    paragraph = "One short sentence here. Another one follows it.\n"
    texts = [None, "", "short", (paragraph * 4 + "\n") * 20, "word " * 700, "中文没有空格" * 300, "a" * 4000, "🙂" * 900]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, id int")
    rows = S.split_documents(df, most=100, overlap=16).toPandas()
    enc = T.encoding()
    for i, x in enumerate(texts):
        mine = rows[rows.doc_id == i].sort_values("piece_no")
        if x is None or len(enc.encode_ordinary(x)) <= 100:
            assert mine.empty
            continue
        assert mine.piece_no.tolist() == list(range(len(mine))) and len(mine) > 1
        assert mine.start_token.iloc[0] == 0 and mine.end_token.iloc[-1] == len(enc.encode_ordinary(x))
        assert all(len(enc.encode_ordinary(p)) <= 100 and "\ufffd" not in p for p in mine.piece)
    assert set(rows[(rows.doc_id == 3) & (rows.cut != "end")].cut) == {"paragraph"}
    assert set(rows[(rows.doc_id == 4) & (rows.cut != "end")].cut) == {"word"}
    assert S.split_documents(df.where("false")).count() == 0


def test_pieces_that_do_not_fit_are_cut_on(spark):
    """Merges across a cut are lost, so a piece of few tokens may have more on its own: it is shortened, overlap included."""
    df = spark.createDataFrame([(1, "internationalisation" * 40 + " 🙂é中" * 60)], "doc_id long, text string")
    for most, overlap in ((12, 8), (10, 5)):
        rows = S.split_documents(df, most=most, overlap=overlap).toPandas()
        assert all(len(T.encoding().encode_ordinary(p)) <= most and "\ufffd" not in p for p in rows.piece) and len(rows) > 20


def test_hamming_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, np.uint64)
    flips = base.copy()
    for k in range(2):
        flips[::2] ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    a, b = L.HammingIndex(base, 2).near(flips)
    want = {(i, j) for i in range(300) for j in range(300) if bin(int(flips[i] ^ base[j])).count("1") <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_hamming_index_with_inner_radius_loses_nothing(monkeypatch):
    monkeypatch.setattr(L.HammingIndex, "MOST", 50)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, np.uint64, endpoint=False)
    near = np.array([int(x) ^ sum(1 << int(b) for b in rng.choice(64, k % 14, replace=False)) for k, x in enumerate(base)], np.uint64)
    a, b = L.HammingIndex(base, 11, 4).near(near)
    want = {(i, j) for i in range(60) for j in range(60) if bin(int(near[i] ^ base[j])).count("1") <= 11}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) > 40


def test_simhash_of_equal_windows_is_equal():
    ids = np.random.default_rng(2).integers(0, 2**63, 40, np.uint64)
    prints = L.simhash_at(L.bit_sums(ids), np.arange(29), 12)
    assert len(prints) == 29 and prints[5] == L.simhash_at(L.bit_sums(ids[5:17]), np.arange(1), 12)[0]


def test_sizes_of_windows():
    for n in range(200):
        size = L.item_size(n)
        assert size == 0 or size == n < 12 or 24 <= size <= n - L.STRIDE + 1 and size > 0.7 * (n - L.STRIDE)


def test_recall_of_altered_items():
    """Items with one or two changed words, and such with a word put in or left out, against brute force over all places."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = {i: rng.choices(vocabulary, k=rng.randint(43, 110)) for i in range(80)}
    block = L.ItemBlock([(i, " ".join(w)) for i, w in items.items()], 12, 2)
    alone = L.ItemBlock([(i, " ".join(w)) for i, w in items.items()], 12, 2)
    alone.indexes = [x for x in alone.indexes if x[0] > 12]  # item-sized windows only
    texts, want = [], set()
    for row, (i, w) in enumerate(items.items()):
        w = list(w)
        for place in rng.sample(range(len(w)), 1 + row % 2):
            w[place] = "other"
        if row % 5 == 0:
            w.insert(rng.randrange(len(w)), "more")
        text = rng.choices(vocabulary, k=rng.randint(0, 90)) + w + rng.choices(vocabulary, k=rng.randint(0, 90))
        texts.append(" ".join(text))
        whole = L.weighted_shingles(items[i])
        if any(L.similarity_of(L.weighted_shingles(text[p : p + len(items[i])]), whole) >= 0.8 for p in range(len(text))):
            want.add((row, i))
    found = lambda b: {(r, i) for r, i, run, share, alike in L._scan(b, WordIds(), texts, 0.8) if alike >= 0.8}
    assert len(want) > 40 and found(block) == want
    assert len(found(alone) & want) >= 0.9 * len(want)
    # every one of them is reported, below the similarity too, as a part of it is whole
    assert {(r, i) for r, i, *_ in L._scan(block, WordIds(), texts, 0.8)} >= {(i, i) for i in range(80)}


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 50)))) for i in range(60)] + [(98, None), (99, "")]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 3 == 0:
            source = words_of(items[rng.randrange(60)][1])
            start = rng.randrange(len(source))
            words[5:5] = source[start : start + rng.randint(8, 30)]
        docs.append((i, " ".join(w.upper() if i % 2 else w + "," for w in words)))
    docs += [(1000, None), (1001, ""), (1002, "x " * 200_000), docs[0]]
    d = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, x, "t") for i, x in items], "item_id long, item_text string, text string")
    grams = {}
    for i, x in items:
        w = words_of(x)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(i, q) for i, x in docs for w in [words_of(x)] for k in range(len(w) - 11) for q in grams.get(tuple(w[k : k + 12]), ())}
    run = lambda: [(r.doc_id, r.item_id) for r in L.find_items(d, it).where("longest_run >= 12").collect()]
    got = run()
    assert len(got) == len(set(got)) and set(got) == want and want
    monkeypatch.setattr(L, "BLOCK_WORDS", 500)  # several blocks of items give the same rows
    assert set(run()) == want
    assert L.find_items(d.where("false"), it).count() == 0 and L.find_items(d, it.where("false")).count() == 0
