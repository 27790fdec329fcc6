"""Problem 5: near-equal records by a byte-position inverted index with count filtering.

Each value gets a digest of ``POSITIONS`` places; place i holds two bytes of the i-th min-hash of the value's set of
three-word shingles, so two values agree in a place about as often as their sets' Jaccard similarity says. Values with
the same set are one class and go on as one representative. The inverted index has a posting for each run of ``RUN``
consecutive places: its number, its field and the six bytes of the run, so postings are shared by chance about once in
2.8e14 and the key needs no widening up to billions of records. Representatives that share a posting are tallied inside
the join over ``TALLY`` positional bytes which the posting carries; only pairs that reach ``LEAST_EQUAL`` equal bytes go
on, and are verified on the exact shingle sets.

What the index can lose: a pair of similarity s shares no posting with probability (1 - s^3)^24, which is 0.3 % at the
threshold 0.6, 0.05 % at 0.65 and 0.004 % at 0.7, and falls short of the count with less than 0.1 % at 0.6. No posting
list is capped and none is collected: pairs come from an equi-join over as many partitions as its size asks for, and
adaptive execution splits it where a posting is hot. ``exact=True`` takes the index of ``guaranteed_pairs`` instead, whose
least count every pair at the threshold reaches; it has about twice the postings and no conjunction of places, so it is
meant for collections that share few phrases. Classes are expanded to pairs of records only at the end.

Null values and values of fewer than ``least_words`` words are no candidates; re-delivered records count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Sieve, WordIds, blocks, field_name, ids_of, minhash, multipliers, shingle_hashes, text_values, words_of
from tracemill.operators.components import connected_components
from tracemill.session import cut, partitioned

POSITIONS, RUN, TALLY = 72, 3, 16
THRESHOLD, SHINGLE, LEAST_WORDS, LEAST_EQUAL = 0.6, 3, 30, 4
_SEED = 20_240_601
#: About what a posting takes in a shuffle, in bytes.
POSTING_BYTES = 20


def _sets(texts: list[str | None], ids: WordIds, shingle: int, least_words: int) -> list[np.ndarray | None]:
    """Sorted distinct shingle hashes of each text, None for short ones."""
    out = []
    for text in texts:
        # a word and the gap to the next take two characters at least
        words = words_of(text) if text and len(text) >= 2 * least_words - 1 else []
        out.append(np.unique(shingle_hashes(ids_of(words, ids), shingle)) if len(words) >= max(least_words, shingle) else None)
    return out


def sketch(values: DataFrame, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(field, id, class, digest, tally): ``class`` names the set, ``digest`` has its places, ``tally`` the half-bytes to be counted."""
    mult = multipliers(POSITIONS, _SEED)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            at, classes, digests, tallies = [], [], [], []
            rows = enumerate(_sets(batch.column("text").to_pylist(), ids, shingle, least_words))
            for part in blocks(((i, s) for i, s in rows if s is not None), lambda x: len(x[1]), 30_000):
                starts = np.cumsum([0, *(len(s) for _, s in part[:-1])])
                digest = (minhash(np.concatenate([s for _, s in part]), starts, mult) & 0xFFFF).astype(np.uint16)
                at += [i for i, _ in part]
                classes += [np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) for _, s in part]
                digests.append(digest.view(np.int16))
                half = (digest[:, :: POSITIONS // TALLY][:, :TALLY] & 0xF).astype(np.uint64)
                tallies.append((half << np.arange(0, 4 * TALLY, 4, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
            if not at:
                continue
            digest, tally = np.concatenate(digests), np.concatenate(tallies)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, digest.size + 1, POSITIONS, dtype=np.int32)), pa.array(digest.ravel()))
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("field").take(taken), batch.column("id").take(taken), pa.array(np.array(classes, np.int64)), lists, pa.array(tally)], ["field", "id", "class", "digest", "tally"])

    return values.where(F.length("text") >= 2 * least_words - 1).select("field", "id", "text").mapInArrow(make, "field int, id bigint, class bigint, digest array<smallint>, tally bigint")


def _equal_halves(a: str, b: str) -> F.Column:
    """Number of equal half-bytes of two 8-byte values, by arithmetic that code generation covers."""
    x = f"({a} ^ {b})"
    fold = f"({x} | shiftrightunsigned({x}, 2))"
    return F.expr(f"16 - bit_count(({fold} | shiftrightunsigned({fold}, 1)) & 1229782938247303441)")  # 0x1 in each half-byte


def near_classes(values: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, least_equal: int = LEAST_EQUAL, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (field, rep, id) of every record, and (field, rep_a, rep_b, similarity) of similar classes."""
    spark = values.sparkSession
    # a repeated delivery has the class of the first one, so nothing has to be dropped before the classes are made
    sketched = cut(sketch(values, shingle, least_words))
    grouped = sketched.groupBy("field", "class")
    reps = grouped.agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("digest", "tally")))
    named = grouped.agg(F.min("id").alias("rep"))
    members = sketched.select("field", "class", "id").distinct().join(named, ["field", "class"]).select("field", "rep", "id")
    if exact:
        return members, verify(values, cut(guaranteed_pairs(values.join(named, (values["field"] == named["field"]) & (values["id"] == named["rep"]), "left_semi"), threshold, shingle, least_words)), threshold, shingle, least_words)
    place = lambda i: F.get("digest", (F.col("run") * RUN + i).cast("int")).cast("bigint").bitwiseAND(0xFFFF)
    runs = reps.select("field", "rep", "tally", "digest", F.explode(F.sequence(F.lit(0), F.lit(POSITIONS // RUN - 1))).alias("run"))
    key = F.shiftleft((F.col("run") * 4 + F.col("field")).cast("bigint"), 48) + F.shiftleft(place(0), 32) + F.shiftleft(place(1), 16) + place(2)
    posting = runs.select(key.alias("key"), "rep", "tally")
    a, b = posting.alias("a"), posting.alias("b")
    tallied = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (_equal_halves("a.tally", "b.tally") >= least_equal))
    pairs = tallied.select(F.shiftright("a.key", 48).bitwiseAND(3).cast("int").alias("field"), F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct()
    # both sides of the join are read
    with partitioned(spark, 2 * sketched.count() * (POSITIONS // RUN) * POSTING_BYTES):
        pairs = cut(pairs)
    return members, verify(values, pairs, threshold, shingle, least_words)


def guaranteed_pairs(values: DataFrame, threshold: float, shingle: int, least_words: int, least: int = 2) -> DataFrame:
    """(field, rep_a, rep_b): every pair at the threshold, and others, by an index with a guaranteed count.

    A pair at the threshold shares ceil(threshold x n) of the n shingles of either side at least. So among the first
    n - ceil(threshold x n) + least shingles of both sides, in one order for all, there are ``least`` common ones: the
    postings are these shingles, their matches are tallied per pair, and pairs below ``least`` cannot be at the threshold.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            sets = _sets(batch.column("text").to_pylist(), ids, shingle, least_words)
            kept = [(i, s[: len(s) - max(least, int(np.ceil(threshold * len(s) - 1e-9))) + least]) for i, s in enumerate(sets) if s is not None]
            at = np.repeat([i for i, _ in kept], [len(s) for _, s in kept]).astype(np.int32)
            flat = np.concatenate([s for _, s in kept]).astype(np.int64) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("field").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(flat)], ["field", "rep", "key"])

    posting = values.select("field", "id", "text").mapInArrow(make, "field int, rep bigint, key bigint").distinct()
    a, b = posting.alias("a"), posting.alias("b")
    shared = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")))
    tally = shared.groupBy(F.col("a.field").alias("field"), F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).agg(F.count("*").alias("n"))
    return tally.where(F.col("n") >= least).drop("n")


def verify(values: DataFrame, pairs: DataFrame, threshold: float, shingle: int, least_words: int) -> DataFrame:
    """The pairs whose exact shingle sets have the similarity, with it."""
    wanted = pairs.select("field", F.explode(F.array("rep_a", "rep_b")).alias("id"))
    sieve = Sieve.of(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            batch = sieve.kept(batch)
            made = _sets(batch.column("text").to_pylist(), ids, shingle, least_words)
            at = pa.array([i for i, s in enumerate(made) if s is not None], pa.int32())
            kept = [s.astype(np.int64) for s in made if s is not None]
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("field").take(at), batch.column("id").take(at), lists], ["field", "id", "set"])

    chosen = values.select("field", "id", "text").mapInArrow(sets, "field int, id bigint, set array<bigint>").dropDuplicates(["field", "id"])
    left = pairs.join(chosen.withColumnsRenamed({"id": "rep_a", "set": "set_a"}), ["field", "rep_a"])
    both = left.join(chosen.withColumnsRenamed({"id": "rep_b", "set": "set_b"}), ["field", "rep_b"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    similarity = shared / (F.size("set_a") + F.size("set_b") - shared)
    return both.select("field", "rep_a", "rep_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, id_a, id_b): every pair of near-equal records."""
    members, pairs = near_classes(text_values(spark, sf_dir))
    members = cut(members)
    same = members.alias("a").join(members.alias("b"), (F.col("a.field") == F.col("b.field")) & (F.col("a.rep") == F.col("b.rep")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.field").alias("field"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    left = pairs.join(members.select("field", F.col("rep").alias("rep_a"), F.col("id").alias("x")), ["field", "rep_a"])
    both = left.join(members.select("field", F.col("rep").alias("rep_b"), F.col("id").alias("y")), ["field", "rep_b"])
    other = both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(other).select(field_name(F.col("field")).alias("field_name"), "id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, id, group_id, links): each record of a group of two or more; ``links`` counts its class's similar classes."""
    members, pairs = near_classes(text_values(spark, sf_dir))
    members, pairs = cut(members), cut(pairs)
    # a representative is unique within its field only
    key = lambda c: F.struct("field", F.col(c).alias("rep"))
    groups = connected_components(pairs.select(key("rep_a").alias("a"), key("rep_b").alias("b")))
    links = pairs.select("field", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("links"))
    found = groups.select("node.field", "node.rep", F.col("component.rep").alias("group_id"))
    sizes = members.groupBy("field", "rep").agg(F.count("*").alias("copies"))
    joined = members.join(sizes, ["field", "rep"]).join(found, ["field", "rep"], "left").join(links, ["field", "rep"], "left")
    joined = joined.where(F.col("group_id").isNotNull() | (F.col("copies") > 1))
    return joined.select(field_name(F.col("field")).alias("field_name"), "id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
