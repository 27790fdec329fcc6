"""Problem 4: values that stop before their author finished.

A value and the value it was cut from agree in their beginnings, so near-copies are looked for there: every value has
min-hash bands over the five-word shingles of its first 12, 36, 108, ... words, and asks with the bands of its own
longest beginning. Where a longer value shares such a band, every value of the band may be the one it was cut from; none
is chosen before its ending is known. So the asking value's last five words before its last word become a posting, all
values of the asked bands are read once and answer for the postings they hold with the word that follows, and only
partners whose word goes on where the asking value stops ("diff" in "different", "16." in "16.85") are paired: an equi-join
that hardly anything passes, however many values share a band. Their texts are fetched, verified as near-copies (0.8 of
the shorter one's shingles), and aligned: where the alignment ends inside the other's word or number, the value was cut.

Values without such a partner are scored by the terminality of their closing words (``endings``), which also scores what
the alignment leaves open; copies of the question have no end of their own and count as whole.

Null and blank values are not cut; re-delivered records count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, Sieve, WordIds, blocks, field_name, ids_of, minhash, multipliers, shingle_hashes, text_values, words_of
from tracemill.llm.defects import defect_of, is_copy, is_empty
from tracemill.llm.endings import cut_reason, terminality
from tracemill.session import cut

SHINGLE, SIMILARITY = 5, 0.8
SCALES = (12, 36, 108, 324, 972, 2916, 8748)
BANDS, ROWS = 3, 2
EARLY = "alignment ends early"
_SEED = 77_001


def beginnings(word_ids: np.ndarray) -> list[np.ndarray]:
    """The shingles of each beginning of a value."""
    hashes = shingle_hashes(word_ids[: SCALES[-1]], SHINGLE)
    return [hashes[: scale - SHINGLE + 1] for scale in SCALES if len(word_ids) >= scale]


def open_end(text: str) -> str | None:
    """'bare' for a text that ends in a word, 'point' for one with . or , behind its last word, None for any other."""
    body = text.rstrip()
    point = body[-1:] in (".", ",")
    body = body[:-1].rstrip() if point else body
    return ("point" if point else "bare") if WORD.fullmatch(body[-1:]) else None


def profile(values: DataFrame, defects: bool = False) -> DataFrame:
    """(field, id, ds_name, blank, reason, score, defect, n_words, keys, whole, ask, last, bare), one row a record.

    ``keys`` are BANDS for each beginning, the longest beginning last; ``whole`` is the hash of all words. Values that look
    whole and end in a word have ``ask``, the hash of the SHINGLE words before the last, ``last``, that word, and ``bare``,
    whether nothing stands behind it. ``defect`` is that of problem 3 if ``defects``.
    """
    mult = multipliers(BANDS * ROWS, _SEED)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            texts, questions = batch.column("text").to_pylist(), batch.column("question").to_pylist()
            ends = [cut_reason(t) for t in texts]
            flaws = [defect_of(t, q, r) if defects else None for t, q, r in zip(texts, questions, ends)]
            # these have no end of their own
            idle = [d in ("empty", "copy") if defects else None for d in flaws]

            def no_end(i: int) -> bool:
                return idle[i] if idle[i] is not None else is_empty(texts[i]) or bool(questions[i] and is_copy(texts[i], questions[i]))

            reasons = [None if r is None or no_end(i) else r for i, r in enumerate(ends)]
            scores = [terminality(t, r) for t, r in zip(texts, reasons)]
            words = [words_of(t) if t and len(t) > 2 * SCALES[0] else [] for t in texts]
            keys: list[list[int]] = [[] for _ in texts]
            wholes, asks, lasts, bares = ([None] * len(texts) for _ in range(4))
            for part in blocks((i for i, w in enumerate(words) if len(w) >= SCALES[0]), lambda i: 2 * len(words[i]), 60_000):
                runs, owner = [], []
                for i in part:
                    coded = ids_of(words[i], ids)
                    own = beginnings(coded)
                    wholes[i] = xxhash.xxh64_intdigest(coded.tobytes()) - 2**63
                    end = open_end(texts[i]) if ends[i] is None and not no_end(i) else None
                    if end:
                        asks[i] = int(shingle_hashes(coded[-SHINGLE - 1 : -1], SHINGLE)[0]) - 2**63
                        lasts[i], bares[i] = words[i][-1], end == "bare"
                    runs += own
                    owner += [(i, k) for k in range(len(own))]
                starts = np.cumsum([0, *(len(r) for r in runs[:-1])])
                signature = minhash(np.concatenate(runs), starts, mult).reshape(len(runs), BANDS, ROWS).astype(np.uint64)
                band = band_keys(signature)
                for (i, k), row in zip(owner, band):
                    keys[i] += (row ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("field"), batch.column("id"), batch.column("ds_name"), pa.array([is_empty(t) for t in texts]), pa.array(reasons, pa.string()), pa.array(scores, pa.float64()), pa.array(flaws, pa.string()), pa.array([len(w) for w in words], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(wholes, pa.int64()), pa.array(asks, pa.int64()), pa.array(lasts, pa.string()), pa.array(bares, pa.bool_())],
                ["field", "id", "ds_name", "blank", "reason", "score", "defect", "n_words", "keys", "whole", "ask", "last", "bare"],
            )

    return values.mapInArrow(make, "field int, id bigint, ds_name string, blank boolean, reason string, score double, defect string, n_words int, keys array<bigint>, whole bigint, ask bigint, last string, bare boolean").dropDuplicates(["field", "id"])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    h = np.arange(1, signature.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    h = np.repeat(h, len(signature), axis=0)
    for r in range(signature.shape[2]):
        h = (h ^ signature[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def aligned_cut(short: str, long: str) -> bool | None:
    """Whether ``short`` stops inside a sentence, word or number of its near-copy ``long``; None where they are no near-copies."""
    a = list(WORD.finditer(short.lower()))
    b = list(WORD.finditer(long.lower()))
    if len(a) < SCALES[0] or len(b) < len(a):
        return None
    wa, wb = [m.group() for m in a], [m.group() for m in b]
    place: dict[tuple, list[int]] = {}
    for j in range(len(wb) - SHINGLE + 1):
        place.setdefault(tuple(wb[j : j + SHINGLE]), []).append(j)
    shared = sum(tuple(wa[i : i + SHINGLE]) in place for i in range(len(wa) - SHINGLE + 1))
    if shared < SIMILARITY * (len(wa) - SHINGLE + 1):
        return None
    # the last words of the shorter one, but for the last word, which may be cut
    for back in range(1, 4):
        i = len(wa) - back - SHINGLE
        if i >= 0 and (hits := place.get(tuple(wa[i : i + SHINGLE]))):
            j = min(hits, key=lambda x: abs(x - i)) + SHINGLE
            rest = wa[i + SHINGLE :]
            if len(wb) < j + len(rest) or wb[j : j + len(rest) - 1] != rest[:-1]:
                continue
            other = wb[j + len(rest) - 1]
            if other != rest[-1]:
                # a part of the word, if nothing but it is left
                return len(other) > len(rest[-1]) and other.startswith(rest[-1]) and not short[a[-1].end() :].strip()
            mine, theirs = short[a[-1].end() :], long[b[j + len(rest) - 1].end() :]
            # 16. of 16.85: the point is no full stop
            return mine.strip() in ("", ".", ",") and len(theirs) > 1 and theirs[0] in ".," and theirs[1].isdigit()
    return False


def partners(values: DataFrame, found: DataFrame) -> DataFrame:
    """(field, id, other): asking values with every different value of their bands that goes on where they stop."""
    posting = found.select("field", "id", "n_words", F.posexplode("keys").alias("at", "key"), F.size("keys").alias("n_keys"), F.col("ask").isNotNull().alias("asks"))
    longest = posting.groupBy("field", "key").agg(F.max("n_words").alias("longest"), F.max("asks").alias("asked"), F.count("*").alias("n")).where("n > 1 AND asked").select("field", "key", "longest")
    banded = posting.join(longest, ["field", "key"])
    # values of equal words ask and answer once
    asks = banded.where((F.col("at") >= F.col("n_keys") - BANDS) & F.col("asks") & (F.col("longest") > F.col("n_words"))).select("field", "id").distinct()
    asks = found.join(asks, ["field", "id"], "left_semi").groupBy("field", "whole", "ask", "last", "bare").agg(F.min("id").alias("id"))
    asks = cut(asks)
    answering = Sieve.of(banded.select("field", "id"))
    wanted = Sieve.of(asks.select("field", F.col("ask").alias("id")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            batch = answering.kept(batch)
            rows = []
            for f, i, t in zip(*(batch.column(c).to_pylist() for c in ("field", "id", "text"))):
                words = words_of(t)
                if len(words) < SCALES[0]:
                    continue
                coded = ids_of(words, ids)
                keys = (shingle_hashes(coded, SHINGLE) ^ np.uint64(2**63)).view(np.int64)[:-1]
                hit = np.flatnonzero(wanted.has(keys, f))
                if not len(hit):
                    continue
                whole = xxhash.xxh64_intdigest(coded.tobytes()) - 2**63
                numbers = None
                for k in hit.tolist():
                    word = words[k + SHINGLE]
                    following = words[k + SHINGLE + 1] if k + SHINGLE + 1 < len(words) else ""
                    number = False
                    if following[:1].isdigit() and word[-1].isdigit():
                        numbers = numbers if numbers is not None else set(_PARTED.findall(t.lower()))
                        number = (word, following) in numbers
                    rows.append((f, i, int(keys[k]), word, number, whole))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()))], ["f", "other", "key", "word", "number", "all"])

    ends = values.select("field", "id", "text").mapInArrow(answer, "f int, other bigint, key bigint, word string, number boolean, all bigint")
    ends = ends.groupBy("f", "key", "word", "number", "all").agg(F.min("other").alias("other"))
    longer = F.col("bare") & (F.length("word") > F.length("last")) & F.startswith("word", "last")
    same = (F.col("f") == F.col("field")) & (F.col("key") == F.col("ask")) & (F.col("all") != F.col("whole"))
    return asks.join(ends, same & (longer | F.col("number") & (F.col("word") == F.col("last")))).select("field", "id", "other").distinct()


#: The parts of numbers like 16.85.
_PARTED = re.compile(r"(?<!\w)(\w*\d)[.,](\d\w*)")


def aligned(values: DataFrame, found: DataFrame) -> DataFrame:
    """(field, id) of values whose alignment with a near-copy ends early."""
    pairs = cut(partners(values, found))
    sieve = Sieve.of(pairs.select("field", F.explode(F.array("id", "other")).alias("id")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield sieve.kept(batch)

    texts = values.select("field", "id", "text").mapInArrow(sift, "field int, id bigint, text string").dropDuplicates(["field", "id"])
    both = pairs.join(texts, ["field", "id"]).join(texts.withColumnsRenamed({"id": "other", "text": "longer"}), ["field", "other"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array([bool(aligned_cut(s, x)) for s, x in zip(batch.column("text").to_pylist(), batch.column("longer").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("field").filter(hit), batch.column("id").filter(hit)], ["field", "id"])

    early = both.select("field", "id", "text", "longer").mapInArrow(align, "field int, id bigint").distinct()
    # values of equal words and equal ends share the finding
    named = found.select("field", "id", "whole", "last", "bare")
    first = named.join(early, ["field", "id"], "left_semi").select("field", "whole", "last", "bare").distinct()
    return named.where("last IS NOT NULL").join(first, ["field", "whole", "last", "bare"], "left_semi").select("field", "id")


def cut_values(values: DataFrame, defects: bool = False) -> DataFrame:
    """(field, id, ds_name, blank, reason, score, defect) of every record; ``reason`` is null for whole values, ``defect`` without ``defects``.

    ``score`` is the terminality of the closing words; 0 where the alignment shows the cut.
    """
    # the beginnings' keys are needed several times
    found = cut(profile(values, defects))
    early = aligned(values, found).withColumn("early", F.lit(True))
    joined = found.select("field", "id", "ds_name", "blank", "reason", "score", "defect").join(early, ["field", "id"], "left")
    reason = F.coalesce(F.when(F.col("early"), F.lit(EARLY)), "reason")
    return joined.select("field", "id", "ds_name", "blank", reason.alias("reason"), F.when(F.col("early"), 0.0).otherwise(F.col("score")).alias("score"), "defect")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_values(text_values(spark, sf_dir)).where("reason IS NOT NULL")
    name = F.when(F.col("field") == 2, F.lit("sampled_response")).otherwise(F.lit("preference_pair"))
    return found.select(name.alias("table_name"), F.col("id").alias("record_id"), field_name(F.col("field")).alias("field_name"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds_name, field_name, n_values, n_cut, share, mean_score): how often each source cuts each field; blank values do not count."""
    found = cut_values(text_values(spark, sf_dir)).where("NOT blank")
    rates = found.groupBy("ds_name", "field").agg(F.count("*").alias("n_values"), F.count("reason").alias("n_cut"), F.round(F.avg("score"), 4).alias("mean_score"))
    return rates.select("ds_name", field_name(F.col("field")).alias("field_name"), "n_values", "n_cut", F.round(F.col("n_cut") / F.col("n_values"), 6).alias("share"), "mean_score")
