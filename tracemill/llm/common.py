"""Words, marks, languages and sketches that several operators of this subpackage share.

A *word* is a longest run of letters or numbers in the lower-cased text after every mark ``<|...|>`` has become a
blank. Word and shingle identities are 64-bit hashes that are the same in every process.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import table

MARK = re.compile(r"<\|[^|]*\|>")
WORD = re.compile(r"[^\W_]+")

#: Numbers of the three text fields, used where a field name would be carried through shuffles.
FIELDS = ("chosen", "rejected", "response")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((MARK.sub(" ", text) if "<|" in text else text).lower())


class WordIds(dict):
    """word -> 64-bit id, with a bounded memory."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def ids_of(words: list[str], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words, in order."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].copy()
    for j in range(1, width):
        h *= _STEP
        h += ids[j : j + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def multipliers(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63 - 1, k, np.uint64) | np.uint64(1)


def minhash(hashes: np.ndarray, starts: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Signatures (len(starts), k) of uint32; every start begins a non-empty run."""
    out = np.empty((len(starts), len(mult)), np.uint32)
    for i, m in enumerate(mult):
        out[:, i] = np.minimum.reduceat(((hashes * m) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def blocks(items: Iterable, size_of, most: int) -> Iterator[list]:
    """Consecutive items in lists of at most ``most`` in size (one item at least), so that arrays stay small."""
    out, total = [], 0
    for x in items:
        n = size_of(x)
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out


class Sieve:
    """Lets pass the rows whose (field, id) may be wanted, so that the texts of others need not be shuffled.

    The bits are as many whatever the data: with more wanted rows more others pass, and joins on the key decide anyway.
    """

    BITS = 2**26

    def __init__(self, shared):
        self.shared = shared

    @staticmethod
    def places(ids: np.ndarray, field) -> np.ndarray:
        x = ids.astype(np.int64).view(np.uint64) * _STEP + np.asarray(field).astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= _MIX
        return (x >> np.uint64(38)).astype(np.int64)

    @classmethod
    def of(cls, wanted: DataFrame) -> "Sieve":
        """From rows (field, id); at most BITS / 64 words come to the driver."""
        def words(batches):
            for batch in batches:
                at = np.unique(cls.places(batch.column("id").to_numpy(zero_copy_only=False), batch.column("field").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

        made = wanted.select("field", "id").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(cls.BITS // 64, np.uint64)
        bits[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
        return cls(wanted.sparkSession.sparkContext.broadcast(bits))

    def has(self, ids: np.ndarray, field) -> np.ndarray:
        at = self.places(ids, field)
        return (self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def kept(self, batch):
        return batch.filter(pa.array(self.has(batch.column("id").to_numpy(zero_copy_only=False), batch.column("field").to_numpy(zero_copy_only=False))))


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, ds_name, question, text) of every chosen, rejected and response; ``field`` is the place in FIELDS.

    Re-delivered rows are kept: they repeat key and content, so operators drop them once their rows are small.
    """
    pairs = table(spark, sf_dir, "preference_pair")
    asked = F.coalesce(F.when(F.trim("question") != "", F.col("question")), F.when(F.trim("prompt") != "", F.col("prompt")))
    both = pairs.select("pair_id", "ds_name", asked.alias("question"), F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("chosen").alias("text")), F.struct(F.lit(1).alias("field"), F.col("rejected").alias("text")))).alias("v"))
    both = both.select(F.col("v.field").alias("field"), F.col("pair_id").alias("id"), "ds_name", "question", F.col("v.text").alias("text"))
    answers = table(spark, sf_dir, "sampled_response").select(F.lit(2).alias("field"), F.col("response_id").alias("id"), "ds_name", F.when(F.trim("question") != "", F.col("question")).alias("question"), F.col("response").alias("text"))
    return both.unionByName(answers)


def field_name(column) -> F.Column:
    return F.element_at(F.array(*(F.lit(x) for x in FIELDS)), column + 1)


# Frequent function words by which prose in these languages is told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was at by be this from or an are not which so than if but we i its only here there between both has have my your you no what how find more let would must cannot first after half many much who why when where while also into then".split(),
    "fr": "le la les de des du un une et est en que qui dans pour sur avec au aux par il on ce se sa son cette ne pas plus donc entre si près nous vous je quelle quel combien où vaut soit comme sont mais ou à été quelles quels quoi pourquoi qui serait était valait chaque reste aussi très sans sous dont cela ces leur tout quand".split(),
    "de": "der die das und ist in den von zu mit auf für ein eine im nicht dem des sich als auch es an aus bei nach wie man kann wir also zwischen genau wert wäre weil neben laut beträgt um wo welche wenn dann über unter ich sie ihre einer einem einen viel viele welcher welches welchen wer warum wann dann dass wird werden hat haben bleibt jede jeder jedes".split(),
    "es": "el la los las de del un una y es en que por para con al se su lo como más pero no entre si está hay cuál cuánto dónde según queda quedan cada o este esta sobre son vale sea nos usted mi tras qué quién cuáles cuántos cuántas cuánta cuándo cómo fuera sería sigue según desde hasta cuando donde también muy junto".split(),
}
CJK = re.compile(r"[㐀-鿿豈-﫿぀-ヿ가-힯]")
_BY_WORD: dict[str, list[tuple[str, float]]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list):
        _BY_WORD.setdefault(_w, []).append((_lang, 1.0))
for _w, _hits in _BY_WORD.items():
    _BY_WORD[_w] = [(x, 1.0 / len(_hits) ** 2) for x, _ in _hits]
_UMLAUT = {"ß": "de", "ä": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "œ": "fr", "ê": "fr", "è": "fr", "à": "fr", "ù": "fr", "î": "fr", "ô": "fr"}


def language_scores(text: str, words: list[str] | None = None) -> dict[str, float]:
    """Evidence for each language in plain text: function words, letters only one language has, and CJK letters as ``zh``."""
    score: dict[str, float] = {}
    for w in words if words is not None else WORD.findall(text.lower()):
        for lang, x in _BY_WORD.get(w, ()):
            score[lang] = score.get(lang, 0.0) + x
    if not text.isascii():
        low = text.lower()
        for letter, lang in _UMLAUT.items():
            if n := low.count(letter):
                score[lang] = score.get(lang, 0.0) + 0.5 * n
        if n := len(CJK.findall(text)):
            score["zh"] = score.get("zh", 0.0) + n / 3.0
    return score


def language_of(text: str, words: list[str] | None = None) -> str | None:
    """The language with most evidence, None where there is hardly any."""
    score = language_scores(text, words)
    if not score:
        return None
    best = max(sorted(score), key=lambda k: score[k])
    return best if score[best] >= 0.9 else None
