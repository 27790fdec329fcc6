"""Problem 3: answers that do not serve their question.

Per value, in this order: ``empty``, ``copy`` (greedy string tiling of the answer by the question), ``refusal`` (a
grammar of inability, unwillingness, policy, missing input and referral in four languages and Chinese), ``truncated``
(the cases of problem 4: pushdown parser and closing words of ``endings``, and alignment with other values) and ``wrong_language`` (scripts and function words of the prose,
quotations left out, against the language asked for). A value has one defect at most; without a question only the
first, third and fourth apply. Null values are empty; re-delivered records count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import MARK, WORD, field_name, language_scores, text_values, words_of
from tracemill.llm.endings import cut_reason

INVISIBLE = re.compile(r"[\s​-‏⁠﻿­]+")
_LABEL = re.compile(r"(?i)\b(?:final )?(?:answer|response|réponse|respuesta|antwort|result)\s*[:：=]\s*$|[*_`#>|]+")
#: What data tools write for a missing value.
NOTHING = {"null", "none", "nan", "nil", "n/a", "na", "undefined", "#n/a", "<null>", "(empty)", "empty"}


_MANY = re.compile(r"(?:[\W_]*[^\W_]){41}")


def is_empty(text: str | None) -> bool:
    """Null, or nothing that could be an answer: blanks, marks, a label, signs of a missing value, lone punctuation."""
    if text is None:
        return True
    if "<|" not in text and _MANY.match(text):  # more letters and figures than any label or sign of a missing value has
        return False
    bare = INVISIBLE.sub(" ", MARK.sub(" ", text)).strip()
    bare = _LABEL.sub("", bare).strip() if len(bare) < 40 else bare
    if not bare or bare.lower() in NOTHING:
        return True
    return len(bare) <= 12 and not any(c.isalnum() for c in bare) and not re.search(r"[∞√πΔ°%$€]|[<>=≤≥+±∅]", bare)


def greedy_tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: maximal non-overlapping common runs (start in a, start in b, length), longest first."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    while True:
        best, found = least - 1, None
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in places.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, (i, j, k)
        if not found:
            return tiles
        i, j, k = found
        free_a[i : i + k] = [False] * k
        free_b[j : j + k] = [False] * k
        tiles.append(found)


#: Requests about the answer's form, which a copy may leave out.
_REQUEST = re.compile(r"(?i)[^.?!\n]*\b(?:french|german|spanish|english|chinese|français|allemand|espagnol|anglais|deutsch|französisch|spanisch|englisch|francés|alemán|español|inglés)\b[^.?!\n]*[.!]?\s*$")


def _names_a_language(question: str) -> bool:
    low = question.lower()
    return any(x in low for x in _NAMES)


@lru_cache(50_000)
def question_core(question: str) -> str:
    """The asked sentence: the first written line without a request for a language."""
    lines = [x for x in question.split("\n") if x.strip() and x.strip() != "<image>"]
    core = lines[0] if lines else question
    short = _REQUEST.sub("", core) if _names_a_language(core) else core
    return short if len(short) > 0.4 * len(core) else core


def is_copy(text: str, question: str | None, value_share: float = 0.75, question_share: float = 0.7) -> bool:
    """Nothing but the question: tiles cover the value, but for words in front, and most of the question."""
    if not question or len(text) > 1.6 * len(question) + (250 if "<|" in text else 60):
        return False
    asked_all, value = words_of(question), words_of(text)
    if not asked_all or not value or len(value) > len(asked_all) + 8:
        return False
    asked = words_of(question_core(question))
    if len(value) < 0.6 * len(asked) or sum((Counter(value) & Counter(asked_all)).values()) < 0.6 * min(len(value), len(asked)):
        return False
    if "".join(value) == "".join(asked) or "".join(value) == "".join(asked_all):
        return True
    tiles = greedy_tiles(value, asked_all)
    covered = sum(k for *_, k in tiles)
    if not tiles:
        return False
    first, last = min(i for i, _, _ in tiles), max(i + k for i, _, k in tiles)
    in_core = sum((Counter(value[first:last]) & Counter(asked)).values())
    # words in front introduce the question, words behind a whole question answer it
    behind = len(value) - last
    if behind and in_core >= 0.95 * len(asked) or behind > 2 or first > 5:
        return False
    return covered >= value_share * (len(value) - first) and in_core >= question_share * len(asked)


def _families(*parts: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in parts), re.I)


# The refusal grammar: who speaks, what is denied, and what the denied act is.
_EN_ACT = r"(?:answer|assist|help|solve|respond|reply|discuss|view|see|look|read(?:ing)?|judge|provide|comply|fulfil|complete|do|process|open|determine|tell|give|offer|comment|work)"
REFUSAL = _families(
    rf"\b(?:i|we)(?: am|'m|’m| are|'re)? (?:really |currently |simply )?(?:can ?not|can['’]t|cannot|could(?:n['’]t| not)|won['’]t|will not|must not|may not|unable to|not able to|not allowed to|not permitted to|not in a position to) (?:be able to )?(?:\w+ ){{0,2}}{_EN_ACT}",
    r"\b(?:i|we)(?:'m| am)? (?:have to|must|will|need to|would rather|['’]d rather|prefer to|choose to)? ?(?:respectfully |politely )?(?:decline|refuse|pass\b|skip (?:it|this)|abstain)",
    r"\b(?:i|we) (?:would|['’]d) (?:rather|prefer) not\b|\b(?:i|we) prefer not to\b|\bdo(?:n['’]t| not) feel (?:comfortable|able)\b|\bwould(?:n['’]t| not) be (?:appropriate|right|proper) for me\b",
    r"\b(?:beyond|outside|exceeds?|not within) (?:of )?(?:my|the scope of my|what i)\b.{0,20}(?:abilit|capabilit|competence|scope|knowledge|allowed|expertise|can do|may do)|\bwhere my (?:competence|knowledge|abilit\w+) ends?\b",
    r"\b(?:against|violates?|contrary to) my (?:polic|guideline|rule|instruction|principle)|\bmy (?:guidelines?|polic\w+|rules|instructions|training|programming) (?:prevents?|forbids?|prohibits?|do(?:es)?(?:n['’]t| not) (?:cover|allow|permit|include))",
    r"\bnot enough (?:information|data|context) (?:for me|to answer|to respond)|\bdo(?:n['’]t| not) have (?:access to|enough information|the ability)|\bno way (?:for me )?to (?:look|see|view|read|know|tell)|\b(?:image|picture|figure|file) .{0,30}(?:was|were|is) not (?:provided|attached|available|visible)",
    r"\b(?:request|query|question|topic) (?:denied|rejected|refused|declined)|\bis not supported\b|\bno (?:answer|solution|response|help|reply) (?:can be given |will come |is possible )?from (?:me|my side|us)\b|\bnothing to offer\b|\bno answer can be given\b",
    r"\b(?:please )?(?:ask|consult|contact|leave \w+ to) (?:a |an |your )?(?:human|qualified|teacher|expert|professional|specialist|doctor|lawyer)|\blet['’]s talk about something (?:else|other)|\bsomething i (?:won['’]t|will not|cannot|can['’]t|must not) (?:answer|discuss|do)",
    r"\b(?:i['’]m |i am )?(?:sorry|afraid|apologi[sz]e)\b.{0,40}\b(?:can ?not|can['’]t|unable|not able|won['’]t|must|have to)\b",
    # French
    r"\bje (?:ne|n['’]) ?(?:\w+ ){0,2}(?:peux|puis|suis|veux|souhaite|saurais|dispose|réponds?|traite)\w* (?:\w+ )?pas\b|\bje (?:préfère|souhaite) ne pas\b|\bje (?:dois|me vois obligé de) (?:refuser|décliner|passer)|\bje (?:refuse|décline)\b|\bil m['’]est impossible\b|\bje suis (?:incapable|dans l['’]impossibilité)",
    r"\bcontre mes (?:consignes|règles|principes)|\bne relève pas de mes\b|\b(?:au-delà|hors) de (?:mes|ma|ce que je)\b|\bdépasse mes\b|\baucune (?:réponse|solution|aide) de ma part\b|\b(?:mes|ma) (?:consignes|règles|formation) (?:ne |m['’])|\b(?:veuillez|merci de) (?:demander|consulter|vous adresser)\b.{0,30}\b(?:professeur|expert|humain|enseignant)|\bdemande (?:refusée|rejetée)|\bs['’]arrêtent? (?:mes|là)\b",
    # German
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|werde|will|möchte|mag|vermag)\b.{0,60}\b(?:nicht|nichts|keine?n?)\b|\b(?:kann|darf|möchte|werde) ich\b.{0,60}\b(?:nicht|nichts|keine?n?)\b|\bbin (?:ich )?(?:leider )?nicht in der lage\b|\bnicht in der lage\b|\bmuss ich (?:leider )?(?:ablehnen|passen|verweigern)|\bich (?:lehne|verweigere)\b",
    r"\b(?:verstößt|verstößen) gegen meine\b|\bgegen meine (?:vorgaben|regeln|richtlinien)|\bendet mein (?:wissen|können)|\bvon mir (?:kommt|gibt es) keine\b|\bübersteigt meine\b|\baußerhalb meine[rs]\b|\b(?:fragen|wenden) sie\b.{0,40}\b(?:lehrkraft|fachmann|fachperson|experten?|menschen)|\banfrage abgelehnt|\bleider (?:darf|kann|muss) ich\b",
    # Spanish
    r"\bno (?:puedo|podré|puedo|me es posible|estoy en condiciones|soy capaz|debo|quiero|voy a|tengo (?:la |el |una |ninguna )?(?:acceso|permiso|forma|posibilidad|manera|capacidad|autorización)|dispongo)\b|\bprefiero no\b|\b(?:debo|tengo que|me veo obligad[oa] a) (?:rechazar|declinar|pasar)|\b(?:rechazo|declino)\b|\bme resulta imposible\b|\bno me (?:corresponde|siento cómod[oa])",
    r"\b(?:en )?contra (?:de )?mis (?:normas|reglas|políticas|directrices)|\bfuera de mis (?:límites|capacidades|competencias)|\bmás allá de mis\b|\b(?:terminan|acaban|termina) (?:mis|mi) (?:conocimientos?|competencias?)|\bde mi parte no (?:habrá|hay)\b|\bconsulte a (?:un|una|su)\b|\bsolicitud (?:denegada|rechazada)|\bmis (?:normas|directrices|reglas) (?:me )?(?:impiden|prohíben|no)",
    # Chinese
    r"(?:我|本人)?(?:无法|不能|不便|不会|拒绝)(?:回答|协助|帮助|提供|查看|完成|处理|讨论)|超出(?:了)?我的|抱歉.{0,20}(?:无法|不能)",
)
_REAL_ANSWER = re.compile(r"\\boxed|(?i:\b(?:final answer|answer is|answer:|result:|réponse :|réponse est|respuesta:|respuesta es|antwort:|antwort lautet))|答案")


_FIGURES = re.compile(r"\d+(?:[.,]\d+)?")


_SENTENCES = re.compile(r"(?<=[.!?。！？])\s*")
#: A sentence that admits a difficulty and goes on to a figure does not decline.
_HEDGED = re.compile(r"(?i)\b(?:yet|but|still|however|though|nevertheless|mais|pourtant|cependant|toutefois|aber|doch|jedoch|dennoch|pero|sin embargo|aunque)\b.*\d|(?:但|不过).*\d", re.S)


def is_refusal(text: str, most_figures: int = 5, long: int = 60) -> bool:
    """A value that declines; one that goes on to an answer, or reckons, only words itself carefully.

    A value of more than ``long`` words has to decline in its first or last sentence: an inability that is admitted on
    the way belongs to an answer.
    """
    bare = MARK.sub(" ", text) if "<|" in text else text
    if next(islice(_FIGURES.finditer(bare), most_figures, None), None):  # a value that reckons
        return False
    if _REAL_ANSWER.search(bare.replace("Answer:", "", 1) if "<|" in text else bare):
        return False
    bare = bare.replace("’", "'")
    if not REFUSAL.search(bare):
        return False
    sentences = [s for s in _SENTENCES.split(bare) if s.strip()]
    said = [bool(REFUSAL.search(s)) for s in sentences]
    declines = [x and not _HEDGED.search(s) for s, x in zip(sentences, said)]
    if any(said) and not any(declines) or len(WORD.findall(bare)) > long and any(said) and not (declines[0] or declines[-1]):
        return False
    # sentences that do something else than refuse: figures in them belong to an answer
    return sum(len(re.findall(r"\d+", s)) for s, x in zip(sentences, said) if not x) < 2


_QUOTED = re.compile(r"\"[^\"\n]{0,400}\"|“[^”\n]{0,400}”|«[^»\n]{0,400}»|「[^」\n]{0,400}」|```.*?```", re.S)
#: Names of the languages in the languages.
_LANGUAGE_NAMES = {
    "en": r"english|anglais|englisch|inglés|英语",
    "fr": r"french|français|französisch|francés|法语",
    "de": r"german|allemand|deutsch|alemán|德语",
    "es": r"spanish|espagnol|spanisch|español|castellano|西班牙语",
    "zh": r"chinese|chinois|chinesisch|chino|中文|汉语",
}
_ASKS_FOR = {k: re.compile(rf"(?i)(?:\b(?:answer|respond|reply|write|répond\w*|rédige\w*|antwort\w*|schreib\w*|respond\w*|contest\w*|escrib\w*)\b|请用)[^.?!\n]{{0,30}}(?:{v})") for k, v in _LANGUAGE_NAMES.items()}


_NAMES = [x for v in _LANGUAGE_NAMES.values() for x in v.split("|")]


@lru_cache(50_000)
def asked_language(question: str) -> str | None:
    """The language a question asks for: the one it names, else its own."""
    if _names_a_language(question):
        for lang, pattern in _ASKS_FOR.items():
            if pattern.search(question):
                return lang
    score = language_scores(question_core(question))
    if not score:
        return None
    best = max(sorted(score), key=lambda k: score[k])
    return best if score[best] >= 0.7 and score[best] > 1.3 * max([0.0, *(v for k, v in score.items() if k != best)]) else None


def is_wrong_language(text: str, question: str, least: float = 2.0) -> bool:
    """The prose of the value, without quotations, is clearly in another language than asked for."""
    if len(text) < 12:
        return False
    asked = asked_language(question)
    if asked is None:
        return False
    prose = MARK.sub(" ", text) if "<|" in text else text
    if '"' in prose or "`" in prose or not prose.isascii():
        prose = _QUOTED.sub(" ", prose)
    # an answer that repeats its question first is judged by what follows
    core = question_core(question).strip()
    if len(core) > 15 and core in prose:
        prose = prose.replace(core, " ")
    score = language_scores(prose)
    if not score:
        return False
    best = max(sorted(score), key=lambda k: score[k])
    return best != asked and score[best] >= least and score[best] > 1.5 * score.get(asked, 0.0)


def defect_of(text: str | None, question: str | None, reason: str | None | bool = False) -> str | None:
    """The defect of a value; ``reason`` is what ``cut_reason`` says of it, if that is known."""
    if is_empty(text):
        return "empty"
    if question and is_copy(text, question):
        return "copy"
    if is_refusal(text):
        return "refusal"
    if cut_reason(text) if reason is False else reason:
        return "truncated"
    if question and is_wrong_language(text, question):
        return "wrong_language"
    return None


def flag_defects(values: DataFrame) -> DataFrame:
    """(field, id, defect) of the defective values of ``values`` (field, id, question, text); equal rows become one."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, d) for i, (t, q) in enumerate(zip(batch.column("text").to_pylist(), batch.column("question").to_pylist())) if (d := defect_of(t, q))]
            at = pa.array([i for i, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("field").take(at), batch.column("id").take(at), pa.array([d for _, d in found], pa.string())], ["field", "id", "defect"])

    return values.select("field", "id", "question", "text").mapInArrow(flag, "field int, id bigint, defect string").dropDuplicates(["field", "id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm.truncation import EARLY, cut_values

    # what only the alignment of problem 4 shows to be cut is truncated too, unless an earlier defect holds
    aligned = (F.col("reason") == EARLY) & (F.col("defect").isNull() | (F.col("defect") == "wrong_language"))
    found = cut_values(text_values(spark, sf_dir), defects=True).withColumn("defect", F.when(aligned, "truncated").otherwise(F.col("defect"))).where("defect IS NOT NULL")
    name = F.when(F.col("field") == 2, F.lit("sampled_response")).otherwise(F.lit("preference_pair"))
    return found.select(name.alias("table_name"), F.col("id").alias("record_id"), field_name(F.col("field")).alias("field_name"), "defect")
