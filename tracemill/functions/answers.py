"""Answers as columns: finding them in responses and bringing them to a common form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import SPACE, occurrences, strip, to_double

#: Triggers of a final answer, the first one that occurs is used.
TRIGGERS = ("Final answer:", "Final Answer:", "答案:")


def last_piece(text: Column, mark: Column) -> Column:
    """What follows the last occurrence of a mark that may differ by row."""
    return F.call_function("substring_index", text, mark, F.lit(-1))


def parse_final_answer(text: Column) -> Column:
    """struct<rationale, answer>: the text split at its last trigger, null unless it is well formed.

    Well formed: one or two triggers, two line ends at least, a rationale, and an answer of one line.
    """
    trigger = F.coalesce(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in TRIGGERS))
    count = reduce(lambda rest, t: F.when(trigger == t, occurrences(text, t)).otherwise(rest), TRIGGERS, F.lit(0))
    answer = strip(last_piece(text, trigger))
    rationale = strip(F.substring(text, F.lit(1), F.length(text) - F.length(last_piece(text, trigger)) - F.length(trigger)))
    good = trigger.isNotNull() & (count <= 2) & (occurrences(text, "\n") >= 2) & (rationale != "") & ~F.contains(answer, F.lit("\n"))
    return F.when(good, F.struct(rationale.alias("rationale"), answer.alias("answer")))


def plain_option_letter(answer: Column, options: Column) -> Column:
    """As ``option_letter``, without the forms ``X.`` and ``(X)``: one character, a leading letter, an option's text, or the prediction."""
    p = strip(answer)
    first = F.substring(p, 1, 1)
    held = F.filter(F.map_entries(options), lambda e: F.contains(p, e["value"]))
    named = F.when(F.array_contains(F.map_keys(options), first), first).when(F.size(held) > 0, F.get(held, F.lit(0))["key"]).otherwise(p)
    return F.when(F.length(p) <= 1, p).otherwise(named)


_QUICK = r"(?i)(Final answer:|Answer:)\s*([^\n]*)"


def quick_extract(text: Column) -> Column:
    """What follows the first answer label in its line, the whole text without one."""
    return F.when(text.rlike(_QUICK), F.regexp_extract(text, _QUICK, 2)).otherwise(text)


def normalize_answer(text: Column) -> Column:
    """Lower case, without white space, of letters, digits and . - / % only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9.\-/%]", "")


def option_letter(answer: Column, options: Column) -> Column:
    """The option a prediction names; ``options`` is map<letter, text>.

    A single character stands for itself; then a leading letter of the options, then the first option whose text the
    prediction holds, then ``X.`` and ``(X)``; else the prediction as it is.
    """
    p = strip(answer)
    first = F.substring(p, 1, 1)
    letters = F.map_keys(options)
    held = F.filter(F.map_entries(options), lambda e: F.contains(p, e["value"]))
    plain = F.when(F.substring(p, 2, 1) == ".", first).otherwise(p)
    bracket = F.when((F.length(plain) > 1) & (F.substring(plain, 1, 1) == "(") & (F.substring(plain, 3, 1) == ")"), F.substring(plain, 2, 1)).otherwise(plain)
    return F.when(F.length(p) == 1, p).when((F.length(p) > 1) & F.array_contains(letters, first), first).when((F.length(p) > 1) & (F.size(held) > 0), F.get(held, F.lit(0))["key"]).otherwise(bracket)


def choice_letter(answer: Column, letters: str = "ABCDEFGHIJKLMN") -> Column:
    """A letter of ``letters`` that a prediction states alone, before a sign or in brackets; null where it states none."""
    p = F.upper(strip(F.regexp_replace(strip(answer), r"^\*+|\*+$", "")))
    return F.when(F.length(p) == 1, p).when(p.rlike(rf"^[{letters}][^\p{{L}}]"), F.substring(p, 1, 1)).when(p.rlike(rf"^\([{letters}]\)"), F.substring(p, 2, 1))


#: Patterns of numbers with thousands separators, in scientific notation, and plain ones.
_COMMAS, _SCIENTIFIC, _PLAIN = r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"


def numbers_by_kind(text: Column) -> Column:
    """struct<grouped, scientific, plain>: numbers with thousands separators, with exponents, and plain ones."""
    return F.struct(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(n) for n, p in (("grouped", _COMMAS), ("scientific", _SCIENTIFIC), ("plain", _PLAIN))))


def extract_numbers(text: Column) -> Column:
    """All numbers: those with thousands separators first, then scientific, then plain ones."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (_COMMAS, _SCIENTIFIC, _PLAIN)))


def normalize_open(text: Column) -> Column:
    """array<struct<s, f>>: a number rounded to two places as ``f``, else the lower-cased text as ``s``; one letter gets a blank on either side."""
    bare = strip(text)
    number = to_double(F.regexp_replace(bare, ",", ""))
    low = F.lower(bare)
    entry = lambda s, f: F.struct(s.alias("s"), f.alias("f"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
    one = F.array(entry(F.concat(F.lit(" "), low), zero), entry(F.concat(low, F.lit(" ")), zero))
    return F.when(number.isNotNull(), F.array(entry(none, F.round(number, 2)))).when(F.length(low) == 1, one).otherwise(F.array(entry(low, zero)))


#: Words behind which the key part of a sentence stands; '=' counts in the last line only.
KEY_WORDS = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ")


def key_parts(text: Column) -> Column:
    """The shortest part behind a key word of each line that has one; the whole text where no line has."""
    body = F.lower(F.regexp_replace(strip(text), r"^\.+|\.+$", ""))
    lines = F.split(body, "\n")

    def part(line: Column, i: Column) -> Column:
        found = [F.when(F.contains(line, F.lit(w)), strip(F.substring_index(line, w, -1))) for w in KEY_WORDS]
        found.append(F.when(F.contains(line, F.lit("=")) & (i == F.size(lines) - 1), strip(F.substring_index(line, "=", -1))))
        tails = F.filter(F.array(*found), lambda x: x.isNotNull() & (x != ""))
        best = F.array_min(F.transform(tails, lambda x, k: F.struct(F.length(x).alias("n"), k.alias("k"), x.alias("x"))))
        return best["x"]

    parts = F.filter(F.transform(lines, part), lambda x: x.isNotNull() & ~x.isin(":", ",", ".", "!", "?", ";", "'"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(body))


def parse_open(text: Column) -> Column:
    """Distinct normalised forms of the key parts and of the numbers in them."""
    parts = key_parts(text)
    every = F.concat(parts, F.flatten(F.transform(parts, extract_numbers)))
    return F.array_distinct(F.flatten(F.transform(every, normalize_open)))


def eval_open(predicted: Column, gold: Column) -> Column:
    """Whether a normalised prediction holds a gold text, or equals a gold number."""
    answers = F.flatten(F.transform(gold, normalize_open))
    return F.exists(predicted, lambda p: F.exists(answers, lambda g: F.coalesce(F.contains(p["s"], g["s"]), F.lit(False)) | F.coalesce(p["f"] == g["f"], F.lit(False))))


def normalize_extracted(extraction: Column, choices: Column, question_type: Column, answer_type: Column, precision: Column) -> Column:
    """An extracted answer in the form its question asks for.

    Multiple choice: the text of a bracketed or lone letter, else the choice of least edit distance (the first of
    equals); integers and floats: truncated, or rounded to ``precision`` places, null if they are no numbers.
    """
    from tracemill.functions.scores import closest_choice

    bare = strip(extraction)
    letter = F.upper(F.regexp_extract(bare, r"\(([a-zA-Z])\)", 1))
    shown = F.when(letter != "", letter).otherwise(bare)
    place = F.when(shown.rlike("^[A-Z]$"), F.ascii(shown) - 65)
    chosen = F.coalesce(F.when(place < F.size(choices), F.get(choices, place)), closest_choice(F.coalesce(shown, F.lit("")), choices))
    number = to_double(extraction)
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint").cast("string")
    rounded = F.format_string("%s", F.round(number * F.pow(F.lit(10.0), precision)) / F.pow(F.lit(10.0), precision))
    return F.when(question_type == "multi_choice", chosen).when(answer_type == "integer", whole).when(answer_type == "float", rounded).otherwise(extraction)


def is_consistent(verdict: Column) -> Column:
    """True or false for a verdict whose first word says yes or no, null for any other."""
    word = F.lower(F.regexp_replace(F.get(F.split(strip(verdict), rf"{SPACE}+"), F.lit(0)), r"^\.+|\.+$", ""))
    return F.when(word == "yes", True).when(word == "no", False)


def fix_answer(response: Column, predicted: Column, gold: Column) -> Column:
    """The response with its last mention of the prediction replaced by the gold answer where the prediction holds it."""
    p, g = F.lower(predicted), F.lower(gold)
    bare = lambda x: F.replace(F.regexp_replace(x, r"^\.+|\.+$", ""), F.lit(","), F.lit(""))
    holds = F.contains(p, g) | F.contains(bare(p), bare(g))
    tail = last_piece(response, predicted)
    head = F.substring(response, F.lit(1), F.length(response) - F.length(tail) - F.length(predicted))
    fixed = strip(F.regexp_replace(strip(F.concat(head, gold, tail)), r"^\*+|\*+$", ""))
    whole = F.when(holds & (predicted != "") & F.contains(response, predicted), fixed).otherwise(response)
    # '**Final' in the last line loses its stars
    last = F.substring_index(whole, "\n", -1)
    other = F.substring(whole, F.lit(1), F.length(whole) - F.length(last))
    return F.when(F.contains(whole, F.lit("\n")) & F.contains(last, F.lit("**Final")), strip(F.concat(other, F.replace(last, F.lit("**Final"), F.lit("Final"))))).otherwise(whole)


# Fixed values of the answer normaliser: spelt-out numbers, articles, and signs in the order they are treated.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
SIGNS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
# Contractions written without an apostrophe.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's",
    "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't",
    "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd",
    "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't",
    "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}


def evalai_normalize(text: Column) -> Column:
    """The answer form of vote-scored question answering.

    Signs next to a blank go, others become blanks, unless two digits have a comma between them: then all go. A full
    stop goes unless a digit follows; numbers in words become digits, articles go, contractions get their apostrophe.
    """
    t = strip(F.regexp_replace(F.replace(F.regexp_replace(F.lower(text), "[,?]", ""), F.lit("'s"), F.lit(" 's")), r"[\n\t]", " "))
    grouped = t.rlike(r"\d,+\d")

    def drop(out: Column, sign: str) -> Column:
        beside = F.contains(t, F.lit(sign + " ")) | F.contains(t, F.lit(" " + sign)) | grouped
        # the text so far occurs once, or the expression would double with every sign
        return F.replace(out, F.lit(sign), F.when(beside, F.lit("")).otherwise(F.lit(" ")))

    out = reduce(drop, SIGNS, t)
    out = F.regexp_replace(out, r"\.(?!\d)", "")
    words = F.filter(F.split(F.lower(out), rf"{SPACE}+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    table = F.create_map(*(F.lit(x) for kv in (NUMBER_WORDS | CONTRACTIONS).items() for x in kv))
    spelt = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(spelt, " ")
