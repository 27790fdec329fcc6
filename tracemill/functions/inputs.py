"""Questions as models get them, and the lesser readers of what models answer."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scores import DIMENSIONS
from tracemill.functions.text import SPACE, strip, to_double
from tracemill.session import cut

PLACEHOLDER = "<image>"


def without_instructions(question: Column, instructions: tuple[str, ...]) -> Column:
    """The question without these endings, tried in order, each at most once."""

    def drop(q: Column, ending: str) -> Column:
        return F.when(F.endswith(q, F.lit(ending)), strip(F.substring(q, F.lit(1), F.length(q) - len(ending)))).otherwise(q)

    return reduce(drop, instructions, question)


def with_placeholder(question: Column) -> Column:
    """One image placeholder goes to the front, in its own line; more of them stay where they are."""
    n = (F.length(question) - F.length(F.replace(question, F.lit(PLACEHOLDER), F.lit("")))) / len(PLACEHOLDER)
    bare = F.replace(F.replace(question, F.lit(PLACEHOLDER + "\n"), F.lit("")), F.lit(PLACEHOLDER), F.lit(""))
    return F.when(n <= 1, F.concat(F.lit(PLACEHOLDER + "\n"), bare)).otherwise(question)


def choice_lines(choices: Column) -> Column:
    """``A. first`` and so on, a line each; '' for none."""
    return F.coalesce(F.array_join(F.transform(choices, lambda c, i: F.concat(F.chr((i + 65).cast("int")), F.lit(". "), c)), "\n"), F.lit(""))


def options_map(choices: Column) -> Column:
    return F.map_from_arrays(F.transform(choices, lambda c, i: F.chr((i + 65).cast("int"))), choices)


def asked(question: Column, choices: Column, hint: Column, prompt: str) -> Column:
    """Hint, question, choices and prompt, each in its own lines."""
    return F.concat(F.coalesce(F.concat(hint, F.lit("\n")), F.lit("")), question, F.when(F.size(choices) > 0, F.concat(F.lit("\n"), choice_lines(choices))).otherwise(F.lit("")), F.lit("\n" + prompt))


def by_name(name: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The text of the first rule whose word the name holds."""
    return F.coalesce(*(F.when(F.contains(name, F.lit(w)), F.lit(t)) for w, t in rules), F.lit(default))


def split_labels(value: Column, token: str = "<|split_token|>") -> Column:
    """struct<text, labels> of a value that carries its labels behind a split token."""
    parts = F.split(value, token.replace("|", r"\|"))
    return F.struct(F.get(parts, F.lit(0)).alias("text"), F.get(parts, F.lit(1)).alias("labels"))


def modality(images: Column, video: Column) -> Column:
    """multi_image, image, video or text, by what a record carries."""
    n = F.coalesce(F.size(F.filter(images, lambda x: x.isNotNull() & (x != ""))), F.lit(0))
    return F.when(n > 1, "multi_image").when(n == 1, "image").when(F.coalesce(video, F.lit("")) != "", "video").otherwise("text")


def exported_answer(answer: Column) -> Column:
    """Lower case, without full stops at the end."""
    return F.lower(F.regexp_replace(answer, r"\.+$", ""))


#: Where the phrase trimmer cuts, in order; the part behind counts, before for the last.
_CUTS = ("is ", "are ", "a ", "an ", "the ")


def trimmed_phrase(response: Column) -> Column:
    """The short phrase of a sentence: up to the first . , or !, then the second piece at each of some words."""
    out = F.lower(F.regexp_extract(strip(response), r"^([^.,!]*)", 1))
    for word in _CUTS:
        out = F.coalesce(F.get(F.split(out, word), F.lit(1)), out)
    return strip(F.get(F.split(out, " of"), F.lit(0)))


def loose_format(prediction: Column, gold: Column) -> Column:
    """If the gold answer is a letter A to J: the prediction without brackets, or its first letter if that is one."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(prediction), r"^\(+|\(+$", ""), r"^\)+|\)+$", ""))
    letter = F.substring(bare, 1, 1)
    return F.when(gold.rlike("^[A-J]$"), F.when((F.length(bare) > 1) & letter.rlike("[A-J]"), letter).otherwise(bare)).otherwise(prediction)


def multi_choice_index(response: Column, choices: Column, key: Column) -> Column:
    """The choice letter a response names last: in brackets, else between blanks, else by its text in a response of more than five words.

    Where none is named, a letter by the hash of ``key`` stands for the random one.
    """
    body = F.concat(F.lit(" "), reduce(lambda t, ch: F.regexp_replace(t, f"^[{ch}]+|[{ch}]+$", ""), (",", ".", "!", "?", ";", ":", "'"), response), F.lit(" "))
    letters = F.transform(choices, lambda c, i: F.chr((i + 65).cast("int")))

    def last(text: Column, needles: Column) -> Column:
        placed = F.transform(needles, lambda n, i: F.struct((F.length(text) - F.length(F.call_function("substring_index", text, n, F.lit(-1)))).alias("at"), (-i).alias("i")))
        named = F.filter(F.transform(F.arrays_zip(placed.alias("p"), needles.alias("n")), lambda z: F.struct(z["p"]["at"].alias("at"), z["p"]["i"].alias("i"), z["n"].alias("n"))), lambda z: F.contains(text, z["n"]))
        return F.chr((F.lit(65) - F.array_max(named)["i"]).cast("int"))

    brackets = last(body, F.transform(letters, lambda x: F.concat(F.lit("("), x, F.lit(")"))))
    blanks = last(body, F.transform(letters, lambda x: F.concat(F.lit(" "), x, F.lit(" "))))
    long = F.size(F.filter(F.split(body, rf"{SPACE}+"), lambda w: w != "")) > 5
    texts = F.when(long, last(F.lower(body), F.transform(choices, lambda c: F.lower(c))))
    drawn = F.chr((F.pmod(F.xxhash64(key), F.size(choices)) + 65).cast("int"))
    return F.coalesce(brackets, blanks, texts, F.when(F.size(choices) > 0, drawn))


# Words by which questions about quantities are told, and spelt-out numbers.
QUANTITY_WORDS = (
    "most", "least", "fewest", "more", "less", "fewer", "largest", "smallest", "greatest", "larger", "smaller", "greater", "highest", "lowest",
    "higher", "lower", "increase", "decrease", "minimum", "maximum", "max", "min", "mean", "average", "median", "total", "sum", "add", "subtract",
    "difference", "quotient", "gap", "half", "double", "twice", "triple", "square", "cube", "root", "approximate", "approximation", "triangle",
    "rectangle", "circle", "sphere", "cylinder", "cone", "pyramid", "multiply", "divide", "percentage", "percent", "ratio", "proportion", "fraction",
    "rate",
)
NUMERALS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million", "billion",
)


def text_traits(text: Column) -> Column:
    """struct<digit, number_word, quantity_word, bool_word, integer, decimal> of a text."""
    words = F.regexp_extract_all(text, F.lit(r"\b\w+\b"), F.lit(0))
    bare = strip(text)
    digit = text.rlike(r"\d")
    return F.struct(
        digit.alias("digit"), (digit | F.exists(words, lambda w: F.lower(w).isin(*NUMERALS))).alias("number_word"), F.exists(words, lambda w: w.isin(*QUANTITY_WORDS)).alias("quantity_word"),
        text.rlike("^(?:[Yy]es|[Nn]o|[Tt]rue|[Ff]alse|YES|NO|TRUE|FALSE)$").alias("bool_word"), F.regexp_replace(bare, r"\.0+$", "").rlike(r"^[+-]?\d+$").alias("integer"), (F.contains(text, F.lit(".")) & to_double(text).isNotNull()).alias("decimal"),
    )


def extracted(response: Column, choices: Column, question_type: Column, answer_type: Column) -> Column:
    """An answer that needs no model: a choice word for word, a whole number, a number, or what follows an answer label; null where a provider has to be asked."""
    label = r"(?i)(Final answer:|Answer:)\s*([^\n]*)"
    bare = strip(response)
    whole = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("bigint").cast("string"))
    return F.when(response == "", "").when((question_type == "multi_choice") & F.array_contains(choices, response), response).when((answer_type == "integer") & whole.isNotNull(), whole).when((answer_type == "float") & to_double(response).isNotNull(), bare).when(response.rlike(label), F.regexp_extract(response, label, 2))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements at the beginning of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def messages_prompt(messages: Column, meta: str, prefix: Column) -> Column:
    """ChatML text of array<struct<role, content>> that ends in the assistant's header and the beginning of its answer."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    own = F.when((F.size(messages) > 0) & (F.get(messages, F.lit(0))["role"] != "system"), F.lit(f"<|im_start|>system\n{meta}<|im_end|>\n")).otherwise(F.lit(""))
    return F.concat(own, F.array_join(F.transform(messages, one), ""), F.lit("<|im_start|>assistant\n"), F.coalesce(prefix, F.lit("")))


def reward_dimensions(text: str | None) -> tuple[str, ...]:
    """Names of dimensions from JSON: a list, or an object with one under a usual key; the default ones without a text."""
    if not text:
        return DIMENSIONS
    value = json.loads(text)
    if isinstance(value, dict):
        value = next((value[k] for k in ("criteria", "dimensions", "reward_dimensions") if isinstance(value.get(k), list)), None)
    if not isinstance(value, list):
        raise ValueError("neither a list nor an object that holds one")
    return tuple(str(x) for x in value)


def ancestor_paths(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, node, path) with the nodes from the root to each node; a parent that is no node of the tree is not in the path.

    Pointer doubling: each round joins a path with that of the node it hangs on, so rounds grow with the logarithm of the
    depth. A node whose ancestors form a circle has no root, and its path is null.
    """
    base = nodes.select(tree, node, parent)
    known = base.select(F.col(tree).alias("t"), F.col(node).alias("n"))
    walk = base.join(known, (F.col(tree) == F.col("t")) & (F.col(parent) == F.col("n")), "left").select(tree, node, F.array(node).alias("path"), F.col("n").alias("at"))
    walk, rounds = cut(walk), 0
    # as many rounds as the size of the largest tree can need
    largest = walk.groupBy(tree).count().agg(F.max("count")).first()[0] or 0
    while rounds < largest.bit_length() and not walk.where(F.col("at").isNotNull()).isEmpty():
        up = walk.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col("path").alias("above"), F.col("at").alias("next"))
        walk = walk.join(up, (F.col(tree) == F.col("t")) & (F.col("at") == F.col("n")), "left")
        walk = cut(walk.select(tree, node, F.when(F.col("n").isNotNull(), F.concat("above", "path")).otherwise(F.col("path")).alias("path"), F.col("next").alias("at")))
        rounds += 1
    return walk.select(tree, node, F.when(F.col("at").isNull(), F.col("path")).alias("path"))


def gathered(df_columns: list[str], prefix: str = "image_", most: int = 7) -> Column:
    """array<string> of the columns ``image_1`` to ``image_7`` that a table has, without nulls, in order."""
    there = [F.col(f"{prefix}{k}") for k in range(1, most + 1) if f"{prefix}{k}" in df_columns]
    return F.filter(F.array(*there), lambda x: x.isNotNull()) if there else F.array().cast("array<string>")


def image_paths(text: Column) -> Column:
    """The paths of ``<img='...'>`` marks in a text, in order."""
    return F.regexp_extract_all(text, F.lit("<img='(.*?)'>"), F.lit(1))


def frame_number(name: Column) -> Column:
    """The number in front of ``.jpg``, -1 without one."""
    return F.coalesce(F.when(F.regexp_extract(name, r"_(\d+).jpg$", 1) != "", F.regexp_extract(name, r"_(\d+).jpg$", 1)).cast("int"), F.lit(-1))


def is_url(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://")) | F.startswith(text, F.lit("data:")), F.lit(False))


def continued(prefix: Column, continuation: Column) -> Column:
    """A response begun with a prefix and carried on by a model; null where nothing was carried on."""
    return F.concat(prefix, continuation)


def extraction_prompt(demo: str, query: Column, response: Column, suffix: str = "Extracted answer: ") -> Column:
    """The prompt that asks a model for the answer inside a response."""
    return F.concat(F.lit(demo + "\n\n"), query, F.lit("\n\n"), F.coalesce(response, F.lit("")), F.lit("\n\n" + suffix))


def wanted_images(images: Column, many: bool) -> Column:
    """Whether a record has more than one image, or (``many`` false) at most one; null lists have none."""
    return (F.coalesce(F.size(images), F.lit(0)) > 1) == F.lit(many)
