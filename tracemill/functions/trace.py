"""Tagged reasoning traces as columns: parsing, rendering and the tests on steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import present, strip, tokens


def mark(name: str) -> str:
    return f"<|{name}|>"


def _quoted(name: str) -> str:
    return rf"<\|{name}\|>"


def between(name: str) -> str:
    """Pattern of what stands between a start and the next end mark, over lines."""
    return rf"(?s){_quoted(name + '_start')}(.*?){_quoted(name + '_end')}"


#: The fields of a step.
STEP_FIELDS = ("name", "thought", "reflection")


def extract_reasoning(text: Column) -> Column:
    """What stands between the first start and the first end mark if the end follows the start, else the whole text; null gives ''."""
    start, end = mark("reasoning_start"), mark("reasoning_end")
    a, b = F.locate(start, text), F.locate(end, text)
    inside = F.substring(text, a + len(start), F.greatest(F.lit(0), b - a - len(start)))
    return F.coalesce(F.when((a > 0) & (b > a), inside).otherwise(text), F.lit(""))


def reasoning_blocks(text: Column) -> Column:
    """All stripped blocks between start and end marks; null gives no block."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(between("reasoning")), F.lit(1)), strip)


def tagged_answer(text: Column) -> Column:
    """The stripped text of the answer marks, null without them."""
    pattern = between("answer")
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def second_piece(text: Column) -> Column:
    """What follows the first answer start mark up to the next mark of the pair, stripped of blanks and then of brackets; null unless both marks occur."""
    both = F.contains(text, F.lit(mark("answer_start"))) & F.contains(text, F.lit(mark("answer_end")))
    after = F.get(F.split(text, _quoted("answer_start")), F.lit(1))
    piece = F.when(both, F.get(F.split(strip(after), _quoted("answer_end")), F.lit(0)))
    return F.regexp_replace(F.regexp_replace(strip(piece), r"^\(+|\(+$", ""), r"^\)+|\)+$", "")


def _field(segment: Column, name: str) -> Column:
    pattern = between(f"reasoning_step_{name}")
    return F.when(segment.rlike(pattern), strip(F.regexp_extract(segment, pattern, 1)))


def parse_steps(text: Column) -> Column:
    """array<struct<name, thought, reflection, raw>>; ``raw`` only where all three are missing or empty."""
    segments = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(between("reasoning_step")), F.lit(1))

    def step(segment: Column) -> Column:
        fields = [_field(segment, x) for x in STEP_FIELDS]
        raw = F.when(present(*fields).isNull(), strip(segment))
        return F.struct(*(f.alias(x) for f, x in zip(fields, STEP_FIELDS)), raw.alias("raw"))

    return F.transform(segments, step)


def step_to_text(step: Column) -> Column:
    """``[NAME] ...`` and so on, the present fields joined by a blank and a line end, else the raw text."""
    parts = [F.when(step[x] != "", F.concat(F.lit(f"[{x.upper()}] "), step[x])) for x in STEP_FIELDS]
    return F.coalesce(F.nullif(F.concat_ws(" \n", *parts), F.lit("")), step["raw"], F.lit(""))


def extract_steps(text: Column) -> Column:
    """Texts of the parsed steps, or of the lines that are not blank where none parse."""
    steps = F.transform(parse_steps(text), step_to_text)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    return F.when(F.size(steps) > 0, steps).otherwise(lines)


def single_step(text: Column) -> Column:
    """The first step of a completion: up to the end of reasoning, else of the step, else before 'proceed', else the first line."""

    def upto(name: str, keep: bool) -> Column:
        at = F.locate(mark(name), text)
        return F.when(at > 0, strip(F.substring(text, F.lit(1), at - 1 + (len(mark(name)) if keep else 0))))

    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    line = F.when(F.size(lines) > 1, strip(F.get(lines, F.lit(0)))).otherwise(strip(text))
    return F.coalesce(upto("reasoning_end", True), upto("reasoning_step_end", True), upto("reasoning_proceed", False), line)


def is_terminal(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(text, F.lit(mark("reasoning_end"))) | F.contains(low, F.lit("final answer")) | F.contains(low, F.lit("the answer is"))


def render_trace(steps: Column, answer: Column, step_mark: str = "") -> Column:
    """The tagged text of array<struct<name, thought, reflection>> and an answer; ``step_mark`` follows each step and the answer."""

    def field(step: Column, x: str) -> Column:
        tag = f"reasoning_step_{x}"
        return F.when(step[x].isNotNull(), F.concat(F.lit(mark(tag + "_start")), step[x], F.lit(mark(tag + "_end") + "\n"))).otherwise(F.lit(""))

    def one(step: Column) -> Column:
        return F.concat(F.lit(mark("reasoning_step_start") + "\n"), *(field(step, x) for x in STEP_FIELDS), F.lit(mark("reasoning_step_end") + step_mark + "\n"))

    body = F.array_join(F.transform(steps, one), mark("reasoning_proceed") + "\n")
    return F.concat(F.lit(mark("reasoning_start") + "\n"), body, F.lit(mark("reasoning_end") + "\nAnswer:\n" + mark("answer_start")), answer, F.lit(mark("answer_end") + step_mark))


def lengths(text: Column) -> Column:
    """struct<chars, tokens> of a text; null counts as empty."""
    return F.struct(F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.size(tokens(text)).alias("tokens"))


def truncated_prefix(text: Column, ratio: float) -> Column:
    """The first part of the words between single blanks, stripped."""
    words = F.split(text, " ")
    return strip(F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int")), " "))




def display_lines(text: Column) -> Column:
    """A trace as numbered lines for reading: name, thought and reflection of each step; '' without steps."""
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"   {label}: "), c))
    lines = lambda s, i: F.array_join(F.array(F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s["name"], F.lit(""))), part("thought", s["thought"]), part("reflection", s["reflection"])), "\n")
    return F.coalesce(F.array_join(F.transform(parse_steps(text), lines), "\n"), F.lit(""))
