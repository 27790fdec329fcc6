"""Prompt templates, chat messages and label masks as columns over array<struct<role, text>> conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


@dataclass(frozen=True)
class Template:
    """How a conversation is written: the text around roles and messages in one of the separator styles.

    ``first`` and ``second`` end the messages at even and odd places (styles with one separator use ``first``).
    """

    style: str
    system: str = "{system}"
    message: str = "You are a helpful assistant."
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    first: str = "\n"
    second: str = ""
    round_from: int = 0


#: Styles as (text behind a role with a message, text behind a role that waits for one).
_SIMPLE = {
    "add_colon_single": (": ", ":"),
    "add_colon_space_single": (": ", ": "),
    "add_new_line_single": ("\n", "\n"),
    "no_colon_single": ("", ""),
    "robin": (":\n", ":\n"),
    "falcon_chat": (": ", ":"),
    "mpt": ("", ""),
    "add_colon_two": (": ", ":"),
    "no_colon_two": ("", ""),
    "message_colon_two": (": ", ":"),
    "chatml": ("\n", "\n"),
    "chatglm3": ("\n ", ""),
    "colon_line_two": (":", ":"),
    "dolly": (":\n", ":\n"),
    "phoenix": (": <s>", ": <s>"),
    "rwkv": (": ", ":"),
    "chatglm": ("：", "："),
}
_TWO = {"add_colon_two", "no_colon_two", "message_colon_two", "colon_line_two", "dolly", "llama2"}
STYLES = (*_SIMPLE, "llama2")

#: The five registered templates, with a neutral system message.
TEMPLATES = {
    "bilingual_colon": Template("message_colon_two", "", "", ("<human>", "<bot>"), " ", "</s>"),
    "Hermes-2": Template("mpt", "<|im_start|>system\n{system}", roles=("<|im_start|>user\n", "<|im_start|>assistant\n"), first="<|im_end|>"),
    "chat_im": Template("mpt", "<|im_start|>system\n{system}", roles=("<|im_start|>user\n", "<|im_start|>assistant\n"), first="<|im_end|>"),
    "phi3-chat": Template("mpt", "<|system|>\n{system}", roles=("<|user|>\n", "<|assistant|>\n"), first="<|end|>"),
    "chat_im_line": Template("mpt", "<|im_start|>system\n{system}", roles=("<|im_start|>user\n", "<|im_start|>assistant\n"), first="<|im_end|>\n"),
}


def render(turns: Column, template: Template) -> Column:
    """The prompt of array<struct<role, text>> turns; roles are USER and ASSISTANT by turns, an empty or null text waits for its message."""
    t, style = template, template.style
    system = t.system.format(system=t.message)
    role = lambda i: F.when(i % 2 == 0, F.lit(t.roles[0])).otherwise(F.lit(t.roles[1]))
    sep = lambda i: F.when(i % 2 == 0, F.lit(t.first)).otherwise(F.lit(t.second)) if style in _TWO else F.lit(t.first)
    said = lambda m: m["text"].isNotNull() & (m["text"] != "")
    if style == "llama2":
        start = system if t.message else "[INST] "
        full = lambda m, i: F.when(i == 0, F.concat(m["text"], F.lit(" "))).otherwise(F.concat(role(i), F.lit(" "), m["text"], sep(i)))
        body = F.transform(turns, lambda m, i: F.when(said(m), full(m, i)).otherwise(role(i)))
        return F.concat(F.lit(start), F.array_join(body, ""))
    with_text, waiting = _SIMPLE[style]
    start = {
        "no_colon_single": system, "no_colon_two": system, "rwkv": system, "colon_line_two": system, "dolly": system, "phoenix": system,
        "message_colon_two": t.message + t.first,
        "chatml": system + t.first + "\n" if system else "",
        "chatglm": system + t.first if system else "",
        "chatglm3": system if t.message else "",
        "add_new_line_single": system + t.first if system else "",
        "falcon_chat": system + t.first if t.message else "",
    }.get(style, system + t.first)
    text = lambda m: F.replace(F.replace(m["text"], F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")) if style == "rwkv" else m["text"]
    end = {
        "rwkv": lambda i: F.lit("\n\n"),
        "chatml": lambda i: F.lit(t.first + "\n"),
        "chatglm3": lambda i: F.lit(""),
        "colon_line_two": lambda i: F.concat(sep(i), F.lit("\n")),
        "dolly": lambda i: F.concat(sep(i), F.when(i % 2 == 1, F.lit("\n\n")).otherwise(F.lit(""))),
        "phoenix": lambda i: F.lit("</s>"),
    }.get(style, sep)
    lead = lambda i: F.when(i % 2 == 0, F.concat(F.lit("[Round "), F.floor(i / 2).cast("int") + t.round_from, F.lit("]" + t.first))).otherwise(F.lit("")) if style == "chatglm" else F.lit("")
    body = F.transform(turns, lambda m, i: F.concat(lead(i), F.when(said(m), F.concat(role(i), F.lit(with_text), text(m), end(i))).otherwise(F.concat(role(i), F.lit(waiting)))))
    return F.concat(F.lit(start), F.array_join(body, ""))


def chat_messages(turns: Column, system: str) -> Column:
    """array<struct<role, content>> in the form of chat interfaces: the system message, then user and assistant by turns."""
    body = F.transform(turns, lambda m, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m["text"].alias("content")))
    said = F.filter(body, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), said)


def without_system(conversation: Column, role: str = "sender") -> Column:
    """The conversation without a leading system turn."""
    return F.filter(conversation, lambda m, i: ~((i == 0) & F.coalesce(m[role] == "system", F.lit(False))))


def turn_pairs(turns: Column) -> Column:
    """array<struct<user, bot>> of turns that follow each other; an answer that is missing is null."""
    n = F.ceil(F.size(turns) / 2).cast("int")
    pair = lambda k: F.struct(F.get(turns, 2 * k)["text"].alias("user"), F.get(turns, 2 * k + 1)["text"].alias("bot"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<struct<user:string,bot:string>>"))


def frame_tags(count: Column, form: str = "Frame-{}: <image>\n") -> Column:
    """One tag per video frame, counted from 1; the other form in use is ``Frame{}: <image>``."""
    before, after = form.split("{}")
    return F.when(count < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit(before), i.cast("string"), F.lit(after))), ""))


def expand_image_tokens(text: Column, tiles: Column, per_tile: int) -> Column:
    """Every <image> replaced, in order, by its tiles' context tokens between image marks."""
    parts = F.split(text, "<image>")
    image = lambda i: F.concat(F.lit("<img>"), F.repeat(F.lit("<IMG_CONTEXT>"), F.coalesce(F.get(tiles, i), F.lit(0)) * per_tile), F.lit("</img>"))
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < last, F.concat(p, image(i))).otherwise(p)), "")


def image_tokens(size: int = 448, patch: int = 14, ratio: float = 0.5) -> int:
    """Context tokens of one tile."""
    return int((size // patch) ** 2 * ratio**2)


def mask_labels(segments: Column, most: int | None = None) -> Column:
    """Labels of array<struct<role, ids>>: everything ignored but what the assistant says, without its header and last token.

    The header is the first token of a segment; ``most`` truncates.
    """
    ignored = lambda n: F.array_repeat(F.lit(IGNORED), n)
    spoken = lambda s: F.concat(ignored(F.least(F.size(s["ids"]), F.lit(1))), F.slice(s["ids"], F.lit(2), F.greatest(F.lit(0), F.size(s["ids"]) - 2)), ignored(F.greatest(F.lit(0), F.least(F.size(s["ids"]) - 1, F.lit(1)))))
    labels = F.flatten(F.transform(segments, lambda s: F.when(s["role"] == "gpt", spoken(s)).otherwise(ignored(F.size(s["ids"])))))
    return F.slice(labels, 1, most) if most else labels


def active_share(labels: Column) -> Column:
    """Share of labels that are not ignored, null for none."""
    return F.size(F.filter(labels, lambda x: x != IGNORED)) / F.when(F.size(labels) > 0, F.size(labels))


def padded(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(values))))
