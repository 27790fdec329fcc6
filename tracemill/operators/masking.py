"""Training labels: which tokens of a conversation count, by any tokenizer.

A conversation becomes pieces of text, each either supervised or not, that together are its prompt. Pieces are encoded
one by one; where they do not make up the tokens of the whole prompt (a tokenizer merged something across a border), no
label can be trusted and all are ignored. The segment style has no such check, as its segments are encoded apart in
training too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.prompts import IGNORED

IMAGE = "<image>"
STYLES = ("segments", "generic", "chat", "strict_chat")
Piece = tuple[str, bool]


class Tokenizer(Protocol):
    """A provider of token ids; ``bos`` opens every text (or is None), ``pad`` fills up."""

    bos: int | None
    pad: int

    def encode(self, text: str) -> list[int]: ...


class WordTokenizer:
    """Marks, words and single white-space characters as tokens, ids by hash: a stand-in that needs no vocabulary."""

    TOKEN = re.compile(r"<\|[^|<>]*\|>|[^ \t\n\r\f\v<]+|[< \t\n\r\f\v]")

    def __init__(self, size: int = 30_000, bos: int | None = None, pad: int = 0):
        self.size, self.bos, self.pad = size, bos, pad

    def encode(self, text: str) -> list[int]:
        return [1 + int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % self.size for t in self.TOKEN.findall(text)]


class FileTokenizer:
    """A byte-pair vocabulary file (``base64 rank`` lines) of the public format; the file stays where it is."""

    def __init__(self, path: str, pattern: str, bos: int | None = None, pad: int = 0):
        self.path, self.pattern, self.bos, self.pad, self._made = path, pattern, bos, pad, None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}  # every worker reads the file itself

    def encode(self, text: str) -> list[int]:
        if self._made is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._made = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._made.encode_ordinary(text)


def with_images(turns: list[tuple[str, str]], tiles: list[int], per_tile: int) -> list[tuple[str, str]]:
    """The turns with the placeholders of human turns, in order, replaced by the tokens of the images' tiles; more placeholders stay."""
    left, out = list(tiles), []
    for sender, text in turns:
        if sender == "human":
            parts = (text or "").split(IMAGE)
            made = parts[0]
            for part in parts[1:]:
                made += (f"<img>{'<IMG_CONTEXT>' * (left.pop(0) * per_tile)}</img>" if left else IMAGE) + part
            text = made
        out.append((sender, text))
    return out


def pieces(style: str, turns: list[tuple[str, str]], system: str = "", roles: tuple[str, str] = ("<|im_start|>user\n", "<|im_start|>assistant\n"), end: str = "<|im_end|>") -> list[Piece]:
    """The pieces of a conversation of (sender, text) turns.

    ``generic``: ``user: text end assistant: `` is not supervised, ``text end`` is. ``chat`` (also with line ends in
    ``end``): the system message, users and roles are not, answers with their end sign are. ``strict_chat``: as chat with
    trimmed texts. A leading turn that is not a human's is left out, as system messages come from ``system``.
    """
    if turns and turns[0][0] != "human":
        turns = turns[1:]
    out: list[Piece] = [(system + end, False)] if system else []
    for sender, text in turns:
        said = (text or "").strip() if style == "strict_chat" else text or ""
        if sender == "human":
            out.append((f"{roles[0]}: {said}{end}" if style == "generic" else f"{roles[0]}{said}{end}", False))
        else:
            out += [(f"{roles[1]}: " if style == "generic" else roles[1], False), (said + end, True)]
    return out


def mask_pieces(parts: list[Piece], tokenizer: Tokenizer, most: int, fill: bool = False) -> tuple[list[int], list[int]]:
    """(ids, labels) of pieces; all labels are ignored where the pieces' tokens are not those of the whole text."""
    ids = [tokenizer.bos] if tokenizer.bos is not None else []
    labels = [IGNORED] * len(ids)
    for text, supervised in parts:
        made = tokenizer.encode(text)
        ids += made
        labels += made if supervised else [IGNORED] * len(made)
    whole = ([tokenizer.bos] if tokenizer.bos is not None else []) + tokenizer.encode("".join(t for t, _ in parts))
    if whole != ids:
        ids, labels = whole, [IGNORED] * len(whole)
    return _fitted(ids, labels, tokenizer, most, fill)


def mask_segments(turns: list[tuple[str, str]], tokenizer: Tokenizer, most: int, system: str = "", fill: bool = False) -> tuple[list[int], list[int]]:
    """(ids, labels), each turn a segment: system and human segments are ignored, answers count but for header and last token."""
    opened = turns[0][0] == "system"
    header = len(tokenizer.encode("<|im_start|>assistant\n"))
    ids = [tokenizer.bos] if tokenizer.bos is not None else []
    labels = [IGNORED] * len(ids)
    segments = ([("system", system)] if system and not opened else []) + turns
    for sender, text in segments:
        name = {"system": "system", "human": "user"}.get(sender, "assistant")
        made = tokenizer.encode(f"<|im_start|>{name}\n{text or ''}<|im_end|>\n")
        ids += made
        if name == "assistant":
            inner = max(0, len(made) - header - 1)
            labels += [IGNORED] * min(header, len(made)) + made[header : header + inner] + [IGNORED] * (len(made) - min(header, len(made)) - inner)
        else:
            labels += [IGNORED] * len(made)
    return _fitted(ids, labels, tokenizer, most, fill)


def _fitted(ids: list[int], labels: list[int], tokenizer: Tokenizer, most: int, fill: bool) -> tuple[list[int], list[int]]:
    ids, labels = ids[:most], labels[:most]
    if fill:
        labels, ids = labels + [IGNORED] * (most - len(labels)), ids + [tokenizer.pad] * (most - len(ids))
    return ids, labels


def masked(df: DataFrame, key: str, conversations: str, tokenizer: Tokenizer | None = None, style: str = "segments", most: int = 8192, fill: bool = False, system: str = "", tiles: str | None = None, per_tile: int = 256) -> DataFrame:
    """(key, input_ids, labels, attention_mask) of array<struct<sender, value>> conversations.

    ``tiles`` names an array<int> column with the tiles of each image. Null and empty conversations give empty arrays;
    other columns are left out; repeated keys give repeated rows.
    """
    if style not in STYLES:
        raise ValueError(f"no style {style}")
    words = tokenizer or WordTokenizer()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for talk, n in zip(batch.column("talk").to_pylist(), batch.column("tiles").to_pylist()):
                turns = [(m["sender"], m["value"]) for m in talk or [] if m]
                if n is not None:
                    turns = with_images(turns, n, per_tile)
                rows.append(([], []) if not turns else mask_segments(turns, words, most, system, fill) if style == "segments" else mask_pieces(pieces(style, turns, system), words, most, fill))
            lists = pa.list_(pa.int32())
            seen = [[int(x != words.pad) for x in ids] for ids, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r[0] for r in rows], lists), pa.array([r[1] for r in rows], lists), pa.array(seen, lists)], ["key", "input_ids", "labels", "attention_mask"])

    talk = F.transform(conversations, lambda m: F.struct(m["sender"].alias("sender"), m["value"].alias("value")))
    chosen = df.select(F.col(key).alias("key"), talk.alias("talk"), (F.col(tiles) if tiles else F.lit(None)).cast("array<int>").alias("tiles"))
    return chosen.mapInArrow(run, f"key {key_type}, input_ids array<int>, labels array<int>, attention_mask array<int>").withColumnRenamed("key", key)
