"""Problem 9: cutting long texts into overlapping pieces at natural boundaries.

Every place between two tokens has a strength: a paragraph, a step, a line, a sentence, a word ends there, or none of
these. A sparse table answers "which place of this window is the strongest, the rightmost among equals" in constant
time; its rows end at the window length, so its memory grows with the text and not with text times log(text). From the
start of a piece the table is asked for the window of permissible lengths, first for long pieces, and for short ones
too where no long one would end at a word; then the next start is the strongest place among the last ``overlap`` ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.tokens import TOKENIZERS, encoding
from tracemill.session import table

PARAGRAPH, STEP, LINE, SENTENCE, WORD_END, TOKEN, INSIDE = 5, 4, 3, 2, 1, 0, -1
CUTS = {PARAGRAPH: "paragraph", STEP: "step", LINE: "line", SENTENCE: "sentence", WORD_END: "word", TOKEN: "token", INSIDE: "inside a character"}
LEAST_OVERLAP = 4
#: Where each kind of unit ends, the weaker first, as a stronger one overwrites.
_ENDS = (
    (WORD_END, re.compile(r"(?<=\S)(?=\s)|(?<=\s)(?=\S)")),
    (SENTENCE, re.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？][”’」』）]*")),
    (LINE, re.compile(r"\r\n?|\n")),
    (STEP, re.compile(r"<\|reasoning_(?:step_end|proceed)\|>\n?|\n(?=\d+[.)] )")),
    (PARAGRAPH, re.compile(r"(?:\r?\n[ \t]*){2,}")),
)


def strengths(text: str, ends: np.ndarray) -> np.ndarray:
    """The strength of the place behind each token; ``ends`` holds the tokens' ends in bytes of UTF-8."""
    if text.isascii():
        at_byte = np.full(len(text) + 1, TOKEN, np.int8)
        offset = None
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width)))
        at_byte = np.full(int(offset[-1]) + 1, INSIDE, np.int8)
        at_byte[offset] = TOKEN
    for strength, pattern in _ENDS:
        places = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        at_byte[places if offset is None else offset[places]] = strength
    return at_byte[ends]


class SparseTable:
    """Range maximum over windows of at most ``longest`` places; among equals the rightmost (or the leftmost) wins."""

    def __init__(self, strength: np.ndarray, longest: int, rightmost: bool = True):
        n = len(strength)
        place = np.arange(n, dtype=np.int64)
        key = (strength.astype(np.int64) + 1 << 40) + (place if rightmost else n - 1 - place)
        self.n, self.rightmost, self.levels = n, rightmost, [key]
        step = 1
        while 2 * step <= min(longest, n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(last) - step], last[step:]))
            step *= 2

    def best(self, low: int, high: int) -> int:
        """The place in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        key = int(max(level[low], level[high - (1 << k) + 1])) & ((1 << 40) - 1)
        return key if self.rightmost else self.n - 1 - key


def spans(strength: np.ndarray, most: int = 512, overlap: int = 64, least: int | None = None) -> list[tuple[int, int]]:
    """[start, end) token spans of the pieces; ``strength[i]`` belongs to the place behind token i."""
    n, least = len(strength), max(overlap + 1, most // 2 if least is None else least)
    if not 1 <= overlap < most:
        raise ValueError("the overlap has to be shorter than a piece")
    if n <= most:
        return [(0, n)] if n else []
    right, left = SparseTable(strength, most), SparseTable(strength, overlap, rightmost=False)
    out, start = [], 0
    while n - start > most:
        place = right.best(start + least - 1, start + most - 1)
        if strength[place] < WORD_END:
            place = right.best(start + overlap, start + most - 1)
        end = place + 1
        out.append((start, end))
        start = left.best(max(end - overlap, start + 1) - 1, end - 2) + 1
    out.append((start, n))
    return out


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 512, overlap: int = 64, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece_no, start_token, end_token, n_tokens, cut, piece) of each text with more than ``most`` tokens.

    ``cut`` says what ends where the piece ends. Null, empty and short texts give no rows; repeated rows give repeated
    pieces. A piece that starts or ends inside a word could be encoded otherwise on its own; it is shortened until its
    own encoding fits too, with a shorter overlap where that is needed, and a ValueError says that none fits. With an
    overlap of ``LEAST_OVERLAP`` tokens or more no piece starts or ends inside a character, as none has more bytes.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        width = np.zeros(enc.n_vocab, np.int64)
        for token in enc._mergeable_ranks.values():
            width[token] = len(enc.decode_single_token_bytes(token))
        names = ["id", "piece_no", "start_token", "end_token", "n_tokens", "cut", "piece"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode_ordinary(text)
                if len(ids) <= most:
                    continue
                ends = np.cumsum(width[ids])
                raw, strength = text.encode("utf-8"), strengths(text, ends)
                limit, shared = most, overlap
                while True:
                    cuts = spans(strength, limit, shared)
                    made = [raw[(int(ends[a - 1]) if a else 0) : int(ends[b - 1])].decode("utf-8", "replace") for a, b in cuts]
                    safe = [(a == 0 or strength[a - 1] >= WORD_END) and strength[b - 1] >= WORD_END for a, b in cuts]
                    if all(ok or len(enc.encode_ordinary(p)) <= most for ok, p in zip(safe, made)):
                        break
                    if limit <= shared + 8:
                        # shorter pieces need a shorter overlap; a piece of few tokens fits in the end
                        if shared <= LEAST_OVERLAP:
                            raise ValueError(f"no pieces of at most {most} tokens cover a text")
                        shared = max(LEAST_OVERLAP, shared // 2)
                    else:
                        limit -= 8
                for no, ((a, b), piece) in enumerate(zip(cuts, made)):
                    at.append(i)
                    rows.append((no, a, b, b - a, "end" if b == len(ids) else CUTS[int(strength[b - 1])], piece))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)
                    at, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

    # A text has at most as many tokens as bytes, so shorter ones need not leave the JVM.
    long = df.where(F.octet_length(text_col) > most).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = long.mapInArrow(pieces, f"id {id_type}, piece_no int, start_token int, end_token int, n_tokens int, cut string, piece string")
    return made.withColumnRenamed("id", id_col)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"))
