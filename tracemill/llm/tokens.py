"""Problem 7: encoding a corpus with a public tokenizer.

Texts up to ``chunk_chars`` are one chunk and are encoded where they are read. A longer text becomes overlapping chunks
that are spread over the cluster: each chunk is pre-tokenised on its own, neighbours are stitched at the first place of
their overlap where both have a pre-token boundary (the pattern looks only forward, so from a common boundary on both
agree), and the pieces between those places are encoded in parallel. A text with an overlap that holds no common
boundary (one run of letters longer than the overlap) is encoded as a whole. Decoding concatenates the raw bytes of the
ids.

Null text gives null, empty text an empty list; every other column is left out; repeated ids stay repeated rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import blocks
from tracemill.session import table

TOKENIZERS = os.environ.get("TRACEMILL_TOKENIZERS", "/opt/tokenizers")
#: The public pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS, OVERLAP = 16_384, 512


@lru_cache(4)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def pretoken() -> regex.Pattern:
    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of ``text``."""
    return [m.end() for m in pretoken().finditer(text)]


def decode(ids: list[int] | None, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str | None:
    """Text of ids; null stays null."""
    return None if ids is None else encoding(folder, name).decode_bytes(ids).decode("utf-8", "replace")


def _lists(rows: list[list[int] | None], of: pa.DataType = pa.int32()) -> pa.Array:
    return pa.array(rows, pa.list_(of))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>) of every row of ``df``."""
    if not 0 < 2 * overlap < chunk_chars:
        raise ValueError("the overlap has to be shorter than half a chunk")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks(range(len(texts)), lambda i: len(texts[i] or "") + 50, 2_000_000):
                ids = [None if texts[i] is None else enc.encode_ordinary(texts[i]) for i in part]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(part[0], len(part)), _lists(ids)], ["id", "ids"])

    schema = f"id {id_type}, ids array<int>"
    long = F.length("text") > chunk_chars
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(whole, schema)

    # Long texts: a number for the row, as ids may repeat, then a row a chunk.
    big = rows.where(long).withColumn("row", F.monotonically_increasing_id())
    count = F.ceil(F.length("text") / F.lit(chunk_chars)).cast("int")
    chunk = big.select("row", "id", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), "text")
    start = F.greatest(F.lit(0), F.col("k") * chunk_chars - overlap)
    chunk = chunk.select("row", "id", "n", "k", start.alias("at"), F.substring("text", start + 1, F.least(F.lit(chunk_chars + 2 * overlap), (F.col("k") + 1) * chunk_chars + overlap - start)).alias("text"))
    chunk = chunk.repartition("row", "k")

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the boundaries inside the overlaps with the chunk before and the chunk after, as places in the whole text."""
        for batch in batches:
            b = batch.to_pydict()
            left, right = [], []
            for k, n, at, text in zip(b["k"], b["n"], b["at"], b["text"]):
                # behind white space a boundary depends on what follows, so a piece could not end there
                ends = [e for e in boundaries(text) if not text[e - 1].isspace()]
                before, after = k * chunk_chars, (k + 1) * chunk_chars
                left.append([at + e for e in ends if k and at + e < before + overlap])
                # the last pre-token may go on behind the chunk, and a contraction that is cut there looks like two
                right.append([at + e for e in ends if k < n - 1 and after - overlap <= at + e <= at + len(text) - 4])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(left), _lists(right)], [*batch.schema.names, "left", "right"])

    seamed = chunk.mapInArrow(seams, f"row bigint, id {id_type}, n int, k int, at int, text string, left array<int>, right array<int>")
    order = Window.partitionBy("row").orderBy("k")
    begin = F.array_min(F.array_intersect("left", F.lag("right").over(order)))
    stitched = seamed.withColumn("begin", F.when(F.col("k") == 0, F.lit(0)).otherwise(begin)).withColumn("stop", F.lead("begin").over(order))
    stitched = stitched.withColumn("whole", F.max(F.col("begin").isNull()).over(Window.partitionBy("row")))
    kept = stitched.where(~F.col("whole"))
    piece = F.substring("text", F.col("begin") - F.col("at") + 1, F.coalesce(F.col("stop"), F.lit(2**31 - 1)) - F.col("begin"))
    inner = kept.select(F.struct("row", "k", "id").alias("id"), piece.alias("text")).mapInArrow(whole, f"id struct<row:bigint,k:int,id:{id_type}>, ids array<int>")
    joined = inner.groupBy("id.row").agg(F.first("id.id").alias("id"), F.array_sort(F.collect_list(F.struct("id.k", "ids"))).alias("parts"))
    stitched_ids = joined.select("id", F.flatten(F.col("parts.ids")).alias("ids"))
    # Texts whose chunks never resynchronise are put together again and encoded in one go.
    own = F.when(F.col("k") == 0, F.col("text")).otherwise(F.substring("text", overlap + 1, 2**31 - 1))
    own = F.when(F.col("k") == F.col("n") - 1, own).otherwise(F.expr(f"substring(CASE WHEN k = 0 THEN text ELSE substring(text, {overlap + 1}, 2147483647) END, 1, {chunk_chars})"))
    again = stitched.where("whole").groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("k", own.alias("t")))).alias("parts"))
    unsynced = again.select("id", F.array_join(F.col("parts.t"), "").alias("text")).mapInArrow(whole, schema)
    return short.unionByName(stitched_ids).unionByName(unsynced).withColumnRenamed("id", id_col)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
