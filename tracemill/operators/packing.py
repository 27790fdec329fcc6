"""Training batches: arrival-order packing with bounded buffers, sub-sequence indices, padding and masks.

This is the loader's packing, which keeps arrival order per worker; the packing of a whole corpus with as little room
lost as possible is another operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


class Buffers:
    """Open buffers of one worker; a buffer is a list of (sample, tokens, images)."""

    def __init__(self, max_tokens: int = 8192, max_images: int = 40, most: int = 20):
        self.max_tokens, self.max_images, self.most, self.open = max_tokens, max_images, most, []

    def _insert(self, buffer: list) -> None:
        """Buffers stand by falling number of images, so the fullest that still fits is found first."""
        images = sum(x[2] for x in buffer)
        at = next((i for i, b in enumerate(self.open) if sum(x[2] for x in b) < images), len(self.open))
        self.open.insert(at, buffer)

    def add(self, sample, tokens: int, images: int) -> list[list]:
        """Puts a sample into the first buffer with room, or into a new one; gives back the buffers that are complete."""
        at = next((i for i, b in enumerate(self.open) if sum(x[1] for x in b) + tokens <= self.max_tokens and sum(x[2] for x in b) + images <= self.max_images), None)
        buffer = self.open.pop(at) if at is not None else []
        buffer.append((sample, tokens, images))
        if sum(x[1] for x in buffer) >= self.max_tokens or sum(x[2] for x in buffer) >= self.max_images:
            return [buffer]
        self._insert(buffer)
        return [self.open.pop(0)] if len(self.open) > self.most else []

    def flush(self) -> list[list]:
        out, self.open = self.open, []
        return out


def pack_samples(samples: DataFrame, worker: str, sample: str, tokens: str, images: str, order: str, max_tokens: int = 8192, max_images: int = 40, most: int = 20, lanes: int = 16) -> DataFrame:
    """(worker, lane, buffer, place, sample, tokens, images) in arrival order per worker.

    A worker's stream is dealt to ``lanes`` by hash first, so that a worker with a third of all samples is no single
    group; each lane has its own buffers. A sample over a capacity gets a buffer of its own. Rows are streamed through
    their group in order, and what is kept at a time are the open buffers.
    """
    sample_type = samples.schema[sample].dataType.simpleString()
    worker_type = samples.schema[worker].dataType.simpleString()
    dealt = samples.select(worker, sample, F.coalesce(F.col(tokens), F.lit(0)).cast("int").alias("n_tokens"), F.coalesce(F.col(images), F.lit(0)).cast("int").alias("n_images"), F.col(order).alias("__o"))
    dealt = dealt.withColumn("lane", F.pmod(F.xxhash64(sample), F.lit(lanes)).cast("int"))
    placed = dealt.repartition(worker, "lane").sortWithinPartitions(worker, "lane", F.col("__o").asc_nulls_last(), sample).drop("__o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, buffers, number = None, None, 0

        def rows(done: list[list]) -> list[tuple]:
            nonlocal number
            out = []
            for b in done:
                out += [(*key, number, place, *x) for place, x in enumerate(b)]
                number += 1
            return out

        for frame in frames:
            out = []
            for w, s, n, m, lane in frame.itertuples(index=False):
                if (w, lane) != key:
                    if buffers:
                        out += rows(buffers.flush())
                    key, buffers, number = (w, lane), Buffers(max_tokens, max_images, most), 0
                out += rows(buffers.add(s, n, m))
            yield pd.DataFrame(out, columns=["worker", "lane", "buffer", "place", "sample", "tokens", "images"])
        if buffers:
            yield pd.DataFrame(rows(buffers.flush()), columns=["worker", "lane", "buffer", "place", "sample", "tokens", "images"])

    return placed.mapInPandas(run, f"worker {worker_type}, lane int, buffer int, place int, sample {sample_type}, tokens int, images int")


def split_at(tokens: int, image_starts: list[int], max_tokens: int) -> list[tuple[int, int]]:
    """[start, end) cuts of a buffer at the capacity, backed off to the start of an image that would be cut."""
    cuts, at = [], 0
    while at < tokens:
        end = min(at + max_tokens, tokens)
        if end < tokens:
            inside = [s for s, e in zip(image_starts[::2], image_starts[1::2]) if s < end < e and s > at]
            end = inside[0] if inside else end
        cuts.append((at, end))
        at = end
    return cuts


@F.pandas_udf(ArrayType(IntegerType()))
def position_ids(mask: pd.Series) -> pd.Series:
    """Running count of attended places less one; masked places get 1. Null arrays stay null."""
    one = lambda m: None if m is None else np.where(np.asarray(m) == 0, 1, np.cumsum(m) - 1)
    return mask.map(one, na_action="ignore")


@F.pandas_udf(ArrayType(IntegerType()))
def cu_seqlens(lengths: pd.Series) -> pd.Series:
    """Cumulative lengths with a leading zero. Null arrays stay null."""
    return lengths.map(lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.int32), na_action="ignore")


def pad_batches(df: DataFrame, batch: str, ids: str, labels: str, pad: int = 0, ignored: int = -100) -> DataFrame:
    """Adds ids and labels padded to the longest of their batch, and the attention mask."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("__n"))
    joined = df.join(longest, batch)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__n") - F.size(c)))
    mask = F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("__n") - F.size(ids)))
    return joined.select(*[c for c in df.columns if c not in (ids, labels)], fill(ids, pad).alias(ids), fill(labels, ignored).alias(labels), mask.alias("attention_mask"))


def pad_flags(flags: F.Column, expected: F.Column) -> F.Column:
    """Image flags with zeros up to the expected count."""
    return F.concat(flags, F.array_repeat(F.lit(0), F.greatest(F.lit(0), expected - F.size(flags))))


def join_sides(pairs: DataFrame, batch: str, chosen: str, rejected: str, pad: int = 0) -> DataFrame:
    """Both sides of pairs as rows of one batch: side 0 chosen, 1 rejected, ids padded to the longest of the batch, with the attention mask."""
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    both = pairs.select(*rest, F.lit(0).alias("side"), F.col(chosen).alias("ids")).unionByName(pairs.select(*rest, F.lit(1).alias("side"), F.col(rejected).alias("ids")))
    return pad_batches(both.withColumn("__labels", F.col("ids")), batch, "ids", "__labels", pad).drop("__labels")


def collate(rows: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """(batch, columns as arrays in order): records of a batch as lists. For batches of a bounded size."""
    entry = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns)))
    listed = rows.groupBy(batch).agg(entry.alias("__e"))
    return listed.select(batch, *(F.col(f"__e.{c}").alias(c) for c in columns))
