"""The packing loader: samples with their tokens, in arrival order per worker, into packs of bounded tokens and images.

What a worker keeps at a time are its open packs. Samples of several sources are interleaved first, in a weighted order
that every engine repeats.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tracemill.functions.prompts import IGNORED
from tracemill.operators.pairs import hash_order

IMAGE_START, IMAGE_TOKEN, IMAGE_END = 50001, 50000, 50002


@dataclass
class Pack:
    """Tokens with labels and the number of the sample each came from."""

    ids: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    index: list[int] = field(default_factory=list)
    images: int = 0

    def add(self, ids: list[int], labels: list[int], images: int) -> "Pack":
        number = self.index[-1] + 1 if self.index else 0
        self.ids, self.labels, self.index = self.ids + ids, self.labels + labels, self.index + [number] * len(ids)
        self.images += images
        return self

    def part(self, low: int, high: int | None, images: int) -> "Pack":
        return Pack(self.ids[low:high], self.labels[low:high], self.index[low:high], images)

    def learns(self, least: float = 1 / 256) -> bool:
        """Whether enough of the labels count."""
        return bool(self.labels) and sum(x != IGNORED for x in self.labels) / len(self.labels) > least


def split_pack(pack: Pack, most: int) -> list[Pack]:
    """Parts of at most ``most`` tokens of a pack that is longer.

    A cut inside an image moves to the image's start; any other cut lets the next part begin with the next image, and what
    stands between is dropped, as text without an image teaches nothing here. Parts without images, or in which hardly
    any label counts, are dropped too.
    """
    out, rest = [], pack
    while len(rest.ids) > most:
        starts = [i for i, x in enumerate(rest.ids) if x == IMAGE_START]
        after = bisect_right(starts, most)  # images that begin up to the cut
        if rest.ids[most] in (IMAGE_START, IMAGE_TOKEN, IMAGE_END) and after:
            cut, n = starts[after - 1], after - 1
            if not cut:  # one image fills all of it and more
                return out
            left, rest = rest.part(0, cut, n), rest.part(cut, None, rest.images - n)
        else:
            left = rest.part(0, most, after)
            rest = rest.part(starts[after], None, rest.images - after) if after < len(starts) else Pack()
        if left.images and left.learns():
            out.append(left)
    if rest is pack or rest.images and rest.learns():
        out.append(rest)
    return out


class Packer:
    """The open packs of one worker, by falling number of images."""

    def __init__(self, max_tokens: int, max_images: int, most_open: int, overflow: bool):
        self.max_tokens, self.max_images, self.most_open, self.overflow, self.open = max_tokens, max_images, most_open, overflow, []

    def _take(self, tokens: int, images: int) -> Pack | None:
        """The first pack with room; if none has room for the tokens and half of all places are taken, the last with room for the images."""
        found = None
        for k, p in enumerate(self.open):
            if p.images + images <= self.max_images:
                if len(p.ids) + tokens <= self.max_tokens:
                    return self.open.pop(k)
                if self.overflow and len(self.open) >= self.most_open // 2:
                    found = k
        return None if found is None else self.open.pop(found)

    def add(self, ids: list[int], labels: list[int], images: int) -> list[Pack]:
        """The packs that are complete once the sample is in."""
        pack = (self._take(len(ids), images) or Pack()).add(ids, labels, images)
        done = []
        for part in split_pack(pack, self.max_tokens):
            if part.images > self.max_images:
                continue
            if len(part.ids) >= self.max_tokens:
                done.append(part)
                continue
            at = next((k for k, p in enumerate(self.open) if p.images < part.images), len(self.open))
            self.open.insert(at, part)
        while self.open and self.open[0].images == self.max_images or len(self.open) > self.most_open:
            done.append(self.open.pop(0))
        return done

    def flush(self) -> list[Pack]:
        done, self.open = self.open, []
        return done


def interleaved(samples: DataFrame, source: str, key: str, weights: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``turn``, the order in which a weighted draw among sources without replacement takes the rows.

    Each row of a source waits for an exponential time of the source's weight (``weights``: source, weight), so sources run
    dry in proportion, and one that is exhausted leaves the others' order as it is. Nothing is drawn one by one.
    """
    uniform = (F.conv(F.substring(hash_order(key, seed=seed), 1, 13), 16, 10).cast("double") + 1) / float(16**13 + 1)
    return samples.join(F.broadcast(weights.select(source, F.col("weight").alias("__w"))), source).withColumn("turn", -F.ln(uniform) / F.col("__w")).drop("__w")


def load_packs(samples: DataFrame, worker: str, order: str, ids: str, labels: str | None, images: str, max_tokens: int = 8192, max_images: int = 40, most_open: int = 20, overflow: bool = True, lanes: int = 16) -> DataFrame:
    """(worker, lane, pack, n_samples, n_images, input_ids, labels, data_index) of the packs, as they are completed.

    A worker's stream is dealt to ``lanes`` by hash, each with its own open packs, so that a worker with a third of all
    samples is no single task; with one lane a worker packs as a single loader does. Null ids are no sample, null labels
    are the ids themselves. The rows of a lane are streamed in order and never held at once.
    """
    worker_type = samples.schema[worker].dataType.simpleString()
    wanted = samples.where(F.size(F.coalesce(ids, F.array().cast("array<int>"))) > 0)
    chosen = wanted.select(F.col(worker).alias("worker"), F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int").alias("lane"), F.col(order).alias("__o"), F.col(ids).alias("ids"), (F.col(labels) if labels else F.col(ids)).alias("labels"), F.coalesce(F.col(images), F.lit(0)).cast("int").alias("images"))
    placed = chosen.repartition("worker", "lane").sortWithinPartitions("worker", "lane", "__o").drop("__o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, number = None, None, 0
        names = ["worker", "lane", "pack", "n_samples", "n_images", "input_ids", "labels", "data_index"]
        lists = pa.list_(pa.int32())

        def rows(done: list[Pack]) -> list[tuple]:
            nonlocal number
            out = []
            for p in done:
                out.append((*key, number, len(set(p.index)), p.images, p.ids, p.labels, [x - p.index[0] for x in p.index]))
                number += 1
            return out

        def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), lists, lists, lists))], names)

        kind = pa.int32()
        for batch in batches:
            kind, out = batch.column("worker").type, []
            for w, lane, i, x, n in zip(*(batch.column(c).to_pylist() for c in ("worker", "lane", "ids", "labels", "images"))):
                if (w, lane) != key:
                    if packer:
                        out += rows(packer.flush())
                    key, packer, number = (w, lane), Packer(max_tokens, max_images, most_open, overflow), 0
                out += rows(packer.add(i, x or i, n))
            yield batch_of(out, kind)
        if packer:
            yield batch_of(rows(packer.flush()), kind)

    return placed.mapInArrow(run, f"worker {worker_type}, lane int, pack int, n_samples int, n_images int, input_ids array<int>, labels array<int>, data_index array<int>")


def collate_stats(packs: DataFrame, batch: str, max_length: int, max_images: int, ids: str = "input_ids", index: str = "data_index", images: str = "n_images") -> DataFrame:
    """(batch, n_samples, n_padding, n_padded_images): what a batch of packs holds when filled up to the lengths."""
    last = F.element_at(index, -1) + 1
    return packs.groupBy(batch).agg(F.sum(F.when(F.size(index) > 0, last).otherwise(0)).alias("n_samples"), F.sum(F.lit(max_length) - F.size(ids)).alias("n_padding"), F.sum(F.greatest(F.lit(0), F.lit(max_images) - F.col(images))).alias("n_padded_images"))


@F.pandas_udf(ArrayType(IntegerType()))
def sub_positions(index: pd.Series) -> pd.Series:
    """The place of each token in its sample, from the samples' numbers in order. Null arrays stay null."""

    def one(x: list[int]) -> np.ndarray:
        x = np.asarray(x, np.int64)
        new = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
        return (np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))).astype(np.int32)

    return index.map(one, na_action="ignore")
