"""Packing as a stream: arriving samples are packed per worker by state that survives restarts with the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators.packing import Buffers

_SCHEMA = "worker int, buffer bigint, place int, sample bigint, tokens int, images int"
_STATE = "number bigint, buffer array<int>, sample array<bigint>, tokens array<int>, images array<int>"


def stream_packed(samples: DataFrame, max_tokens: int = 8192, max_images: int = 40, most: int = 20, idle: str = "NoTimeout") -> DataFrame:
    """(worker, buffer, place, sample, tokens, images) of complete buffers.

    ``samples`` is (worker int, sample bigint, tokens int, images int). The state of a worker is its open buffers, at
    most ``most`` of them; buffers that are open when the stream stops come out of the checkpoint when it goes on.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffers, number = Buffers(max_tokens, max_images, most), 0
        if state.exists:
            number, place, s, t, m = state.get
            grouped: dict[int, list] = {}
            for p, x in zip(place, zip(s, t, m)):
                grouped.setdefault(p, []).append(x)
            buffers.open = [grouped[p] for p in sorted(grouped)]
        rows = []
        for frame in frames:
            for r in frame.sort_values("sample").itertuples(index=False):
                for done in buffers.add(int(r.sample), int(r.tokens), int(r.images)):
                    rows += [(key[0], number, i, *x) for i, x in enumerate(done)]
                    number += 1
        flat = [(p, *x) for p, b in enumerate(buffers.open) for x in b]
        columns = [list(c) for c in zip(*flat)] if flat else [[], [], [], []]
        state.update((number, *columns))
        yield pd.DataFrame(rows, columns=["worker", "buffer", "place", "sample", "tokens", "images"])

    kept = samples.select(F.col("worker").cast("int").alias("worker"), F.col("sample").cast("bigint").alias("sample"), F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens"), F.coalesce("images", F.lit(0)).cast("int").alias("images"))
    return kept.groupBy("worker").applyInPandasWithState(run, _SCHEMA, _STATE, "append", getattr(GroupStateTimeout, idle))


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) per window of event time, late rows up to the watermark included; an extension, works on streams and tables."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")
