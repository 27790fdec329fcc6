"""Problem 8: evaluation items inside a training corpus.

Windows of documents and items have a 64-bit SimHash over their words. Whole items, possibly altered, are looked for in
windows of their own size: window sizes grow by a seventh, an item takes the largest that leaves it ``STRIDE`` places, and
has a fingerprint at each of these, so documents need a window at every ``STRIDE``-th word only. Parts of items are looked
for in windows of ``window`` words at every place of both sides. Each size has a multi-index over blocks of bits: two
fingerprints that differ in at most ``radius`` bits differ in at most radius // blocks bits of one block, and the index
holds every key that near, so it loses none of them. The radius is ``RADIUS`` for parts and ``ITEM_RADIUS`` for items;
with one of 43 words changed 4.4 bits differ on average, with two 6.2.

Candidates are verified where they stand: the item is laid over the document at the place the windows give, and the exact
weighted similarity of both multisets of five-word shingles is taken (a shingle weighs as many as it has letters), as well
as the longest run of equal words. A document holds an item if it has a run of a window's length, or if the similarity
reaches the limit.

The items go to the executors in blocks of a bounded number of words, all documents are read against every block, and
only verified (document, item) rows are shuffled. Null, blank and short texts hold nothing; an item with fewer words than
the window is looked for as a whole, one with fewer than five cannot be found; repeated documents are one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import WordIds, ids_of, shingle_hashes, words_of
from tracemill.session import table

WINDOW, RADIUS, SHINGLE = 12, 2, 5
STRIDE, ITEM_RADIUS, ITEM_BLOCKS = 8, 11, 4
#: Words of items that one broadcast holds; the arrays take about 450 bytes a word.
BLOCK_WORDS = 200_000
SLICE = 40_000


def bit_sums(ids: np.ndarray) -> np.ndarray:
    """Row i: how many of the first i words have each of the 64 bits."""
    kind = np.uint16 if len(ids) < 2**16 else np.int64
    out = np.zeros((len(ids) + 1, 64), kind)
    np.cumsum(np.unpackbits(ids.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=kind, out=out[1:])
    return out


def simhash_at(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words from ``starts``: bit i is set where more than half of the words have it."""
    return np.packbits(sums[starts + size] - sums[starts] > size // 2, axis=1).view(np.uint64).ravel()


def item_size(n_words: int, window: int = WINDOW, stride: int = STRIDE) -> int:
    """The size of the windows in which a whole item of ``n_words`` words is looked for; 0 for none."""
    size = 2 * window
    if n_words < size + stride - 1:
        return n_words if SHINGLE <= n_words < window else 0
    while (larger := size + max(1, size // 7)) + stride - 1 <= n_words:
        size = larger
    return size


class HammingIndex:
    """Fingerprints by blocks of bits, under every key that differs in at most radius // blocks bits."""

    #: Candidates that are compared at a time.
    MOST = 2_000_000

    def __init__(self, prints: np.ndarray, radius: int, blocks: int | None = None):
        self.prints, self.radius, self.blocks = prints, radius, []
        n_blocks = blocks or radius + 1
        width, extra = divmod(64, n_blocks)
        shift = 0
        for b in range(n_blocks):
            bits = width + (b < extra)
            mask, down = np.uint64((1 << bits) - 1), np.uint64(shift)
            shift += bits
            flips = np.array([sum(1 << i for i in c) for k in range(radius // n_blocks + 1) for c in combinations(range(bits), k)], np.uint64)
            key = (((prints >> down) & mask)[:, None] ^ flips).ravel()
            order = np.argsort(key, kind="stable")
            coarse = np.zeros(1 << min(bits, 22), bool)
            coarse[(key & np.uint64(len(coarse) - 1)).astype(np.int64)] = True
            self.blocks.append((down, mask, key[order], (order // len(flips)).astype(np.int32), coarse))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the index) of all pairs within the radius, each once."""
        left, right = [], []
        for down, mask, keys, order, coarse in self.blocks:
            key = (prints >> down) & mask
            hit = np.flatnonzero(coarse[(key & np.uint64(len(coarse) - 1)).astype(np.int64)])
            if not len(hit):
                continue
            low, high = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            count = high - low
            ends = np.cumsum(count)
            # many candidates at a time, but not all, so that memory stays bounded
            bounds = np.unique([0, *np.searchsorted(ends, np.arange(self.MOST, int(ends[-1]), self.MOST)), len(hit)])
            for at, stop in zip(bounds[:-1], bounds[1:]):
                c = count[at:stop]
                total = int(c.sum())
                a = np.repeat(hit[at:stop], c)
                b = order[np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:stop], c)]
                ok = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
                left.append(a[ok])
                right.append(b[ok])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]


def weighted_shingles(words: list[str], shingle: int = SHINGLE) -> Counter:
    """Shingle -> number of its letters times its occurrences."""
    out: Counter = Counter()
    for i in range(len(words) - shingle + 1):
        run = tuple(words[i : i + shingle])
        out[run] += sum(map(len, run))
    return out


def similarity_of(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    union = (a | b).total()
    return (a & b).total() / union if union else 0.0


class ItemBlock:
    """Some items with an index for each size of window."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int):
        ids = WordIds()
        self.window, self.words, self.shingles = window, {}, {}
        self.ids, self.runs = {}, {}
        sizes: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) < SHINGLE:
                continue
            self.words[item], self.shingles[item] = words, weighted_shingles(words)
            coded = self.ids[item] = ids_of(words, ids)
            # hashes and letters of the shingles, to tell most candidates apart before words are compared
            letters = np.cumsum([0, *map(len, words)])
            self.runs[item] = shingle_hashes(coded, SHINGLE), letters[SHINGLE:] - letters[:-SHINGLE]
            sums = bit_sums(coded)
            wanted = [(window, 1, len(words) - window + 1)] if len(words) >= window else []
            if size := item_size(len(words), window):
                wanted.append((size, STRIDE if size > window else 1, STRIDE if size > window else 1))
            for size, step, n in wanted:
                places = np.arange(n)
                sizes.setdefault((size, step), []).append((item, places, simhash_at(sums, places, size)))
        self.indexes = []
        for (size, step), found in sorted(sizes.items()):
            prints = np.concatenate([p for *_, p in found])
            index = HammingIndex(prints, ITEM_RADIUS, ITEM_BLOCKS) if step > 1 else HammingIndex(prints, radius)
            self.indexes.append((size, step, index, np.concatenate([np.full(len(p), i, np.int64) for i, p, _ in found]), np.concatenate([p for _, p, _ in found])))
        self.longest = max([window, *(s for s, *_ in self.indexes)])

    def candidates(self, ids: np.ndarray, fresh: int) -> np.ndarray:
        """Rows (window's place in ``ids``, window's size, item, where the item would begin) of windows near an item's; ``fresh`` windows a size."""
        out = []
        sums = bit_sums(ids)
        for size, step, index, item, place in self.indexes:
            starts = np.arange(0, min(fresh, len(ids) - size + 1), step)
            if len(starts):
                a, b = index.near(simhash_at(sums, starts, size))
                at = starts[a]
                out.append(np.stack([at, np.full(len(at), size), item[b], at - place[b]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 4), np.int64)


def find_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text", window: int = WINDOW, radius: int = RADIUS, similarity: float = 0.8) -> DataFrame:
    """(document, item, longest_run, share, similarity): documents holding a part of an item, or one similar to it.

    ``longest_run`` is the longest run of consecutive words that both share if it has a window's length (else 0),
    ``share`` the part of the item's words inside such runs at one place (1 for a similar item without any), and
    ``similarity`` that of the item and what stands in its place, the greatest of all places.
    """
    spark = documents.sparkSession
    id_type = documents.schema[doc_col].dataType.simpleString()
    size = items.agg(F.sum(F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[^\p{L}\p{N}]+"))).alias("n")).first().n or 0
    n_blocks = max(1, -(-int(size) // BLOCK_WORDS))
    out = None
    schema = f"doc {id_type}, item bigint, longest_run int, share double, similarity double"
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64(item_col), F.lit(n_blocks)) == k).select(item_col, item_text).collect()  # at most about BLOCK_WORDS words
        shared = spark.sparkContext.broadcast(ItemBlock([(r[0], r[1]) for r in sorted(rows, key=lambda r: r[0])], window, radius))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, ids = shared.value, WordIds()
            for batch in batches:
                found = _scan(block, ids, batch.column("text").to_pylist(), similarity)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([f[0] for f in found], pa.int32())), *(pa.array([f[c] for f in found], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.float64()), (4, pa.float64())))], ["doc", "item", "longest_run", "share", "similarity"])

        # A text of fewer characters than two a word has no window.
        part = documents.where(F.length(text_col) >= 2 * SHINGLE - 1).select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc", "item").agg(F.max("longest_run").alias("longest_run"), F.max("share").alias("share"), F.max("similarity").alias("similarity"))
    return best.withColumnsRenamed({"doc": doc_col, "item": item_col})


def _scan(block: ItemBlock, ids: WordIds, texts: list[str], similarity: float) -> list[tuple]:
    """(row, item, longest run, share, similarity) of the documents of a batch, many short ones at a time."""
    best: dict[tuple[int, int], tuple[int, float, float]] = {}

    def flush(words: list[str], owner: list[tuple[int, int, int]]) -> None:
        flat = ids_of(words, ids)
        runs = shingle_hashes(flat, SHINGLE)
        starts, rows, ends = (np.array(x, np.int64) for x in zip(*owner))
        # slices begin at a multiple of the stride, so every document window is taken once
        for at in range(0, len(flat), SLICE):
            found = block.candidates(flat[at : at + SLICE + block.longest - 1], SLICE)
            if not len(found):
                continue
            place, size, item, begin = found.T
            doc = np.searchsorted(starts, place + at, "right") - 1
            inside = place + at + size <= ends[doc]
            # the item lies over the document in one way per (document, item, beginning)
            for d, i, s in np.unique(np.stack([doc[inside], item[inside], begin[inside] + at], axis=1), axis=0).tolist():
                if possible(flat, runs, int(starts[d]), int(ends[d]), i, s):
                    verify(words, int(starts[d]), int(ends[d]), int(rows[d]), i, s)

    def possible(flat: np.ndarray, runs: np.ndarray, first: int, end: int, item: int, begin: int) -> bool:
        """Whether there is a run of a window's length, or shingles that weigh enough for the similarity."""
        own = block.ids[item]
        low, high = max(first, begin), min(end, begin + len(own))
        other = np.flatnonzero(flat[low:high] != own[low - begin : high - begin])
        if np.diff(other, prepend=-1, append=high - low).max() > block.window:
            return True
        hashes, letters = block.runs[item]
        return letters[np.isin(hashes, runs[low : high - SHINGLE + 1])].sum() >= similarity * letters.sum()

    def verify(words: list[str], first: int, end: int, row: int, item: int, begin: int) -> None:
        own = block.words[item]
        low, high = max(first, begin), min(end, begin + len(own))
        there, mine = words[low:high], own[low - begin : high - begin]
        run = longest = covered = 0
        for x, y in zip(there, mine):
            if x == y:
                run += 1
                longest = max(longest, run)
                covered += block.window if run == block.window else run > block.window
            else:
                run = 0
        alike = similarity_of(weighted_shingles(there), block.shingles[item])
        if longest < block.window and alike < similarity:
            return
        share = 1.0 if alike >= similarity and not covered else covered / len(own)
        old = best.get((row, item), (0, 0.0, 0.0))
        best[row, item] = (max(old[0], longest if longest >= block.window else 0), max(old[1], share), max(old[2], alike))

    words, owner = [], []
    for row, text in enumerate(texts):
        own = words_of(text)
        if len(own) < SHINGLE:
            continue
        owner.append((len(words), row, len(words) + len(own)))
        words += own
        if len(words) >= SLICE:
            flush(words, owner)
            words, owner = [], []
    if owner:
        flush(words, owner)
    return [(row, item, *x) for (row, item), x in best.items()]


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verified leaks, with how much of the item they hold."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) where twelve consecutive words of the item stand in the document."""
    return p8_leaks(spark, sf_dir).where(F.col("longest_run") >= WINDOW).select("doc_id", "item_id")
