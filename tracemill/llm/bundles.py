"""Problem 1: samples combined into bundles of fixed token and tile capacity.

The samples are counted in a histogram of token units and tiles, whose size follows from the capacities and not from the
data; neighbouring cells become at most ``most_types`` types. The configuration linear program (how many bundles of each
filling are needed so that every type is covered) is solved on the driver by multiplicative weights with a knapsack
dynamic program over tokens and tiles as pricing: ``Program`` gives a fractional solution and a dual bound over all types
of the histogram, coarsened; ``Plan`` rounds on the fine histogram, where the same weights and pricing give whole
bundles. Then every sample finds its bundle from its type and its rank within the type; ranks come from counts per type
and salt, which stay on the executors, so no type's samples meet in one task.

A sample over a capacity is cut into pieces, each piece full but for the last, never inside a tile's ids. Trailing
padding does not count, null arrays are empty, ``num_patches`` is not read; a sample without tokens and tiles still gets
a place. Re-delivered samples count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import cut, table

MAX_TOKENS, MAX_TILES, PAD = 8192, 40, 0
TILE_START, TILE_END = 50001, 50002
UNIT, MOST_TYPES, SALTS = 16, 6000, 64


def measure(samples: DataFrame) -> DataFrame:
    """(sample_id, n_tokens, n_tiles) of every sample: ids up to the last that is no padding, and tiles."""
    ids = F.coalesce("input_ids", F.array().cast("array<int>"))
    kept = F.expr("size(ids) - (array_position(transform(reverse(ids), v -> v <> 0), true) - 1)").cast("int")
    tokens = F.when(F.size("ids") == 0, 0).when(F.element_at("ids", -1) != PAD, F.size("ids")).when(F.exists("ids", lambda v: v != PAD), kept).otherwise(0)
    tiles = F.coalesce(F.size("pixel_values"), F.lit(0))
    sized = samples.select("sample_id", ids.alias("ids"), F.when(F.col("pixel_values").isNull(), 0).otherwise(tiles).alias("n_tiles"))
    return sized.select("sample_id", tokens.alias("n_tokens"), "n_tiles").dropDuplicates(["sample_id"])


def cut_sample(ids: np.ndarray, n_tiles: int, max_tokens: int, max_tiles: int) -> list[tuple[int, int]]:
    """(tokens, tiles) of the pieces of a sample that is too large; tiles without ids of their own follow at the end."""
    starts = np.flatnonzero(ids == TILE_START)[:n_tiles]
    ends = np.flatnonzero(ids == TILE_END)
    stops = np.array([ends[k] + 1 if (k := np.searchsorted(ends, s)) < len(ends) else len(ids) for s in starts], np.int64)
    pieces, at, done = [], 0, 0
    while at < len(ids):
        end = min(at + max_tokens, len(ids))
        if done + max_tiles < len(starts):
            end = min(end, int(starts[done + max_tiles]))
        k = int(np.searchsorted(starts, end)) - 1  # the last tile that starts before the end
        if k >= done and stops[k] > end and starts[k] > at:
            end = int(starts[k])
        inside = int(np.searchsorted(starts, end)) - done
        pieces.append((end - at, inside))
        at, done = end, done + inside
    rest = n_tiles - done
    while rest > 0:
        room = max_tiles - pieces[-1][1] if pieces else 0
        if room:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + min(room, rest))
            rest -= min(room, rest)
        else:
            pieces.append((0, 0))
    return pieces


def items_of(samples: DataFrame, max_tokens: int = MAX_TOKENS, max_tiles: int = MAX_TILES) -> DataFrame:
    """(sample_id, piece_no, n_pieces, n_tokens, n_tiles): whole samples, and the pieces of those over a capacity."""
    sized = measure(samples)
    over = (F.col("n_tokens") > max_tokens) | (F.col("n_tiles") > max_tiles)
    whole = sized.where(~over).select("sample_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "n_tokens", "n_tiles")
    large = samples.select("sample_id", "input_ids").join(sized.where(over), "sample_id").dropDuplicates(["sample_id"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sample, ids, n, tiles in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "input_ids", "n_tokens", "n_tiles"))):
                made = cut_sample(np.array((ids or [])[:n], np.int64), tiles, max_tokens, max_tiles)
                rows += [(sample, k, len(made), *p) for k, p in enumerate(made)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["sample_id", "piece_no", "n_pieces", "n_tokens", "n_tiles"])

    schema = "sample_id bigint, piece_no int, n_pieces int, n_tokens int, n_tiles int"
    return whole.unionByName(large.select("sample_id", "input_ids", "n_tokens", "n_tiles").mapInArrow(pieces, schema))


class Program:
    """The configuration linear program over a coarse histogram: its dual prices, a bound, and a fractional solution.

    How many bundles of each filling are needed so that every type is covered? Sizes are rounded down to ``COARSE`` units,
    so every filling of the real sizes is one here and each bound holds for them. Multiplicative weights: a type's weight
    falls with the share of its count that is covered; a knapsack dynamic program over units and tiles finds the filling of
    greatest weight (with any number of copies). As that is an exact best one, (weights x counts) / its weight bounds the
    program from below. It and near-best fillings from the same table are taken by fractions of what their types have left,
    so nothing is covered twice, until ``REST`` of the room is left, which is counted as bundles of one type each.
    ``value`` is that solution's number of bundles, ``bound`` the best bound, ``price`` its weights in bundles.
    """

    COARSE, TAKEN, NEAR, RATE, STEP, REST = 8, 32, 0.004, 4.0, 0.7, 0.004

    def __init__(self, sizes: list[tuple[int, int]], counts: list[int], units: int, tiles: int):
        self.units, self.tiles = units // self.COARSE, tiles
        cells: dict[tuple[int, int], list[int]] = {}
        for t, (u, m) in enumerate(sizes):
            cells.setdefault((u // self.COARSE, m), []).append(t)
        cells.pop((0, 0), None)  # takes no room here
        self.cells = sorted(cells)
        self.u, self.m = (np.array([c[k] for c in self.cells], np.int64) for k in (0, 1))
        self.n = np.array([sum(counts[t] for t in cells[c]) for c in self.cells], float)
        self.bound, self.value, self.tables = 0.0, 0.0, 0
        self.price = np.zeros(len(self.cells))
        if len(self.cells):
            self._solve()

    def table(self, weight: np.ndarray) -> np.ndarray:
        """best[u, m]: the greatest weight in u units and m tiles; a margin of minus infinity stands around it."""
        pad_u, pad_m = int(self.u.max()) + 1, int(self.m.max())
        best = np.full((pad_u + self.units + 1, pad_m + self.tiles + 1), -np.inf)
        wide = np.arange(self.tiles + 1) + pad_m
        flat = np.flatnonzero(self.u == 0)
        some = np.flatnonzero(self.u > 0)
        columns, w = wide - self.m[some][:, None], weight[some][:, None]
        for u in range(self.units + 1):
            row = best[pad_u + u]
            if u:
                row[pad_m:] = best[pad_u + u - 1, pad_m:]
            else:
                row[pad_m:] = 0.0
            if len(some):
                np.maximum(row[pad_m:], (best[(pad_u + u - self.u[some])[:, None], columns] + w).max(0), out=row[pad_m:])
            for t in flat:  # tiles without units: copies follow from smaller numbers of tiles of the same row
                for m in range(int(self.m[t]), self.tiles + 1):
                    row[pad_m + m] = max(row[pad_m + m], row[pad_m + m - self.m[t]] + weight[t])
        return best

    def filling(self, best: np.ndarray, weight: np.ndarray, near: float, rng: np.random.Generator) -> np.ndarray:
        """Copies of each type in a filling of greatest weight, or with choices at most ``near`` below it."""
        pad_u, pad_m = int(self.u.max()) + 1, int(self.m.max())
        u, m, out = self.units, self.tiles, np.zeros(len(self.u))
        while True:
            here = best[pad_u + u, pad_m + m]
            if here <= 1e-12:
                return out
            worth = best[pad_u + u - self.u, pad_m + m - self.m] + weight
            options = np.flatnonzero(worth >= here - near - 1e-12)
            if not len(options):  # unused room: a smaller place has the same weight
                u, m = (u - 1, m) if u and best[pad_u + u - 1, pad_m + m] >= here - near - 1e-12 else (u, m - 1)
                continue
            t = int(rng.choice(options)) if near else int(options[0])
            out[t] += 1
            u, m = u - int(self.u[t]), m - int(self.m[t])

    def _solve(self) -> None:
        rng = np.random.default_rng(40)
        room = self.u / self.units if self.units else np.zeros(len(self.n))
        tiled = self.m / self.tiles if self.tiles else np.zeros(len(self.n))

        def priced(weight: np.ndarray) -> np.ndarray:
            """The table of the weights; their bound is kept if it is the best so far, with the weights in bundles as prices."""
            best = self.table(weight)
            held = np.maximum(weight, 0.0)
            if (bound := float(self.n @ held) / float(best[-1, -1])) > self.bound:
                self.bound, self.price = bound, held / float(best[-1, -1])
            return best

        # prices by room alone: no filling holds more than a bundle's tokens, or tiles
        for weight in (room, tiled, (room + tiled) / 2):
            if weight.any():
                priced(weight)
        left, size = self.n.copy(), np.maximum(room, tiled)
        # what is left at last is counted as bundles of one type each
        while float(left @ size) > self.REST * float(self.n @ size):
            open_ = left > 1e-4 * self.n
            share = 1 - left / self.n
            weight = np.where(open_, (room + tiled) * np.exp(-self.RATE * (share - share[open_].min())), -np.inf)
            weight = weight / weight.max()
            best = priced(weight)
            self.tables += 1
            for k in range(self.TAKEN):
                filling = self.filling(best, weight, self.NEAR * float(best[-1, -1]) if k else 0.0, rng)
                held = np.flatnonzero(filling)
                part = float((left[held] / filling[held]).min())
                if part > 1e-7:
                    part *= self.STEP if k < self.TAKEN - 1 else 1.0
                    left[held] = np.maximum(0.0, left[held] - part * filling[held])
                    self.value += part
        copies = np.minimum(np.where(self.u > 0, self.units // np.maximum(self.u, 1), 1 << 30), np.where(self.m > 0, self.tiles // np.maximum(self.m, 1), 1 << 30))
        self.value += float((left / copies).sum())


class Plan:
    """Fillings with their number of bundles, for types of (token units, tiles) with counts."""

    #: Types that one pricing step looks at first, and how fast covered types lose weight.
    PRICED, RATE = 32, 0.35

    def __init__(self, cells: dict[tuple[int, int], int], units: int, tiles: int, most_types: int = MOST_TYPES, step: float = 0.34):
        self.units, self.tiles = units, tiles
        self.type_of: dict[tuple[int, int], int] = {}
        self.size: list[tuple[int, int]] = []
        self.count: list[int] = []
        self._types(cells, most_types)
        self.program = Program(self.size, self.count, units, tiles)
        # no packing needs fewer bundles than the program, nor than all tokens or tiles fill
        room = [sum(n * x[c] for x, n in cells.items()) / most for c, most in ((0, units), (1, tiles)) if most]
        self.bound = max([self.program.bound, *room])
        self.fillings = self._solve(step) if self.count else []

    def _types(self, cells: dict[tuple[int, int], int], most: int) -> None:
        """Cells with the same tiles that follow each other become a type of about equal counts; the largest gives its size."""
        total, goal = sum(cells.values()), max(1, most - self.tiles - 1)
        per_type = max(1, -(-total // goal)) if len(cells) > most else 1
        group: list[tuple[int, int]] = []
        filled = 0

        def close() -> None:
            nonlocal group, filled
            if group:
                for cell in group:
                    self.type_of[cell] = len(self.size)
                self.size.append(group[-1])
                self.count.append(filled)
            group, filled = [], 0

        for cell in sorted(cells, key=lambda c: (c[1], c[0])):
            if group and (group[-1][1] != cell[1] or filled >= per_type):
                close()
            group.append(cell)
            filled += cells[cell]
        close()

    def _price(self, types: np.ndarray, weight: np.ndarray, left: np.ndarray) -> dict[int, int]:
        """The filling of greatest weight from some types: a knapsack over token units and tiles, copies in powers of two."""
        entries = []
        for t in types:
            u, m = self.size[t]
            copies = int(min(left[t], self.units // u if u else 1 << 30, self.tiles // m if m else 1 << 30, 1 << 10))
            k = 1
            while copies > 0:
                take = min(k, copies)
                entries.append((int(t), take))
                copies -= take
                k *= 2
        best = np.zeros((self.units + 1, self.tiles + 1), np.float32)
        taken = np.zeros((len(entries), self.units + 1, self.tiles + 1), bool)
        for e, (t, k) in enumerate(entries):
            u, m = self.size[t][0] * k, self.size[t][1] * k
            with_it = best[: self.units + 1 - u, : self.tiles + 1 - m] + np.float32(weight[t] * k)
            np.greater(with_it, best[u:, m:], out=taken[e, u:, m:])
            np.maximum(best[u:, m:], with_it, out=best[u:, m:])
        u, m, filling = self.units, self.tiles, {}
        for e in range(len(entries) - 1, -1, -1):
            if taken[e, u, m]:
                t, k = entries[e]
                filling[t] = filling.get(t, 0) + k
                u, m = u - self.size[t][0] * k, m - self.size[t][1] * k
        return filling

    def _solve(self, step: float) -> list[tuple[dict[int, int], int]]:
        """The program rounded: whole bundles that cover all counts once.

        A type's weight is the room it takes, times a factor that falls as its covered share rises, as in the program, so
        that what remains keeps the mixture of the whole. Each step takes part of the bundles its filling allows, rounded down to whole ones, one at least; so
        nothing is covered twice. Types are priced some at a time, drawn by count and shortage; a filling that leaves room
        in both capacities is priced again over four times as many, in the end over all that are open, which is exact.
        """
        need = np.array(self.count, np.int64)
        left = need.copy()
        room = np.array([u / self.units + m / self.tiles + 1e-4 for u, m in self.size])
        hard = np.array([max(u / self.units, m / self.tiles) for u, m in self.size])
        rng = np.random.default_rng(8192)
        solution: dict[tuple, int] = {}
        while True:
            open_ = np.flatnonzero(left)
            if not len(open_):
                return sorted(((dict(k), x) for k, x in solution.items()), key=lambda s: (-s[1], sorted(s[0].items())))
            share = 1 - left[open_] / need[open_]
            weight = np.zeros(len(need))
            weight[open_] = room[open_] * np.exp(-self.RATE * (share - share.min()))
            # types as often as they occur and are short, always with the largest that is left
            chance = left[open_] * np.exp(-(share - share.min()))
            order = open_[np.argsort(-np.log(rng.random(len(open_))) / chance, kind="stable")]
            most = self.PRICED
            while True:
                types = order[:most]
                types = np.unique(np.append(types, open_[np.argmax(hard[open_])]))
                filling = self._price(types, weight, left)
                units, tiles = (sum(self.size[t][c] * k for t, k in filling.items()) for c in (0, 1))
                if most >= len(open_) or units >= self.units or tiles >= self.tiles:
                    break
                most *= 4
            copies = max(1, int(step * min(int(left[t]) // k for t, k in filling.items())))
            key = tuple(sorted(filling.items()))
            solution[key] = solution.get(key, 0) + copies
            for t, k in filling.items():
                left[t] -= k * copies

    def slots(self) -> dict[int, np.ndarray]:
        """type -> rows (first rank, copies of the type in a bundle, first bundle, first place), by first rank."""
        rows: dict[int, list] = {}
        used, bundle = {}, 0
        for filling, copies in self.fillings:
            place = 0
            for t in sorted(filling, key=lambda t: (-self.size[t][0], t)):
                k = filling[t]
                rows.setdefault(t, []).append((used.get(t, 0), k, bundle, place))
                used[t] = used.get(t, 0) + k * copies
                place += k
            bundle += copies
        return {t: np.array(r, np.int64) for t, r in rows.items()}


def pack(samples: DataFrame, max_tokens: int = MAX_TOKENS, max_tiles: int = MAX_TILES, unit: int = UNIT, most_types: int = MOST_TYPES) -> DataFrame:
    """(sample_id, piece_no, n_pieces, n_tokens, n_tiles, bundle_id, place) of every sample or piece of a sample."""
    spark = samples.sparkSession
    items = items_of(samples, max_tokens, max_tiles)
    # where the unit does not divide the capacity, an item of nearly all tokens takes all units
    items = items.withColumn("units", F.least(F.ceil(F.col("n_tokens") / unit), F.lit(max_tokens // unit)).cast("int"))
    items = cut(items.withColumn("salt", F.pmod(F.xxhash64("sample_id", "piece_no"), F.lit(SALTS)).cast("int")))
    # at most (max_tokens / unit + 1) x (max_tiles + 1) rows, whatever the data
    cells = {(r.units, r.n_tiles): r.n for r in items.groupBy("units", "n_tiles").agg(F.count("*").alias("n")).collect()}
    plan = Plan(cells, max_tokens // unit, max_tiles, most_types)
    shared = spark.sparkContext.broadcast(plan.slots())
    typed = spark.createDataFrame([(u, m, t) for (u, m), t in plan.type_of.items()], "units int, n_tiles int, type int")
    salted = items.groupBy("units", "n_tiles", "salt").agg(F.count("*").alias("n")).join(F.broadcast(typed), ["units", "n_tiles"])
    # at most SALTS rows a cell, so a type's window is bounded by the histogram
    earlier = Window.partitionBy("type").orderBy("units", "n_tiles", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.select("units", "n_tiles", "salt", "type", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("units", "n_tiles", "salt").orderBy("sample_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, ["units", "n_tiles", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            bundles, places = [], []
            for t, first, r in zip(*(batch.column(c).to_pylist() for c in ("type", "offset", "rank"))):
                rows = slots[t]
                rank = first + r
                start, k, bundle, at = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                bundles.append(int(bundle + (rank - start) // k))
                places.append(int(at + (rank - start) % k))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sample_id", "piece_no", "n_pieces", "n_tokens", "n_tiles")), pa.array(bundles, pa.int64()), pa.array(places, pa.int32())], ["sample_id", "piece_no", "n_pieces", "n_tokens", "n_tiles", "bundle_id", "place"])

    schema = "sample_id bigint, piece_no int, n_pieces int, n_tokens int, n_tiles int, bundle_id bigint, place int"
    return ranked.select("sample_id", "piece_no", "n_pieces", "n_tokens", "n_tiles", "type", "offset", "rank").mapInArrow(place, schema)


def p1_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "packing_sample"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id) of the samples that stand in the bundles in pieces."""
    return p1_bundles(spark, sf_dir).where("n_pieces > 1").select("sample_id").distinct()
