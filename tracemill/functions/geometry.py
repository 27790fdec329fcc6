"""Frame indices, tiles and grids as columns; decoding pictures is a provider's work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(n: Column) -> Column:
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1))


def frame_indices_middle(length: Column, count: Column) -> Column:
    """The middle frame of each of ``count`` even stretches of a video, the last one repeated where it is shorter."""
    used = F.least(count, length).cast("int")
    edge = lambda k: F.floor(k * length / F.when(used > 0, used)).cast("int")
    picked = F.transform(_range(used), lambda k: F.floor((edge(k) + edge(k + 1) - 1) / 2).cast("int"))
    return F.when(used < 1, picked).otherwise(F.concat(picked, F.array_repeat(F.element_at(F.concat(F.array(F.lit(0)), picked), -1), count.cast("int") - used)))


def frame_indices_drawn(length: Column, count: Column, key: Column, seed: int = 0) -> Column:
    """A frame of each of ``count`` even stretches, drawn by the hash of key, seed and stretch, so that it repeats; the last one fills up."""
    used = F.least(count, length).cast("int")
    edge = lambda k: F.floor(k * length / F.when(used > 0, used)).cast("int")
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), k.cast("string"))), 1, 7), 16, 10).cast("int")
    picked = F.transform(_range(used), lambda k: (edge(k) + F.pmod(drawn(k), F.greatest(F.lit(1), edge(k + 1) - edge(k)))).cast("int"))
    return F.when(used < 1, picked).otherwise(F.concat(picked, F.array_repeat(F.element_at(F.concat(F.array(F.lit(0)), picked), -1), count.cast("int") - used)))


def frame_indices_fps(length: Column, input_fps: float, fps: float, most: int = -1) -> Column:
    """Frames at ``fps`` pictures a second, from the middle of the first interval on, at most ``most``."""
    duration = length / input_fps
    step = 1 / fps
    n = F.floor(duration / step - 0.5 + 0.5).cast("int")
    frames = F.transform(_range(n), lambda k: F.bround((k + 0.5) * step * input_fps, 0).cast("int"))
    inside = F.filter(frames, lambda x: x < length)
    return F.slice(inside, 1, most) if most > 0 else inside


def frame_indices_fixed(length: Column, count: Column, start: int = 0) -> Column:
    """As many indices as stretches, each ``start`` frames behind its stretch's beginning."""
    return F.transform(_range(count), lambda k: F.least(F.floor(k * length / count).cast("int") + start, (length - 1).cast("int")))


def segment_offsets(first: Column, last: Column, count: int) -> Column:
    """The middle of each of ``count`` even segments of a clip, rounded half to even."""
    size = (last - first).cast("double") / count
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (first + size / 2 + F.bround(size * k, 0)).cast("int"))


def clip_bounds(clip: Column, fps: Column, frames: Column) -> Column:
    """struct<first, last> frame of [start, end] seconds inside a video."""
    first = F.greatest(F.lit(0), F.floor(F.get(clip, 0) * fps)).cast("int")
    return F.struct(first.alias("first"), F.least(frames - 1, F.floor(F.get(clip, 1) * fps)).cast("int").alias("last"))


def ratios(least: int = 1, most: int = 12) -> list[tuple[int, int]]:
    """Grids of ``least`` to ``most`` tiles, the smaller first."""
    return sorted({(w, h) for w in range(1, most + 1) for h in range(1, most + 1) if least <= w * h <= most}, key=lambda r: (r[0] * r[1], r))


def closest_ratio(width: Column, height: Column, grids: list[tuple[int, int]], size: int = 448) -> Column:
    """struct<w, h>: the grid whose ratio is nearest; an equally near later one wins if the picture has more than half its area."""
    aspect, area = width / height, width.cast("double") * height
    table = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(w / h).alias("r")) for w, h in grids))
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("w"), F.lit(1).alias("h"))

    def fold(acc: Column, g: Column) -> Column:
        d = F.abs(aspect - g["r"])
        wins = (d < acc["d"]) | ((d == acc["d"]) & (area > 0.5 * size * size * g["w"] * g["h"]))
        return F.when(wins, F.struct(d.alias("d"), g["w"].alias("w"), g["h"].alias("h"))).otherwise(acc)

    best = F.aggregate(table, start, fold)
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def tile_boxes(w: Column, h: Column, size: int = 448) -> Column:
    """array<struct<left, top, right, bottom>> of a grid's tiles, row by row."""
    left, top = lambda k: (k % w) * size, lambda k: F.floor(k / w).cast("int") * size
    return F.transform(_range(w * h), lambda k: F.struct(left(k).alias("left"), top(k).alias("top"), (left(k) + size).alias("right"), (top(k) + size).alias("bottom")))


def tile_count(w: Column, h: Column, thumbnail: bool = True) -> Column:
    return w * h + F.when(F.lit(thumbnail) & (w * h > 1), 1).otherwise(0)


def tiles_per_image(most: Column, images: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(most / F.when(images > 0, images)).cast("int"))


def stitch_offsets(position: Column, columns: int, cell: int) -> Column:
    """struct<x, y> of a picture in a grid that is filled row by row."""
    return F.struct((position % columns * cell).alias("x"), (F.floor(position / columns).cast("int") * cell).alias("y"))


def square_box(width: Column, height: Column) -> Column:
    """struct<side, left, top>: the square that a picture is set into, centred; odd rests go right and down."""
    side = F.greatest(width, height)
    return F.struct(side.cast("int").alias("side"), F.floor((side - width) / 2).cast("int").alias("left"), F.floor((side - height) / 2).cast("int").alias("top"))
