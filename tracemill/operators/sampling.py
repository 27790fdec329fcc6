"""Samples, shards, repeats and mixtures. Order without a given column is hash order."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.pairs import hash_order


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in hash order; a top-n, so each task passes on ``n`` rows only."""
    return df.orderBy(hash_order(key, seed=seed), key).limit(n)


def numbered(df: DataFrame, order: str, name: str = "rn", rows_per_range: int = 500_000) -> DataFrame:
    """Adds the 0-based place of each row in the order of a numeric column with distinct values.

    A window over the whole table would be one task; here rows are counted per range of the column first, and a row's
    place is its place in the range plus the rows of the ranges before. The ranges are quantiles, so they hold about
    ``rows_per_range`` rows however many there are and however the values are spread. Ranges are told by doubles, places
    inside them by the column itself, so large keys that share a double stay apart.
    """
    buckets = max(8, -(-df.count() // rows_per_range))
    bounds = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    if not bounds:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    splits = [float("-inf"), *bounds, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="__v", outputCol="__b").transform(df.withColumn("__v", F.col(order).cast("double"))).drop("__v")
    counts = ranged.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # a row a range
    place = F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    return ranged.join(before, "__b").withColumn(name, (F.col("__o") + place).cast("bigint")).drop("__b", "__o")


def hash_ranked(df: DataFrame, key: str, by: str | None = None, seed: int = 0, digits: int = 3) -> DataFrame:
    """Adds ``__rank``, the 0-based place in hash order (of each ``by``), and ``__n``, how many rows there are.

    The first ``digits`` of the hash deal the rows to 16^digits parts that follow each other, so no source is one group:
    a place is the one in the part plus the rows of the parts before, of which there are at most 16^digits a source.
    """
    group = [by] if by else []
    hashed = df.withColumn("__h", hash_order(key, seed=seed)).withColumn("__p", F.left("__h", F.lit(digits)))
    counts = hashed.groupBy(*group, "__p").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*group)
    before = counts.select(*group, "__p", F.coalesce(F.sum("__c").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__c").over(whole).alias("__n"))
    same = hashed["__p"].eqNullSafe(before["__p"]) & (hashed[by].eqNullSafe(before[by]) if by else F.lit(True))
    joined = hashed.join(before, same).drop(before["__p"], *([before[by]] if by else []))
    place = F.row_number().over(Window.partitionBy(*group, "__p").orderBy("__h", key)) - 1
    return joined.withColumn("__rank", (F.col("__o") + place).cast("bigint")).drop("__h", "__p", "__o")


def stride_sample(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every k-th row, k the number of rows over ``most``; may keep more than ``most``."""
    step = max(1, df.count() // most)
    return numbered(df, order).where(F.col("rn") % step == 0).drop("rn")


def rank_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds ``shard``: contiguous, the first shards one row longer where the rows do not divide."""
    total = df.count()
    size, extra = divmod(total, shards)
    rn = F.col("rn")
    long = extra * (size + 1)
    shard = F.when(rn < long, F.floor(rn / (size + 1))).otherwise(extra + F.floor((rn - long) / max(1, size)))
    return numbered(df, order).withColumn("shard", shard.cast("int")).drop("rn")


def repeat_rows(df: DataFrame, source: str, order: str, times: DataFrame) -> DataFrame:
    """Rows of each source as often as ``times`` (source, repeat_time) says: below one the first part in hash order, else whole repeats."""
    joined = df.join(times.select(source, "repeat_time"), source)
    # only sources that are cut need places
    part = hash_ranked(joined.where("repeat_time < 1"), order, source).where(F.col("__rank") < F.floor(F.col("__n") * F.col("repeat_time"))).drop("__rank", "__n")
    copies = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor("repeat_time").cast("int")))
    return part.unionByName(joined.where("repeat_time >= 1")).withColumn("copy", F.explode(copies)).drop("repeat_time")


def head(df: DataFrame, order: str, most: int, blank: str | None = None) -> DataFrame:
    """The first ``most`` rows in the order of a column; a top-n, so each task passes on ``most`` rows only.

    Rows whose ``blank`` column is null or blank count against the limit, and are left out afterwards.
    """
    first = df.orderBy(F.asc(order)).limit(most)
    return first if blank is None else first.where(F.trim(F.coalesce(F.col(blank), F.lit(""))) != "")


def round_robin(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Adds ``worker``: row k of the order goes to worker k mod ``workers``, as in slices [w::n]."""
    return numbered(df, order).withColumn("worker", (F.col("rn") % workers).cast("int")).drop("rn")


def even_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds ``shard``: contiguous shards of equal size; the last rows, which do not fill a shard each, are dropped."""
    size = df.count() // shards
    rn = F.col("rn")
    return numbered(df, order).where(rn < size * shards).withColumn("shard", F.floor(rn / max(1, size)).cast("int")).drop("rn")


def few_shots(asked: DataFrame, key: str, pool: DataFrame, pool_key: str, shots: int, seed: int = 0, cells: int = 64) -> DataFrame:
    """(key, shots): for every asked row ``shots`` different rows of the pool, in an order that depends on the row.

    The pool is brought down to ``cells`` x ``shots`` candidates in hash order, a bounded list, of which each row takes the
    run that its own hash points at; the pool is never joined with the asked rows.
    """
    names = [r[0] for r in pool.orderBy(hash_order(pool_key, seed=seed), pool_key).limit(cells * shots).select(pool_key).collect()]
    if not names:
        return asked.select(key).withColumn("shots", F.array().cast(f"array<{pool.schema[pool_key].dataType.simpleString()}>"))
    many = F.array(*(F.lit(x) for x in names))
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(len(names)))
    picked = F.transform(F.sequence(F.lit(0), F.lit(min(shots, len(names)) - 1)), lambda i: F.get(many, ((at + i) % len(names)).cast("int")))
    return asked.select(key, picked.alias("shots"))


def mixture_weights(sizes: DataFrame, size: str = "n", sqrt: bool = True) -> DataFrame:
    """Adds ``weight``: a source's share of all (square roots of) sizes. One row a source, so the window is small."""
    value = F.sqrt(size) if sqrt else F.col(size).cast("double")
    return sizes.withColumn("weight", F.round(value / F.sum(value).over(Window.partitionBy()), 6))


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0, digits: int = 3) -> DataFrame:
    """(draw, key): ``n`` draws with replacement by weight: hashed uniforms against cumulative weights, found cell by cell.

    Rows are dealt to 16^digits cells by hash; a draw finds its cell among their sums, which are as many whatever the data,
    and its row among the rows of that cell. Rows without weight are never drawn.
    """
    hexed = lambda c, k: F.conv(F.substring(hash_order(c, seed=seed), 1, k), 16, 10)
    celled = df.select(key, F.coalesce(F.col(weight), F.lit(0)).cast("double").alias("w")).where("w > 0").withColumn("cell", hexed(key, digits).cast("int"))
    sums = celled.groupBy("cell").agg(F.sum("w").alias("all"))
    base = sums.select("cell", "all", (F.sum("all").over(Window.orderBy("cell")) - F.col("all")).alias("lo"))  # a row a cell
    total = base.agg(F.max(F.col("lo") + F.col("all")).alias("total"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (hexed(F.col("id").cast("string"), 13).cast("double") / float(16**13)).alias("u")).join(F.broadcast(total))  # one row
    draws = draws.select("draw", (F.col("u") * F.col("total")).alias("u"))
    found = draws.join(F.broadcast(base), (draws.u >= base.lo) & (draws.u < base.lo + base["all"])).select("draw", (F.col("u") - F.col("lo")).alias("u"), "cell")
    items = celled.withColumn("hi", F.sum("w").over(Window.partitionBy("cell").orderBy(key)))
    hit = found.join(items, "cell")
    return hit.where((F.col("u") >= F.col("hi") - F.col("w")) & (F.col("u") < F.col("hi"))).select("draw", key)


def length_grouped(df: DataFrame, key: str, length: str, batch: int, world: int, megabatch: int = 50, seed: int = 0) -> DataFrame:
    """(key, length, mega, chunk, place): rows in hash order form megabatches, whose rows go to ``world`` chunks of even total length.

    Inside a megabatch rows are taken by falling length, each by the chunk that is shortest so far among those with
    room; every megabatch but the last has batch x world x megabatch rows, so its group is bounded.
    """
    size = batch * world * megabatch
    hashed = hash_ranked(df.select(key, length), key, seed=seed).withColumn("mega", F.floor(F.col("__rank") / size).cast("int")).drop("__rank", "__n")
    key_type = df.schema[key].dataType.simpleString()

    def spread(rows):
        rows = rows.sort_values([length, key], ascending=[False, True], kind="stable")
        room = -(-len(rows) // world)
        total, filled, chunk, place = [0] * world, [0] * world, [], []
        for x in rows[length]:
            c = min((k for k in range(world) if filled[k] < room), key=lambda k: (total[k], k))
            chunk.append(c)
            place.append(filled[c])
            total[c] += int(x)
            filled[c] += 1
        return rows.assign(chunk=chunk, place=place)[[key, length, "mega", "chunk", "place"]]

    return hashed.withColumn(length, F.coalesce(F.col(length), F.lit(0)).cast("bigint")).groupBy("mega").applyInPandas(spread, f"{key} {key_type}, {length} bigint, mega int, chunk int, place int")
