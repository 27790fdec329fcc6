"""Readers and writers: tolerant JSON lines, registries, criteria lists, conversations, and resumable sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.text import present, strip
from tracemill.sources.schemas import ALIASES, IMAGE_ALIASES

_BRACES = r"(?s)\{.*\}"


def json_repaired(c: Column, schema: str) -> Column:
    """A JSON text as a struct: as it is, without commas at its end, or from its first to its last brace; null if none parses."""
    good = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(good(c), good(F.regexp_replace(c, r"[,\s]+$", "")), good(F.regexp_extract(c, _BRACES, 0)))


def read_jsonl(spark: SparkSession, path: str, schema: str, malformed: str = "fail") -> DataFrame:
    """JSON lines with blank lines skipped and trailing commas forgiven.

    ``malformed``: ``fail`` raises, ``drop`` leaves the line out, ``keep`` gives a row of nulls with the line in
    ``_corrupt_record`` (the column is null for good lines and exists only then).
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parsed = lines.select("value", F.coalesce(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)), F.from_json(F.when(F.try_parse_json(F.regexp_replace("value", r"[,\s]+$", "")).isNotNull(), F.regexp_replace("value", r"[,\s]+$", "")), schema)).alias("r"))
    if malformed == "drop":
        return parsed.where("r IS NOT NULL").select("r.*")
    if malformed == "keep":
        return parsed.select("r.*", F.when(F.col("r").isNull(), F.col("value")).alias("_corrupt_record"))
    checked = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select("r.*")


def coalesce_aliases(df: DataFrame, names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """One column per field from whichever of its names a table has; an empty text counts as missing."""
    out = {}
    for field, aliases in names.items():
        there = [F.col(a) for a in aliases if a in df.columns]
        if there:
            out[field] = present(*there)
    drop = [a for f, aliases in names.items() if f in out for a in aliases if a in df.columns and a != f]
    return df.withColumns(out).drop(*drop)


def image_list(df: DataFrame, names: tuple[str, ...] = IMAGE_ALIASES) -> Column:
    """All images of a record in order, each once: text columns (a JSON array or one path), arrays, or structs with url or path."""
    parts = []
    for name, kind in df.dtypes:
        if name not in names:
            continue
        c = F.col(name)
        if kind == "string":
            many = F.from_json(F.when(F.startswith(strip(c), F.lit("[")), c), "array<string>")
            parts.append(F.coalesce(many, F.when(c != "", F.array(c))))
        elif kind == "array<string>":
            parts.append(c)
        elif kind.startswith("array<struct"):
            names_inside = [f for f in ("url", "path") if f"{f}:string" in kind]
            if names_inside:
                parts.append(F.transform(c, lambda x: present(*(x[f] for f in names_inside))))  # noqa: B023
        elif kind.startswith("struct"):
            there = [c[f] for f in ("url", "path") if f"{f}:string" in kind]
            parts.append(F.array(present(*there)) if there else F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(p, empty) for p in parts))) if parts else empty, lambda x: x.isNotNull() & (x != "")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(ds_name, root, annotation, repeat_time, data_augment, max_dynamic_patch) of a registry in one JSON file."""
    from tracemill.sources.schemas import SCHEMAS

    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", SCHEMAS["registry"])).alias("ds_name", "s")).select("ds_name", "s.*")


def criteria_pairs(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(parent, children) from lines ``Parent：child、child``; also with ASCII signs. A repeated parent's last line counts."""
    parts = F.split("value", "[：:]", 2)
    children = F.array_distinct(F.filter(F.transform(F.split(F.get(parts, 1), "[、,;；]"), strip), lambda x: x != ""))
    rows = lines.where(F.col("value").rlike("[：:]")).select(strip(F.get(parts, 0)).alias("parent"), children.alias("children"), order)
    last = Window.partitionBy("parent").orderBy(F.desc(order))
    return rows.where("parent <> ''").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("parent", "children")


def conversations_without_system(df: DataFrame, key: str, conversations: str) -> DataFrame:
    """The conversations without a leading system turn, numbered from 0 in the order of the key."""
    from tracemill.functions.prompts import without_system
    from tracemill.operators.sampling import numbered

    return numbered(df.withColumn(conversations, without_system(F.col(conversations))), key, "id")


def first_question(df: DataFrame) -> Column:
    """The question field, or what the human said first."""
    human = F.filter("conversations", lambda m: m["sender"] == "human")
    return present(F.col("question"), F.get(human, F.lit(0))["value"])


def data_url(content: Column, mime: Column) -> Column:
    """A data URL; the engine's line breaks inside base64 are taken out, as they do not belong there."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def scene_frames(df: DataFrame, scenes: str) -> DataFrame:
    """(key, value) of map<scene, map<frame, value>>; the key is ``scene_frame`` and its first value in name order counts."""
    flat = df.select(F.explode(scenes).alias("scene", "frames")).select("scene", F.explode("frames").alias("frame", "value"))
    return flat.groupBy(F.concat_ws("_", "scene", "frame").alias("key")).agg(F.min_by("value", F.struct("scene", "frame")).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, committed as a whole; modes: ``append`` adds, ``ignore`` keeps what is there, ``overwrite`` replaces."""
    df.write.mode(mode).json(path)


def write_counts(counts: DataFrame, key: str, count: str, path: str) -> None:
    """Text lines ``key<TAB>count``, the most frequent first."""
    ordered = counts.orderBy(F.desc(count), F.asc(key))
    ordered.select(F.concat_ws("\t", key, F.col(count).cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tables as one, by column names; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of files that each are one JSON array; each file is one task's work."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"array<struct<{_colons(schema)}>>")).alias("r")).select("r.*")


def _colons(schema: str) -> str:
    """``a int, b string`` as ``a:int,b:string``, by the engine's own parser."""
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def json_array_to_lines(spark: SparkSession, source: str, schema: str, target: str) -> None:
    """A JSON array as JSON lines."""
    write_jsonl(read_json_array(spark, source, schema), target)


def read_json_object(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """(key, fields) of files that each are one JSON object of records."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{_colons(value_schema)}>>")).alias(key, "r")).select(key, "r.*")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV files of a declared schema, with quoted line ends."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"')


def read_config(path: str) -> dict:
    """A configuration file on the driver: JSON, or YAML where a parser for it is installed."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML configuration needs the yaml package") from e
        return yaml.safe_load(text)


#: File endings of pictures and videos.
PICTURES, VIDEOS = ("jpg", "jpeg", "png", "gif", "bmp", "webp"), ("mp4", "avi", "mov", "mkv", "webm", "gif")


def read_media(spark: SparkSession, path: str, endings: tuple[str, ...] = PICTURES) -> DataFrame:
    """(path, name, length, content) of the files with these endings below a folder; decoding is left to a provider."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(video, frame, content) of a folder of frame folders, frames numbered by their names (-1 without a number)."""
    from tracemill.functions.inputs import frame_number

    files = read_media(spark, folder, ("jpg",))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), frame_number(F.col("name")).alias("frame"), "content")


def of_kind(df: DataFrame, kind: str, column: str = "data_type") -> DataFrame:
    """The records of one kind, such as ``video``."""
    return df.where(F.col(column) == kind)


def fetch_frames(df: DataFrame, key: str, video: str, indices: str, fetch, result_type: str = "array<binary>") -> DataFrame:
    """(key, frames): what ``fetch(video, indices)`` gives for each record, a provider that runs in the tasks; null where it raises."""
    key_type = df.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        def one(v, i):
            try:
                return fetch(v, list(i))
            except Exception:  # noqa: BLE001  a file that cannot be read has no frames
                return None

        for x in frames:
            yield pd.DataFrame({"key": x["key"], "frames": [one(v, i) for v, i in zip(x["v"], x["i"])]})

    chosen = df.select(F.col(key).alias("key"), F.col(video).alias("v"), F.col(indices).alias("i"))
    return chosen.mapInPandas(run, f"key {key_type}, frames {result_type}").withColumnRenamed("key", key)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_lines, n_good, n_malformed) of JSON lines; blank lines do not count."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    good = F.coalesce(F.try_parse_json("value"), F.try_parse_json(F.regexp_replace("value", r"[,\s]+$", ""))).isNotNull()
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_malformed"))


def write_parts(df: DataFrame, path: str, parts: int, by: str, mode: str = "error") -> None:
    """JSON lines in one folder a part (``part=0`` ...); a record's part follows from its key."""
    df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts))).write.mode(mode).partitionBy("part").json(path)


def write_many(df: DataFrame, outputs: dict[str, list[Column]], root: str, where: dict[str, Column] | None = None, mode: str = "error") -> None:
    """Several JSON line outputs of one pass: the rows are computed once, stored, and each output is read from there."""
    from tracemill.session import cut, drop

    stored = cut(df)
    for name, columns in outputs.items():
        chosen = stored.where(where[name]) if where and name in where else stored
        write_jsonl(chosen.select(*columns), f"{root}/{name}", mode)
    drop(stored)


def caption_lines(df: DataFrame, path: str, caption: str) -> DataFrame:
    """(value): JSON lines ``{file name: caption}``."""
    return df.select(F.to_json(F.create_map(F.regexp_extract(path, r"([^/]*)$", 1), F.col(caption))).alias("value"))


def valid_or_logged(df: DataFrame, valid: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that are valid, the others with the reason); no row is replaced by another."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", reason)


def write_items(df: DataFrame, path: str, questions_only: bool = False, keys: tuple[str, ...] = ("image", "question", "answer"), mode: str = "error") -> None:
    """All records as JSON lines, or their different questions only."""
    write_jsonl(df.select(*keys).distinct() if questions_only else df, path, mode)


def nested_tree(rows: list[tuple[str, str | None, float, int]]) -> dict:
    """Adjacency rows (name, parent, distance, size) of one bounded tree as nested {name, distance, size, children}; a ValueError if there is not one root."""
    nodes = {name: {"name": name, "distance": distance, "size": size, "children": []} for name, _, distance, size in rows}
    roots = [nodes[name] for name, parent, *_ in rows if parent is None]
    if len(roots) != 1:
        raise ValueError(f"{len(roots)} roots")
    for name, parent, *_ in rows:
        if parent is not None:
            nodes[parent]["children"].append(nodes[name])
    return roots[0]


def write_tree(rows: list[tuple[str, str | None, float, int]], path: str) -> None:
    """A tree as one JSON file, written by the driver."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump(nested_tree(rows), f, ensure_ascii=False, indent=2)
