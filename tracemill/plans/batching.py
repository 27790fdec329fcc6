"""Queries on prompts, labels, batches, streams of samples and picture geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import geometry as V
from tracemill.functions import prompts as M
from tracemill.functions import scores as S
from tracemill.functions.text import tokens
from tracemill.operators import packing as K
from tracemill.plans.registry import conversations, ctes, query, tokens_sql
from tracemill.session import records, table
from tracemill.streaming.packing import windowed_counts

_BARE = f"{ctes('c')}, t AS (SELECT conv_id, CASE WHEN conversations[1].sender = 'system' THEN conversations[2:] ELSE conversations END AS m FROM c)"
_TURNS = f"{_BARE}, x AS (SELECT conv_id, generate_subscripts(m, 1) - 1 AS i, unnest(m).value AS v FROM t)"


def _turns(spark, d):
    """(conv_id, m): the turns without a system turn, as array<struct<role, text>>."""
    c = conversations(spark, d, "conversations")
    m = F.transform(M.without_system(F.col("conversations")), lambda x: F.struct(x["sender"].alias("role"), x["value"].alias("text")))
    return c.select("conv_id", m.alias("m"))


@query("drop_system_turn", f"{_BARE} SELECT conv_id, CAST(len(m) AS INTEGER) AS n_turns, m[1].sender AS first_sender FROM t")
def drop_system_turn(spark, d):
    return _turns(spark, d).select("conv_id", F.size("m").alias("n_turns"), F.get("m", F.lit(0))["role"].alias("first_sender"))


def _rendered(spark, d, template):
    return _turns(spark, d).where(F.size("m") > 0).select("conv_id", M.render(F.col("m"), template).alias("prompt"))


def _render_sql(start: str, said: str, waiting: str) -> str:
    return f"{_TURNS} SELECT conv_id, {start} || string_agg(CASE WHEN v <> '' THEN {said} ELSE {waiting} END, '' ORDER BY i) AS prompt FROM x GROUP BY conv_id"


_ROLE = "CASE WHEN i % 2 = 0 THEN '{}' ELSE '{}' END"
_SYS = "You are a helpful assistant."


@query("render_chatml", _render_sql(f"'<|im_start|>system' || chr(10) || '{_SYS}<|im_end|>' || chr(10)", "CASE WHEN i % 2 = 0 THEN '<|im_start|>user' ELSE '<|im_start|>assistant' END || chr(10) || v || '<|im_end|>' || chr(10)", "CASE WHEN i % 2 = 0 THEN '<|im_start|>user' ELSE '<|im_start|>assistant' END || chr(10)"))
def render_chatml(spark, d):
    return _rendered(spark, d, M.Template("chatml", "<|im_start|>system\n{system}", roles=("<|im_start|>user", "<|im_start|>assistant"), first="<|im_end|>"))


@query("render_chat_im", _render_sql(f"'<|im_start|>system' || chr(10) || '{_SYS}<|im_end|>'", "CASE WHEN i % 2 = 0 THEN '<|im_start|>user' ELSE '<|im_start|>assistant' END || chr(10) || v || '<|im_end|>'", "CASE WHEN i % 2 = 0 THEN '<|im_start|>user' ELSE '<|im_start|>assistant' END || chr(10)"))
def render_chat_im(spark, d):
    return _rendered(spark, d, M.TEMPLATES["chat_im"])


@query("render_colon_two", _render_sql(f"'{_SYS} '", _ROLE.format("USER", "ASSISTANT") + " || ': ' || v || " + _ROLE.format(" ", "</s>"), _ROLE.format("USER", "ASSISTANT") + " || ':'"))
def render_colon_two(spark, d):
    return _rendered(spark, d, M.Template("add_colon_two", first=" ", second="</s>"))


@query("render_llama2", _render_sql(f"'[INST] <<SYS>>{_SYS}<</SYS>>'", "CASE WHEN i = 0 THEN v || ' ' ELSE " + _ROLE.format("[INST]", "[/INST]") + " || ' ' || v || " + _ROLE.format(" ", " </s><s>") + " END", _ROLE.format("[INST]", "[/INST]")))
def render_llama2(spark, d):
    return _rendered(spark, d, M.Template("llama2", "[INST] <<SYS>>{system}<</SYS>>", roles=("[INST]", "[/INST]"), first=" ", second=" </s><s>"))


@query("render_all_styles")
def render_all_styles(spark, d):
    turns = _turns(spark, d).where(F.size("m") > 0)
    rendered = [F.struct(F.lit(s).alias("style"), M.render(F.col("m"), M.Template(s, second="</s>")).alias("prompt")) for s in M.STYLES]
    return turns.select("conv_id", F.explode(F.array(*rendered)).alias("r")).select("conv_id", "r.*")


@query("to_chat_messages", f"{_TURNS} SELECT conv_id, -1 AS place, 'system' AS role, '{_SYS}' AS content FROM (SELECT DISTINCT conv_id FROM c) UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER), CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, v FROM x WHERE i % 2 = 0 OR v IS NOT NULL")
def to_chat_messages(spark, d):
    messages = _turns(spark, d).select("conv_id", F.posexplode(M.chat_messages(F.col("m"), _SYS)).alias("place", "x"))
    return messages.select("conv_id", (F.col("place") - 1).alias("place"), "x.role", "x.content")


@query("turn_pairs", f"{_TURNS} SELECT a.conv_id, CAST(a.i // 2 AS INTEGER) AS pair_no, a.v AS user_text, b.v AS bot_text FROM x a LEFT JOIN x b ON a.conv_id = b.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0")
def turn_pairs(spark, d):
    p = _turns(spark, d).select("conv_id", F.posexplode(M.turn_pairs(F.col("m"))).alias("pair_no", "x"))
    return p.select("conv_id", "pair_no", F.col("x.user").alias("user_text"), F.col("x.bot").alias("bot_text"))


@query("frame_tags", "SELECT p_partkey, array_to_string(list_transform(range(1, CAST(p_size % 6 + 1 AS BIGINT)), lambda i: 'Frame-' || i || ': <image>' || chr(10)), '') AS tags FROM part")
def frame_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", M.frame_tags(F.col("p_size") % 6).alias("tags"))


@query("expand_image_tokens", f"""{ctes('c')}, x AS (SELECT conv_id, generate_subscripts(conversations, 1) - 1 AS pos, unnest(conversations).value AS v FROM c)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, replace(v, '<image>', '<img>' || repeat('<IMG_CONTEXT>', 2) || '</img>') AS text FROM x WHERE v IS NOT NULL""")
def expand_image_tokens(spark, d):
    x = conversations(spark, d, "conversations").select("conv_id", F.posexplode("conversations").alias("pos", "m")).where("m.value IS NOT NULL")
    tiles = F.array_repeat(F.lit(1), F.size(F.split("m.value", "<image>")))  # one tile for every image there is
    return x.select("conv_id", "pos", M.expand_image_tokens(F.col("m.value"), tiles, 2).alias("text"))


# ---- labels and batches ----------------------------------------------------

_SEGMENTS = f"{ctes('c')}, x AS (SELECT conv_id, generate_subscripts(conversations, 1) - 1 AS pos, unnest(conversations) AS m FROM c), g AS (SELECT conv_id, pos, m.sender AS sender, list_transform({tokens_sql('m.value')}, lambda w: length(w)) AS ids FROM x)"
_MASKED = f"""{_SEGMENTS}, l AS (SELECT conv_id, pos, list_transform(list_zip(ids, range(1, len(ids) + 1)), lambda z: CASE WHEN sender = 'gpt' AND z[2] > 1 AND z[2] < len(ids) THEN z[1] ELSE -100 END) AS l FROM g),
masked AS (SELECT conv_id, flatten(list(l ORDER BY pos)) AS labels FROM l GROUP BY conv_id)"""


def _labels(spark, d):
    ids = lambda v: F.transform(tokens(v), lambda w: F.length(w))
    segments = F.transform("conversations", lambda m: F.struct(m["sender"].alias("role"), ids(m["value"]).alias("ids")))
    return conversations(spark, d, "conversations").where(F.size("conversations") > 0).select("conv_id", M.mask_labels(segments).alias("labels"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("mask_labels", f"{_MASKED} SELECT conv_id, coalesce(array_to_string(list_transform(labels, lambda x: CAST(x AS VARCHAR)), ','), '') AS labels FROM masked")
def mask_labels(spark, d):
    return _labels(spark, d).select("conv_id", _joined("labels").alias("labels"))


@query("active_token_filter", f"{_MASKED} SELECT conv_id FROM masked WHERE len(labels) > 0 AND len(list_filter(labels, lambda x: x <> -100)) / len(labels) > 1 / 256")
def active_token_filter(spark, d):
    return _labels(spark, d).where(M.active_share(F.col("labels")) > 1 / 256).select("conv_id")


@query("loss_weight", f"{_MASKED} SELECT conv_id, round(1 / sqrt(CASE WHEN len(list_filter(labels, lambda x: x <> -100)) > 0 THEN len(list_filter(labels, lambda x: x <> -100)) END), 6) AS weight FROM masked")
def loss_weight(spark, d):
    active = F.size(F.filter("labels", lambda x: x != M.IGNORED))
    return _labels(spark, d).select("conv_id", F.round(S.loss_weight(active), 6).alias("weight"))


@query("position_ids", f"{_MASKED}, m AS (SELECT conv_id, generate_subscripts(labels, 1) AS i, CASE WHEN unnest(labels) = -100 THEN 0 ELSE 1 END AS m FROM masked), r AS (SELECT *, sum(m) OVER (PARTITION BY conv_id ORDER BY i) AS r FROM m) SELECT conv_id, string_agg(CAST(CASE WHEN m = 0 THEN 1 ELSE r - 1 END AS VARCHAR), ',' ORDER BY i) AS ids FROM r GROUP BY conv_id")
def position_ids(spark, d):
    mask = F.transform("labels", lambda x: F.when(x == M.IGNORED, 0).otherwise(1))
    return _labels(spark, d).where(F.size("labels") > 0).select("conv_id", _joined(K.position_ids(mask)).alias("ids"))


@query("cu_seqlens", f"{_SEGMENTS}, n AS (SELECT conv_id, pos, len(ids) AS n, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY pos) AS s FROM g) SELECT conv_id, '0,' || string_agg(CAST(s AS VARCHAR), ',' ORDER BY pos) AS lengths FROM n GROUP BY conv_id")
def cu_seqlens(spark, d):
    lengths = F.transform("conversations", lambda m: F.size(tokens(m["value"])))
    return conversations(spark, d, "conversations").where(F.size("conversations") > 0).select("conv_id", _joined(K.cu_seqlens(lengths)).alias("lengths"))


@query("pad_batch", f"{_MASKED}, n AS (SELECT conv_id, conv_id % 40 AS batch, len(labels) AS n, max(len(labels)) OVER (PARTITION BY conv_id % 40) AS w FROM masked) SELECT conv_id, batch, CAST(w AS INTEGER) AS width, CAST(n AS INTEGER) AS attended FROM n")
def pad_batch(spark, d):
    x = _labels(spark, d).select("conv_id", (F.col("conv_id") % 40).alias("batch"), F.transform("labels", lambda x: F.abs(x)).alias("ids"), "labels")
    p = K.pad_batches(x, "batch", "ids", "labels")
    return p.select("conv_id", "batch", F.size("labels").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("attended"))


@query("pack_samples")
def pack_samples(spark, d):
    k = records(table(spark, d, "packing_sample"), "sample_id", "worker_id", "input_ids", "image_flags", "created_at")
    sized = k.select("worker_id", "sample_id", F.coalesce(F.size(F.col("input_ids")), F.lit(0)).alias("n"), F.coalesce(F.size("image_flags"), F.lit(0)).alias("images"), "created_at")
    return K.pack_samples(sized, "worker_id", "sample_id", "n", "images", "created_at")


@query("window_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour")


# ---- geometry --------------------------------------------------------------


@query("frame_indices_middle", """WITH e AS (SELECT p_partkey, p_size AS n, least(8, p_size) AS u FROM part), i AS (SELECT p_partkey, n, u, unnest(range(0, CAST(u AS BIGINT))) AS k FROM e),
m AS (SELECT p_partkey, k, CAST(floor((floor(k * n / u) + floor((k + 1) * n / u) - 1) / 2) AS INTEGER) AS f, u FROM i)
SELECT p_partkey, string_agg(CAST(f AS VARCHAR), ',' ORDER BY k) || repeat(',' || CAST(max(f) AS VARCHAR), CAST(8 - any_value(u) AS BIGINT)) AS frames FROM m GROUP BY p_partkey""")
def frame_indices_middle(spark, d):
    return table(spark, d, "part").select("p_partkey", _joined(V.frame_indices_middle(F.col("p_size"), F.lit(8))).alias("frames"))


@query("segment_offsets", "WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS s FROM part) SELECT p_partkey, array_to_string(list_transform(range(0, 4), lambda k: CAST(CAST(trunc(s / 2 + round_even(s * k, 0)) AS INTEGER) AS VARCHAR)), ',') AS frames FROM p")
def segment_offsets(spark, d):
    return table(spark, d, "part").select("p_partkey", _joined(V.segment_offsets(F.lit(0), F.col("p_size"), 4)).alias("frames"))


_GRIDS = V.ratios(1, 6)
_PICTURE = "SELECT doc_id, CAST(n_chars + 1 AS DOUBLE) AS w, 300.0 + doc_id % 700 AS h FROM documents WHERE n_chars IS NOT NULL"


def _pictures(spark, d):
    x = table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", (F.col("n_chars") + 1).cast("double").alias("w"), (300 + F.col("doc_id") % 700).cast("double").alias("h"))
    return x.select("doc_id", V.closest_ratio(F.col("w"), F.col("h"), _GRIDS).alias("r"))


# The fold keeps, among grids at the least distance, the last one whose area rule holds, else the first.
_RATIO = f"""x AS ({_PICTURE}), r AS (SELECT unnest({[w for w, _ in _GRIDS]}) AS gw, unnest({[h for _, h in _GRIDS]}) AS gh, unnest(range({len(_GRIDS)})) AS i),
s AS (SELECT doc_id, gw, gh, i, abs(w / h - gw::DOUBLE / gh) AS dist, w * h > 0.5 * 448 * 448 * gw * gh AS big FROM x, r), m AS (SELECT *, min(dist) OVER (PARTITION BY doc_id) AS least FROM s),
c AS (SELECT doc_id, gw, gh, i, big, min(i) OVER (PARTITION BY doc_id) AS first FROM m WHERE dist = least),
ratio AS (SELECT doc_id, gw, gh FROM c WHERE big OR i = first QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)"""


@query("closest_aspect_ratio", f"WITH {_RATIO} SELECT doc_id, gw AS w, gh AS h FROM ratio")
def closest_aspect_ratio(spark, d):
    return _pictures(spark, d).select("doc_id", "r.w", "r.h")


@query("tile_boxes", f"WITH {_RATIO}, k AS (SELECT doc_id, gw, gh, unnest(range(0, CAST(gw * gh AS BIGINT))) AS k FROM ratio) SELECT doc_id, CAST(k AS INTEGER) AS tile, CAST(k % gw * 448 AS INTEGER) AS l, CAST(k // gw * 448 AS INTEGER) AS t, CAST(gw * gh + CASE WHEN gw * gh > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_tiles FROM k")
def tile_boxes(spark, d):
    p = _pictures(spark, d).select("doc_id", "r.w", "r.h")
    boxes = p.select("doc_id", F.posexplode(V.tile_boxes(F.col("w"), F.col("h"))).alias("tile", "b"), V.tile_count(F.col("w"), F.col("h")).alias("n_tiles"))
    return boxes.select("doc_id", "tile", F.col("b.left").alias("l"), F.col("b.top").alias("t"), "n_tiles")


@query("clip_bounds", "WITH p AS (SELECT DISTINCT ON (pair_id) * FROM preference_pair) SELECT pair_id, CAST(greatest(0, floor(clip[1] * 24)) AS INTEGER) AS first, CAST(least(4799, floor(clip[2] * 24)) AS INTEGER) AS last FROM p WHERE clip IS NOT NULL AND len(clip) = 2")
def clip_bounds(spark, d):
    p = records(table(spark, d, "preference_pair"), "pair_id", "clip").where("clip IS NOT NULL AND size(clip) = 2")
    return p.select("pair_id", V.clip_bounds(F.col("clip"), F.lit(24.0), F.lit(4800)).alias("b")).select("pair_id", "b.first", "b.last")


@query("stitch_offsets", "SELECT p_partkey, CAST(p_partkey % 6 % 3 * 224 AS INTEGER) AS x, CAST(p_partkey % 6 // 3 * 224 AS INTEGER) AS y FROM part")
def stitch_offsets(spark, d):
    o = V.stitch_offsets((F.col("p_partkey") % 6).cast("int"), 3, 224)
    return table(spark, d, "part").select("p_partkey", o.alias("o")).select("p_partkey", "o.x", "o.y")
