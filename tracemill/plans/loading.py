"""Queries on the packing loader, label masks by a tokenizer, and model providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import providers as X
from tracemill.operators import loader as L
from tracemill.operators import masking as K
from tracemill.operators import packing as B
from tracemill.plans.registry import conversations, ctes, query, responses
from tracemill.session import records, table

_TOKENS = r"'<\|[^|<>]*\|>|[^ \t\n\r\f\v<]+|[< \t\n\r\f\v]'"
_ID = "1 + CAST('0x' || substring(md5(x), 1, 7) AS INTEGER) % 30000"


def _ids(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {_TOKENS}), lambda x: {_ID})"


_TURNS = f"{ctes('c')}, u AS (SELECT conv_id, generate_subscripts(conversations, 1) AS i, unnest(conversations) AS m FROM c)"
_SEGMENTS = f"""{_TURNS}, e AS (SELECT conv_id, i, m.sender AS r, {_ids("'<|im_start|>' || CASE m.sender WHEN 'system' THEN 'system' WHEN 'human' THEN 'user' ELSE 'assistant' END || chr(10) || coalesce(m.value, '') || '<|im_end|>' || chr(10)")} AS ids FROM u),
l AS (SELECT conv_id, i, ids, CASE WHEN r IN ('system', 'human') THEN list_transform(ids, lambda x: -100) ELSE list_transform(list_zip(ids, range(1, len(ids) + 1)), lambda z: CASE WHEN z[2] <= 3 OR z[2] = len(ids) THEN -100 ELSE z[1] END) END AS labels FROM e),
w AS (SELECT conv_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(labels ORDER BY i)) AS labels FROM l GROUP BY conv_id)"""
_CHAT = f"""{_TURNS}, k AS (SELECT conv_id, min(i) FILTER (i > 1 OR m.sender = 'human') AS first FROM u GROUP BY conv_id),
v AS (SELECT u.conv_id, i, m.sender AS r, coalesce(m.value, '') AS t FROM u JOIN k ON k.conv_id = u.conv_id AND i >= first),
e AS (SELECT conv_id, i, {_ids("CASE r WHEN 'human' THEN '<|im_start|>user' || chr(10) || t || '<|im_end|>' ELSE '<|im_start|>assistant' || chr(10) END")} AS a, CASE WHEN r = 'human' THEN [] ELSE {_ids("t || '<|im_end|>'")} END AS b FROM v),
s AS (SELECT conv_id, {_ids("'Be brief.<|im_end|>'")} AS ids FROM c WHERE len(conversations) > 0),
w AS (SELECT s.conv_id, list_concat(any_value(s.ids), coalesce(flatten(list(list_concat(a, b) ORDER BY i) FILTER (i IS NOT NULL)), [])) AS ids, list_concat(list_transform(any_value(s.ids), lambda x: -100), coalesce(flatten(list(list_concat(list_transform(a, lambda x: -100), b) ORDER BY i) FILTER (i IS NOT NULL)), [])) AS labels FROM s LEFT JOIN e ON e.conv_id = s.conv_id GROUP BY s.conv_id)"""
_OUT = "SELECT conv_id, array_to_string(ids[1:400], ',') AS ids, array_to_string(labels[1:400], ',') AS labels FROM w"


def _masked(spark, d, style, system=""):
    talks = conversations(spark, d, "conversations").where(F.size("conversations") > 0)
    # 400 tokens are the truncation that the operator has as its parameter
    m = K.masked(talks, "conv_id", "conversations", style=style, most=400, system=system)
    return m.select("conv_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("mask_segments", f"{_SEGMENTS} {_OUT}")
def mask_segments(spark, d):
    return _masked(spark, d, "segments")


@query("mask_chat", f"{_CHAT} {_OUT}")
def mask_chat(spark, d):
    return _masked(spark, d, "chat", "Be brief.")


def _samples(spark, d):
    ids = F.coalesce("input_ids", F.array().cast("array<int>"))
    kept = F.size(ids) - F.coalesce(F.array_position(F.transform(F.reverse(ids), lambda v: v != 0), True) - 1, F.size(ids))
    k = records(table(spark, d, "packing_sample"), "sample_id", "worker_id", "input_ids", "pixel_values")
    images = F.size(F.filter("ids", lambda x: x == L.IMAGE_START))
    return k.select("sample_id", "worker_id", F.slice(ids, F.lit(1), kept.cast("int")).alias("ids")).withColumn("images", images)


def _packs(spark, d):
    return L.load_packs(_samples(spark, d), "worker_id", "sample_id", "ids", None, "images")


@query("load_packs")
def load_packs(spark, d):
    return _packs(spark, d).select("worker", "lane", "pack", "n_samples", "n_images", F.size("input_ids").alias("n_tokens"))


@query("collate_stats")
def collate_stats(spark, d):
    return L.collate_stats(_packs(spark, d).withColumn("batch", F.col("pack") % 4), "batch", 8192, 40)


@query("sub_positions", f"{ctes('k')}, x AS (SELECT sample_id, generate_subscripts(input_ids, 1) AS i, unnest(input_ids) // 1000 AS g FROM k WHERE len(input_ids) > 0), y AS (SELECT *, lag(g) OVER (PARTITION BY sample_id ORDER BY i) IS DISTINCT FROM g AS new FROM x), z AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY sample_id ORDER BY i) AS run FROM y), p AS (SELECT sample_id, i, row_number() OVER (PARTITION BY sample_id, run ORDER BY i) - 1 AS p FROM z) SELECT sample_id, max(p) AS longest, CAST(sum(p) AS BIGINT) AS total FROM p GROUP BY sample_id")
def sub_positions(spark, d):
    k = records(table(spark, d, "packing_sample"), "sample_id", "input_ids").where(F.size("input_ids") > 0)
    at = k.select("sample_id", L.sub_positions(F.transform("input_ids", lambda x: F.floor(x / 1000).cast("int"))).alias("p"))
    return at.select("sample_id", F.array_max("p").cast("bigint").alias("longest"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("interleaved_sources", f"{ctes('s')}, r AS (SELECT response_id, ds_name, -ln((CAST('0x' || substring(md5(CAST(response_id AS VARCHAR) || '|0'), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370497.0) / repeat_time AS t FROM s JOIN dataset_registry USING (ds_name) WHERE repeat_time > 0) SELECT response_id, ds_name, round(t, 6)::DOUBLE AS turn FROM r")
def interleaved_sources(spark, d):
    weights = table(spark, d, "dataset_registry").where("repeat_time > 0").select("ds_name", F.col("repeat_time").alias("weight"))
    out = L.interleaved(responses(spark, d, "ds_name"), "ds_name", "response_id", weights)
    return out.select("response_id", "ds_name", F.round("turn", 6).alias("turn"))


@query("joined_batches", f"{ctes('p')}, x AS (SELECT pair_id, 0 AS side, chosen AS t FROM p UNION ALL SELECT pair_id, 1, rejected FROM p), n AS (SELECT pair_id, side, list_transform(regexp_extract_all(coalesce(t, ''), '[^ ]+'), lambda w: length(w)) AS ids, pair_id % 16 AS b FROM x), m AS (SELECT b, max(len(ids)) AS n FROM n GROUP BY b) SELECT pair_id, side, CAST(n.b AS BIGINT) AS batch, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(m.n AS INTEGER) AS n_padded FROM n JOIN m USING (b)")
def joined_batches(spark, d):
    p = records(table(spark, d, "preference_pair"), "pair_id", "chosen", "rejected")
    ids = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[^ ]+"), F.lit(0)), lambda w: F.length(w))
    made = B.join_sides(p.select("pair_id", (F.col("pair_id") % 16).alias("batch"), ids("chosen").alias("chosen"), ids("rejected").alias("rejected")), "batch", "chosen", "rejected")
    return made.select("pair_id", "side", "batch", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"), F.size("ids").alias("n_padded"))


# ---- providers: what the stand-ins give is no result to compare, so these have no SQL ----


@query("generated_criteria")
def generated_criteria(spark, d):
    return X.generate_criteria(responses(spark, d, "question"), "question", X.HashChat(("Clarity; Order; Clarity", "1. Use of units\n2. Sign handling")), "criteria").select("response_id", "criteria")


@query("judged_steps")
def judged_steps(spark, d):
    r = responses(spark, d, "question", "response").withColumn("criteria", F.array(F.lit("Clarity"), F.lit("Order")))
    return X.judge_steps(r, "question", "response", "criteria", X.HashJudge()).select("response_id", "review.reward_categories", "review.reward_scores")


@query("sampled_responses")
def sampled_responses(spark, d):
    return X.sample_responses(responses(spark, d, "question"), "response_id", "question", 4, X.HashChat())


@query("continued_prefixes")
def continued_prefixes(spark, d):
    from tracemill.functions.trace import truncated_prefix

    r = responses(spark, d, "question", "response").withColumn("prefix", truncated_prefix(F.col("response"), 0.5))
    return X.continue_prefixes(r, "response_id", "question", "prefix", 2, X.HashChat())


@query("scored_traces")
def scored_traces(spark, d):
    p = records(table(spark, d, "preference_pair"), "pair_id", "chosen").withColumn("trace", F.concat(F.replace(F.coalesce("chosen", F.lit("")), F.lit("<|reasoning_step_end|>"), F.lit("ки")), F.lit("ки")))
    return X.score_traces(p, "trace", X.HashLogits()).select("pair_id", "step_scores")


@query("named_clusters")
def named_clusters(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("name"))
    return X.name_clusters(n, "cluster", "name", X.HashChat(("First group", "Second group")))


@query("chat_replies")
def chat_replies(spark, d):
    return X.chat(responses(spark, d, "question"), "response_id", "question", X.HashChat())
