"""Queries on questions as models get them and on the lesser readers of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import inputs as I
from tracemill.plans.registry import ctes, number_sql, pairs, query, responses, strip_sql
from tracemill.plans.rewarding import _TREE, _tree
from tracemill.session import table

_ENDINGS = ("\nThink it through, then answer.", "\nReply with the letter only.", "\nGive one short value.", "\nExplain every step you take.")


def _without_sql(x: str) -> str:
    for e in _ENDINGS:
        text = e.replace("\n", "")
        x = f"CASE WHEN ends_with({x}, chr(10) || '{text}') THEN {strip_sql(f'substring({x}, 1, length({x}) - {len(e)})')} ELSE {x} END"
    return x


@query("sampling_question", f"""{ctes('s')} SELECT response_id, '<image>' || chr(10) || {_without_sql('question')} AS question FROM s""")
def sampling_question(spark, d):
    return responses(spark, d, "question").select("response_id", I.with_placeholder(I.without_instructions(F.col("question"), _ENDINGS)).alias("question"))


@query("choice_prompt", """SELECT item_id, item_text || CASE WHEN len(choices) > 0 THEN chr(10) || array_to_string(list_transform(list_zip(choices, range(1, len(choices) + 1)), lambda z: chr(CAST(64 + z[2] AS INTEGER)) || '. ' || z[1]), chr(10)) ELSE '' END || chr(10) || 'Answer:' AS question FROM eval_items""")
def choice_prompt(spark, d):
    return table(spark, d, "eval_items").select("item_id", I.asked(F.col("item_text"), F.col("choices"), F.lit(None).cast("string"), "Answer:").alias("question"))


@query("source_prompt", "SELECT ds_name, CASE WHEN contains(ds_name, 'chart') THEN 'number' WHEN contains(ds_name, 'doc') THEN 'phrase' ELSE 'word' END AS prompt FROM dataset_registry")
def source_prompt(spark, d):
    return table(spark, d, "dataset_registry").select("ds_name", I.by_name(F.col("ds_name"), (("chart", "number"), ("doc", "phrase")), "word").alias("prompt"))


@query("split_labels", "SELECT doc_id, coalesce(text, '') AS body, CAST(n_chars AS VARCHAR) AS labels FROM documents WHERE NOT contains(coalesce(text, ''), '<|split_token|>')")
def split_labels(spark, d):
    text = F.coalesce("text", F.lit(""))
    value = F.when(F.col("n_chars").isNull(), text).otherwise(F.concat(text, F.lit("<|split_token|>"), F.col("n_chars").cast("string")))
    docs = table(spark, d, "documents").where(~F.contains(text, F.lit("<|split_token|>")))
    return docs.select("doc_id", I.split_labels(value).alias("x")).select("doc_id", F.col("x.text").alias("body"), "x.labels")


@query("modality", f"""{ctes('p')}, n AS (SELECT pair_id, coalesce(len(list_filter(image, lambda x: x IS NOT NULL AND x <> '')), 0) AS n, video FROM p) SELECT pair_id, CASE WHEN n > 1 THEN 'multi_image' WHEN n = 1 THEN 'image' WHEN coalesce(video, '') <> '' THEN 'video' ELSE 'text' END AS kind FROM n""")
def modality(spark, d):
    return pairs(spark, d, "image", "video").select("pair_id", I.modality(F.col("image"), F.col("video")).alias("kind"))


@query("multi_image_filter", f"{ctes('p')} SELECT pair_id FROM p WHERE len(image) > 1")
def multi_image_filter(spark, d):
    return pairs(spark, d, "image").where(F.size("image") > 1).select("pair_id")


@query("exported_answer", f"{ctes('s')} SELECT response_id, lower(regexp_replace(answer, '\\.+$', '')) AS answer FROM s")
def exported_answer(spark, d):
    return responses(spark, d, "answer").select("response_id", I.exported_answer(F.col("answer")).alias("answer"))


def _trim_sql() -> str:
    x = f"lower(regexp_extract({strip_sql('response')}, '^([^.,!]*)', 1))"
    for w in I._CUTS:
        x = f"coalesce(string_split({x}, '{w}')[2], {x})" if w == I._CUTS[0] else f"coalesce(string_split({x}, '{w}')[2], {x})"
    return strip_sql(f"string_split({x}, ' of')[1]")


@query("trimmed_phrase", f"{ctes('s')} SELECT response_id, {_trim_sql()} AS phrase FROM s")
def trimmed_phrase(spark, d):
    return responses(spark, d, "response").select("response_id", I.trimmed_phrase(F.col("response")).alias("phrase"))


@query("loose_format", rf"""{ctes('s')}, n AS (SELECT response_id, answer_pred AS p, answer AS g, {strip_sql(rf"regexp_replace(regexp_replace({strip_sql('answer_pred')}, '^\(+|\(+$', '', 'g'), '^\)+|\)+$', '', 'g')")} AS b FROM s)
SELECT response_id, CASE WHEN regexp_matches(g, '^[A-J]$') THEN CASE WHEN length(b) > 1 AND regexp_matches(b[1], '[A-J]') THEN b[1] ELSE b END ELSE p END AS answer FROM n""")
def loose_format(spark, d):
    return responses(spark, d, "answer_pred", "answer").select("response_id", I.loose_format(F.col("answer_pred"), F.col("answer")).alias("answer"))


@query("multi_choice_index")
def multi_choice_index(spark, d):
    items = table(spark, d, "eval_items").where("choices IS NOT NULL")
    return items.select("item_id", I.multi_choice_index(F.concat(F.lit("It seems that the right one must be "), "answer"), F.col("choices"), F.col("item_id")).alias("letter"))


@query("text_traits", rf"""{ctes('s')}, w AS (SELECT response_id, answer, regexp_extract_all(answer, '\b\w+\b') AS w FROM s)
SELECT response_id, regexp_matches(answer, '\d') AS digit, regexp_matches(answer, '\d') OR len(list_filter(w, lambda x: lower(x) IN {tuple(I.NUMERALS)})) > 0 AS number_word, len(list_filter(w, lambda x: x IN {tuple(I.QUANTITY_WORDS)})) > 0 AS quantity_word, regexp_matches(answer, '^(?:[Yy]es|[Nn]o|[Tt]rue|[Ff]alse|YES|NO|TRUE|FALSE)$') AS bool_word,
regexp_matches(regexp_replace({strip_sql('answer')}, '\.0+$', ''), '^[+-]?\d+$') AS integer, contains(answer, '.') AND ({number_sql('answer')}) IS NOT NULL AS decimal FROM w""")
def text_traits(spark, d):
    return responses(spark, d, "answer").select("response_id", I.text_traits(F.col("answer")).alias("x")).select("response_id", "x.*")


@query("extraction_cascade", rf"""{ctes('s')} SELECT response_id, CASE WHEN response = '' THEN '' WHEN regexp_matches({strip_sql('response')}, '^[+-]?\d+$') THEN CAST(TRY_CAST({strip_sql('response')} AS BIGINT) AS VARCHAR) WHEN regexp_matches(response, '(?i)(Final answer:|Answer:)\s*([^\n]*)') THEN regexp_extract(response, '(?i)(Final answer:|Answer:)\s*([^\n]*)', 2) END AS extraction FROM s""")
def extraction_cascade(spark, d):
    none = F.array().cast("array<string>")
    return responses(spark, d, "response").select("response_id", I.extracted(F.col("response"), none, F.lit("free_form"), F.lit("integer")).alias("extraction"))


@query("extraction_resume", f"{ctes('s')} SELECT response_id FROM s WHERE answer_pred IS NULL OR {strip_sql('answer_pred')} = ''")
def extraction_resume(spark, d):
    return responses(spark, d, "answer_pred").where("answer_pred IS NULL OR trim(answer_pred) = ''").select("response_id")


@query("common_prefix", rf"""{ctes('p')}, t AS (SELECT pair_id, string_split(coalesce(chosen, ''), ' ') AS a, string_split(coalesce(rejected, ''), ' ') AS b FROM p), n AS (SELECT pair_id, CAST(least(len(a), len(b)) AS BIGINT) AS n, a, b FROM t)
SELECT pair_id, CAST(coalesce(list_min(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) - 1, n) AS INTEGER) AS n FROM n""")
def common_prefix(spark, d):
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    return pairs(spark, d, "chosen", "rejected").select("pair_id", I.common_prefix(words("chosen"), words("rejected")).alias("n"))


@query("messages_prompt", f"""{ctes('s')} SELECT response_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(left(response, 10), '') AS prompt FROM s""")
def messages_prompt(spark, d):
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    return responses(spark, d, "question", "response").select("response_id", I.messages_prompt(m, "Be brief.", F.left("response", F.lit(10))).alias("prompt"))


@query("ancestor_paths", f"WITH RECURSIVE {_TREE}, walk AS (SELECT o_custkey, node, CAST(node AS VARCHAR) AS path, parent AS up FROM tree UNION ALL SELECT w.o_custkey, w.node, CAST(t.node AS VARCHAR) || ',' || w.path, t.parent FROM walk w JOIN tree t ON t.o_custkey = w.o_custkey AND t.node = w.up) SELECT o_custkey, CAST(node AS INTEGER) AS node, path FROM walk WHERE up IS NULL")
def ancestor_paths(spark, d):
    p = I.ancestor_paths(_tree(spark, d).withColumn("parent", F.col("parent").cast("int")), "o_custkey", "node", "parent")
    return p.select("o_custkey", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("preference_items", f"""{ctes('p')}, q AS (SELECT pair_id, CASE WHEN contains(q, '<image>') THEN q ELSE '<image>' || chr(10) || q END AS q, chosen, rejected FROM (SELECT *, coalesce(nullif(question, ''), nullif(prompt, '')) AS q FROM p))
SELECT pair_id, 'chosen' AS side, q AS question, chosen AS answer FROM q UNION ALL SELECT pair_id, 'rejected', q, rejected FROM q""")
def preference_items(spark, d):
    from tracemill.functions.text import present

    q = present(F.col("question"), F.col("prompt"))
    asked = F.when(F.contains(q, F.lit("<image>")), q).otherwise(F.concat(F.lit("<image>\n"), q))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("answer")) for s in ("chosen", "rejected")))
    return pairs(spark, d, "question", "prompt", "chosen", "rejected").select("pair_id", asked.alias("question"), F.explode(sides).alias("x")).select("pair_id", "x.side", "question", "x.answer")
