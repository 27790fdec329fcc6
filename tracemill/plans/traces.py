"""Queries on tagged traces, lengths and repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import trace as T
from tracemill.operators.evaluate import ngram_repetition
from tracemill.plans.registry import conversations, ctes, pairs, query, responses, strip_sql, tokens_sql
from tracemill.session import table

_RS, _RE = "<|reasoning_start|>", "<|reasoning_end|>"
_SEGMENTS = r"regexp_extract_all(chosen, '(?s)<\|reasoning_step_start\|>(.*?)<\|reasoning_step_end\|>', 1)"


def _field_sql(name: str, x: str = "seg") -> str:
    pattern = rf"(?s)<\|reasoning_step_{name}_start\|>(.*?)<\|reasoning_step_{name}_end\|>"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN {strip_sql(f'''regexp_extract({x}, '{pattern}', 1)''')} END"


_STEPS = f"""steps AS (SELECT pair_id, generate_subscripts({_SEGMENTS}, 1) - 1 AS step_index, unnest({_SEGMENTS}) AS seg FROM p WHERE chosen IS NOT NULL),
fields AS (SELECT pair_id, CAST(step_index AS INTEGER) AS step_index, {_field_sql('name')} AS name, {_field_sql('thought')} AS thought, {_field_sql('reflection')} AS reflection, seg FROM steps)"""


@query("extract_reasoning", f"""{ctes('p')}, t AS (SELECT pair_id, chosen AS t, strpos(chosen, '{_RS}') AS a, strpos(chosen, '{_RE}') AS b FROM p)
SELECT pair_id, coalesce(CASE WHEN a > 0 AND b > a THEN substring(t, a + {len(_RS)}, greatest(0, b - a - {len(_RS)})) ELSE t END, '') AS reasoning FROM t""")
def extract_reasoning(spark, d):
    return pairs(spark, d, "chosen").select("pair_id", T.extract_reasoning(F.col("chosen")).alias("reasoning"))


@query("reasoning_blocks", rf"""{ctes('p')}, b AS (SELECT pair_id, list_transform(regexp_extract_all(coalesce(chosen, ''), '(?s)<\|reasoning_start\|>(.*?)<\|reasoning_end\|>', 1), lambda x: {strip_sql('x')}) AS l FROM p)
SELECT pair_id, CAST(len(l) AS INTEGER) AS n_blocks, coalesce(array_to_string(l, '|'), '') AS blocks FROM b""")
def reasoning_blocks(spark, d):
    b = pairs(spark, d, "chosen").select("pair_id", T.reasoning_blocks(F.col("chosen")).alias("l"))
    return b.select("pair_id", F.size("l").alias("n_blocks"), F.array_join("l", "|").alias("blocks"))


@query("parse_steps", f"""{ctes('p')}, {_STEPS}
SELECT pair_id, step_index, name, thought, reflection, CASE WHEN coalesce(nullif(name, ''), nullif(thought, ''), nullif(reflection, '')) IS NULL THEN {strip_sql('seg')} END AS raw FROM fields""")
def parse_steps(spark, d):
    steps = pairs(spark, d, "chosen").select("pair_id", F.posexplode(T.parse_steps(F.col("chosen"))).alias("step_index", "s"))
    return steps.select("pair_id", "step_index", "s.*")


@query("step_texts", f"""{ctes('p')}, {_STEPS}, texts AS (SELECT pair_id, step_index, coalesce(nullif(concat_ws(chr(32) || chr(10), CASE WHEN name <> '' THEN '[NAME] ' || name END, CASE WHEN thought <> '' THEN '[THOUGHT] ' || thought END, CASE WHEN reflection <> '' THEN '[REFLECTION] ' || reflection END), ''), {strip_sql('seg')}) AS step_text FROM fields),
plain AS (SELECT pair_id, list_filter(list_transform(string_split(coalesce(chosen, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM p WHERE pair_id NOT IN (SELECT pair_id FROM fields))
SELECT pair_id, step_index, step_text FROM texts UNION ALL SELECT pair_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER), unnest(l) FROM plain""")
def step_texts(spark, d):
    return pairs(spark, d, "chosen").select("pair_id", F.posexplode(T.extract_steps(F.col("chosen"))).alias("step_index", "step_text"))


@query("extract_answer_tag", rf"""{ctes('p')}
SELECT pair_id, CASE WHEN regexp_matches(chosen, '(?s)<\|answer_start\|>(.*?)<\|answer_end\|>') THEN {strip_sql(r"regexp_extract(chosen, '(?s)<\|answer_start\|>(.*?)<\|answer_end\|>', 1)")} END AS answer,
regexp_replace(regexp_replace({strip_sql(r"CASE WHEN contains(chosen, '<|answer_start|>') AND contains(chosen, '<|answer_end|>') THEN string_split(string_split(chosen, '<|answer_start|>')[2], '<|answer_end|>')[1] END")}, '^\(+|\(+$', '', 'g'), '^\)+|\)+$', '', 'g') AS piece FROM p""")
def extract_answer_tag(spark, d):
    c = F.col("chosen")
    return pairs(spark, d, "chosen").select("pair_id", T.tagged_answer(c).alias("answer"), T.second_piece(c).alias("piece"))


@query("single_step", f"""{ctes('p')}, t AS (SELECT pair_id, rejected AS t, strpos(rejected, '{_RE}') AS e, strpos(rejected, '<|reasoning_step_end|>') AS s, strpos(rejected, '<|reasoning_proceed|>') AS q, list_filter(string_split(rejected, chr(10)), lambda x: {strip_sql('x')} <> '') AS l FROM p)
SELECT pair_id, CASE WHEN e > 0 THEN {strip_sql(f"substring(t, 1, e - 1 + {len(_RE)})")} WHEN s > 0 THEN {strip_sql("substring(t, 1, s - 1 + 22)")} WHEN q > 0 THEN {strip_sql("substring(t, 1, q - 1)")} WHEN len(l) > 1 THEN {strip_sql("l[1]")} ELSE {strip_sql("t")} END AS step FROM t""")
def single_step(spark, d):
    return pairs(spark, d, "rejected").select("pair_id", T.single_step(F.col("rejected")).alias("step"))


@query("terminal_step", f"""{ctes('s')} SELECT response_id, contains(response, '{_RE}') OR contains(lower(response), 'final answer') OR contains(lower(response), 'the answer is') AS terminal FROM s""")
def terminal_step(spark, d):
    return responses(spark, d, "response").select("response_id", T.is_terminal(F.col("response")).alias("terminal"))


def _rendered_field(name: str) -> str:
    tag = f"reasoning_step_{name}"
    return f"CASE WHEN {name} IS NOT NULL THEN '<|{tag}_start|>' || {name} || '<|{tag}_end|>' || chr(10) ELSE '' END"


@query("render_trace", f"""{ctes('p')}, {_STEPS}, one AS (SELECT pair_id, step_index, '<|reasoning_step_start|>' || chr(10) || {_rendered_field('name')} || {_rendered_field('thought')} || {_rendered_field('reflection')} || '<|reasoning_step_end|>' || chr(10) AS x FROM fields)
SELECT pair_id, '{_RS}' || chr(10) || string_agg(x, '<|reasoning_proceed|>' || chr(10) ORDER BY step_index) || '{_RE}' || chr(10) || 'Answer:' || chr(10) || '<|answer_start|>' || CAST(pair_id AS VARCHAR) || '<|answer_end|>' AS trace FROM one GROUP BY pair_id""")
def render_trace(spark, d):
    parsed = pairs(spark, d, "chosen").select("pair_id", T.parse_steps(F.col("chosen")).alias("s")).where(F.size("s") > 0)
    return parsed.select("pair_id", T.render_trace(F.col("s"), F.col("pair_id").cast("string")).alias("trace"))


@query("measure_lengths", f"""SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS chars, CAST(len({tokens_sql('text')}) AS INTEGER) AS tokens FROM documents""")
def measure_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lengths(F.col("text")).alias("l")).select("doc_id", "l.*")


@query("length_parity", f"""{ctes('p')}, l AS (SELECT length(coalesce(chosen, '')) AS a, length(coalesce(rejected, '')) AS b, len({tokens_sql('chosen')}) AS x, len({tokens_sql('rejected')}) AS y FROM p)
SELECT count(*) AS total, count(*) FILTER (a = b) AS same_chars, count(*) FILTER (x = y) AS same_tokens, round(100.0 * count(*) FILTER (a = b) / count(*), 4) AS pct_chars, round(100.0 * count(*) FILTER (x = y) / count(*), 4) AS pct_tokens FROM l""")
def length_parity(spark, d):
    l = pairs(spark, d, "chosen", "rejected").select(T.lengths(F.col("chosen")).alias("a"), T.lengths(F.col("rejected")).alias("b"))
    same, tokens = F.count_if(F.col("a.chars") == F.col("b.chars")), F.count_if(F.col("a.tokens") == F.col("b.tokens"))
    counts = l.agg(F.count("*").alias("total"), same.alias("same_chars"), tokens.alias("same_tokens"))
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("total")), 4)
    return counts.select("*", share("same_chars").alias("pct_chars"), share("same_tokens").alias("pct_tokens"))


@query("truncate_prefix", f"""{ctes('s')}, w AS (SELECT response_id, string_split(response, ' ') AS w FROM s)
SELECT response_id, {strip_sql("array_to_string(w[1:CAST(floor(len(w) * 0.5) AS BIGINT)], ' ')")} AS prefix FROM w""")
def truncate_prefix(spark, d):
    return responses(spark, d, "response").select("response_id", T.truncated_prefix(F.col("response"), 0.5).alias("prefix"))


def _ngrams_sql(source: str, key: str, n: int = 10) -> str:
    return f"""w AS (SELECT {key}, {tokens_sql('t')} AS w FROM ({source})),
g AS (SELECT {key}, CASE WHEN len(w) >= {n} THEN list_transform(range(1, CAST(len(w) - {n} + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE [] END AS g FROM w),
u AS (SELECT {key}, unnest(g) AS x FROM g), n AS (SELECT {key}, x, count(*) AS c FROM u GROUP BY ALL),
r AS (SELECT {key}, CAST(sum(c) AS INTEGER) AS n_grams, round(count(*) FILTER (c > 1) / sum(c), 6) AS ratio FROM n GROUP BY {key}),
ngrams AS (SELECT g.{key}, coalesce(n_grams, 0) AS n_grams, coalesce(ratio, 0.0) AS ratio FROM g LEFT JOIN r USING ({key}))"""


@query("ngram_repetition", f"""WITH {_ngrams_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')} SELECT doc_id, n_grams, CAST(ratio AS DOUBLE) AS ratio FROM ngrams""")
def ngram_repetition_query(spark, d):
    return ngram_repetition(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("repetition_filter", f"""{ctes('c')}, turns AS (SELECT conv_id * 1000 + generate_subscripts(conversations, 1) - 1 AS turn_id, unnest(conversations) AS m FROM c),
{_ngrams_sql("SELECT turn_id, m.value AS t FROM turns WHERE m.sender = 'gpt'", 'turn_id')}
SELECT conv_id, conv_id NOT IN (SELECT turn_id // 1000 FROM ngrams WHERE ratio > 0.05) AS keep FROM c""")
def repetition_filter(spark, d):
    c = conversations(spark, d, "conversations")
    turns = c.select("conv_id", F.posexplode("conversations").alias("pos", "m")).where("m.sender = 'gpt'")
    ratios = ngram_repetition(turns.select((F.col("conv_id") * 1000 + F.col("pos")).alias("turn_id"), F.col("m.value").alias("t")), "turn_id", F.col("t"))
    bad = ratios.where("ratio > 0.05").select(F.floor(F.col("turn_id") / 1000).alias("conv_id")).distinct().withColumn("bad", F.lit(True))
    return c.select("conv_id").join(bad, "conv_id", "left").select("conv_id", F.coalesce(~F.col("bad"), F.lit(True)).alias("keep"))
