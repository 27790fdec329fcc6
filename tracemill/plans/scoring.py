"""Queries on answers, scores and accuracies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import scores as S
from tracemill.functions.text import strip
from tracemill.operators import evaluate as E
from tracemill.plans.registry import ctes, number_sql, query, responses, strip_sql, tokens_sql
from tracemill.session import table

# ---- finding answers -------------------------------------------------------

#: Synthetic responses around documents: some well formed, some without rationale or with two answers.
_FINAL = "CASE doc_id % 5 WHEN 0 THEN t || chr(10) || 'so' || chr(10) || 'Final answer: ' || doc_id WHEN 1 THEN t || chr(10) || chr(10) || 'Final Answer: x' || doc_id || chr(10) || 'y' WHEN 2 THEN 'Final answer: ' || doc_id WHEN 3 THEN t || chr(10) || chr(10) || '答案: ' || doc_id || ' ' ELSE t END"


def _final(t):
    i, nl = F.col("doc_id").cast("string"), F.lit("\n")
    k = F.col("doc_id") % 5
    return (
        F.when(k == 0, F.concat(t, nl, F.lit("so"), nl, F.lit("Final answer: "), i)).when(k == 1, F.concat(t, nl, nl, F.lit("Final Answer: x"), i, nl, F.lit("y")))
        .when(k == 2, F.concat(F.lit("Final answer: "), i)).when(k == 3, F.concat(t, nl, nl, F.lit("答案: "), i, F.lit(" "))).otherwise(t)
    )


def _parsed(spark, d, text):
    r = table(spark, d, "documents").select("doc_id", A.parse_final_answer(_final(text)).alias("x"))
    return r.where("x IS NOT NULL").select("doc_id", "x.rationale", "x.answer")


def _count(x: str, sub: str) -> str:
    return f"((length({x}) - length(replace({x}, '{sub}', ''))) // length('{sub}'))"


@query("parse_final_answer", f"""WITH r AS (SELECT doc_id, {_FINAL} AS r FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
t AS (SELECT doc_id, r, CASE WHEN contains(r, 'Final answer:') THEN 'Final answer:' WHEN contains(r, 'Final Answer:') THEN 'Final Answer:' WHEN contains(r, '答案:') THEN '答案:' END AS g FROM r),
x AS (SELECT doc_id, r, g, string_split(r, g) AS s FROM t WHERE g IS NOT NULL),
y AS (SELECT doc_id, r, g, {strip_sql("substring(r, 1, length(r) - length(s[len(s)]) - length(g))")} AS rationale, {strip_sql("s[len(s)]")} AS answer, len(s) - 1 AS n FROM x)
SELECT doc_id, rationale, answer FROM y WHERE n <= 2 AND length(r) - length(replace(r, chr(10), '')) >= 2 AND rationale <> '' AND NOT contains(answer, chr(10))""")
def parse_final_answer(spark, d):
    return _parsed(spark, d, F.coalesce("text", F.lit("")))


@query("quick_extract", rf"""{ctes('s')} SELECT response_id, CASE WHEN regexp_matches(response, '(?i)(Final answer:|Answer:)\s*([^\n]*)') THEN regexp_extract(response, '(?i)(Final answer:|Answer:)\s*([^\n]*)', 2) ELSE response END AS answer FROM s""")
def quick_extract(spark, d):
    return responses(spark, d, "response").select("response_id", A.quick_extract(F.col("response")).alias("answer"))


@query("normalize_answer", rf"""{ctes('s')} SELECT response_id, regexp_replace(lower(answer), '[^a-z0-9.\-/%]', '', 'g') AS answer FROM s""")
def normalize_answer(spark, d):
    return responses(spark, d, "answer").select("response_id", A.normalize_answer(F.col("answer")).alias("answer"))


@query("answer_reward", rf"""{ctes('s')}, g AS (SELECT response_id, regexp_replace(lower(right(response, 2000)), '[^a-z0-9.\-/%]', '', 'g') AS r, regexp_replace(lower(answer), '[^a-z0-9.\-/%]', '', 'g') AS g FROM s)
SELECT response_id, CASE WHEN g IS NULL OR g = '' THEN 0.0 WHEN contains(r, g) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM g""")
def answer_reward(spark, d):
    return responses(spark, d, "response", "answer").select("response_id", S.answer_reward(F.col("response"), F.col("answer")).alias("reward"))


# RE2 has no look-ahead, which plain numbers need, so the SQL has numbers with thousands and with exponents; all three
# kinds are in numbers_by_kind and all_numbers, which are tested against Python's expressions.
@query("extract_numbers", r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '-?\b\d{1,3}(?:,\d{3})+\b')) AS INTEGER) AS n_grouped, CAST(len(regexp_extract_all(coalesce(text, ''), '-?\d+(?:\.\d+)?[eE][+-]?\d+')) AS INTEGER) AS n_scientific FROM documents""")
def extract_numbers(spark, d):
    return numbers_by_kind(spark, d).drop("n_plain")


@query("numbers_by_kind")
def numbers_by_kind(spark, d):
    n = A.numbers_by_kind(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.size("n.grouped").alias("n_grouped"), F.size("n.scientific").alias("n_scientific"), F.size("n.plain").alias("n_plain"))


@query("all_numbers")
def all_numbers(spark, d):
    return responses(spark, d, "response").select("response_id", F.array_join(A.extract_numbers(F.col("response")), "|").alias("numbers"))


@query("parse_open")
def parse_open(spark, d):
    parsed = responses(spark, d, "response").select("response_id", F.explode(A.parse_open(F.col("response"))).alias("x"))
    return parsed.select("response_id", F.col("x.s").alias("text"), F.col("x.f").alias("number"))


@query("eval_open")
def eval_open(spark, d):
    r = responses(spark, d, "response", "answer")
    return r.select("response_id", A.eval_open(A.parse_open(F.col("response")), F.array("answer")).alias("correct"))


_OPTIONS = {"A": "green", "B": "almond", "C": "steel", "D": "copper"}


@query("option_letter", f"""WITH n AS (SELECT p_partkey, {strip_sql("CASE p_partkey % 4 WHEN 0 THEN '(' || chr(CAST(65 + p_partkey % 3 AS INTEGER)) || ') x' WHEN 1 THEN 'B. yes' WHEN 2 THEN p_type ELSE lower(p_name) END")} AS p FROM part)
SELECT p_partkey, CASE WHEN length(p) = 1 THEN p WHEN length(p) > 1 AND p[1] IN ('A', 'B', 'C', 'D') THEN p[1] WHEN length(p) > 1 AND contains(p, 'green') THEN 'A' WHEN length(p) > 1 AND contains(p, 'almond') THEN 'B' WHEN length(p) > 1 AND contains(p, 'steel') THEN 'C' WHEN length(p) > 1 AND contains(p, 'copper') THEN 'D'
WHEN p[2] = '.' THEN p[1] WHEN length(p) > 1 AND p[1] = '(' AND p[3] = ')' THEN p[2] ELSE p END AS letter FROM n""")
def option_letter(spark, d):
    k = F.col("p_partkey") % 4
    p = F.when(k == 0, F.concat(F.lit("("), F.chr((F.lit(65) + F.col("p_partkey") % 3).cast("int")), F.lit(") x"))).when(k == 1, F.lit("B. yes")).when(k == 2, F.col("p_type")).otherwise(F.lower("p_name"))
    options = F.create_map(*(F.lit(x) for kv in _OPTIONS.items() for x in kv))
    return table(spark, d, "part").select("p_partkey", A.option_letter(p, options).alias("letter"))


@query("choice_letter", rf"""{ctes('s')}, n AS (SELECT response_id, upper({strip_sql(rf"regexp_replace({strip_sql('response')}, '^\*+|\*+$', '', 'g')")}) AS p FROM s)
SELECT response_id, CASE WHEN length(p) = 1 THEN p WHEN regexp_matches(p, '^[A-N][^\pL]') THEN p[1] WHEN regexp_matches(p, '^\([A-N]\)') THEN p[2] END AS letter FROM n""")
def choice_letter(spark, d):
    return responses(spark, d, "response").select("response_id", A.choice_letter(F.col("response")).alias("letter"))


@query("consistency_flag", f"""{ctes('s')}, w AS (SELECT response_id, lower(regexp_replace(string_split_regex({strip_sql('meta.consistency')}, '[\\s\\p{{Z}}]+')[1], '^\\.+|\\.+$', '', 'g')) AS w FROM s)
SELECT response_id, CASE w WHEN 'yes' THEN true WHEN 'no' THEN false END AS consistent FROM w""")
def consistency_flag(spark, d):
    return responses(spark, d, "meta").select("response_id", A.is_consistent(F.col("meta.consistency")).alias("consistent"))


_FIXED = rf"""{ctes('s')}, a AS (SELECT response_id, response AS r, answer_pred AS p, answer AS g, contains(lower(answer_pred), lower(answer)) OR contains(replace(regexp_replace(lower(answer_pred), '^\.+|\.+$', '', 'g'), ',', ''), replace(regexp_replace(lower(answer), '^\.+|\.+$', '', 'g'), ',', '')) AS holds FROM s),
b AS (SELECT response_id, r, CASE WHEN holds AND p <> '' AND contains(r, p) THEN string_split(r, p)[-1] END AS tail, p, g FROM a),
c AS (SELECT response_id, CASE WHEN tail IS NOT NULL THEN {strip_sql(rf"regexp_replace({strip_sql('substring(r, 1, length(r) - length(tail) - length(p)) || g || tail')}, '^\*+|\*+$', '', 'g')")} ELSE r END AS w FROM b),
d AS (SELECT response_id, w, string_split(w, chr(10))[-1] AS last FROM c)"""


@query("fix_answer", f"{_FIXED} SELECT response_id, CASE WHEN contains(w, chr(10)) AND contains(last, '**Final') THEN {strip_sql("substring(w, 1, length(w) - length(last)) || replace(last, '**Final', 'Final')")} ELSE w END AS response FROM d")
def fix_answer(spark, d):
    r = responses(spark, d, "response", "answer", "answer_pred")
    return r.select("response_id", A.fix_answer(F.col("response"), F.col("answer_pred"), F.col("answer")).alias("response"))


# ---- scores of answers -----------------------------------------------------

_LINE = "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '%' ELSE '' END AS target, CAST(CAST(round(l_extendedprice * (1 + l_discount)) AS BIGINT) AS VARCHAR) || CASE l_linenumber % 4 WHEN 0 THEN '%' WHEN 1 THEN 'x' ELSE '' END AS prediction FROM lineitem"


def _lines(spark, d):
    text = lambda c: F.round(c).cast("bigint").cast("string")
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    target = F.concat(text(price), F.when(n % 3 == 0, F.lit("%")).otherwise(F.lit("")))
    prediction = F.concat(text(price * (1 + F.col("l_discount"))), F.when(n % 4 == 0, F.lit("%")).when(n % 4 == 1, F.lit("x")).otherwise(F.lit("")))
    return table(spark, d, "lineitem").select("l_orderkey", n, target.alias("target"), prediction.alias("prediction"))


def _relative_sql(t: str, p: str, tolerance: str) -> str:
    return f"CASE WHEN {p} IS NOT NULL AND coalesce({t}, 0) <> 0 THEN abs({p} - {t}) / abs({t}) <= {tolerance} ELSE lower(prediction) = lower(target) END"


def _pct(x: str, divide: str) -> str:
    return f"CASE WHEN ends_with({x}, '%') THEN ({number_sql(f'''regexp_replace({x}, '%+$', '')''')}) {divide} ELSE {number_sql(x)} END"


_RELAXED = f"l AS ({_LINE}), n AS (SELECT *, {_pct('target', '/ 100')} AS t, {_pct('prediction', '/ 100')} AS p FROM l), relaxed AS (SELECT l_orderkey, l_linenumber, {_relative_sql('t', 'p', '0.05')} AS correct FROM n)"


@query("relaxed_correctness", f"WITH {_RELAXED} SELECT * FROM relaxed")
def relaxed_correctness(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.relaxed_correctness(F.col("target"), F.col("prediction")).alias("correct"))


@query("relaxed_correctness_year", f"""WITH l AS ({_LINE}), n AS (SELECT *, {_pct('target', '')} AS t, {_pct('prediction', '')} AS p FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN length(target) = 4 AND starts_with(target, '20') THEN lower(prediction) = lower(target) ELSE {_relative_sql('t', 'p', '0.05')} END AS correct FROM n""")
def relaxed_correctness_year(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.relaxed_correctness_year(F.col("target"), F.col("prediction")).alias("correct"))


@query("math_score", f"""WITH l AS ({_LINE}), n AS (SELECT *, {number_sql("regexp_replace(target, 'degrees|degree|\\\\angle|°|%|cm', '', 'g')")} AS t, {number_sql("regexp_replace(prediction, 'degrees|degree|\\\\angle|°|%|cm', '', 'g')")} AS p FROM l)
SELECT l_orderkey, l_linenumber, {_relative_sql('t', 'p', '0.001')} AS correct FROM n""")
def math_score(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.math_score(F.col("target"), F.col("prediction")).alias("correct"))


@query("relaxed_accuracy", f"WITH {_RELAXED} SELECT count(*) AS asked, count(correct) AS answered, round(sum(CAST(correct AS INTEGER)), 6)::DOUBLE AS correct, round(avg(CAST(correct AS INTEGER)), 6) AS acc_answered, round(sum(CAST(correct AS INTEGER)) / count(*), 6) AS acc_asked FROM relaxed")
def relaxed_accuracy(spark, d):
    return E.accuracy(_lines(spark, d), S.relaxed_correctness(F.col("target"), F.col("prediction")).cast("int"))


@query("exact_match_accuracy", f"""{ctes('s')}, m AS (SELECT CASE WHEN answer_pred IS NOT NULL THEN CAST(lower({strip_sql('answer_pred')}) = lower({strip_sql('answer')}) AS INTEGER) END AS m FROM s)
SELECT count(*) AS asked, count(m) AS answered, round(sum(m), 6)::DOUBLE AS correct, round(avg(m), 6) AS acc_answered, round(sum(m) / count(*), 6) AS acc_asked FROM m""")
def exact_match_accuracy(spark, d):
    r = responses(spark, d, "answer_pred", "answer")
    return E.accuracy(r, (F.lower(strip(F.col("answer_pred"))) == F.lower(strip(F.col("answer")))).cast("int"))


def _mc_sql(p: str, g: str) -> str:
    dotted = f"CASE WHEN length({p}) >= 2 AND {p}[2] = '.' THEN {p}[1] ELSE {p} END"
    return f"(lower({p}) = lower({g}) OR lower(CASE WHEN length({dotted}) >= 3 AND ({dotted})[1] = '(' AND ({dotted})[3] = ')' THEN ({dotted})[2] ELSE {dotted} END) = lower({g}))"


@query("multi_choice_score", f"""{ctes('s')}, n AS (SELECT response_id, {strip_sql('answer_pred')} AS p, {strip_sql('answer')} AS g FROM s) SELECT response_id, {_mc_sql('p', 'g')} AS correct FROM n""")
def multi_choice_score(spark, d):
    return responses(spark, d, "answer_pred", "answer").select("response_id", S.multi_choice_score(F.col("answer_pred"), F.col("answer")).alias("correct"))


_MODES_SQL = "CASE WHEN contains(x, 'chart') THEN 'relaxed_accuracy' WHEN contains(x, 'docvqa') OR contains(x, 'infographics') THEN 'anls' WHEN contains(x, 'SROIE') OR contains(x, 'CLEVR_math') OR contains(x, 'geos') OR contains(x, 'geometry') THEN 'relaxed_accuracy|vqa_score|mc_score' ELSE 'vqa_score|mc_score|math_score' END"


@query("metric_mode", f"SELECT ds_name, {_MODES_SQL.replace(chr(39) + 'chart' + chr(39), chr(39) + 'chartqa' + chr(39)).replace('contains(x,', 'contains(ds_name,')} AS modes FROM dataset_registry")
def metric_mode(spark, d):
    return table(spark, d, "dataset_registry").select("ds_name", F.array_join(S.metric_modes(F.col("ds_name")), "|").alias("modes"))


@query("check_answer", f"""{ctes('s')}, l AS (SELECT response_id, answer_pred AS prediction, answer AS target, {strip_sql('answer_pred')} AS p, {strip_sql('answer')} AS g FROM s),
n AS (SELECT *, {_pct('target', '')} AS t, {_pct('prediction', '')} AS q, {number_sql("regexp_replace(target, 'degrees|degree|\\\\angle|°|%|cm', '', 'g')")} AS mt, {number_sql("regexp_replace(prediction, 'degrees|degree|\\\\angle|°|%|cm', '', 'g')")} AS mp FROM l)
SELECT response_id, CASE WHEN lower(prediction) = lower(target) OR coalesce({_mc_sql('p', 'g')}, false) OR coalesce({_relative_sql('mt', 'mp', '0.001')}, false) OR coalesce(CASE WHEN length(target) = 4 AND starts_with(target, '20') THEN lower(prediction) = lower(target) ELSE {_relative_sql('t', 'q', '0.05')} END, false) THEN 1 ELSE 0 END AS correct FROM n""")
def check_answer(spark, d):
    modes = F.array(F.lit("mc_score"), F.lit("math_score"), F.lit("relaxed_accuracy"))
    return responses(spark, d, "answer_pred", "answer").select("response_id", S.check_answer(F.col("answer_pred"), F.col("answer"), modes).alias("correct"))


@query("edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


_CHOICES = ("ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL", "MEDIUM")


@query("closest_choice", f"""WITH c AS (SELECT unnest({list(_CHOICES)}) AS c, unnest(range({len(_CHOICES)})) AS i), r AS (SELECT p_partkey, c, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(upper(p_type || p_name), c), i) AS rn FROM part, c) SELECT p_partkey, c AS choice FROM r WHERE rn = 1""")
def closest_choice(spark, d):
    choices = F.array(*(F.lit(c) for c in _CHOICES))
    return table(spark, d, "part").select("p_partkey", S.closest_choice(F.upper(F.concat("p_type", "p_name")), choices).alias("choice"))


def _anls_sql(a: str, b: str) -> str:
    flat = lambda x: rf"regexp_replace(lower({strip_sql(x)}), '[\s\p{{Z}}]+', ' ', 'g')"
    v = f"(1 - levenshtein({flat(a)}, {flat(b)}) / greatest(length({a}), length({b})))"
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 WHEN {v} < 0.5 THEN 0.0 ELSE {v} END"


_ANLS = f"""a AS (SELECT x.p_partkey, x.p_type, greatest({_anls_sql('x.p_name', 'y.p_name')}, {_anls_sql('x.p_name', 'z.p_name')}) AS score FROM part x JOIN part y ON y.p_partkey = x.p_partkey // 2 + 1 JOIN part z ON z.p_partkey = x.p_partkey // 3 + 1)"""


def _anls(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    gold = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("g"))
    x = part.join(gold, F.floor(F.col("p_partkey") / 2) + 1 == F.col("k")).drop("k")
    y = x.join(gold.withColumnRenamed("g", "h"), F.floor(F.col("p_partkey") / 3) + 1 == F.col("k"))
    return y.select("p_partkey", "p_type", S.anls(F.col("p_name"), F.array("g", "h")).alias("score"))


@query("anls", f"WITH {_ANLS} SELECT p_partkey, round(score, 6)::DOUBLE AS score FROM a")
def anls(spark, d):
    return _anls(spark, d).select("p_partkey", F.round("score", 6).alias("score"))


@query("anls_by_type", f"WITH {_ANLS} SELECT 'p_type' AS facet, p_type AS value, count(*) AS n, round(avg(score), 6)::DOUBLE AS acc FROM a GROUP BY p_type")
def anls_by_type(spark, d):
    return E.accuracy_by_facet(_anls(spark, d), ["p_type"], F.col("score"))


_VOTES = "SELECT o_orderkey, CAST(pow(o_orderkey, 1) AS BIGINT) % 11 AS m FROM orders"


@query("vqa_consensus", f"WITH v AS ({_VOTES}) SELECT o_orderkey, round(CASE WHEN m = 0 THEN 0 ELSE (m * least(1.0, (m - 1) / 3) + (10 - m) * least(1.0, m / 3)) / 10 END, 6)::DOUBLE AS score FROM v")
def vqa_consensus(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.consensus(F.col("o_orderkey") % 11), 6).alias("score"))


@query("vqa_accuracy", f"WITH v AS ({_VOTES}) SELECT count(*) AS n, round(avg(CASE WHEN m = 0 THEN 0 ELSE (m * least(1.0, (m - 1) / 3) + (10 - m) * least(1.0, m / 3)) / 10 END), 6)::DOUBLE AS acc FROM v")
def vqa_accuracy(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.avg(S.consensus(F.col("o_orderkey") % 11)), 6).alias("acc"))


def evalai_sql(x: str, name: str) -> str:
    """CTEs that end in ``name``: (id, n), the common form of (id, v) rows of the relation ``x``."""
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    dropped = "t"
    for sign in A.SIGNS:
        c = quoted(sign)
        dropped = f"replace({dropped}, {c}, CASE WHEN contains(t, {quoted(sign + ' ')}) OR contains(t, {quoted(' ' + sign)}) OR g THEN '' ELSE ' ' END)"
    words = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in (A.NUMBER_WORDS | A.CONTRACTIONS).items())
    clean = strip_sql(r"regexp_replace(replace(regexp_replace(lower(v), '[,?]', '', 'g'), chr(39) || 's', ' ' || chr(39) || 's'), '[\n\t]', ' ', 'g')")
    return rf"""{name}_t AS (SELECT id, {clean} AS t FROM {x}), {name}_g AS (SELECT id, t, regexp_matches(t, '\d,+\d') AS g FROM {name}_t), {name}_d AS (SELECT id, {dropped} AS o FROM {name}_g),
{name}_w AS (SELECT id, list_filter(string_split_regex(lower(replace(replace(regexp_replace(o, '\.(\d)', chr(1) || '\1', 'g'), '.', ''), chr(1), '.')), '[\s\p{{Z}}]+'), lambda w: w <> '' AND w NOT IN {A.ARTICLES}) AS w FROM {name}_d),
{name} AS (SELECT id, array_to_string(list_transform(w, lambda x: coalesce(MAP {{{words}}}[x], x)), ' ') AS n FROM {name}_w)"""


_VOTED = f"""{ctes('s')}, v AS (SELECT response_id AS id, answer_pred, answer FROM s WHERE answer_pred IS NOT NULL), p AS (SELECT id, answer_pred AS v FROM v), q AS (SELECT id, answer AS v FROM v), r AS (SELECT id, answer || ' x' AS v FROM v), {evalai_sql('p', 'pn')}, {evalai_sql('q', 'qn')}, {evalai_sql('r', 'rn')},
m AS (SELECT pn.id, (CASE WHEN pn.n = qn.n THEN 1 ELSE 0 END) * (1 + pn.id % 10) + (CASE WHEN pn.n = rn.n THEN 1 ELSE 0 END) * (9 - pn.id % 10) AS m FROM pn JOIN qn USING (id) JOIN rn USING (id)),
z AS (SELECT id, CASE WHEN m = 0 THEN 0 ELSE (m * least(1.0, (m - 1) / 3) + (10 - m) * least(1.0, m / 3)) / 10 END AS score FROM m)"""


@query("vqa_accuracy_answers", f"{_VOTED} SELECT count(*) AS n, round(avg(round(score, 6)), 5)::DOUBLE AS acc FROM z")
def vqa_accuracy_answers(spark, d):
    return vqa_score_answers(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("acc"))


@query("vqa_score_answers", f"{_VOTED} SELECT id AS response_id, round(score, 6)::DOUBLE AS score FROM z")
def vqa_score_answers(spark, d):
    r = responses(spark, d, "answer_pred", "answer").where("answer_pred IS NOT NULL")
    # ten annotators, of whom 1 + id % 10 gave the answer and the others something else
    answers = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i <= F.col("response_id") % 10, F.col("answer")).otherwise(F.concat(F.col("answer"), F.lit(" x"))))
    return r.select("response_id", F.round(S.vqa_score(F.col("answer_pred"), answers), 6).alias("score"))


@query("evalai_normalize", f"{ctes('s')}, p AS (SELECT response_id AS id, answer AS v FROM s), {evalai_sql('p', 'pn')} SELECT id AS response_id, n AS answer FROM pn")
def evalai_normalize(spark, d):
    return responses(spark, d, "answer").select("response_id", A.evalai_normalize(F.col("answer")).alias("answer"))


@query("evalai_normalize_texts", f"{ctes('s')}, p AS (SELECT response_id AS id, question AS v FROM s), {evalai_sql('p', 'pn')} SELECT id AS response_id, n AS text FROM pn")
def evalai_normalize_texts(spark, d):
    return responses(spark, d, "question").select("response_id", A.evalai_normalize(F.col("question")).alias("text"))


_EXTRACTED = f"""WITH a AS (SELECT item_id, answer, coalesce(choices, []) AS choices, choices IS NOT NULL AS multi, {strip_sql('answer')} AS bare FROM eval_items), b AS (SELECT *, CASE WHEN regexp_extract(bare, '\\(([a-zA-Z])\\)', 1) <> '' THEN upper(regexp_extract(bare, '\\(([a-zA-Z])\\)', 1)) ELSE bare END AS shown, {number_sql('answer')} AS number FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(shown, '^[A-Z]$') THEN ascii(shown) - 64 END AS place FROM b),
d AS (SELECT *, CASE WHEN place <= len(choices) THEN choices[place] END AS named, list_sort(list_transform(list_zip(choices, range(1, len(choices) + 1)), lambda z: {{'d': levenshtein(shown, z[1]), 'i': z[2], 'c': z[1]}}))[1].c AS near FROM c)"""


@query("normalize_extracted", f"{_EXTRACTED} SELECT item_id, CASE WHEN multi THEN coalesce(named, near) WHEN item_id % 2 = 0 THEN CAST(CAST(trunc(number) AS BIGINT) AS VARCHAR) ELSE CAST(round(number * 10) / 10 AS VARCHAR) END AS answer FROM d")
def normalize_extracted(spark, d):
    items = table(spark, d, "eval_items")
    kind = F.when(F.col("choices").isNotNull(), "multi_choice").otherwise("free_form")
    form = F.when(F.col("item_id") % 2 == 0, "integer").otherwise("float")
    out = A.normalize_extracted(F.col("answer"), F.coalesce("choices", F.array().cast("array<string>")), kind, form, F.lit(1))
    return items.select("item_id", out.alias("answer"))


_UNITS = "'degrees|degree|\\\\angle|°|%|cm'"
_BLANKS = "'[\\s\\p{Z}]+'"
_JUDGED = f"""{ctes('s')}, l AS (SELECT response_id AS id, ds_name, answer_pred AS prediction, answer AS target, {strip_sql('answer_pred')} AS p, {strip_sql('answer')} AS g FROM s), a AS (SELECT id, prediction AS v FROM l), b AS (SELECT id, target AS v FROM l), {evalai_sql('a', 'an')}, {evalai_sql('b', 'bn')},
n AS (SELECT l.*, {_MODES_SQL.replace("'chart'", "'chartqa'").replace('contains(x,', 'contains(ds_name,')} AS modes, an.n AS pn, bn.n AS gn, {_pct('target', '')} AS t, {_pct('prediction', '')} AS q, {number_sql(f"regexp_replace(target, {_UNITS}, '', 'g')")} AS mt, {number_sql(f"regexp_replace(prediction, {_UNITS}, '', 'g')")} AS mp,
1 - levenshtein(regexp_replace(lower(g), {_BLANKS}, ' ', 'g'), regexp_replace(lower(p), {_BLANKS}, ' ', 'g')) / greatest(length(prediction), length(target), 1) AS near FROM l JOIN an USING (id) JOIN bn USING (id)),
c AS (SELECT ds_name, CASE WHEN lower(prediction) = lower(target) OR coalesce(contains(modes, 'vqa_score') AND pn = gn AND pn <> '', false) OR coalesce(contains(modes, 'mc_score') AND {_mc_sql('p', 'g')}, false) OR coalesce(contains(modes, 'math_score') AND {_relative_sql('mt', 'mp', '0.001')}, false) OR coalesce(contains(modes, 'anls') AND near > 0.9, false)
OR coalesce(contains(modes, 'relaxed_accuracy') AND CASE WHEN length(target) = 4 AND starts_with(target, '20') THEN lower(prediction) = lower(target) ELSE {_relative_sql('t', 'q', '0.05')} END, false) THEN 1 ELSE 0 END AS correct FROM n)"""


@query("check_answer_by_source", f"{_JUDGED} SELECT ds_name, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM c GROUP BY ds_name")
def check_answer_by_source(spark, d):
    r = responses(spark, d, "ds_name", "answer_pred", "answer")
    scored = r.select("ds_name", S.check_answer(F.col("answer_pred"), F.col("answer"), S.metric_modes(F.col("ds_name"))).alias("correct"))
    return scored.groupBy("ds_name").agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"))


# ---- accuracies ------------------------------------------------------------

_FACETS = f"{ctes('s')}"


@query("accuracy_by_facet", f"""{_FACETS}, x AS (SELECT ds_name, image, is_correct FROM s WHERE is_correct IS NOT NULL)
SELECT 'ds_name' AS facet, ds_name AS value, count(*) AS n, round(avg(is_correct), 6) AS acc FROM x GROUP BY ds_name
UNION ALL SELECT 'image', i, count(*), round(avg(is_correct), 6) FROM (SELECT unnest(image) AS i, is_correct FROM x) GROUP BY i""")
def accuracy_by_facet(spark, d):
    r = responses(spark, d, "ds_name", "image", "is_correct").where("is_correct IS NOT NULL")
    return E.accuracy_by_facet(r, ["ds_name", "image"], F.col("is_correct"))


@query("accuracy_rollup", f"""{_FACETS}, x AS (SELECT substring(ds_name, 1, 1) AS domain, ds_name AS category, is_correct FROM s WHERE is_correct IS NOT NULL)
SELECT domain, category, count(*) AS n, round(avg(is_correct), 6) AS acc, CAST(grouping(domain, category) AS INTEGER) AS level FROM x GROUP BY ROLLUP (domain, category)""")
def accuracy_rollup(spark, d):
    r = responses(spark, d, "ds_name", "is_correct").where("is_correct IS NOT NULL")
    return E.accuracy_rollup(r.select(F.substring("ds_name", 1, 1).alias("domain"), F.col("ds_name").alias("category"), "is_correct"), "domain", "category", F.col("is_correct"))


@query("validate_submission", """WITH p AS (SELECT response_id AS id FROM sampled_response WHERE response_id % 7 <> 0), g AS (SELECT DISTINCT response_id AS id FROM sampled_response WHERE response_id % 11 <> 0),
a AS (SELECT id, count(*) AS np FROM p GROUP BY id), b AS (SELECT id, count(*) AS ng FROM g GROUP BY id), f AS (SELECT np, ng FROM a FULL JOIN b USING (id)),
r AS (SELECT CAST(sum(np) AS BIGINT) AS n_predictions, CAST(sum(ng) AS BIGINT) AS n_gold, count(*) FILTER (np IS NULL) AS missing, count(*) FILTER (ng IS NULL) AS unknown, count(*) FILTER (np > 1) AS repeated FROM f)
SELECT *, missing = 0 AND unknown = 0 AND repeated = 0 AS valid FROM r""")
def validate_submission(spark, d):
    # predictions and gold answers overlap without being the same: the two sides of a faulty submission
    ids = table(spark, d, "sampled_response").select(F.col("response_id").alias("id"))
    return E.validate_submission(ids.where("id % 7 <> 0"), ids.where("id % 11 <> 0").distinct(), "id")


@query("score_gain", """WITH s AS (SELECT DISTINCT ON (response_id) * FROM sampled_response), a AS (SELECT ds_name, round(avg(is_correct), 6) AS acc FROM s WHERE is_correct IS NOT NULL GROUP BY ds_name)
SELECT ds_name, acc, repeat_time AS baseline, round(acc - repeat_time, 2) AS gain FROM a JOIN dataset_registry USING (ds_name)""")
def score_gain(spark, d):
    r = responses(spark, d, "ds_name", "is_correct").where("is_correct IS NOT NULL")
    scores = r.groupBy("ds_name").agg(F.round(F.avg("is_correct"), 6).alias("acc"))
    return E.gain(scores, table(spark, d, "dataset_registry").select("ds_name", F.col("repeat_time").alias("acc")), ["ds_name"])


def _grams_sql(words: str) -> str:
    return "list_concat(" + ", ".join(f"list_transform(range(1, greatest(1, CAST(len({words}) - {n} + 2 AS BIGINT))), lambda i: {n} || ':' || array_to_string({words}[i:i + {n - 1}], ' '))" for n in range(1, 5)) + ")"


@query("bleu4", f"""{ctes('s')}, t AS (SELECT response_id AS id, {tokens_sql('lower(question)')} AS c, {tokens_sql('lower(question_orig)')} AS r FROM s WHERE question_orig IS NOT NULL),
g AS (SELECT id, unnest({_grams_sql('c')}) AS gram, 1 AS c, 0 AS r FROM t UNION ALL SELECT id, unnest({_grams_sql('r')}), 0, 1 FROM t), k AS (SELECT id, gram, sum(c) AS c, sum(r) AS r FROM g GROUP BY ALL),
o AS (SELECT id, string_split(gram, ':')[1] AS n, sum(least(c, r)) AS hits, sum(c) AS total FROM k GROUP BY ALL), l AS (SELECT id, sum(ln(hits / total)) / 4 AS logs, count(*) AS found FROM o WHERE hits > 0 GROUP BY id)
SELECT t.id AS response_id, round(CASE WHEN found = 4 THEN exp(logs + CASE WHEN len(c) >= len(r) THEN 0 ELSE 1 - len(r) / len(c) END) ELSE 0 END, 6)::DOUBLE AS bleu FROM t LEFT JOIN l ON l.id = t.id""")
def bleu4(spark, d):
    r = responses(spark, d, "question", "question_orig").where("question_orig IS NOT NULL")
    return E.bleu4(r, "response_id", F.col("question"), F.col("question_orig")).select("response_id", F.round("bleu", 6).alias("bleu"))
