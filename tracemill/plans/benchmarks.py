"""Queries on evaluation joins, metrics, orders and step scores that the other plans do not have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import geometry as V
from tracemill.functions import inputs as I
from tracemill.functions import prompts as M
from tracemill.functions import scores as S
from tracemill.functions.text import strip
from tracemill.operators import evaluate as E
from tracemill.operators import hierarchy as H
from tracemill.operators import packing as K
from tracemill.operators import rewards as R
from tracemill.operators import sampling as P
from tracemill.plans.registry import ctes, judgments, pairs, query, responses, strip_sql, tokens_sql
from tracemill.plans.scoring import _LINE, _OPTIONS, _pct, _relative_sql
from tracemill.session import table
from tracemill.sources.io import criteria_pairs, data_url

# ---- answers against gold --------------------------------------------------


@query("safe_equal", f"{ctes('s')} SELECT response_id, answer_pred IS NOT DISTINCT FROM answer AS same FROM s")
def safe_equal(spark, d):
    return responses(spark, d, "answer_pred", "answer").select("response_id", S.safe_equal(F.col("answer_pred"), F.col("answer")).alias("same"))


@query("eval_multi_choice", "SELECT item_id, coalesce(list_contains([answer, upper(answer)], CASE WHEN item_id % 2 = 0 THEN answer ELSE choices[1] END), false) AS correct FROM eval_items")
def eval_multi_choice(spark, d):
    prediction = F.when(F.col("item_id") % 2 == 0, F.col("answer")).otherwise(F.get("choices", F.lit(0)))
    return table(spark, d, "eval_items").select("item_id", E.eval_multi_choice(F.array("answer", F.upper("answer")), prediction).alias("correct"))


@query("plain_option_letter", f"""WITH n AS (SELECT p_partkey, {strip_sql("CASE p_partkey % 4 WHEN 0 THEN '(A) x' WHEN 1 THEN 'B. yes' WHEN 2 THEN p_type ELSE lower(p_name) END")} AS p FROM part)
SELECT p_partkey, CASE WHEN length(p) <= 1 THEN p WHEN p[1] IN ('A', 'B', 'C', 'D') THEN p[1] WHEN contains(p, 'green') THEN 'A' WHEN contains(p, 'almond') THEN 'B' WHEN contains(p, 'steel') THEN 'C' WHEN contains(p, 'copper') THEN 'D' ELSE p END AS letter FROM n""")
def plain_option_letter(spark, d):
    k = F.col("p_partkey") % 4
    p = F.when(k == 0, F.lit("(A) x")).when(k == 1, F.lit("B. yes")).when(k == 2, F.col("p_type")).otherwise(F.lower("p_name"))
    options = F.create_map(*(F.lit(x) for kv in _OPTIONS.items() for x in kv))
    return table(spark, d, "part").select("p_partkey", A.plain_option_letter(p, options).alias("letter"))


@query("gold_default", f"{ctes('s')}, g AS (SELECT response_id, answer AS gold FROM s WHERE response_id % 7 <> 0) SELECT s.response_id, coalesce(answer_pred, gold, '') AS answer FROM s LEFT JOIN g USING (response_id)")
def gold_default(spark, d):
    r = responses(spark, d, "answer_pred", "answer")
    own = r.select("response_id", F.col("answer_pred").alias("answer"))
    return E.with_gold_default(own, r.where("response_id % 7 <> 0").select("response_id", "answer"), "response_id").select("response_id", "answer")


_IDS = "'part_' || ds_name || '_' || response_id"


@query("category_join", f"""{ctes('s')}, o AS (SELECT {_IDS} AS id, ds_name AS category, answer_pred FROM s WHERE response_id % 3 <> 0), a AS (SELECT {_IDS} AS id, ds_name AS category, answer FROM s WHERE ds_name <> (SELECT min(ds_name) FROM s))
SELECT o.id, o.category, answer_pred, answer FROM o JOIN a USING (id) WHERE o.category IN (SELECT category FROM a)""")
def category_join(spark, d):
    r = responses(spark, d, "ds_name", "answer_pred", "answer")
    named = r.withColumn("id", F.concat(F.lit("part_"), "ds_name", F.lit("_"), F.col("response_id").cast("string")))
    first = r.agg(F.min("ds_name").alias("first"))
    answers = named.join(F.broadcast(first), F.col("ds_name") != F.col("first"))  # one row
    return E.align_by_category(named.where("response_id % 3 <> 0").select("id", "answer_pred"), answers.select("id", "answer"), "id").select("id", "category", "answer_pred", "answer")


_NOTES = f"{ctes('s')}, a AS (SELECT response_id, answer_pred, [answer, answer || ' ' || ds_name, question_orig] AS notes FROM s)"


@query("exact_match_best", f"{_NOTES} SELECT response_id, list_max(list_transform(notes, lambda x: CAST(lower({strip_sql('answer_pred')}) = lower({strip_sql('x')}) AS DOUBLE))) AS score FROM a")
def exact_match_best(spark, d):
    r = responses(spark, d, "ds_name", "answer_pred", "answer", "question_orig")
    notes = F.array("answer", F.concat("answer", F.lit(" "), "ds_name"), "question_orig")
    same = lambda a: F.lower(strip(F.col("answer_pred"))) == F.lower(strip(a))
    return r.select("response_id", E.best_annotation(same, notes).alias("score"))


_TAXED = _LINE.replace("AS target", "AS target, CAST(CAST(round(l_extendedprice * (1 + l_tax)) AS BIGINT) AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '%' ELSE '' END AS other")


@query("relaxed_best", f"""WITH l AS ({_TAXED}), n AS (SELECT *, {_pct('target', '/ 100')} AS t, {_pct('prediction', '/ 100')} AS p FROM l), m AS (SELECT * EXCLUDE (target, other), other AS target, {_pct('other', '/ 100')} AS t, {_pct('prediction', '/ 100')} AS p, {_relative_sql('t', 'p', '0.05')} AS first FROM (SELECT * FROM n) AS n)
SELECT l_orderkey, l_linenumber, greatest(CAST(first AS INTEGER), CAST({_relative_sql('t2', 'p', '0.05')} AS INTEGER))::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, prediction, target, p, first, {_pct('target', '/ 100')} AS t2 FROM m)""")
def relaxed_best(spark, d):
    text = lambda c: F.round(c).cast("bigint").cast("string")
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    end = F.when(n % 3 == 0, F.lit("%")).otherwise(F.lit(""))
    prediction = F.concat(text(price * (1 + F.col("l_discount"))), F.when(n % 4 == 0, F.lit("%")).when(n % 4 == 1, F.lit("x")).otherwise(F.lit("")))
    notes = F.array(F.concat(text(price), end), F.concat(text(price * (1 + F.col("l_tax"))), end))
    return table(spark, d, "lineitem").select("l_orderkey", n, E.best_annotation(lambda a: S.relaxed_correctness(a, prediction), notes).alias("score"))


@query("title_accuracy", f"{ctes('s')} SELECT count(*) AS n, count(*) FILTER (lower(answer_pred) = lower(answer)) AS n_correct FROM s WHERE answer_pred IS NOT NULL")
def title_accuracy(spark, d):
    r = responses(spark, d, "answer_pred", "answer").where("answer_pred IS NOT NULL")
    return r.agg(F.count("*").alias("n"), F.count_if(E.title_equal(F.col("answer_pred"), F.col("answer"))).alias("n_correct"))


@query("percent_by_source", f"{ctes('s')} SELECT ds_name, CAST(round(100.0::DOUBLE * sum(is_correct) / count(*), 2) AS VARCHAR) AS percent FROM s WHERE is_correct IS NOT NULL GROUP BY ds_name")
def percent_by_source(spark, d):
    r = responses(spark, d, "ds_name", "is_correct").where("is_correct IS NOT NULL")
    return r.groupBy("ds_name").agg(E.percent(F.sum("is_correct"), F.count("*")).alias("percent"))


@query("full_denominator", f"{ctes('s')} SELECT count(*) AS n, round(avg(CASE WHEN response_id % 5 <> 0 THEN coalesce(is_correct, 0) ELSE 0 END), 6)::DOUBLE AS mean FROM s WHERE response_id NOT IN (1, 2, 3)")
def full_denominator(spark, d):
    r = responses(spark, d, "is_correct").withColumn("is_correct", F.col("is_correct").cast("double"))
    return E.full_denominator(r.where("response_id % 5 <> 0"), r, "response_id", "is_correct", [1, 2, 3])


@query("report_lines", f"""{ctes('s')}, a AS (SELECT 'ds_name' AS facet, ds_name AS value, round(avg(is_correct), 6) AS acc FROM s WHERE is_correct IS NOT NULL GROUP BY ds_name)
SELECT facet, string_agg(value || ': ' || printf('%.4f', acc), chr(10) ORDER BY value) AS lines FROM a GROUP BY facet""")
def report_lines(spark, d):
    r = responses(spark, d, "ds_name", "is_correct").where("is_correct IS NOT NULL")
    return E.report_lines(E.accuracy_by_facet(r, ["ds_name"], F.col("is_correct")), "facet", "value", "acc")


# ---- judge output ----------------------------------------------------------

_REVIEWED = f"{ctes('j')}, g AS (SELECT judgment_id, flatten(list_transform(coalesce(chosen_step_reviews, []), lambda r: coalesce(r.reward_categories, []))) AS good, flatten(list_transform(coalesce(rejected_step_reviews, []), lambda r: coalesce(r.reward_categories, []))) AS bad FROM j)"


def _by_id(spark, d):
    return R.categories_by_id(judgments(spark, d, "chosen_step_reviews", "rejected_step_reviews"), "judgment_id", "chosen_step_reviews", "rejected_step_reviews")


@query("categories_by_id", f"{_REVIEWED} SELECT judgment_id, array_to_string(good, '|') AS good, array_to_string(bad, '|') AS bad FROM g")
def categories_by_id(spark, d):
    return _by_id(spark, d).select("judgment_id", F.array_join("good", "|").alias("good"), F.array_join("bad", "|").alias("bad"))


@query("category_index", f"""{_REVIEWED}, x AS (SELECT 'good' AS mode, judgment_id, unnest(good) AS category FROM g UNION ALL SELECT 'bad', judgment_id, unnest(bad) FROM g), y AS (SELECT * FROM x UNION ALL SELECT 'all', judgment_id, category FROM x)
SELECT mode, category, count(DISTINCT judgment_id) AS support FROM y WHERE category IS NOT NULL GROUP BY ALL""")
def category_index(spark, d):
    return R.category_index(_by_id(spark, d), "judgment_id")


@query("ordered_reviews", f"""{ctes('j')}, u AS (SELECT judgment_id, generate_subscripts(chosen_step_reviews, 1) AS k, unnest(chosen_step_reviews) AS r FROM j)
SELECT judgment_id, string_agg(coalesce(CAST(r.step_index AS VARCHAR), '-'), ',' ORDER BY r.step_index IS NULL, r.step_index, k) AS places FROM u GROUP BY judgment_id""")
def ordered_reviews(spark, d):
    j = judgments(spark, d, "chosen_step_reviews").where(F.size("chosen_step_reviews") > 0)
    ordered = R.in_step_order(F.col("chosen_step_reviews"))
    return j.select("judgment_id", F.array_join(F.transform(ordered, lambda r: F.coalesce(r["step_index"].cast("string"), F.lit("-"))), ",").alias("places"))


@query("first_criteria", f"{_REVIEWED}, n AS (SELECT judgment_id, list_filter(good, lambda x: x IS NOT NULL) AS good FROM g) SELECT judgment_id, array_to_string(list_transform(list_filter(list_zip(good, range(1, len(good) + 1)), lambda z: list_position(good, z[1]) = z[2]), lambda z: z[1])[1:5], '|') AS criteria FROM n")
def first_criteria(spark, d):
    return _by_id(spark, d).select("judgment_id", F.array_join(R.first_distinct(F.filter("good", lambda x: x.isNotNull()), 5), "|").alias("criteria"))


@query("review_mean_scores", f"""{ctes('j')}, u AS (SELECT judgment_id, generate_subscripts(chosen_step_reviews, 1) AS k, unnest(chosen_step_reviews) AS r FROM j), v AS (SELECT DISTINCT judgment_id, k, r.reward_scores AS m, {strip_sql('c')} AS c FROM (SELECT *, unnest(map_keys(r.reward_scores)) AS c FROM u)),
w AS (SELECT judgment_id, k, least(10, greatest(1, coalesce(m[c], 5))) AS s FROM v WHERE c <> '')
SELECT judgment_id, CAST(k - 1 AS INTEGER) AS place, round(avg((s - 1) / 9.0), 6)::DOUBLE AS mean FROM w GROUP BY ALL""")
def review_mean_scores(spark, d):
    j = judgments(spark, d, "chosen_step_reviews").select("judgment_id", F.posexplode("chosen_step_reviews").alias("place", "r"))
    scores = F.coalesce("r.reward_scores", F.create_map().cast("map<string,int>"))
    made = j.select("judgment_id", "place", R.normalize_review(F.map_keys(scores), scores, None, 0, 10_000).alias("x"))
    return made.where(F.size("x.categories") > 0).select("judgment_id", "place", F.round("x.mean", 6).alias("mean"))


@query("coerced_scores", f"{ctes('s')}, n AS (SELECT response_id, TRY_CAST({strip_sql('answer')} AS DOUBLE) AS v, {strip_sql('answer')} AS t FROM s) SELECT response_id, CAST(least(10, greatest(1, CASE WHEN regexp_matches(t, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN round_even(v, 0) ELSE 5 END)) AS INTEGER) AS score FROM n")
def coerced_scores(spark, d):
    return responses(spark, d, "answer").select("response_id", S.coerce_score(F.col("answer")).alias("score"))


# ---- step and preference losses --------------------------------------------


@query("prm_probability", "SELECT event_id, round(1 / (1 + exp((event_id % 5) - value % 7)), 3)::DOUBLE AS score FROM events")
def prm_probability(spark, d):
    return table(spark, d, "events").select("event_id", S.prm_probability(F.col("value") % 7, F.col("event_id") % 5).alias("score"))


@query("prm_loss", "WITH p AS (SELECT user_id, least(1 - 1e-9, greatest(1e-9, 1 / (1 + exp((event_id % 5) - value % 7)))) AS p, event_id % 2 AS y FROM events) SELECT user_id, round(avg(-2 * (y * ln(p) + (1 - y) * ln(1 - p))), 6)::DOUBLE AS loss FROM p GROUP BY user_id")
def prm_loss(spark, d):
    p = 1 / (1 + F.exp(F.col("event_id") % 5 - F.col("value") % 7))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(S.step_loss(p, F.col("event_id") % 2)), 6).alias("loss"))


@query("preference_loss", "WITH m AS (SELECT event_id, value % 7 - event_id % 5 AS m, value % 3 AS nll FROM events) SELECT event_id, round(0.8 * ln(1 + exp(-0.1 * m)) + 0.2 * greatest(0.0, 1 - 0.1 * m) + 0.5 * nll, 6)::DOUBLE AS loss FROM m")
def preference_loss(spark, d):
    m = F.col("value") % 7 - F.col("event_id") % 5
    return table(spark, d, "events").select("event_id", F.round(S.preference_loss(m, F.col("value") % 3, {"sigmoid": 0.8, "hinge": 0.2}, 0.5), 6).alias("loss"))


@query("raw_vector", f"{ctes('j')}, u AS (SELECT judgment_id, generate_subscripts(chosen_step_reviews, 1) AS k, unnest(chosen_step_reviews) AS r FROM j) SELECT judgment_id, CAST(k - 1 AS INTEGER) AS place, round((least(10.0, greatest(1.0, coalesce(r.reward_scores['Visual Grounding'][1], 5))) - 1) / 9, 6)::DOUBLE AS a, round((least(10.0, greatest(1.0, coalesce(r.reward_scores['Domain Knowledge'][1], 5))) - 1) / 9, 6)::DOUBLE AS b FROM u".replace("[1],", ","))
def raw_vector(spark, d):
    j = judgments(spark, d, "chosen_step_reviews").select("judgment_id", F.posexplode("chosen_step_reviews").alias("place", "r"))
    v = S.raw_vector(F.col("r.reward_scores"), ("Visual Grounding", "Domain Knowledge"))
    return j.select("judgment_id", "place", F.round(F.get(v, 0), 6).alias("a"), F.round(F.get(v, 1), 6).alias("b"))


# ---- orders, limits and shards ---------------------------------------------


@query("frame_number", "SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(n, '_(\\d+).jpg$', 1), '') AS INTEGER), -1) AS number FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || '_' || p_partkey || '.jpg' END AS n FROM part)")
def frame_number(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".jpg")))
    return table(spark, d, "part").select("p_partkey", I.frame_number(name).alias("number"))


@query("head_rows", "SELECT doc_id FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 200) WHERE trim(coalesce(text, '')) <> ''")
def head_rows(spark, d):
    # the limit is the feature; blank rows count against it
    return P.head(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 200, "text").select("doc_id")


@query("round_robin", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS INTEGER) AS worker FROM orders")
def round_robin(spark, d):
    return P.round_robin(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8)


@query("even_shards", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () // 7 AS size FROM orders) SELECT o_orderkey, CAST(rn // size AS INTEGER) AS shard FROM r WHERE rn < size * 7")
def even_shards(spark, d):
    return P.even_shards(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("image_order", f"{ctes('s')} SELECT response_id, CAST(response_id % 4 AS INTEGER) AS shard, row_number() OVER (PARTITION BY response_id % 4 ORDER BY image[1] NULLS FIRST, response_id) AS place FROM s")
def image_order(spark, d):
    r = responses(spark, d, "image").withColumn("shard", (F.col("response_id") % 4).cast("int"))
    order = Window.partitionBy("shard").orderBy(F.get("image", F.lit(0)).asc_nulls_first(), "response_id")
    return r.select("response_id", "shard", F.row_number().over(order).cast("bigint").alias("place"))


@query("ordered_clusters", "WITH m AS (SELECT n_regionkey AS cluster, list_sort(list(n_name)) AS members FROM nation GROUP BY n_regionkey) SELECT cluster, array_to_string(members, '|') AS members, row_number() OVER (ORDER BY -len(members), members) AS place FROM m")
def ordered_clusters(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("name"))
    return H.ordered_clusters(n, "cluster", "name").select("cluster", F.array_join("members", "|").alias("members"), "place")


@query("least_over_ranks", f"{ctes('s')}, n AS (SELECT ds_name, count(*) AS n FROM s GROUP BY ds_name) SELECT min(n) AS least FROM n")
def least_over_ranks(spark, d):
    return responses(spark, d, "ds_name").groupBy("ds_name").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))


@query("length_estimate", f"WITH n AS (SELECT doc_id, length(text) AS l, len({tokens_sql('text')}) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(first_value(n) OVER (PARTITION BY l ORDER BY doc_id) AS INTEGER) AS estimate FROM n")
def length_estimate(spark, d):
    from tracemill.functions.text import tokens

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("l"), F.size(tokens(F.col("text"))).alias("n"))
    first = docs.groupBy("l").agg(F.min_by("n", "doc_id").alias("estimate"))  # lengths repeat often, so they meet as aggregates
    return docs.join(first, "l").select("doc_id", "estimate")


@query("few_shots")
def few_shots(spark, d):
    items = table(spark, d, "eval_items")
    return P.few_shots(responses(spark, d), "response_id", items, "item_id", 3)


# ---- prompts and records ---------------------------------------------------


@query("extraction_prompt", f"{ctes('s')} SELECT response_id, 'Take the answer out.' || chr(10) || chr(10) || question || chr(10) || chr(10) || coalesce(response, '') || chr(10) || chr(10) || 'Extracted answer: ' AS prompt FROM s")
def extraction_prompt(spark, d):
    return responses(spark, d, "question", "response").select("response_id", I.extraction_prompt("Take the answer out.", F.col("question"), F.col("response")).alias("prompt"))


@query("continued_rejected", f"{ctes('s')} SELECT response_id, {strip_sql("array_to_string(string_split(response, ' ')[1:CAST(floor(len(string_split(response, ' ')) * 0.5) AS BIGINT)], ' ')")} || ' so it is ' || answer AS rejected FROM s WHERE response IS NOT NULL")
def continued_rejected(spark, d):
    from tracemill.functions.trace import truncated_prefix

    r = responses(spark, d, "response", "answer").where("response IS NOT NULL")
    return r.select("response_id", I.continued(truncated_prefix(F.col("response"), 0.5), F.concat(F.lit(" so it is "), "answer")).alias("rejected"))


@query("image_columns", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN p_name END, p_brand, p_type], lambda x: x IS NOT NULL), '|') AS images FROM part")
def image_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("image_1"), F.col("p_brand").alias("image_2"), F.col("p_type").alias("image_5"))
    return p.select("p_partkey", F.array_join(I.gathered(p.columns), "|").alias("images"))


@query("data_urls", "SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM documents")
def data_urls(spark, d):
    return table(spark, d, "documents").select("doc_id", data_url(F.encode("text", "utf-8"), F.lit("text/plain")).alias("url"))


@query("url_images", f"{ctes('p')}, u AS (SELECT pair_id, unnest(image) AS i FROM p) SELECT pair_id, count(*) AS n, count(*) FILTER (starts_with(i, 'http://') OR starts_with(i, 'https://') OR starts_with(i, 'data:')) AS n_urls FROM u WHERE i IS NOT NULL GROUP BY pair_id")
def url_images(spark, d):
    u = pairs(spark, d, "image").select("pair_id", F.explode("image").alias("i")).where("i IS NOT NULL")
    return u.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(I.is_url(F.col("i"))).alias("n_urls"))


@query("last_criteria_line", "WITH l AS (SELECT p_type AS parent, p_partkey AS n, p_brand || '、' || p_name AS children FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n DESC) AS rn FROM l) SELECT parent, children FROM r WHERE rn = 1")
def last_criteria_line(spark, d):
    lines = table(spark, d, "part").select(F.concat("p_type", F.lit("："), "p_brand", F.lit("、"), "p_name").alias("value"), F.col("p_partkey").alias("line_no"))
    return criteria_pairs(lines).select("parent", F.array_join("children", "、").alias("children"))


@query("set_vectors", """WITH x AS (SELECT DISTINCT p_brand, p_type FROM part), n AS (SELECT p_brand, 1 / sqrt(count(*)) AS weight FROM x GROUP BY p_brand) SELECT p_brand, p_type, round(weight, 6)::DOUBLE AS weight FROM x JOIN n USING (p_brand)""")
def set_vectors(spark, d):
    return H.set_vectors(table(spark, d, "part"), "p_brand", "p_type").select("p_brand", "p_type", F.round("weight", 6).alias("weight"))


@query("tiles_per_image", f"{ctes('s')} SELECT response_id, CAST(greatest(1, 12 // len(image)) AS INTEGER) AS tiles, 256 * CAST(greatest(1, 12 // len(image)) AS INTEGER) AS tokens FROM s WHERE len(image) > 0")
def tiles_per_image(spark, d):
    tiles = V.tiles_per_image(F.lit(12), F.size("image"))
    return responses(spark, d, "image").where(F.size("image") > 0).select("response_id", tiles.cast("int").alias("tiles"), (tiles * M.image_tokens()).cast("int").alias("tokens"))


@query("padded_flags", f"{ctes('k')} SELECT sample_id, array_to_string(list_concat(coalesce(image_flags, []), list_transform(range(0, greatest(0, 12 - coalesce(len(image_flags), 0))), lambda x: 0)), ',') AS flags FROM k")
def padded_flags(spark, d):
    from tracemill.session import records

    k = records(table(spark, d, "packing_sample"), "sample_id", "image_flags")
    flags = K.pad_flags(F.coalesce("image_flags", F.array().cast("array<int>")), F.lit(12))
    return k.select("sample_id", F.array_join(flags, ",").alias("flags"))


@query("frame_indices_drawn", """WITH e AS (SELECT p_partkey, p_size AS n, least(8, p_size) AS u FROM part), i AS (SELECT p_partkey, n, u, unnest(range(0, CAST(u AS BIGINT))) AS k FROM e), d AS (SELECT p_partkey, k, k * n // u AS low, (k + 1) * n // u AS high, CAST('0x' || substring(md5(p_partkey || '|0|' || k), 1, 7) AS BIGINT) AS h FROM i),
f AS (SELECT p_partkey, k, low + h % greatest(1, high - low) AS f FROM d), l AS (SELECT p_partkey, list(f ORDER BY k) AS fs FROM f GROUP BY p_partkey)
SELECT p_partkey, array_to_string(list_concat(fs, list_transform(range(0, 8 - len(fs)), lambda x: fs[-1])), ',') AS frames FROM l""")
def frame_indices_drawn(spark, d):
    frames = V.frame_indices_drawn(F.col("p_size"), F.lit(8), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query("frame_indices_fixed", "SELECT p_partkey, array_to_string(list_transform(range(0, 8), lambda k: least(k * p_size // 8 + 1, p_size - 1)), ',') AS frames FROM part")
def frame_indices_fixed(spark, d):
    frames = V.frame_indices_fixed(F.col("p_size"), F.lit(8), 1)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query("frame_indices_fps", "SELECT p_partkey, coalesce(array_to_string(list_filter(list_transform(range(0, CAST(floor(p_size * 25 / 25.0 / 0.5) AS BIGINT)), lambda k: CAST(round_even((k + 0.5) * 0.5 * 25, 0) AS INTEGER)), lambda x: x < p_size * 25), ','), '') AS frames FROM part")
def frame_indices_fps(spark, d):
    frames = V.frame_indices_fps(F.col("p_size") * 25, 25.0, 2.0)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query("leaf_clusters")
def leaf_clusters(spark, d):
    from tracemill.plans.registry import QUERIES
    from tracemill.plans.rewarding import _labels

    labels = _labels(spark, d)
    support = H.category_support(labels, "category", "judgment_id")
    return H.leaf_clusters(QUERIES["birch_leaves"](spark, d), H.category_cosine(labels, "category", "judgment_id"), support, "category", 0.2)


@query("sequence_logp", f"{ctes('k')}, z AS (SELECT sample_id, list_sum(list_transform(list_filter(input_ids, lambda x: x % 3 <> 0), lambda x: -(x % 7) / 10.0::DOUBLE)) AS total, len(list_filter(input_ids, lambda x: x % 3 <> 0)) AS n FROM k WHERE input_ids IS NOT NULL) SELECT sample_id, round(coalesce(total, 0), 4)::DOUBLE AS total, round(total / n, 5)::DOUBLE AS mean, CAST(n AS INTEGER) AS n FROM z")
def sequence_logp(spark, d):
    from tracemill.session import records

    k = records(table(spark, d, "packing_sample"), "sample_id", "input_ids").where("input_ids IS NOT NULL")
    logps = F.transform("input_ids", lambda x: -(x % 7) / F.lit(10.0))
    labels = F.transform("input_ids", lambda x: F.when(x % 3 == 0, M.IGNORED).otherwise(x))
    out = k.select("sample_id", S.sequence_logp(logps, labels).alias("x"))
    return out.select("sample_id", F.round("x.total", 4).alias("total"), F.round("x.mean", 5).alias("mean"), "x.n")


@query("square_box", "SELECT doc_id, CAST(greatest(n_chars + 1, 300 + doc_id % 700) AS INTEGER) AS side, CAST((greatest(n_chars + 1, 300 + doc_id % 700) - (n_chars + 1)) // 2 AS INTEGER) AS \"left\", CAST((greatest(n_chars + 1, 300 + doc_id % 700) - (300 + doc_id % 700)) // 2 AS INTEGER) AS top FROM documents WHERE n_chars IS NOT NULL")
def square_box(spark, d):
    docs = table(spark, d, "documents").where("n_chars IS NOT NULL")
    return docs.select("doc_id", V.square_box(F.col("n_chars") + 1, 300 + F.col("doc_id") % 700).alias("b")).select("doc_id", "b.*")


@query("single_image_filter", f"{ctes('p')} SELECT pair_id FROM p WHERE coalesce(len(image), 0) <= 1")
def single_image_filter(spark, d):
    return pairs(spark, d, "image").where(I.wanted_images(F.col("image"), False)).select("pair_id")


@query("strict_gain", "WITH s AS (SELECT DISTINCT ON (response_id) * FROM sampled_response), a AS (SELECT ds_name, round(avg(is_correct), 6) AS acc FROM s WHERE is_correct IS NOT NULL GROUP BY ds_name) SELECT ds_name, acc, 0.25 AS baseline, round(acc - 0.25, 2) AS gain FROM a")
def strict_gain(spark, d):
    r = responses(spark, d, "ds_name", "is_correct").where("is_correct IS NOT NULL")
    scores = r.groupBy("ds_name").agg(F.round(F.avg("is_correct"), 6).alias("acc"))
    return E.gain(scores, r.select("ds_name").distinct().withColumn("acc", F.lit(0.25)), ["ds_name"], strict=True)


@query("text_exact_accuracy", f"{ctes('s')}, m AS (SELECT CAST(answer_pred = answer OR answer_pred = coalesce(question_orig, '') AS INTEGER) AS m FROM s WHERE answer_pred IS NOT NULL) SELECT count(*) AS n, round(avg(m), 6)::DOUBLE AS acc FROM m")
def text_exact_accuracy(spark, d):
    r = responses(spark, d, "answer_pred", "answer", "question_orig").where("answer_pred IS NOT NULL")
    score = E.best_annotation(lambda a: F.col("answer_pred") == a, F.array("answer", F.coalesce("question_orig", F.lit(""))))
    return r.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("acc"))


@query("trace_lines")
def trace_lines(spark, d):
    from tracemill.functions.trace import display_lines

    return pairs(spark, d, "chosen").select("pair_id", display_lines(F.col("chosen")).alias("lines"))
