"""Queries on pairs, margins, samples, shards and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scores as S
from tracemill.operators import pairs as P
from tracemill.operators import sampling as M
from tracemill.plans.registry import ctes, query, responses
from tracemill.session import table

_KEYS = ["image", "question", "answer"]


def _scored(spark, d):
    """Judged responses; the image, a list, stands as text, and no image is a value like any other."""
    r = responses(spark, d, "image", "question", "answer", "answer_pred", "is_correct", "response", "meta")
    return r.where("is_correct IS NOT NULL").withColumn("image", F.coalesce(F.to_json("image"), F.lit("null")))


_SCORED = f"{ctes('s')}, r AS (SELECT response_id, coalesce(to_json(image)::VARCHAR, 'null') AS image, question, answer, answer_pred, is_correct, response, meta FROM s WHERE is_correct IS NOT NULL)"


_PAIRED = f"""{_SCORED}, h AS (SELECT *, md5(CAST(response_id AS VARCHAR) || '|0') AS h FROM r),
j AS (SELECT a.image, a.question, a.answer, a.response_id AS chosen_id, b.response_id AS rejected_id, a.response AS chosen, b.response AS rejected, a.meta.consistency AS chosen_meta, b.meta.consistency AS rejected_meta, a.h AS ha, b.h AS hb FROM h a JOIN h b ON a.image = b.image AND a.question = b.question AND a.answer = b.answer AND a.is_correct = 1 AND b.is_correct = 0 WHERE NOT coalesce(contains(lower(b.answer_pred), lower(a.answer_pred)), false)),
k AS (SELECT *, row_number() OVER (PARTITION BY image, question, answer ORDER BY greatest(ha, hb), ha, hb, chosen_id, rejected_id) AS rk FROM j)"""


def _pairs(spark, d):
    r = _scored(spark, d)
    return r, P.pos_neg_pairs(r.where("is_correct = 1"), r.where("is_correct = 0"), _KEYS, "response_id", "answer_pred", P.pairs_per_key(r))


@query("pos_neg_pairs", f"{_PAIRED} SELECT image, question, answer, chosen_id, rejected_id FROM k WHERE rk <= 15")
def pos_neg_pairs(spark, d):
    return _pairs(spark, d)[1]


@query("pos_neg_pair_rows", f"{_PAIRED} SELECT image, question, chosen, rejected, answer AS answer_gt, chosen_meta, rejected_meta, chosen_id, rejected_id FROM k WHERE rk <= 15")
def pos_neg_pair_rows(spark, d):
    r, found = _pairs(spark, d)
    made = P.pair_rows(found, r.withColumn("meta", F.col("meta.consistency")), _KEYS, "response_id", "response", "meta")
    return made.select("image", "question", "chosen", "rejected", F.col("answer").alias("answer_gt"), "chosen_meta", "rejected_meta", "chosen_id", "rejected_id")


@query("pairing_stats", f"""{_SCORED}, c AS (SELECT image, question, answer, lower(answer_pred) AS pred, count(*) FILTER (is_correct = 1) AS p, count(*) FILTER (is_correct <> 1) AS n FROM r GROUP BY ALL),
e AS (SELECT a.image, a.question, a.answer, sum(a.p * b.n) AS skipped FROM c a JOIN c b ON a.image = b.image AND a.question = b.question AND a.answer = b.answer AND contains(b.pred, a.pred) GROUP BY ALL),
k AS (SELECT image, question, answer, sum(p) AS p, sum(n) AS n FROM c GROUP BY ALL), f AS (SELECT k.*, coalesce(skipped, 0) AS skipped FROM k LEFT JOIN e ON e.image = k.image AND e.question = k.question AND e.answer = k.answer)
SELECT count(*) FILTER (p > 0 AND n = 0) AS only_in_pos, count(*) FILTER (p = 0 AND n > 0) AS only_in_neg, count(*) FILTER (p > 0 AND n > 0) AS in_both, CAST(sum(p * n) AS BIGINT) AS max_possible_pairs, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, CAST(sum(skipped) AS BIGINT) AS entail_skip, count(*) FILTER (p * n > 0 AND p * n = skipped) AS key_without_pairs FROM f""")
def pairing_stats(spark, d):
    return P.pairing_stats(_scored(spark, d), _KEYS, F.col("is_correct") == 1, "answer_pred")


_SETS = f"{_SCORED}, p AS (SELECT DISTINCT image, question, answer FROM r WHERE is_correct = 1), n AS (SELECT DISTINCT image, question, answer FROM r WHERE is_correct = 0)"


@query("key_set_ops", f"""{_SETS}
SELECT 'pos_minus_neg' AS op, count(*) AS n FROM (SELECT * FROM p EXCEPT SELECT * FROM n) UNION ALL SELECT 'neg_minus_pos', count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM p) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM n) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM p UNION SELECT * FROM n)""")
def key_set_ops(spark, d):
    return P.key_set_ops(_scored(spark, d), _KEYS, F.col("is_correct") == 1, F.col("is_correct") == 0)


@query("gt_augment", f"""{_SCORED}, p AS (SELECT image, question, answer, CAST(response_id AS VARCHAR) AS source FROM r WHERE is_correct = 1), g AS (SELECT DISTINCT image, question, answer, 'gold' AS source FROM r)
SELECT * FROM p UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image = g.image AND p.question = g.question AND p.answer = g.answer)""")
def gt_augment(spark, d):
    r = _scored(spark, d)
    positives = r.where("is_correct = 1").select(*_KEYS, F.col("response_id").cast("string").alias("source"))
    return P.gt_augment(positives, r.select(*_KEYS).distinct().withColumn("source", F.lit("gold")), _KEYS)


# Candidates: events as steps of a user, with a reward vector of three dimensions from their columns.
_REWARDS = """v AS (SELECT user_id, event_id, (least(10.0, greatest(1.0, 1 + 0.9 * (value % 10))) - 1) / 9 AS a, (least(10.0, greatest(1.0, CAST(length(event_type) AS DOUBLE))) - 1) / 9 AS b, (least(10.0, greatest(1.0, 1 + 0.9 * (event_id % 10))) - 1) / 9 AS c FROM events),
g AS (SELECT user_id, event_id, a, b, c, -greatest(1 - a, 1 - b, 1 - c) - 0.1 * ((1 - a) + (1 - b) + (1 - c)) AS score FROM v)"""


def _candidates(spark, d):
    raw = [1 + 0.9 * (F.col("value") % 10), F.length("event_type"), 1 + 0.9 * (F.col("event_id") % 10)]
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.array(*(S.normalize_score(x) for x in raw)).alias("v"))
    return e.withColumn("score", S.chebyshev(F.col("v"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))))


@query("normalize_score", f"WITH {_REWARDS} SELECT event_id, round(a, 6)::DOUBLE AS a, round(b, 6)::DOUBLE AS b, round(c, 6)::DOUBLE AS c FROM g")
def normalize_score(spark, d):
    return _candidates(spark, d).select("event_id", *(F.round(F.get("v", i), 6).alias(n) for i, n in enumerate("abc")))


@query("chebyshev", f"WITH {_REWARDS} SELECT event_id, round(score, 6)::DOUBLE AS score FROM g")
def chebyshev(spark, d):
    return _candidates(spark, d).select("event_id", F.round("score", 6).alias("score"))


@query("fused_score", f"WITH {_REWARDS} SELECT event_id, round(0.5 * score + 0.5 * (event_id % 2), 6)::DOUBLE AS fused FROM g")
def fused_score(spark, d):
    return _candidates(spark, d).select("event_id", F.round(S.fused(F.col("score"), F.col("event_id") % 2), 6).alias("fused"))


@query("ideal_point", f"WITH {_REWARDS} SELECT event_id, round(greatest(1 - a, 1 - b, 1 - c), 6)::DOUBLE AS ideal FROM g")
def ideal_point(spark, d):
    ones = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    return _candidates(spark, d).select("event_id", F.round(F.get(S.next_ideal(F.col("v"), ones), 0), 6).alias("ideal"))


@query("uct", f"WITH {_REWARDS} SELECT event_id, round(score + 1.4 * sqrt(ln(greatest(event_id % 30, 1) + 1.0) / (event_id % 5 + 1.0)), 6)::DOUBLE AS uct FROM g")
def uct(spark, d):
    i = F.col("event_id")
    return _candidates(spark, d).select("event_id", F.round(S.uct(F.col("score"), i % 5, i % 30), 6).alias("uct"))


@query("margin_pairs", f"""WITH {_REWARDS}, k AS (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rk FROM g),
j AS (SELECT a.user_id, a.event_id AS chosen, b.event_id AS rejected, a.score - b.score AS m, row_number() OVER (PARTITION BY a.user_id ORDER BY a.rk, b.rk DESC) AS n FROM k a JOIN k b ON a.user_id = b.user_id AND a.rk < b.rk WHERE a.score - b.score >= 0.05)
SELECT user_id, chosen, rejected, round(m, 6)::DOUBLE AS margin FROM j WHERE n <= 3""")
def margin_pairs(spark, d):
    return P.margin_pairs(_candidates(spark, d), "user_id", "event_id", "score", 0.05, 3)


@query("resume_deficit", f"""{ctes('s')}, w AS (SELECT DISTINCT question FROM s), n AS (SELECT question, count(*) AS c FROM s WHERE is_correct IS NOT NULL GROUP BY question)
SELECT question, coalesce(c, 0) AS n_done, 8 - coalesce(c, 0) AS needed FROM w LEFT JOIN n USING (question) WHERE coalesce(c, 0) < 8""")
def resume_deficit(spark, d):
    r = responses(spark, d, "question", "is_correct")
    return P.resume_deficit(r, r.where("is_correct IS NOT NULL"), "question", 8)


@query("distinct_pairs", "SELECT p.pair_id, max(p.ingested_at) AS ingested_at FROM preference_pair p GROUP BY p.pair_id")
def distinct_pairs(spark, d):
    return P.distinct_pairs(table(spark, d, "preference_pair").select("pair_id", "ingested_at"), ["pair_id"], "ingested_at")


@query("distinct_questions", "SELECT DISTINCT to_json(image)::VARCHAR AS image, question, answer FROM sampled_response WHERE image IS NOT NULL")
def distinct_questions(spark, d):
    r = table(spark, d, "sampled_response").where("image IS NOT NULL")
    return r.select(F.to_json("image").alias("image"), "question", "answer").distinct()


# ---- samples ---------------------------------------------------------------


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id LIMIT 100")
def hash_sample(spark, d):
    # the sample is the feature
    return M.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query("stride_sample", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE rn % greatest(1, n // 300) = 0")
def stride_sample(spark, d):
    return M.stride_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 300)


@query("rank_shards", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST(CASE WHEN rn < (n % 8) * (n // 8 + 1) THEN rn // (n // 8 + 1) ELSE n % 8 + (rn - (n % 8) * (n // 8 + 1)) // (n // 8) END AS INTEGER) AS shard FROM r")
def rank_shards(spark, d):
    return M.rank_shards(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8)


@query("repeat_time", f"""{ctes('s')}, r AS (SELECT response_id, ds_name, repeat_time, row_number() OVER (PARTITION BY ds_name ORDER BY md5(CAST(response_id AS VARCHAR) || '|0'), response_id) AS rn, count(*) OVER (PARTITION BY ds_name) AS n FROM s JOIN dataset_registry USING (ds_name))
SELECT ds_name, response_id, CAST(unnest(range(1, CAST(greatest(1, floor(repeat_time)) AS BIGINT) + 1)) AS INTEGER) AS copy FROM r WHERE repeat_time >= 1 OR rn <= floor(n * repeat_time)""")
def repeat_time(spark, d):
    return M.repeat_rows(responses(spark, d, "ds_name"), "ds_name", "response_id", table(spark, d, "dataset_registry")).select("ds_name", "response_id", "copy")


@query("mixture_weights", f"{ctes('s')}, n AS (SELECT ds_name, count(*) AS n FROM s GROUP BY ds_name) SELECT ds_name, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS weight FROM n")
def mixture_weights(spark, d):
    return M.mixture_weights(responses(spark, d, "ds_name").groupBy("ds_name").agg(F.count("*").alias("n")))


@query("weighted_sample", """WITH i AS (SELECT o_orderkey, o_totalprice, left(md5(CAST(o_orderkey AS VARCHAR) || '|3'), 3) AS cell FROM orders), c AS (SELECT *, sum(o_totalprice) OVER (ORDER BY cell, o_orderkey) AS hi FROM i),
u AS (SELECT range AS draw, CAST('0x' || substring(md5(CAST(range AS VARCHAR) || '|3'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT sum(o_totalprice) FROM orders) AS u FROM range(500))
SELECT draw, o_orderkey FROM u JOIN c ON u >= hi - o_totalprice AND u < hi""")
def weighted_sample(spark, d):
    return M.weighted_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500, 3)


@query("megabatches", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|0'), doc_id) - 1 AS rn FROM documents) SELECT doc_id, coalesce(n_chars, 0) AS n_chars, CAST(rn // 64 AS INTEGER) AS mega FROM r")
def megabatches(spark, d):
    return length_grouped(spark, d).select("doc_id", "n_chars", "mega")


@query("length_grouped")
def length_grouped(spark, d):
    return M.length_grouped(table(spark, d, "documents"), "doc_id", "n_chars", 4, 4, 4)
