"""Queries on step reviews, trajectories, trees and reward categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scores as S
from tracemill.functions.text import present
from tracemill.operators import hierarchy as H
from tracemill.operators import rewards as R
from tracemill.operators.search import mcts_search as run_search
from tracemill.plans.pairing import _REWARDS, _candidates
from tracemill.plans.registry import ctes, judgments, pairs, query, strip_sql
from tracemill.providers import HashEmbedding, apply_provider
from tracemill.session import table
from tracemill.sources.io import criteria_pairs, json_repaired


@query("trajectory_reward", f"WITH {_REWARDS} SELECT user_id, round(avg(a), 6)::DOUBLE AS a, round(avg(b), 6)::DOUBLE AS b, round(avg(c), 6)::DOUBLE AS c FROM g GROUP BY user_id")
def trajectory_reward(spark, d):
    r = R.trajectory_rewards(_candidates(spark, d), "user_id", "v", 3)
    return r.select("user_id", *(F.get("reward", i).alias(n) for i, n in enumerate("abc")))


@query("reward_margins", f"""{ctes('j')}, m AS (SELECT list_aggregate(list_transform(chosen_step_reviews, lambda r: r.mean_normalized_score), 'avg') AS c, list_aggregate(list_transform(rejected_step_reviews, lambda r: r.mean_normalized_score), 'avg') AS r FROM j), b AS (SELECT * FROM m WHERE c IS NOT NULL AND r IS NOT NULL)
SELECT count(*) AS n_pairs, round(avg(c), 6) AS reward_chosen, round(avg(r), 6) AS reward_rejected, round(avg(CAST(c > r AS INTEGER)), 6) AS accuracy, round(avg(c - r), 6) AS margin FROM b""")
def reward_margins(spark, d):
    def mean(c):
        known = F.filter(F.transform(c, lambda r: r["mean_normalized_score"]), lambda x: x.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(known) > 0, F.size(known))

    j = judgments(spark, d, "chosen_step_reviews", "rejected_step_reviews")
    return R.reward_margins(j, mean(F.col("chosen_step_reviews")), mean(F.col("rejected_step_reviews")))


# A tree per customer: an order's parent is the order of a third of its place, the root has none.
_TREE = "t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), tree AS (SELECT o_custkey, n AS node, CASE WHEN n > 1 THEN (n + 1) // 3 + CASE WHEN (n + 1) // 3 = 0 THEN 1 ELSE 0 END END AS parent, CAST(floor(log(n) / log(3)) AS INTEGER) AS depth0, o_orderkey FROM t)"


def _tree(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", n.alias("node"))
    up = F.floor((F.col("node") + 1) / 3)
    return t.withColumn("parent", F.when(F.col("node") > 1, F.greatest(F.lit(1), up))).withColumn("depth", F.when(F.col("node") > 1, 1).otherwise(0))


@query("leaf_candidates", f"WITH {_TREE}, l AS (SELECT o_custkey, node, node NOT IN (SELECT parent FROM tree u WHERE u.o_custkey = t.o_custkey AND parent IS NOT NULL) AS leaf FROM tree t WHERE node > 1), m AS (SELECT *, max(leaf) OVER (PARTITION BY o_custkey) AS has_leaf FROM l) SELECT o_custkey, CAST(node AS INTEGER) AS node FROM m WHERE leaf OR NOT has_leaf")
def leaf_candidates(spark, d):
    return R.leaf_candidates(_tree(spark, d), "o_custkey", "node", "parent", "depth").select("o_custkey", "node")


@query("best_candidate", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1")
def best_candidate(spark, d):
    return R.best_candidate(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("backpropagate", "WITH p AS (SELECT unnest([0, user_id, 1000000 + event_id % 50]) AS node, value FROM events) SELECT node, count(*) AS visits, round(sum(value), 4) AS value_sum FROM p GROUP BY node")
def backpropagate(spark, d):
    e = table(spark, d, "events").select(F.array(F.lit(0).cast("bigint"), F.col("user_id"), F.lit(1000000) + F.col("event_id") % 50).alias("path"), "value")
    return R.backpropagate(e, "path", "value").select("node", "visits", F.round("value_sum", 4).alias("value_sum"))


_HEURISTIC = {"visual": "|".join(S.VISUAL), "logic": "|".join(S.LOGIC)}


@query("heuristic_step_scores", rf"""WITH t AS (SELECT doc_id, {strip_sql("coalesce(text, '')")} AS t, lower({strip_sql("coalesce(text, '')")}) AS l FROM documents),
n AS (SELECT *, greatest(1, len(list_filter(string_split_regex(t, '[\s\p{{Z}}]+'), lambda x: x <> ''))) AS n, t = '' OR contains(l, 'i don''t know') OR contains(l, 'cannot') AS refused FROM t)
SELECT doc_id, (CASE WHEN refused THEN 3.0 WHEN regexp_matches(l, '{_HEURISTIC['visual']}') THEN 7.0 ELSE 5.0 END)::DOUBLE AS visual, (CASE WHEN refused THEN 3.0 WHEN regexp_matches(l, '{_HEURISTIC['logic']}') THEN 7.0 ELSE 5.5 END)::DOUBLE AS logic,
(CASE WHEN refused THEN 3.0 WHEN regexp_matches(l, '\d|=|\+|-|\*|/|°|angle') THEN 6.5 ELSE 5.5 END)::DOUBLE AS correct, (CASE WHEN refused THEN 3.0 WHEN n <= 80 THEN 8.0 WHEN n <= 180 THEN 6.0 ELSE 4.0 END)::DOUBLE AS concise FROM n""")
def heuristic_step_scores(spark, d):
    s = table(spark, d, "documents").select("doc_id", S.heuristic_scores(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", *(F.get("s", i).alias(n) for i, n in ((0, "visual"), (1, "logic"), (2, "correct"), (4, "concise"))))


@query("parse_judge_scores", """WITH e AS (SELECT event_id, least(10.0, greatest(1.0, event_id % 12 + 0.5)) AS v, least(10.0, greatest(1.0, CAST(event_id % 9 AS DOUBLE))) AS l FROM events)
SELECT event_id, v::DOUBLE AS visual, l::DOUBLE AS logic, 5.0::DOUBLE AS correct FROM e""")
def parse_judge_scores(spark, d):
    text = F.concat(F.lit("Visual Grounding: [["), (F.col("event_id") % 12).cast("string"), F.lit(".5]]\n- logical: [[ "), (F.col("event_id") % 9).cast("string"), F.lit(" ]]\nnothing else: [[4]]"))
    s = table(spark, d, "events").select("event_id", S.judge_scores(text).alias("s"))
    return s.select("event_id", *(F.get("s", i).alias(n) for i, n in ((0, "visual"), (1, "logic"), (2, "correct"))))


def _reviews(spark, d):
    j = judgments(spark, d, "chosen_step_reviews").select("judgment_id", F.posexplode("chosen_step_reviews").alias("pos", "r"))
    return j.select("judgment_id", "pos", F.col("r.step_index").alias("step_index"), F.col("r.step_text").alias("step_text"), F.col("r.selected_parent").alias("selected_parent"), F.col("r.reward_categories").alias("categories"), F.col("r.reward_scores").alias("scores"))


@query("normalize_reviews")
def normalize_reviews(spark, d):
    reviews = _reviews(spark, d)
    none = F.array().cast("array<string>")
    steps = reviews.groupBy("judgment_id").agg(F.max("step_index").alias("n")).where("n IS NOT NULL")
    steps = steps.select("judgment_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n")) + 1)).alias("step_index"))
    steps = steps.select("judgment_id", "step_index", F.lit("").alias("step_text"), F.lit(None).cast("string").alias("selected_parent"), none.alias("candidates"))
    out = R.normalize_reviews(steps, reviews, "judgment_id")
    return out.select("judgment_id", "step_index", "selected_parent", F.array_join("review.categories", "|").alias("categories"), F.array_join(F.transform(F.map_values("review.scores"), lambda v: v.cast("string")), "|").alias("scores"), F.round("review.mean", 6).alias("mean"))


@query("review_means", f"""{ctes('j')}, r AS (SELECT judgment_id, generate_subscripts(chosen_step_reviews, 1) - 1 AS pos, unnest(chosen_step_reviews) AS r FROM j), s AS (SELECT judgment_id, pos, map_values(r.reward_scores) AS s FROM r)
SELECT judgment_id, CAST(pos AS INTEGER) AS pos, CASE WHEN len(s) > 0 THEN round(list_aggregate(list_transform(s, lambda x: (x - 1) / 9), 'avg'), 6) ELSE 0 END::DOUBLE AS mean FROM s WHERE s IS NOT NULL""")
def review_means(spark, d):
    s = F.map_values("scores")
    mean = F.when(F.size(s) > 0, F.aggregate(F.transform(s, lambda x: (x - 1) / F.lit(9.0)), F.lit(0.0), lambda a, x: a + x) / F.when(F.size(s) > 0, F.size(s))).otherwise(0.0)
    return _reviews(spark, d).where("scores IS NOT NULL").select("judgment_id", "pos", F.round(mean, 6).alias("mean"))


@query("json_repair", "SELECT event_id, user_id AS k FROM events")
def json_repair(spark, d):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    good = F.concat(F.lit('{"k": '), u, F.lit("}"))
    text = F.when(i % 3 == 0, good).when(i % 3 == 1, F.concat(good, F.lit(" ,"))).otherwise(F.concat(F.lit("Sure:\n"), good, F.lit(" done")))
    return table(spark, d, "events").select("event_id", json_repaired(text, "k bigint")["k"].alias("k"))


@query("prm_step_scores", """WITH s AS (SELECT user_id, list(round(value / 1000, 6) ORDER BY event_id) AS s FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_transform(s[1:len(s) - 1], lambda x: CAST(CAST(round(x * 1000) AS INTEGER) AS VARCHAR)), '|') AS steps, s[len(s)]::DOUBLE AS answer_score FROM s WHERE len(s) % 2 = 0""")
def prm_step_scores(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.round(x["value"] / 1000, 6)).alias("s"))
    e = e.withColumn("n", F.when(F.size("s") % 2 == 0, F.size("s") - 1).otherwise(F.size("s")))
    r = R.prm_step_scores(e, "user_id", "s", "n")
    return r.select("user_id", F.array_join(F.transform("step_scores", lambda x: F.round(x * 1000).cast("int").cast("string")), "|").alias("steps"), "answer_score")


@query("mcts_search")
def mcts_search(spark, d):
    p = pairs(spark, d, "question", "prompt", "chosen").select("pair_id", present(F.col("question"), F.col("prompt")).alias("question"), F.regexp_extract("chosen", r"<\|answer_start\|>([^<]*)", 1).alias("gold"))
    return run_search(p, "pair_id", "question", "gold").drop("vector")


# ---- categories ------------------------------------------------------------

_LABELS = f"""{ctes('j')}, l AS (SELECT judgment_id, 'good' AS polarity, unnest(flatten(list_transform(chosen_step_reviews, lambda r: r.reward_categories))) AS category FROM j UNION ALL SELECT judgment_id, 'bad', unnest(flatten(list_transform(rejected_step_reviews, lambda r: r.reward_categories))) FROM j),
labels AS (SELECT l.* FROM l SEMI JOIN reward_criteria ON category = criterion_name)"""


def _labels(spark, d):
    j = judgments(spark, d, "chosen_step_reviews", "rejected_step_reviews")
    part = lambda c, x: j.select("judgment_id", F.lit(x).alias("polarity"), F.explode(F.filter(F.flatten(F.filter(F.transform(c, lambda r: r["reward_categories"]), lambda a: a.isNotNull())), lambda v: v.isNotNull())).alias("category"))
    labels = part("chosen_step_reviews", "good").unionByName(part("rejected_step_reviews", "bad"))
    names = table(spark, d, "reward_criteria").select(F.col("criterion_name").alias("category"))
    return labels.join(names, "category", "left_semi")


@query("category_counts", f"{_LABELS} SELECT polarity, category, count(*) AS n FROM labels GROUP BY ALL")
def category_counts(spark, d):
    return H.category_counts(_labels(spark, d), "polarity", "category")


@query("category_support", f"{_LABELS} SELECT category, count(DISTINCT judgment_id) AS support FROM labels GROUP BY category HAVING count(DISTINCT judgment_id) >= 2")
def category_support(spark, d):
    return H.category_support(_labels(spark, d), "category", "judgment_id", 2)


_COSINE = f"""{_LABELS}, u AS (SELECT DISTINCT category AS c, judgment_id AS i FROM labels), n AS (SELECT c, count(*) AS n FROM u GROUP BY c),
cosine AS (SELECT x.c AS a, y.c AS b, count(*) AS shared, round(1 - count(*) / sqrt(CAST(any_value(p.n) * any_value(q.n) AS DOUBLE)), 6) AS distance FROM u x JOIN u y ON x.i = y.i AND x.c < y.c JOIN n p ON p.c = x.c JOIN n q ON q.c = y.c GROUP BY x.c, y.c)"""


@query("category_cosine", f"{_COSINE} SELECT a, b, shared, distance FROM cosine")
def category_cosine(spark, d):
    return H.category_cosine(_labels(spark, d), "category", "judgment_id")


_CUT = 0.84
_CLUSTERS = f"""{_COSINE.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT a, b FROM cosine WHERE distance < {_CUT} UNION SELECT b, a FROM cosine WHERE distance < {_CUT}),
reach AS (SELECT c AS x, c AS y FROM n UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y), clusters AS (SELECT x AS category, min(y) AS cluster FROM reach GROUP BY x)"""


def _clusters(spark, d):
    labels = _labels(spark, d)
    return H.threshold_clusters(labels, H.category_cosine(labels, "category", "judgment_id"), "category", _CUT)


@query("threshold_clusters", f"{_CLUSTERS} SELECT category, cluster FROM clusters")
def threshold_clusters(spark, d):
    return _clusters(spark, d)


@query("cluster_representative", f"{_CLUSTERS}, r AS (SELECT cluster, category, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS rn, count(*) OVER (PARTITION BY cluster) AS size FROM clusters JOIN n ON c = category) SELECT cluster, category AS representative, size FROM r WHERE rn = 1")
def cluster_representative(spark, d):
    return H.representatives(_clusters(spark, d), H.category_support(_labels(spark, d), "category", "judgment_id"), "category")


@query("average_linkage")
def average_linkage(spark, d):
    labels = _labels(spark, d)
    names = [r[0] for r in table(spark, d, "reward_criteria").select("criterion_name").orderBy("criterion_name").collect()]  # the fixed list of criteria
    merges = H.average_linkage(H.category_cosine(labels, "category", "judgment_id"), names)
    return spark.createDataFrame(H.linkage_tree(merges, names), "name string, parent string, distance double, size int")


@query("birch_leaves")
def birch_leaves(spark, d):
    import numpy as np
    import pandas as pd

    names = [r[0] for r in table(spark, d, "reward_criteria").select("criterion_name").orderBy("criterion_name").collect()]  # the fixed list of criteria
    leaves = H.birch_leaves(np.array(HashEmbedding()(names)), 0.6)
    return spark.createDataFrame(pd.DataFrame({"category": names, "leaf": leaves}), "category string, leaf int")


_DOT = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_PARENTS = "p AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label)"


@query("embedding_cosine", f"SELECT x.vec_id, round({_DOT}, 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _parents(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return e.join(first, "vec_id").select(F.col("vec_id").alias("parent_id"), F.col("embedding").alias("parent_vector"))


@query("nearest_parent", f"WITH {_PARENTS}, s AS (SELECT x.vec_id, y.vec_id AS p_id, {_DOT} AS sim FROM embeddings x, embeddings y WHERE y.vec_id IN (SELECT vec_id FROM p)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, p_id) AS rn FROM s) SELECT vec_id, p_id, round(sim, 6) AS sim FROM r WHERE rn = 1")
def nearest_parent(spark, d):
    return H.nearest_parent(table(spark, d, "embeddings"), "vec_id", _parents(spark, d), "embedding", "parent_id", "parent_vector")


@query("parent_distance_filter", f"WITH {_PARENTS}, s AS (SELECT x.vec_id, y.vec_id AS p_id, {_DOT} AS sim FROM embeddings x, embeddings y WHERE y.vec_id IN (SELECT vec_id FROM p)), n AS (SELECT *, 1 - sim <= 0.8 AS near, max(1 - sim <= 0.8) OVER (PARTITION BY vec_id) AS has_near FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, p_id) AS place FROM n WHERE near OR NOT has_near) SELECT vec_id, p_id, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def parent_distance_filter(spark, d):
    scored = H.scored_parents(table(spark, d, "embeddings").select("vec_id", "embedding"), _parents(spark, d), "embedding", "parent_id", "parent_vector")
    return H.parent_distance_filter(scored, "vec_id", 0.8, 3)


@query("text_embedding")
def text_embedding(spark, d):
    names = table(spark, d, "reward_criteria").select("criterion_id", "criterion_name")
    made = apply_provider(names, "criterion_name", HashEmbedding(), "vector", "array<double>")
    return made.select("criterion_id", F.round(S.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


_MERGED = "f AS (SELECT p_type, p_brand, min(p_partkey) AS o FROM part GROUP BY ALL), m AS (SELECT p_type, string_agg(p_brand, '、' ORDER BY o, p_brand) AS children FROM f GROUP BY p_type)"


@query("merge_parents", f"WITH {_MERGED} SELECT p_type, children FROM m")
def merge_parents(spark, d):
    return H.merge_parents(table(spark, d, "part"), "p_type", "p_brand", "p_partkey").select("p_type", F.array_join("children", "、").alias("children"))


@query("criteria_pairs", f"WITH {_MERGED} SELECT p_type AS parent, children FROM m")
def criteria_pairs_query(spark, d):
    lines = H.pairs_lines(H.merge_parents(table(spark, d, "part"), "p_type", "p_brand", "p_partkey"), "p_type").withColumn("line_no", F.lit(1))
    return criteria_pairs(lines).select("parent", F.array_join("children", "、").alias("children"))


