"""Reward categories: support, set similarity, clusters, representatives, nearest parents and merged parents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scores import dot
from tracemill.operators.components import connected_components


def category_counts(labels: DataFrame, *by: str) -> DataFrame:
    return labels.groupBy(*by).agg(F.count("*").alias("n"))


def category_support(labels: DataFrame, category: str, item: str, least: int = 1) -> DataFrame:
    """(category, support): number of different items; null items and categories do not count."""
    distinct = labels.where(F.col(category).isNotNull() & F.col(item).isNotNull()).select(category, item).distinct()
    return distinct.groupBy(category).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def category_cosine(labels: DataFrame, category: str, item: str, most_per_item: int | None = 10_000) -> DataFrame:
    """(a, b, shared, distance) of categories with a common item: 1 - shared / sqrt(support a x support b).

    Other pairs have distance 1 and are left out, so the pairs come from a self-join on the item. An item has few
    categories in this data; where one could have many, ``most_per_item`` raises instead of joining on.
    """
    distinct = labels.where(F.col(category).isNotNull() & F.col(item).isNotNull()).select(F.col(category).alias("c"), F.col(item).alias("i")).distinct()
    if most_per_item and not distinct.groupBy("i").count().where(F.col("count") > most_per_item).isEmpty():
        raise ValueError(f"an item has more than {most_per_item} categories")
    support = distinct.groupBy("c").agg(F.count("*").alias("n"))
    pairs = distinct.alias("x").join(distinct.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.c") < F.col("y.c")))
    shared = pairs.groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.count("*").alias("shared"))
    joined = shared.join(support.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(support.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    distance = F.round(1 - F.col("shared") / F.sqrt(F.col("na").cast("double") * F.col("nb")), 6)
    return joined.select("a", "b", "shared", distance.alias("distance"))


def threshold_clusters(categories: DataFrame, distances: DataFrame, category: str, threshold: float) -> DataFrame:
    """(category, cluster): components of pairs nearer than the threshold; a cluster is named by its smallest member."""
    found = connected_components(distances.where(F.col("distance") < threshold), "a", "b")
    return categories.select(category).distinct().join(found.withColumnRenamed("node", category), category, "left").select(category, F.coalesce("component", category).alias("cluster"))


def representatives(clusters: DataFrame, support: DataFrame, category: str) -> DataFrame:
    """(cluster, representative, size): the member of most support, the first by name among equals."""
    joined = clusters.join(support, category)
    order = Window.partitionBy("cluster").orderBy(F.desc("support"), F.asc(category))
    sizes = joined.groupBy("cluster").agg(F.count("*").alias("size"))
    return joined.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("cluster", F.col(category).alias("representative")).join(sizes, "cluster")


def average_linkage(distances: pd.DataFrame | DataFrame, names: list[str], default: float = 1.0, most: int = 2_000) -> pd.DataFrame:
    """The merges of average-linkage clustering: rows (id, left, right, distance, size), leaves being 0 .. n-1.

    For the names of one bounded list (criteria, not documents), which is checked: more than ``most`` names raise a
    ValueError, as the merges are made on the driver. The closest pair merges first, the earliest among equals.
    """
    if len(names) > most:
        raise ValueError(f"more than {most} names")
    if isinstance(distances, DataFrame):
        distances = distances.select("a", "b", "distance").where(F.col("a").isin(names) & F.col("b").isin(names)).toPandas()
    place = {x: i for i, x in enumerate(names)}
    n = len(names)
    total = np.full((2 * n, 2 * n), np.inf)
    total[:n, :n] = default
    for a, b, d in distances.itertuples(index=False):
        if a in place and b in place:
            total[place[a], place[b]] = total[place[b], place[a]] = d
    np.fill_diagonal(total, np.inf)
    size = {i: 1 for i in range(n)}
    merges, alive = [], list(range(n))
    for new in range(n, 2 * n - 1):
        block = total[np.ix_(alive, alive)]
        block = np.where(np.triu(np.ones_like(block), 1) > 0, block, np.inf)
        i, j = divmod(int(np.argmin(block)), len(alive))
        a, b = alive[i], alive[j]
        merges.append((new, a, b, float(block[i, j]), size[a] + size[b]))
        for k in alive:
            if k not in (a, b):
                mean = (total[a, k] * size[a] + total[b, k] * size[b]) / (size[a] + size[b])
                total[new, k] = total[k, new] = mean
        size[new] = size[a] + size[b]
        alive = [k for k in alive if k not in (a, b)] + [new]
    return pd.DataFrame(merges, columns=["id", "left", "right", "distance", "size"])


def linkage_tree(merges: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The merges as adjacency rows (name, parent, distance, size); inner nodes are called ``cluster_<id>``."""
    label = lambda i: names[i] if i < len(names) else f"cluster_{i}"
    parent = {int(c): int(r.id) for r in merges.itertuples() for c in (r.left, r.right)}
    rows = [(label(i), label(parent[i]) if i in parent else None, 0.0, 1) for i in range(len(names))]
    rows += [(label(int(r.id)), label(parent[int(r.id)]) if int(r.id) in parent else None, r.distance, int(r.size)) for r in merges.itertuples()]
    return pd.DataFrame(rows, columns=["name", "parent", "distance", "size"])


def birch_leaves(vectors: np.ndarray, threshold: float, branching: int = 50) -> np.ndarray:
    """Leaf entry of each vector by a clustering-feature tree: a vector joins the nearest entry whose radius stays within the threshold.

    Entries are (count, sum, squared norm); a full node splits at its farthest pair. For bounded lists of categories.
    """

    class Node:
        def __init__(self, leaf: bool):
            self.leaf, self.n, self.s, self.q, self.kids = leaf, [], [], [], []

    def add(node: Node, i: int, n: int, s: np.ndarray, q: float, kid: object) -> None:
        node.n[i], node.s[i], node.q[i] = node.n[i] + n, node.s[i] + s, node.q[i] + q

    def push(node: Node, n: int, s: np.ndarray, q: float, kid: object) -> None:
        node.n.append(n), node.s.append(s), node.q.append(q), node.kids.append(kid)

    def split(node: Node) -> tuple[Node, Node]:
        centres = np.array([s / n for n, s in zip(node.n, node.s)])
        d = ((centres[:, None] - centres[None]) ** 2).sum(-1)
        i, j = divmod(int(np.argmax(d)), len(centres))
        parts = (Node(node.leaf), Node(node.leaf))
        for k in range(len(centres)):
            push(parts[int(d[k, j] < d[k, i])], node.n[k], node.s[k], node.q[k], node.kids[k])
        return parts

    entries = 0

    def insert(node: Node, v: np.ndarray) -> tuple[int, tuple[Node, Node] | None]:
        nonlocal entries
        q = float(v @ v)
        i = int(np.argmin([((s / n - v) ** 2).sum() for n, s in zip(node.n, node.s)])) if node.n else -1
        if node.leaf:
            if i >= 0:
                n, s = node.n[i] + 1, node.s[i] + v
                if max(0.0, (node.q[i] + q) / n - float(s @ s) / n**2) ** 0.5 <= threshold:
                    add(node, i, 1, v, q, None)
                    return node.kids[i], None
            entry, entries = entries, entries + 1
            push(node, 1, v.copy(), q, entry)
        else:
            entry, parts = insert(node.kids[i], v)
            add(node, i, 1, v, q, None)
            if parts:
                for x in (node.n, node.s, node.q, node.kids):
                    x.pop(i)
                for p in parts:
                    push(node, sum(p.n), np.sum(p.s, axis=0), sum(p.q), p)
        return entry, split(node) if len(node.n) > branching else None

    root, out = Node(True), []
    for v in vectors:
        entry, parts = insert(root, np.asarray(v, float))
        out.append(entry)
        if parts:
            root = Node(False)
            for p in parts:
                push(root, sum(p.n), np.sum(p.s, axis=0), sum(p.q), p)
    return np.array(out, np.int64)


def merge_parents(rows: DataFrame, parent: str, child: str, order: str) -> DataFrame:
    """(parent, children): the different children of a name in their first order."""
    first = rows.where(F.col(parent).isNotNull()).groupBy(parent, child).agg(F.min(order).alias("o"))
    return first.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", child))), lambda x: x[child]).alias("children"))


def pairs_lines(merged: DataFrame, parent: str) -> DataFrame:
    """The merged parents as text lines ``parent：a、b``."""
    return merged.select(F.concat(F.col(parent), F.lit("："), F.array_join("children", "、")).alias("value"))


def scored_parents(items: DataFrame, parents: DataFrame, vector: str, parent_id: str, parent_vector: str, most_bytes: int = 64_000_000) -> DataFrame:
    """Each item with each parent and their similarity. The catalogue of parents is broadcast behind a check of its bytes."""
    size = parents.agg(F.sum(F.size(parent_vector) * 8 + 32)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the catalogue of parents takes more than {most_bytes} bytes")
    p = parents.select(F.col(parent_id).alias("p_id"), F.col(parent_vector).alias("p_vec"))
    return items.join(F.broadcast(p), F.lit(True)).withColumn("sim", dot(F.col(vector), F.col("p_vec"))).drop("p_vec")


def nearest_parent(items: DataFrame, item: str, parents: DataFrame, vector: str, parent_id: str, parent_vector: str) -> DataFrame:
    """(item, p_id, sim): the most similar parent, the first by id among equals."""
    scored = scored_parents(items.select(item, vector), parents, vector, parent_id, parent_vector)
    best = scored.groupBy(item).agg(F.min(F.struct(-F.col("sim"), "p_id")).alias("b"))
    return best.select(item, F.col("b.p_id").alias("p_id"), F.round(-F.col("b.col1"), 6).alias("sim"))


def parent_distance_filter(scored: DataFrame, item: str, zeta: float, most: int) -> DataFrame:
    """Per item the parents within distance zeta (0 to 1), all of them where none is, the first ``most`` by similarity."""
    z = min(1.0, max(0.0, zeta))
    near = (1 - F.col("sim")) <= z
    some = F.max(near).over(Window.partitionBy(item))
    order = Window.partitionBy(item).orderBy(F.desc("sim"), "p_id")
    kept = scored.withColumn("near", near).withColumn("some", some).where(F.col("near") | ~F.col("some"))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(item, "p_id", F.round("sim", 6).alias("sim"), "place")


def set_vectors(labels: DataFrame, category: str, item: str) -> DataFrame:
    """(category, item, weight): binary item vectors of the categories, scaled to unit length, as sparse rows."""
    distinct = labels.select(category, item).where(F.col(category).isNotNull() & F.col(item).isNotNull()).distinct()
    norm = distinct.groupBy(category).agg((1 / F.sqrt(F.count("*"))).alias("weight"))
    return distinct.join(norm, category)




def ordered_clusters(members: DataFrame, cluster: str, name: str) -> DataFrame:
    """(cluster, members, place): clusters by falling size, then by their sorted members. For the names of one bounded list."""
    lists = members.groupBy(cluster).agg(F.array_sort(F.collect_list(name)).alias("members"))
    return lists.withColumn("place", F.row_number().over(Window.orderBy(-F.size("members"), "members")).cast("bigint"))


def leaf_clusters(leaves: DataFrame, distances: DataFrame, support: DataFrame, category: str, threshold: float = 0.2) -> DataFrame:
    """(leaf, cluster, representative, size): inside each leaf the clusters of members nearer than the threshold.

    Distances between leaves are left out first, so no cluster spans two. A member without support can represent only
    members without any.
    """
    side = lambda c: leaves.select(F.col(category).alias(c), F.col("leaf").alias(f"leaf_{c}"))
    inside = distances.join(side("a"), "a").join(side("b"), "b").where("leaf_a = leaf_b").select("a", "b", "distance")
    clusters = threshold_clusters(leaves, inside, category, threshold)
    full = leaves.select(category).join(support, category, "left").select(category, F.coalesce("support", F.lit(0)).alias("support"))
    named = representatives(clusters, full, category)
    return named.join(leaves.select(F.col(category).alias("representative"), "leaf"), "representative").select("leaf", "cluster", "representative", "size")
