"""Random-projection trees over TF-IDF vectors: built level by level, searched nearest leaf first.

Each document's sparse weights are first hashed to a narrow dense vector, from
which all trees are built; candidates are scored with the sparse weights.  A
node's random direction is +1 or -1 in each dimension, from a hash of (seed,
tree, node), so no direction is ever stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import knn, ranking, tfidf
from .held import hold
from .models import sign_rows, signs

TREES, LEAF, CANDIDATES = 3, 50, 200
#: Levels whose thresholds are sent to every task, at most 2^TOP_LEVELS numbers of each tree; what is below is split inside tasks.
TOP_LEVELS = 16
#: Summaries of a node's projections place a value within n / ACCURACY ranks; those of fewer rows than half of it are exact.
ACCURACY = 10_000


@lru_cache(maxsize=1 << 16)
def _direction(seed: int, tree: int, node: int, dim: int) -> np.ndarray:
    bits = b"".join(hashlib.md5(f"{seed} {tree} {node} {k}".encode()).digest()[:8] for k in range(-(-dim // 64)))
    return sign_rows([bits])[0, :dim]


def projections(v: np.ndarray, tree: int, nodes: np.ndarray, seed: int) -> np.ndarray:
    """Each row's projection on the direction of its node, summed in order: equal rows have equal ones wherever in a batch they stand."""
    out = np.empty(len(v))
    for node in np.unique(nodes):
        own = nodes == node
        out[own] = np.cumsum(v[own] * _direction(seed, tree, int(node), v.shape[1]), axis=1)[:, -1]
    return out


def vectors(corpus: DataFrame, max_features: int = tfidf.MAX_FEATURES) -> DataFrame:
    """``index, terms, v``: each document's weights as an array, and the sum of its terms' sign vectors by weight."""

    @F.pandas_udf("array<float>")
    def dense(terms: pd.Series) -> pd.Series:
        return pd.Series([np.asarray([t["weight"] for t in own]) @ sign_rows([signs(t["term"]) for t in own]) for own in terms])

    w = tfidf.weights(corpus, max_features)
    rows = w.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    return rows.withColumn("v", dense("terms"))


def _descended(v: np.ndarray, tree: int, thresholds: dict, seed: int) -> np.ndarray:
    """The node that each row reaches below the given inner nodes."""
    at, open_ = np.ones(len(v), np.int64), np.arange(len(v))
    while len(open_):
        cut = np.asarray([thresholds.get((tree, int(n)), np.nan) for n in at[open_]])
        open_, cut = open_[~np.isnan(cut)], cut[~np.isnan(cut)]
        if len(open_):
            at[open_] = 2 * at[open_] + (projections(v[open_], tree, at[open_], seed) > cut)
    return at


def level(docs: DataFrame, thresholds: dict, trees: int, seed: int = 42) -> DataFrame:
    """``index, tree, node, p``: where each row of ``docs`` (index, v) stands below the inner nodes, and its projection there."""
    held = docs.sparkSession.sparkContext.broadcast(thresholds)  # at most trees * 2^TOP_LEVELS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = knn.matrix(batch.column("v"))
            for tree in range(trees):
                at = _descended(v, tree, held.value, seed)
                p = projections(v, tree, at, seed)
                yield pa.RecordBatch.from_arrays([batch.column("index"), pa.array(np.full(len(v), tree, np.int32)), pa.array(at), pa.array(p)], ["index", "tree", "node", "p"])

    return docs.select(F.col("index").cast("long").alias("index"), "v").mapInArrow(run, "index long, tree int, node long, p double")


def medians(placed: DataFrame, leaf_size: int) -> dict[tuple[int, int], float]:
    """The lower median of ``p`` for each node of ``placed`` (tree, node, p) with more than ``leaf_size`` rows and a value above it.

    Exact for any number of rows: a summary gives that of a small node, and for
    a large one a narrow range around it, whose values are then counted.
    """
    spark, out, spread = placed.sparkSession, {}, 3 / ACCURACY
    tops: dict[tuple[int, int], float] = {}
    while True:
        near = F.percentile_approx("p", [max(0.0, 0.5 - spread), 0.5, min(1.0, 0.5 + spread)], ACCURACY)
        nodes = placed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), near.alias("near"), F.max("p").alias("top")).where(F.col("n") > leaf_size).collect()
        tops |= {(r["tree"], r["node"]): r["top"] for r in nodes}
        out |= {(r["tree"], r["node"]): r["near"][1] for r in nodes if 2 * r["n"] < ACCURACY}
        wide = [(r["tree"], r["node"], (r["n"] - 1) // 2, r["near"][0], r["near"][2]) for r in nodes if (r["tree"], r["node"]) not in out]
        if wide:
            ranges = spark.createDataFrame(wide, "tree int, node long, place long, low double, high double")
            value = F.when(F.col("p") >= F.col("low"), F.col("p")).alias("value")  # null, the first in order, for all below
            counted = placed.join(F.broadcast(ranges), ["tree", "node"]).where("p <= high").groupBy("tree", "node", "place", value).agg(F.count(F.lit(1)).alias("n"))
            order = Window.partitionBy("tree", "node").orderBy("value")  # less than a thousandth of a node's rows
            upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            first = counted.withColumn("upto", upto).where("upto > place").groupBy("tree", "node").agg(F.min_by("value", "upto").alias("value"))
            out |= {(r["tree"], r["node"]): r["value"] for r in first.collect() if r["value"] is not None}
        if out.keys() == tops.keys():
            return {k: x for k, x in out.items() if tops[k] > x}
        spread *= 8  # for a range that missed its median


def build(docs: DataFrame, trees: int = TREES, leaf_size: int = LEAF, seed: int = 42, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``index, tree, node`` of every document's leaf, and the inner nodes ``tree, node, threshold``.

    A node of more than ``leaf_size`` documents is split at the median of its
    projections, ``<=`` going left to node 2i, others to 2i + 1; a split that
    leaves one side empty makes a leaf.  Any depth is split, or the given
    number of ``levels`` at most: after ``TOP_LEVELS`` levels, the rest of each
    subtree is built in one task.
    """
    spark = docs.sparkSession
    thresholds: dict[tuple[int, int], float] = {}
    below = None
    for depth in range(TOP_LEVELS + 1):
        if depth == levels:
            break
        lowest = level(docs, thresholds, trees, seed).where(F.col("node") >= 1 << depth)
        if depth == TOP_LEVELS:
            large = lowest.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), F.max("p").alias("top"))
            below = large.where((F.col("n") > leaf_size) & (F.col("top") > F.col("least"))).select("tree", "node")
            break
        found = medians(lowest, leaf_size)  # at most trees * 2^depth
        if not found:
            break
        thresholds |= found
    inner = spark.createDataFrame([(t, n, float(x)) for (t, n), x in thresholds.items()], "tree int, node long, threshold double")
    placed = level(docs, thresholds, trees, seed).drop("p")
    if below is None or below.isEmpty():
        return placed, inner

    def subtree(rows: pd.DataFrame) -> pd.DataFrame:
        tree, v = int(rows["tree"].iloc[0]), np.stack(rows["v"].to_numpy()).astype(float)
        at, cuts, todo = rows["node"].to_numpy().copy(), [], [int(rows["node"].iloc[0])]
        while todo:
            node = todo.pop()
            own = np.flatnonzero(at == node)
            p = projections(v[own], tree, at[own], seed)
            cut = np.sort(p)[(len(p) - 1) // 2]
            if len(own) > leaf_size and p.max() > cut and (levels is None or node.bit_length() <= levels):
                at[own] = 2 * node + (p > cut)
                cuts.append((None, tree, node, cut))
                todo += [2 * node, 2 * node + 1]
        return pd.concat([pd.DataFrame({"index": rows["index"], "tree": tree, "node": at, "threshold": np.nan}), pd.DataFrame(cuts, columns=["index", "tree", "node", "threshold"])])

    deep = placed.join(below, ["tree", "node"]).join(docs.select("index", "v"), "index")
    done = hold(deep.groupBy("tree", "node").applyInPandas(subtree, "index long, tree int, node long, threshold double"))
    kept = placed.join(below, ["tree", "node"], "left_anti").select("index", "tree", "node")
    return (
        kept.unionByName(done.where("index is not null").select("index", "tree", "node")),
        inner.unionByName(done.where("index is null").select("tree", "node", "threshold")),
    )


def leaves_for(q: np.ndarray, sizes: DataFrame, inner: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """``tree, node, take`` of the leaves (tree, node, n) nearest to a vector, ``budget`` rows for each tree.

    At each ancestor a leaf is on the vector's side or beyond a margin.  Leaves
    are ordered by their largest margin, then the next largest and so on, which
    is the order in which a search that always opens the closest boundary
    reaches them.
    """
    bits = F.floor(F.log2("node")).cast("int")
    up = sizes.select("tree", "node", "n", F.explode_outer(F.when(F.col("node") > 1, F.sequence(F.lit(1), bits))).alias("k"))
    steps = up.select("tree", "node", "n", F.expr("shiftright(node, k)").alias("above"), (F.expr("shiftright(node, k - 1)") % 2).alias("right"))

    @F.pandas_udf("double")
    def side(tree: pd.Series, node: pd.Series) -> pd.Series:
        return pd.Series([float(q @ _direction(seed, int(t), int(n), len(q))) for t, n in zip(tree, node, strict=True)])

    cuts = inner.select("tree", F.col("node").alias("above"), (side("tree", "node") - F.col("threshold")).alias("d"))
    beyond = (F.col("d") > 0) != (F.col("right") == 1)
    keyed = steps.join(cuts, ["tree", "above"], "left").groupBy("tree", "node", "n").agg(F.sort_array(F.collect_list(F.when(beyond, F.abs("d"))), asc=False).alias("margins"))
    order = Window.partitionBy("tree").orderBy("margins", "node")
    near = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)  # every leaf has a row
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.select("tree", "node", F.least(F.col("n"), F.lit(budget) - before).alias("take")).where("take > 0")


def search(
    corpus: DataFrame, query: str, top_k: int = 10, n_trees: int = TREES, leaf_size: int = LEAF, n_candidates: int = CANDIDATES,
    max_features: int = tfidf.MAX_FEATURES, seed: int = 42,
) -> DataFrame:
    """``rank, index, score``: TF-IDF cosine of the candidates that the trees give.

    With at most ``n_candidates`` non-blank documents all of them are scored.
    A blank query gives no rows; an unknown word scores 0.  The result is
    approximate: the more candidates, the higher the recall.
    """
    ranking.check_k(top_k)
    docs = corpus.where(tx.not_blank("document"))
    if not query.strip() or docs.limit(n_candidates + 1).count() <= n_candidates:
        return tfidf.search(corpus, query, top_k, max_features)
    return _through_trees(docs, query, top_k, n_trees, leaf_size, n_candidates, max_features, seed)


def _through_trees(docs: DataFrame, query: str, top_k: int, n_trees: int, leaf_size: int, n_candidates: int, max_features: int, seed: int) -> DataFrame:
    vecs = hold(vectors(docs, max_features))
    asked = {r["term"]: r["w"] for r in tfidf.query_weights(docs, query, max_features).collect()}  # words of the query
    norm = max(float(np.sqrt(sum(x * x for x in asked.values()))), 1e-10)
    q = np.zeros(64)
    for term, x in asked.items():
        q += x / norm * sign_rows([signs(term)])[0]
    assign, inner = build(vecs, n_trees, leaf_size, seed)
    assign = hold(assign)
    sizes = assign.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
    chosen = leaves_for(q, sizes, inner, max(1, n_candidates // n_trees), seed)
    near = assign.join(F.broadcast(chosen), ["tree", "node"])  # at most n_candidates leaves
    place = F.row_number().over(Window.partitionBy("tree", "node").orderBy("index"))
    candidates = near.withColumn("place", place).where("place <= take").select("index").distinct()
    known = F.create_map(*(F.lit(x) for term, w in asked.items() for x in (term, w / norm))) if asked else F.create_map(F.lit(""), F.lit(0.0))
    weight = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["weight"] * F.coalesce(F.try_element_at(known, t["term"]), F.lit(0.0)))
    scored = vecs.join(F.broadcast(candidates), "index").select("index", weight.alias("score"))  # at most n_candidates rows
    return ranking.top_k(scored, top_k).select("rank", "index", "score")
