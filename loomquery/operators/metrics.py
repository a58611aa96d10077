"""Retrieval quality: NDCG, reciprocal rank, recall, precision and hit rate, per query and on average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, rank, rel, n_rel``: each result row's relevance; a query without results has one row with null rank."""
    relevant = qrels.distinct()
    n_rel = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = results.join(relevant.withColumn("_r", F.lit(1)), ["query_id", "index"], "left").select(
        "query_id", "rank", F.coalesce("_r", F.lit(0)).alias("rel")
    )
    return queries.select("query_id").join(n_rel, "query_id", "left").join(rows, "query_id", "left").select(
        "query_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("n_rel", F.lit(0)).alias("n_rel")
    )


def _hits(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))


def ndcg_at(k: int) -> Column:
    """Binary gain over log2(rank + 1), over its best possible value; 0 without relevant rows."""
    gain = F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.max("n_rel"), F.lit(k))).cast("int"))
    ideal = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(F.max("n_rel") == 0, F.lit(0.0)).otherwise(gain / ideal)


def mrr(k: int | None = None) -> Column:
    """One over the rank of the first relevant row, with no cutoff unless ``k`` is given; else 0."""
    hit = F.col("rel") == 1 if k is None else (F.col("rel") == 1) & (F.col("rank") <= k)
    return F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0))


def recall_at(k: int) -> Column:
    return F.coalesce(F.try_divide(_hits(k), F.max("n_rel")), F.lit(0.0))


def precision_at(k: int) -> Column:
    """Hits over k, even where fewer rows were returned; 0 for k = 0."""
    return _hits(k) / F.lit(float(k)) if k else F.lit(0.0)


def hit_rate_at(k: int) -> Column:
    return F.max(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1.0).otherwise(0.0))


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of all metrics for each query."""
    return judged(results, qrels, queries).groupBy("query_id").agg(
        ndcg_at(10).alias("ndcg_10"), recall_at(10).alias("recall_10"), recall_at(100).alias("recall_100"),
        mrr().alias("mrr"), precision_at(10).alias("precision_10"), hit_rate_at(10).alias("hit_rate_10"),
    )


def leaderboard(by_query: DataFrame) -> DataFrame:
    """Mean metrics of each strategy, best NDCG first."""
    names = ("ndcg_10", "recall_10", "recall_100", "mrr", "precision_10", "hit_rate_10")
    return by_query.groupBy("strategy").agg(*(F.avg(c).alias(c) for c in names)).orderBy(F.desc("ndcg_10"), "strategy")


def position_percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group, the values at positions floor(n * share) of its sorted values, counted from 0, under the names of ``shares``.

    Nulls have no position.  A group is sorted, not held, so its size is not
    bounded by memory.
    """
    rows = df.where(F.col(value).isNotNull())
    own = Window.partitionBy(by)
    placed = rows.select(by, value, (F.row_number().over(own.orderBy(value)) - 1).alias("_at"), F.count(F.lit(1)).over(own).alias("_n"))
    at = {name: F.least(F.col("_n") - 1, F.floor(F.col("_n") * share)) for name, share in shares.items()}
    return placed.groupBy(by).agg(*(F.max(F.when(F.col("_at") == place, F.col(value))).alias(name) for name, place in at.items()))
