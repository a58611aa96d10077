"""Benchmark of strategies on a labelled corpus."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import SearchEngine, resolve
from .operators import held, metrics


def evaluate_strategy(spark: SparkSession, strategy: str, docs: DataFrame, queries: DataFrame, qrels: DataFrame, runs: int = 1, fetch: int = 100, **options) -> DataFrame:
    """``strategy, query_id``, all metrics and ``latency_ms`` (mean of the runs, actions only) for each query.

    The query set is read on the driver: each query is a timed search of its own.
    """
    name = resolve(strategy)
    engine = SearchEngine(spark, name, **options)
    if not {"projection", "model_path"} & set(options):
        engine.train(docs)
    fetch = min(fetch, max(1, docs.count()))
    rows, times = [], []
    for q in queries.orderBy("query_id").collect():
        took, found = [], []
        for _ in range(runs):
            start = time.perf_counter()
            found = engine.search(q["query"], docs, fetch).select("rank", "index").collect()
            took.append((time.perf_counter() - start) * 1000)
        held.release()
        rows += [(q["query_id"], r["rank"], r["index"]) for r in found]
        times.append((q["query_id"], sum(took) / len(took)))
    results = spark.createDataFrame(rows, "query_id long, rank long, index long")
    latency = spark.createDataFrame(times, "query_id long, latency_ms double")
    return metrics.evaluate(results, qrels, queries).join(latency, "query_id").withColumn("strategy", F.lit(name))


def run(spark: SparkSession, strategies: Sequence[str], docs: DataFrame, queries: DataFrame, qrels: DataFrame, runs: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """Metrics of each strategy and query; strategies that fail are reported by name instead."""
    out, failed = None, {}
    for s in strategies:
        try:
            part = evaluate_strategy(spark, s, docs, queries, qrels, runs)
        except Exception as e:  # one strategy's failure must not end the others' run
            failed[s] = f"{type(e).__name__}: {e}"
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no strategy ran: {failed}")
    return out, failed


def summary(by_query: DataFrame) -> DataFrame:
    """Leaderboard with positional latency percentiles."""
    mean = by_query.groupBy("strategy").agg(F.avg("latency_ms").alias("latency_mean_ms"))
    latency = metrics.position_percentiles(by_query, "strategy", "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    return metrics.leaderboard(by_query).join(mean, "strategy").join(latency, "strategy").orderBy(F.desc("ndcg_10"), "strategy")


def save(by_query: DataFrame, path: str) -> None:
    """Write per-query rows as JSON lines, metrics rounded to 4 places and milliseconds to 2."""
    out = [F.round(c, 2 if c == "latency_ms" else 4).alias(c) if t == "double" else F.col(c) for c, t in by_query.dtypes]
    by_query.select(*out).write.mode("overwrite").json(path)
