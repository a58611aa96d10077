"""Top-k, normalisation and fusion of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_k(top_k: int) -> int:
    """``top_k`` if it is at least 1."""
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")
    return top_k


def top_k(scored: DataFrame, k: int, id_col: str = "index", score: str = "score") -> DataFrame:
    """The k rows of highest score, ties by id, with ``rank`` from 1; planned as a bounded selection in each task."""
    best = scored.orderBy(F.desc(score), F.asc(id_col)).limit(check_k(k))
    # At most k rows come here.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))).cast("long"))


def top_k_by(scored: DataFrame, k: int, group: str = "query_id", id_col: str = "index", score: str = "score") -> DataFrame:
    """The same for each group; Spark limits each group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= check_k(k))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..1; 0.5 where the range is below 1e-12."""
    return F.when(high - low < 1e-12, F.lit(0.5)).otherwise(F.try_divide(value - low, high - low))


def min_max(scored: DataFrame, *columns: str) -> DataFrame:
    """Each column scaled over the whole table, by one row of extremes sent to every task."""
    extremes = scored.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    wide = scored.crossJoin(F.broadcast(extremes))  # one row
    out = {c: scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns}
    return wide.select(*(out[c].alias(c) if c in out else F.col(c) for c in scored.columns))


def fused(first: Column, second: Column, alpha: float = 0.3) -> Column:
    """``alpha * first + (1 - alpha) * second``."""
    return alpha * first + (1 - alpha) * second


def union_max(*lists: DataFrame, id_col: str = "index") -> DataFrame:
    """Candidates of all lists by id with their highest score; ``origin`` is the first list that has it."""
    out = None
    for i, part in enumerate(lists):
        one = part.select(id_col, F.col("score"), F.lit(i).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(id_col).agg(F.max("score").alias("score"), F.min("origin").alias("origin"))


def candidate_count(n: int, stage2_k: int = 50) -> int:
    """Candidates for the second stage: a twentieth of the corpus within ``stage2_k`` and 500."""
    return max(stage2_k, min(n // 20, 500))
