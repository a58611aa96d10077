"""Cascades: cheap candidate stages, then a model on few rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neural, projection, ranking
from .models import Embedder, PairScorer

STAGE1_K, STAGE2_K, DIRECT = 200, 50, 5000


def candidates(
    corpus: DataFrame, query: str, w: np.ndarray, top_k: int = 10, stage1_k: int = STAGE1_K, stage2_k: int = STAGE2_K,
    sps_direct_threshold: int = DIRECT, merge: str = "max_raw",
) -> DataFrame:
    """``rank, index, score`` of the rows that the last stage will see.

    Up to ``sps_direct_threshold`` documents: the best by projection.  Beyond:
    the union of the best ``stage1_k`` by BM25 and by projection, by their
    larger score.  The two scales differ; ``merge="minmax"`` scales BM25 first.
    Both scores come from one reading of the texts.
    """
    ranking.check_k(top_k)
    n = corpus.count()
    m = ranking.candidate_count(n, stage2_k)
    both = projection.scores(corpus, query, w)
    if n <= sps_direct_threshold:
        return ranking.top_k(both, m).select("rank", "index", "score")
    if merge not in ("max_raw", "minmax"):
        raise ValueError(f"unknown merge {merge!r}")
    lexical = (ranking.min_max(both, "bm25") if merge == "minmax" else both).select("index", F.col("bm25").alias("score"))
    lexical = ranking.top_k(lexical.where("score > 0"), stage1_k).select("index", "score")
    semantic = ranking.top_k(both, stage1_k).select("index", "score")
    return ranking.top_k(ranking.union_max(lexical, semantic), m).select("rank", "index", "score")


def is_confident(scores: list[float], top_k: int, threshold: float = 0.3) -> bool:
    """Whether the gap after the k-th score is a large enough part of the best; true if there are no more than k."""
    if len(scores) <= top_k:
        return True
    return scores[0] > 0 and (scores[top_k - 1] - scores[top_k]) / scores[0] >= threshold


def _texts(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """The candidates' texts; at most a few hundred candidates are sent to the corpus."""
    return corpus.join(F.broadcast(found), "index").select("rank", "index", "document")


def search(
    corpus: DataFrame, query: str, w: np.ndarray, top_k: int = 10, stage1_k: int = STAGE1_K, stage2_k: int = STAGE2_K,
    sps_direct_threshold: int = DIRECT, confidence_threshold: float = 0.3, skip_neural: bool = False, skip_if_confident: bool = False,
    embedder: Embedder | None = None, merge: str = "max_raw",
) -> DataFrame:
    """Candidates reranked by embedding similarity (blank texts drop out there), or cut to ``top_k`` with ``skip_neural``."""
    found = candidates(corpus, query, w, top_k, stage1_k, stage2_k, sps_direct_threshold, merge)
    if skip_if_confident and not skip_neural:
        head = [r["score"] for r in found.where(F.col("rank") <= top_k + 1).orderBy("rank").collect()]
        skip_neural = is_confident(head, top_k, confidence_threshold)
    if skip_neural:
        return found.where(F.col("rank") <= top_k)
    return neural.search(_texts(found, corpus), query, top_k, embedder)


def search_v2(
    corpus: DataFrame, query: str, w: np.ndarray, top_k: int = 10, stage1_k: int = STAGE1_K, stage2_k: int = STAGE2_K,
    sps_direct_threshold: int = DIRECT, scorer: PairScorer | None = None, merge: str = "max_raw",
) -> DataFrame:
    """Candidates reranked by a pair scorer; ties keep the candidates' order."""
    found = candidates(corpus, query, w, top_k, stage1_k, stage2_k, sps_direct_threshold, merge)
    return neural.rerank(_texts(found, corpus), query, top_k, scorer)
