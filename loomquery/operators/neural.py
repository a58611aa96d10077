"""Embedding search and pair reranking by pluggable models, run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking
from .models import Embedder, HashEmbedder, OverlapScorer, PairScorer, even


def embed(corpus: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``index, embedding`` of every non-blank document."""
    model = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.embed(list(texts))))

    return corpus.where(tx.not_blank("document")).select("index", run("document").alias("embedding"))


def scores(corpus: DataFrame, query: str, embedder: Embedder | None = None) -> DataFrame:
    """``index, score``: cosine of every non-blank document with the query; vectors are dropped in the same batch."""
    model = embedder or HashEmbedder()
    q = model.embed([query])[0]

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(even(model.embed(list(texts)) @ q))

    return corpus.where(tx.not_blank("document")).select("index", run("document").alias("score"))


def search(corpus: DataFrame, query: str, top_k: int = 10, embedder: Embedder | None = None, patience: int = 3) -> DataFrame:
    """``rank, index, score`` of the nearest documents.

    The result is always the exact top k; ``patience`` (early stopping of a
    sequential reader) is accepted and has no effect.
    """
    return ranking.top_k(scores(corpus, query, embedder), top_k).select("rank", "index", "score")


def batch_search(corpus: DataFrame, queries: dict, top_k: int = 10, embedder: Embedder | None = None) -> DataFrame:
    """``query_id, rank, index, score`` for queries by id; each document is embedded once for all of them."""
    ranking.check_k(top_k)
    model = embedder or HashEmbedder()
    q = model.embed(list(queries.values()))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(even(model.embed(list(texts)) @ q.T)))

    every = corpus.where(tx.not_blank("document")).select("index", run("document").alias("s"))
    ids = F.array(*(F.lit(k).cast("long") for k in queries))
    rows = every.select("index", F.explode(F.arrays_zip(ids.alias("query_id"), F.col("s").alias("score"))).alias("p")).select("p.query_id", "index", "p.score")
    return ranking.top_k_by(rows, top_k).select("query_id", "rank", "index", "score")


def rerank(candidates: DataFrame, query: str, top_k: int = 10, scorer: PairScorer | None = None, order: str = "rank") -> DataFrame:
    """Score ``(query, document)`` pairs of a candidate table and keep the best; ties keep the candidates' ``order``."""
    model = scorer or OverlapScorer()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(even(model.score(query, ["" if t is None else t for t in texts])))

    scored = candidates.withColumn("score", run("document"))
    best = scored.orderBy(F.desc("score"), order).limit(ranking.check_k(top_k))
    place = F.row_number().over(Window.orderBy(F.desc("score"), order)).cast("long")
    return best.select(place.alias("rank"), "index", "score")
