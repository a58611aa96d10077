"""BM25 over substring frequencies of stemmed query terms, without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking
from .held import hold

K1, B = 1.5, 0.75


def _terms(queries: dict) -> list[str]:
    return list(dict.fromkeys(s for q in queries.values() for s in tx.stems_of(q)))


def _frequencies(corpus: DataFrame, stems: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``dl`` and one ``tf<i>`` for each stem; null text is empty."""
    low = corpus.select(*keep, F.lower(F.coalesce(F.col("document"), F.lit(""))).alias("_t"))
    return low.select(*keep, tx.space_length("_t").alias("dl"), *(tx.substring_tf("_t", s).alias(f"tf{i}") for i, s in enumerate(stems)))


def _statistics(freq: DataFrame, stems: list[str]) -> DataFrame:
    """One row: ``n``, ``avgdl`` and the document frequency ``df<i>`` of each stem."""
    return freq.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(stems)))
    )


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _term_score(i: int, k1: float, b: float) -> Column:
    tf = F.col(f"tf{i}")
    length = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return idf(F.col("n"), F.col(f"df{i}")) * F.coalesce(F.try_divide(tf * (k1 + 1), tf + length), F.lit(0.0))


def score_columns(corpus: DataFrame, queries: dict, k1: float = K1, b: float = B, cache: bool = True, keep: tuple[str, ...] = ("index",)) -> tuple[DataFrame, dict]:
    """The corpus with ``n`` and so on, and each query's score as a Column (0 for a query without terms).

    The texts are read once: the narrow table of frequencies is held (unless
    ``cache`` is off) and serves the statistics and the scores; ``held.release``
    frees it.
    """
    stems = _terms(queries)
    freq = _frequencies(corpus, stems, keep)
    if cache:
        freq = hold(freq)
    wide = freq.crossJoin(F.broadcast(_statistics(freq, stems)))  # one row
    at = {s: i for i, s in enumerate(stems)}
    scores = {}
    for key, query in queries.items():
        total = F.lit(0.0)
        for s in tx.stems_of(query):
            total = total + _term_score(at[s], k1, b)
        scores[key] = total
    return wide, scores


def scores(corpus: DataFrame, query: str, k1: float = K1, b: float = B, cache: bool = True) -> DataFrame:
    """``index, score`` of every document, 0 included."""
    wide, by_query = score_columns(corpus, {0: query}, k1, b, cache)
    return wide.select("index", by_query[0].alias("score"))


def search(corpus: DataFrame, query: str, top_k: int = 10, k1: float = K1, b: float = B, cache: bool = True) -> DataFrame:
    """``rank, index, score`` of the best documents with a positive score.

    A query without terms or an empty corpus gives no rows.  Ties go by index.
    """
    ranking.check_k(top_k)
    return ranking.top_k(scores(corpus, query, k1, b, cache).where("score > 0"), top_k).select("rank", "index", "score")


def batch_scores(corpus: DataFrame, queries: dict, k1: float = K1, b: float = B, cache: bool = True) -> DataFrame:
    """``query_id, index, score`` of every positive score; all queries share one reading of the corpus."""
    wide, by_query = score_columns(corpus, queries, k1, b, cache)
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("query_id"), c.alias("score")) for k, c in by_query.items()))
    return wide.select("index", F.inline(F.filter(rows, lambda r: r["score"] > 0)))


def batch_search(corpus: DataFrame, queries: dict, top_k: int = 10, k1: float = K1, b: float = B, cache: bool = True) -> DataFrame:
    """``query_id, rank, index, score`` of the best documents of each query."""
    found = ranking.top_k_by(batch_scores(corpus, queries, k1, b, cache), top_k)
    return found.select("query_id", "rank", "index", "score")


def document_frequencies(corpus: DataFrame, query: str) -> DataFrame:
    """``stem, df, n, idf`` of each query term."""
    stems = tx.stems_of(query)
    stats = _statistics(_frequencies(corpus, stems, ()), stems)
    rows = F.array(*(F.struct(F.lit(s).alias("stem"), F.col(f"df{i}").alias("df")) for i, s in enumerate(stems)))
    return stats.select("n", F.inline(rows)).select("stem", "df", "n", idf(F.col("n"), F.col("df")).alias("idf"))
