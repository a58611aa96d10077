"""TF-IDF weights over the most frequent words, and exact sparse cosine search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking
from .held import hold

MAX_FEATURES = 5000


def term_counts(corpus: DataFrame) -> DataFrame:
    """``index, term, tf``; blank documents have no rows."""
    words = corpus.where(tx.not_blank("document")).select("index", F.explode(tx.word_tokens("document")).alias("term"))
    return words.groupBy("index", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``term, idf`` of the words with the highest corpus frequency (ties by word)."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    top = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    return top.crossJoin(F.broadcast(n_docs)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(corpus: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``index, term, weight``: (1 + ln tf) * idf with unit length by document."""
    counts = term_counts(corpus)
    n_docs = corpus.where(tx.not_blank("document")).agg(F.count(F.lit(1)).alias("n"))
    vocab = vocabulary(counts, n_docs, max_features)
    # At most max_features short rows.
    raw = counts.join(F.broadcast(vocab), "term").select("index", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = raw.groupBy("index").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "index").select("index", "term", (F.col("w") / F.greatest("norm", F.lit(1e-10))).alias("weight"))


def query_weights(corpus: DataFrame, query: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """``term, w``: (1 + ln tf) * idf of the query's words that the corpus's vocabulary has."""
    counts = term_counts(corpus)
    n_docs = corpus.where(tx.not_blank("document")).agg(F.count(F.lit(1)).alias("n"))
    return _weighted(corpus.sparkSession, query, vocabulary(counts, n_docs, max_features))


def _weighted(spark: SparkSession, query: str, vocab: DataFrame) -> DataFrame:
    asked = spark.range(1).select(F.lit(0).cast("long").alias("index"), F.lit(query).alias("document"))
    return term_counts(asked).join(vocab, "term").select("term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def search(corpus: DataFrame, query: str, top_k: int = 10, max_features: int = MAX_FEATURES) -> DataFrame:
    """``rank, index, score``: exact cosine of the query's and each document's weights.

    Every non-blank document is ranked, those without a common word with score
    0.  A blank query or a corpus without words gives no rows.
    """
    ranking.check_k(top_k)
    spark = corpus.sparkSession
    if not query.strip():
        return corpus.limit(0).select(F.lit(0).cast("long").alias("rank"), "index", F.lit(0.0).alias("score"))
    corpus = corpus.where(tx.not_blank("document"))
    counts = hold(term_counts(corpus))
    n_docs = corpus.agg(F.count(F.lit(1)).alias("n"))
    vocab = vocabulary(counts, n_docs, max_features)
    q = _weighted(spark, query, vocab).withColumnRenamed("w", "qw")
    raw = counts.join(F.broadcast(vocab), "term").select("index", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    parts = raw.join(F.broadcast(q), "term", "left").groupBy("index").agg(
        F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn")
    )
    qn = q.agg(F.coalesce(F.sqrt(F.sum(F.col("qw") * F.col("qw"))), F.lit(0.0)).alias("qn"))
    found = parts.crossJoin(F.broadcast(qn)).select("index", (F.col("dot") / F.greatest(F.col("dn") * F.col("qn"), F.lit(1e-10))).alias("score"))
    every = corpus.select("index").join(found, "index", "left").select("index", F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranking.top_k(every, top_k).select("rank", "index", "score")
