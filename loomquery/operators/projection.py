"""Semantic projection: hashed n-grams, a ridge-trained map into embedding space, and fusion with BM25."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, ranking
from .models import Embedder, HashEmbedder, even, remember, sign_rows, signs, unit_rows, words

FEATURES = 1 << 14
ALPHA = 0.3
RIDGE = 1.0
#: Texts that a map is trained on at most.
TRAIN_TEXTS = 1024


_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    """The first 32 bits of the word's MD5."""
    found = _HASHES.get(word)
    return remember(_HASHES, word, int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")) if found is None else found


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text's words and word pairs: signed hashing, unit length, sorted by number.

    The number is the hash modulo ``FEATURES``, the sign its bit 16; a pair
    (a, b) has the hash 31 a + b modulo 2^32.
    """
    h = np.asarray([_word_hash(w) for w in words(text)], np.uint32)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0)
    h = np.concatenate([h, h[:-1] * np.uint32(31) + h[1:]])
    value = np.bincount((h % FEATURES).astype(np.int64), np.where(h >> np.uint32(16) & np.uint32(1), 1.0, -1.0), FEATURES)
    found = np.flatnonzero(np.bincount((h % FEATURES).astype(np.int64), minlength=FEATURES))
    value = value[found]
    return found, value / max(float(np.linalg.norm(value)), 1e-10)


def sign_map() -> np.ndarray:
    """A map that needs no training: row f holds the sign vector of the text ``f`` plus its number (a random projection to 64 dimensions)."""
    return sign_rows([signs(f"f{f}") for f in range(FEATURES)]).astype(np.float32)


def project(texts: Sequence[str | None], w: np.ndarray) -> np.ndarray:
    """Unit rows of the texts in embedding space; a text without words is all zeros."""
    out = np.zeros((len(texts), w.shape[1]))
    for i, text in enumerate(texts):
        x, v = hashed(text)
        if len(x):
            out[i] = v @ w[x]
    return unit_rows(out)


def train(texts: Sequence[str], embedder: Embedder | None = None, ridge: float = RIDGE) -> np.ndarray:
    """Map of least squares with an L2 penalty and no intercept, by the dual form (texts are far fewer than features)."""
    embedder = embedder or HashEmbedder()
    x = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        at, v = hashed(t)
        x[i, at] = v
    gram = x @ x.T + ridge * np.eye(len(texts), dtype=np.float32)
    return (x.T @ np.linalg.solve(gram, embedder.embed(list(texts)))).astype(np.float32)


def train_on(corpus: DataFrame, embedder: Embedder | None = None, max_texts: int = TRAIN_TEXTS) -> np.ndarray:
    """Train on at most ``max_texts`` documents, those with the smallest hash of their index."""
    rows = corpus.where("document is not null").orderBy(F.xxhash64("index"), "index").limit(max_texts).select("document").collect()
    return train([r["document"] for r in rows], embedder)


def save(spark: SparkSession, w: np.ndarray, path: str) -> None:
    """Write a map as ``feature, w`` rows."""
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(w)], "feature int, w array<float>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> np.ndarray:
    """Read a map; its feature numbers must be complete and its rows equally long."""
    rows = spark.read.parquet(path).orderBy("feature").toPandas()
    if rows["feature"].tolist() != list(range(FEATURES)) or rows["w"].map(len).nunique() != 1:
        raise ValueError(f"not a projection of {FEATURES} features: {path}")
    return np.stack(rows["w"].to_numpy()).astype(np.float32)


def similarities(corpus: DataFrame, queries: dict, w: np.ndarray) -> DataFrame:
    """The corpus with ``sps<i>`` for the i-th query: cosine of its and each document's projection; each text is projected once."""
    spark = corpus.sparkSession
    held = spark.sparkContext.broadcast(w)  # FEATURES rows, whatever the corpus
    q = project(list(queries.values()), w)

    @F.pandas_udf("array<double>")
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(even(project(list(texts), held.value) @ q.T)))

    wide = corpus.withColumn("_sps", cosines("document"))
    return wide.select(*corpus.columns, *(F.col("_sps")[i].alias(f"sps{i}") for i in range(len(queries))))


def _both(corpus: DataFrame, queries: dict, w: np.ndarray, alpha: float) -> DataFrame:
    """``index`` and, for the i-th query, ``bm25_<i>`` and ``score<i>``; both parts of a score are min-max scaled over the corpus."""
    own = {i: q for i, q in enumerate(queries.values())}
    names = [f"sps{i}" for i in own]
    wide, by_query = bm25.score_columns(similarities(corpus, own, w), own, keep=("index", *names))
    both = wide.select("index", *names, *(by_query[i].alias(f"bm25_{i}") for i in own))
    scaled = ranking.min_max(both.select("*", *(F.col(f"bm25_{i}").alias(f"raw{i}") for i in own)), *names, *(f"bm25_{i}" for i in own))
    return scaled.select("index", *(F.col(f"sps{i}") for i in own), *(F.col(f"raw{i}").alias(f"bm25_{i}") for i in own),
                         *(ranking.fused(F.col(f"sps{i}"), F.col(f"bm25_{i}"), alpha).alias(f"score{i}") for i in own))


def scores(corpus: DataFrame, query: str, w: np.ndarray, alpha: float = ALPHA) -> DataFrame:
    """``index, bm25, score`` of every document: raw BM25, and the fusion of both parts scaled over the corpus."""
    return _both(corpus, {0: query}, w, alpha).select("index", F.col("bm25_0").alias("bm25"), F.col("score0").alias("score"))


def batch_search(corpus: DataFrame, queries: dict, w: np.ndarray, top_k: int = 10, alpha: float = ALPHA) -> DataFrame:
    """``query_id, rank, index, score`` for queries by id; the corpus is read and projected once for all of them."""
    ranking.check_k(top_k)
    both = _both(corpus, queries, w, alpha)
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("query_id"), F.col(f"score{i}").alias("score")) for i, k in enumerate(queries)))
    rows = both.select("index", F.explode(each).alias("s")).select("s.query_id", "index", "s.score")
    return ranking.top_k_by(rows, top_k).select("query_id", "rank", "index", "score")


def search(corpus: DataFrame, query: str, w: np.ndarray, top_k: int = 10, alpha: float = ALPHA) -> DataFrame:
    """``rank, index, score`` of exactly min(top_k, n) documents, whether or not anything matches."""
    ranking.check_k(top_k)
    return ranking.top_k(scores(corpus, query, w, alpha), top_k).select("rank", "index", "score")
