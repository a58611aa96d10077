"""Exact nearest neighbours by cosine over a vector column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import ranking
from .models import even, unit_rows

#: Query vectors sent to every task at once, about; more are searched in blocks.
BLOCK_QUERIES = 2048
#: Rows multiplied with a block of queries at once.
BLOCK_ROWS = 4096


def search(table: DataFrame, query: Sequence[float], top_k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rank, index, score`` of the vectors nearest to one query vector."""
    found = table.select(F.col(id_col).alias("index"), vx.cosine(vector, vx.literal(query)).alias("score"))
    return ranking.top_k(found, top_k).select("rank", "index", "score")


def matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as rows of doubles; all must be equally long."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def best_of(scores: np.ndarray, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and row numbers of the k highest scores of each column, ties by index."""
    if len(index) <= k:
        rows, cols = np.indices(scores.shape)
        return cols.ravel(), rows.ravel()
    floor = np.partition(scores, len(index) - k, axis=0)[len(index) - k]
    rows, cols = np.nonzero(scores >= floor)
    order = np.lexsort((index[rows], -scores[rows, cols], cols))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(cols, cols)  # where each column begins
    keep = np.arange(len(cols)) - first < k
    return cols[keep], rows[keep]


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries (query_id, query_vector) that have a vector, about ``BLOCK_QUERIES`` at a time, dealt by a hash of the id."""
    asked = queries.where("query_vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # one block
        if own:
            yield np.asarray([r["query_id"] for r in own]), unit_rows(np.asarray([r["query_vector"] for r in own], float))


def batch_search(table: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, index, score`` for each row of ``queries`` (query_id, query_vector).

    The queries are sent to every task in blocks of about
    ``BLOCK_QUERIES``, so what is sent stays bounded; the table is never
    shuffled: a task multiplies its rows with a block and passes on the best
    of each.  Rows and queries without a vector are left out.
    """
    ranking.check_k(top_k)
    spark = table.sparkSession
    rows = table.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("index"), F.col(vector).alias("v"))
    out = None
    for block in query_blocks(queries):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS)
                    index = batch.column("index").to_numpy(zero_copy_only=False)
                    scores = even(unit_rows(matrix(batch.column("v"))) @ q.T)
                    cols, places = best_of(scores, index, top_k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cols]), pa.array(index[places]), pa.array(scores[places, cols])], ["query_id", "index", "score"])

        part = rows.mapInArrow(run, "query_id long, index long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank long, index long, score double")
    return ranking.top_k_by(out, top_k).select("query_id", "rank", "index", "score")
