"""An inverted-file index of vectors: built once, stored as Parquet, searched by cells.

Every row is stored in the cells of the nearest centroids, so a search reads
the files of a few cells only.  More cells read mean higher recall; with all of
them the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn, ranking
from .models import even, unit_rows

#: Rows that centroids are fitted on at most.
SAMPLE_ROWS = 20_000
#: Cells of an index: its square root of rows within these limits.
LEAST_CELLS, MOST_CELLS = 8, 4096
ROUNDS = 12


def _centroids(rows: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty one is replaced by the row that fits worst."""
    rng = np.random.default_rng(seed)
    out = rows[rng.permutation(len(rows))[:cells]].copy()
    for _ in range(ROUNDS):
        scores = rows @ out.T
        at = scores.argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, rows)
        count = np.bincount(at, minlength=len(out))
        worst = np.argsort(scores.max(1))
        sums[count == 0] = rows[worst[: int((count == 0).sum())]]
        out = unit_rows(sums)
    return out


def build(table: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> int:
    """Write an index of all rows with a vector under ``path`` and return the number of rows that it then has.

    Centroids are fitted on at most about ``sample_rows`` rows, drawn by a hash
    of the id; every row is indexed.  Large cells are several files, dealt by
    a hash of the id.
    """
    spark = table.sparkSession
    rows = table.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    n = rows.count()
    cells = min(max(LEAST_CELLS, round(n**0.5)), MOST_CELLS) if cells is None else cells
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    drawn = rows.where(share).orderBy("id").limit(2 * sample_rows).toPandas()["v"] if n else []
    fitted = _centroids(unit_rows(np.stack([np.asarray(v, float) for v in drawn])), min(cells, len(drawn))) if len(drawn) else np.empty((0, 0))
    held = spark.sparkContext.broadcast(fitted)  # at most MOST_CELLS rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (unit_rows(knn.matrix(batch.column("v"))) @ held.value.T).argmax(1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), batch.column("v")], ["cell", "id", "v"])

    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    placed = rows.mapInArrow(place, "cell int, id long, v array<float>")
    parts = max(1, n // 100_000)
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows").count() if n else 0


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 10, probes: int = 8) -> DataFrame:
    """``query_id, rank, index, score``: the nearest rows within the ``probes`` cells nearest to each query (query_id, query_vector).

    Only the folders of cells that some query probes are read.  Queries are
    collected and sent to the tasks in blocks, as in ``knn``; each block reads
    the cells that it probes.
    """
    ranking.check_k(top_k)
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    centroids = np.stack(cells["centroid"].to_numpy()) if len(cells) else None
    out = None
    for ids, q in knn.query_blocks(queries) if len(cells) else ():
        part = _probe(spark, path, ids, q, centroids, top_k, probes)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank long, index long, score double")
    return ranking.top_k_by(out, top_k).select("query_id", "rank", "index", "score")


def _probe(spark: SparkSession, path: str, ids: np.ndarray, q: np.ndarray, centroids: np.ndarray, top_k: int, probes: int) -> DataFrame:
    """``query_id, index, score``: the best rows for one block of queries in each batch of the cells that it probes."""
    near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
    wanted = np.zeros((len(centroids), len(q)), bool)
    wanted[near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])] = True
    held = spark.sparkContext.broadcast((ids, q, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, wants = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, knn.BLOCK_ROWS):
                batch = whole.slice(start, knn.BLOCK_ROWS)
                cell, index = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
                rows = unit_rows(knn.matrix(batch.column("v")))
                for c in np.unique(cell):
                    at, own = np.flatnonzero(cell == c), np.flatnonzero(wants[c])
                    scores = even(rows[at] @ vectors[own].T)
                    cols, places = knn.best_of(scores, index[at], top_k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own[cols]]), pa.array(index[at[places]]), pa.array(scores[places, cols])], ["query_id", "index", "score"])

    some = np.flatnonzero(wanted.any(1)).tolist()
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(some)).select("cell", "id", "v")
    return rows.mapInArrow(run, "query_id long, index long, score double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that were found."""
    n = exact.count()
    return exact.join(found.select("query_id", "index"), ["query_id", "index"], "left_semi").count() / max(n, 1)


def sweep(spark: SparkSession, path: str, table: DataFrame, queries: DataFrame, probes: tuple[int, ...] = (1, 4, 8, 16), top_k: int = 10) -> list[tuple[int, float]]:
    """Recall against brute force for each number of cells read."""
    exact = knn.batch_search(table, queries, top_k).persist()
    out = [(p, recall(search(spark, path, queries, top_k, p), exact)) for p in probes]
    exact.unpersist()
    return out
