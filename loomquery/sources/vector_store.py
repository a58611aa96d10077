"""Vector tables of other stores: read them, and turn their nearest-neighbour answers into results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx


def read_table(spark: SparkSession, path: str, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of a stored table; ids that count from 1 become 0-based with :func:`vectors.zero_based`."""
    return _named(spark.read.parquet(path), id_col, vector)


def read_jdbc(spark: SparkSession, options: dict[str, str], id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The same of a database table through Spark's JDBC source; ``options`` are that source's (url, dbtable, partitionColumn ...).

    Vectors may be arrays or text literals ``[x,y,...]``.
    """
    return _named(spark.read.format("jdbc").options(**options).load(), id_col, vector)


def _named(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    if dict(table.dtypes)[vector] == "string":
        v = F.from_json(v, "array<float>")
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>").alias("embedding"))


def results(answers: DataFrame, id_col: str = "id", distance: str = "distance") -> DataFrame:
    """``index, score`` of a store's answers: rows numbered from 1, with cosine distances."""
    return answers.select(vx.zero_based(id_col).alias("index"), vx.score_of(distance).alias("score"))
