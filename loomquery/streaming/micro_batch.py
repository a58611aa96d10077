"""Search over a stream: each micro-batch is searched as a corpus of its own.

An extension: scores use the batch's own statistics, so they differ from a
search over all rows seen so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25


def search_stream(stream: DataFrame, query: str, out_path: str, checkpoint: str, top_k: int = 10, search: Callable[..., DataFrame] = bm25.search) -> StreamingQuery:
    """Write ``batch_id, rank, index, score`` of every micro-batch of ``stream`` (index, document) to Parquet; one run over what is there.

    A batch that is repeated after a failure replaces its own folder.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        found = search(batch, query, top_k=top_k).withColumn("batch_id", F.lit(batch_id).cast("long"))
        found.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
