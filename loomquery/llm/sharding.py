"""Sharding by global byte-size prefix sums.

Rows are put in one global order, per-partition totals give every partition
its byte and row offset, and the byte range is cut at equal targets, so each
shard is one contiguous run of the order.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """Assign every row to one of ``shards`` contiguous, byte-balanced shards.

    Returns ``doc_id, size, text_crc32, shard, slot``.  The order is
    (id, crc, size).  A row goes to the shard that holds the middle of its
    byte range, so a shard's size differs from the target by less than its
    largest row.  Only these narrow columns are shuffled; the text never is.

    Null text: size ``overhead`` and crc 0.  Null ids come first.  Repeated
    rows: each copy is placed on its own; rows equal in every key are
    interchangeable and are spread by input position, so a hot id cannot fill
    one partition.  Empty table: no rows.  A shard may stay empty where one
    row is larger than the target.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    order = ["doc_id", "text_crc32", "size", "spread"]
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    # The partition number is data from here on: it must not be computed twice.
    ranged = durable(
        narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-order"
    )
    # One row for each partition, so one task for these sums is enough at any size.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    start = F.col("byte_offset") + F.col("byte_end") - F.col("size")
    placed = (
        ranged.withColumn("byte_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("local_row", F.row_number().over(within) - 1)
        # A row for each partition of the order: its number is a setting, not a property of the data.
        .join(F.broadcast(totals), "part")
        .withColumn("row", F.col("row_offset") + F.col("local_row"))
        .withColumn("middle", 2 * start + F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((middle * {shards}) div (2 * all_bytes) as int)")))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("row") - F.col("first_row")).alias("slot")
    )
