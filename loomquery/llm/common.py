"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_path

#: ``bytes.translate`` table of the word rule: A-Z to a-z, every other ASCII
#: byte that is not a letter or digit to a space; bytes of non-ASCII
#: characters stay, so they are word characters.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z is lower-cased, as UTF-8."""
    if not text:
        return []
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split()


#: Entries of each of the two generations of a Python worker's cache, and bytes of a key that is kept: some 45 MB at most.
CACHE_ENTRIES, CACHED_BYTES = 120_000, 48
_cache: tuple[str, dict, dict] = ("", {}, {})


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers are kept for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def worker_cache(owner: str, entries: int | None = None) -> tuple[dict, dict]:
    """This Python worker's recent and older entries; both emptied when another operator comes to use it.

    When the recent ones are full, they become the older ones, so what is used
    often stays: who finds an entry among the older ones puts it back.
    ``entries``: of a generation, where they are not ``CACHE_ENTRIES``.
    """
    global _cache
    if _cache[0] != owner:
        _cache = (owner, {}, {})
        trim()
    elif len(_cache[1]) >= (entries or CACHE_ENTRIES):
        _cache = (owner, {}, _cache[1])
    return _cache[1:]


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: the crc of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def py_id_remainder(doc_id: int | None, modulus: int) -> int:
    """The same rule in Python, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Cuts lineage in a way that survives the loss of any executor, and fixes
    values that must not be computed twice.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomquery_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`durable` that no later plan reads."""
    path = getattr(df, "_loomquery_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Rows and bytes of text that a task turns into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def slices(batches: Iterator, column: str) -> Iterator:
    """Arrow batches cut so that each holds ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes of ``column`` at most, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + SLICE_BYTES, "right"))
            end = min(max(end, at + 1), at + SLICE_ROWS)
            yield batch.slice(at, end - at)
            at = end
    trim()


def chunks(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches regrouped into tables of at most ``rows`` rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(rows - n, batch.num_rows - at))
            held.append(part)
            n += part.num_rows
            at += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
