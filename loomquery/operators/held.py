"""Tables that searches keep in Spark's cache while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame

_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Cache a narrow table until :func:`release`; if it is lost or released early, Spark computes it anew."""
    _HELD.append(df.persist())
    return df


def release() -> None:
    """Free what searches have held so far, and nothing else; for callers that have collected their results."""
    while _HELD:
        _HELD.pop().unpersist()
