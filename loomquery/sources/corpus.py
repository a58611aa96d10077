"""Readers and writers of corpora, queries, records and results."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Sequence
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_list(spark: SparkSession, documents: Sequence[str | None]) -> DataFrame:
    """``index, document`` of a list, in its order."""
    return spark.createDataFrame(list(enumerate(documents)), "index long, document string")


def from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``index, document`` of any table."""
    return df.select(F.col(id_col).cast("long").alias("index"), F.col(text_col).cast("string").alias("document"))


def read_json_strings(spark: SparkSession, path: str) -> DataFrame:
    """``index, document`` of a file that holds one JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>"))).select(F.col("pos").cast("long").alias("index"), F.col("col").alias("document"))


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that holds one JSON array of objects, with their position as ``index``."""
    schema = spark.read.json(path, multiLine=True).schema
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<{schema.simpleString()}>")))
    return rows.select(F.col("pos").cast("long").alias("index"), "col.*")


def parse_json(source: IO[str] | str) -> list:
    """A non-empty JSON array from a stream or a text; else ``ValueError``."""
    text = source if isinstance(source, str) else source.read()
    if not text.strip():
        raise ValueError("no input")
    data = json.loads(text)
    if not isinstance(data, list) or not data:
        raise ValueError("input must be a non-empty JSON array")
    return data


def need_strings(items: Iterable) -> list[str]:
    """The items if all are strings; else ``ValueError``."""
    items = list(items)
    if not all(isinstance(x, str) for x in items):
        raise ValueError("all items must be strings unless text fields are named")
    return items


def from_objects(spark: SparkSession, objects: Sequence[dict]) -> DataFrame:
    """Records with their position as ``index``; each value is kept as text, a missing key is null."""
    names = list(dict.fromkeys(k for o in objects for k in o))
    schema = "index long" + "".join(f", `{n}` string" for n in names)
    rows = [(i, *(None if o.get(n) is None else o[n] if isinstance(o[n], str) else json.dumps(o[n]) for n in names)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, schema)


def result_json(results: DataFrame) -> DataFrame:
    """``value``: one JSON object for each result row, its score rounded to 4 places."""
    columns = [F.round("score", 4).alias("score") if c == "score" else F.col(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*columns)).alias("value"))


def response(query: str, strategy: str, rows: list, num_documents: int, latency_ms: float, digits: int | None = 4) -> dict:
    """The answer to one search as plain data."""
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        d.pop("rank", None)
        if digits is not None:
            d["score"] = round(d["score"], digits)
        out.append(d)
    return {"query": query, "strategy": strategy, "latency_ms": round(latency_ms, 1), "num_documents": num_documents, "results": out}


def write_json(data: dict, out: IO[str] | None = None) -> None:
    """Write one answer as indented JSON."""
    (out or sys.stdout).write(json.dumps(data, indent=2, ensure_ascii=False) + "\n")


def write_vectors(table: DataFrame, path: str) -> int:
    """Store a vector table as Parquet and return the number of rows that it then has."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path).count()
