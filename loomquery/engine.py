"""Search engine: named strategies over any DataFrame of texts or records."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import bm25, cascade, held, neural, rptree
from .operators import projection as maps

Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, tuple[Strategy, bool]] = {}
DEFAULT = "cascade"


def register(name: str, needs_projection: bool = False) -> Callable[[Strategy], Strategy]:
    """Register ``f(corpus, query, [w,] top_k=..., **options) -> rank, index, score``; a later one of the same name wins."""

    def add(f: Strategy) -> Strategy:
        _STRATEGIES[name] = (f, needs_projection)
        return f

    return add


register("lexical")(bm25.search)
register("projection", True)(maps.search)
register("neural")(neural.search)
register("cascade", True)(cascade.search)
register("rptree")(rptree.search)
register("cascade_v2", True)(cascade.search_v2)


def strategies() -> list[str]:
    """Registered names, sorted."""
    return sorted(_STRATEGIES)


def resolve(name: str) -> str:
    """The strategy's own name: "auto" is the default; unknown names raise ``ValueError`` with the known ones."""
    name = DEFAULT if name == "auto" else name
    if name not in _STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(strategies())}")
    return name


class SearchEngine:
    """Search with one strategy and its options.

    Strategies that need a projection take it from ``projection`` (an array),
    from ``model_path`` (see ``operators.projection.save``) or from ``train``;
    without any, each search trains one on its own corpus and forgets it.
    """

    def __init__(self, spark: SparkSession, strategy: str = "auto", projection: np.ndarray | None = None, model_path: str | None = None, **options):
        self.spark, self.options, self._w = spark, options, projection
        self.strategy = resolve(strategy)
        if model_path and projection is None and _STRATEGIES[self.strategy][1]:
            self._w = maps.load(spark, model_path)

    def train(self, docs: DataFrame | Sequence[str], text_col: str = "document", id_col: str = "index", model_path: str | None = None) -> SearchEngine:
        """Train the projection of later searches on one corpus, and store it if a path is given."""
        if _STRATEGIES[self.strategy][1]:
            self._w = maps.train_on(self._corpus(docs, text_col, id_col))
            if model_path:
                maps.save(self.spark, self._w, model_path)
        return self

    def _corpus(self, docs: DataFrame | Sequence[str], text_col: str, id_col: str) -> DataFrame:
        if isinstance(docs, DataFrame):
            return docs.select(F.col(id_col).cast("long").alias("index"), F.col(text_col).cast("string").alias("document"))
        return self.spark.createDataFrame(list(enumerate(docs)), "index long, document string")

    def search(self, query: str, docs: DataFrame | Sequence[str], top_k: int = 10, text_col: str = "document", id_col: str = "index") -> DataFrame:
        """``rank, index, score, document`` of the best rows of a table or a list of texts."""
        corpus = self._corpus(docs, text_col, id_col)
        f, needs_projection = _STRATEGIES[self.strategy]
        args = (corpus, query)
        if needs_projection:
            args += (maps.train_on(corpus) if self._w is None else self._w,)
        found = f(*args, top_k=top_k, **self.options)
        return corpus.join(F.broadcast(found), "index").select("rank", "index", "score", "document").orderBy("rank")  # top_k rows

    def search_objects(self, query: str, objects: DataFrame, text_fields: str | Sequence[str], top_k: int = 10, id_col: str = "index") -> DataFrame:
        """The same over records: ``text_fields`` are joined to one text, and each result carries its record as ``object``."""
        fields = tx.field_list(text_fields) if isinstance(text_fields, str) else list(text_fields)
        known = set(objects.columns)
        text = F.concat_ws(" ", *(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) if f in known else F.lit("") for f in fields))
        rows = objects.select(F.col(id_col).cast("long").alias("index"), text.alias("document"), F.struct(*[f"`{c}`" for c in objects.columns if c != id_col]).alias("object"))
        found = self.search(query, rows, top_k)
        return rows.select("index", "object").join(F.broadcast(found), "index").select("rank", "index", "score", "document", "object").orderBy("rank")

    def search_timed(self, query: str, docs: DataFrame | Sequence[str], top_k: int = 10, **kwargs) -> tuple[list, float]:
        """Collected rows and the milliseconds that they took."""
        start = time.perf_counter()
        rows = self.search(query, docs, top_k, **kwargs).collect()
        took = (time.perf_counter() - start) * 1000
        held.release()
        return rows, took
