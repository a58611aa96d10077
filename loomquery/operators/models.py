"""Model interfaces, adapters to real models, and deterministic offline stand-ins.

The stand-ins need no download.  They make the model operators testable; their
scores say nothing about a real encoder's quality.
"""

from __future__ import annotations

import hashlib
import importlib
import unicodedata
from collections import Counter
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import regex

_WORD = regex.compile(r"\b\w\w+\b")
#: Words or n-grams that a worker remembers.
CACHE_ENTRIES = 50_000


class Embedder(Protocol):
    """Maps texts to rows of unit length."""

    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """Scores documents against a query, higher is better."""

    def score(self, query: str, documents: Sequence[str]) -> np.ndarray: ...


def plain(text: str | None) -> str:
    """Lower-case text without accents."""
    low = (text or "").lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Words of two characters or more, lower-case and without accents."""
    return _WORD.findall(plain(text))


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)


def even(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles of 12 places, so that equal texts tie wherever in a batch they stand."""
    return np.round(np.asarray(scores, float), 12)


def remember(cache: dict, key, value):
    """``value``, kept in a worker's cache that is emptied when it is full."""
    if len(cache) >= CACHE_ENTRIES:
        cache.clear()
    cache[key] = value
    return value


_GRAMS: dict[str, bytes] = {}
_VECTORS: dict[str, np.ndarray] = {}


def signs(gram: str) -> bytes:
    """The first 64 bits of the gram's MD5: its fixed random vector of +1 (bit set) and -1."""
    found = _GRAMS.get(gram)
    return remember(_GRAMS, gram, hashlib.md5(gram.encode()).digest()[:8]) if found is None else found


def sign_rows(bits: Sequence[bytes]) -> np.ndarray:
    """Rows of +1 and -1, first bit first."""
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1) * 2.0 - 1


class HashEmbedder:
    """Sum over the words of a text: the mean of the sign vectors of the word and its character trigrams (``<`` and ``>`` at the edges)."""

    dim = 64

    def _vectors(self, found: Sequence[str]) -> np.ndarray:
        grams = [[w, *(f"<{w}>"[j : j + 3] for j in range(len(w)))] for w in found]
        rows = sign_rows([signs(g) for own in grams for g in own])
        sizes = np.asarray([len(own) for own in grams])
        return np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            count = Counter(words(text))
            if not count:
                continue
            vectors = {w: _VECTORS.get(w) for w in count}
            missing = [w for w, v in vectors.items() if v is None]
            if missing:
                for w, v in zip(missing, self._vectors(missing), strict=True):
                    vectors[w] = remember(_VECTORS, w, v)
            out[i] = np.fromiter(count.values(), float) @ np.stack(list(vectors.values()))
        return unit_rows(out)


class OverlapScorer:
    """Share of the query's words in the document, plus the cosine of the embeddings."""

    def __init__(self, embedder: Embedder | None = None):
        self.embedder = embedder or HashEmbedder()

    def score(self, query: str, documents: Sequence[str]) -> np.ndarray:
        asked = set(words(query))
        shared = np.asarray([len(asked & set(words(d))) / max(1, len(asked)) for d in documents])
        return shared + self.embedder.embed(list(documents)) @ self.embedder.embed([query])[0]


class _Lazy:
    """A model of an optional library, loaded once in each worker that uses it."""

    library, maker = "", ""

    def __init__(self, name: str, **options):
        self.name, self.options, self._model = name, options, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def model(self):
        if self._model is None:
            try:
                module = importlib.import_module(self.library)
            except ImportError as e:
                raise RuntimeError(f"{type(self).__name__} needs the library {self.library!r} on the driver and every executor") from e
            self._model = getattr(module, self.maker)(self.name, **self.options)
        return self._model


class FastEmbedder(_Lazy):
    """Text embeddings of the library ``fastembed`` by model name."""

    library, maker = "fastembed", "TextEmbedding"

    def __init__(self, name: str = "BAAI/bge-small-en-v1.5", dim: int = 384, **options):
        super().__init__(name, **options)
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return unit_rows(np.stack(list(self.model().embed(list(texts)))).astype(float))


class CrossEncoderScorer(_Lazy):
    """Pair scores of a cross-encoder of the library ``sentence_transformers`` by model name."""

    library, maker = "sentence_transformers", "CrossEncoder"

    def __init__(self, name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2", **options):
        super().__init__(name, **options)

    def score(self, query: str, documents: Sequence[str]) -> np.ndarray:
        return np.asarray(self.model().predict([(query, d) for d in documents]), float)
