"""Language identification by multilingual mixture inference.

A document's character n-grams are drawn from a mixture of languages.
Expectation-maximisation estimates the proportions, and the language set is
chosen by penalised likelihood: a further language stays only if it explains
the n-grams better than its cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_remainder, release, slices
from .training import PARTITIONS, SPACE

#: Hashed n-grams of order 1 to 3.
BITS = 16
#: Training documents of each language at most.
TRAIN_ROWS = 4096
SMOOTH = 0.5
#: Cost of one more language, in times half the logarithm of the number of n-grams.
#: n-grams overlap three times in each order and in three orders, so they count for a ninth as evidence.
PENALTY = 9.0
EM_STEPS = 25
#: Languages at most: each is a table of 2^BITS numbers on the driver and in every worker.
MAX_LANGS = 512

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their counts; empty where it has no letter.

    Letters are lower-cased, every run of other characters is one space, and
    the text begins and ends with one.
    """
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    keep = _letters()[points]
    if not keep.any():
        return none, none
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(keep, points, 0)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + one[2:]
    h = np.concatenate([one[c != 0], two, three])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
    count = np.bincount(h, minlength=1 << BITS)
    found = np.flatnonzero(count)
    return found, count[found]


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # [2^BITS, languages]

    def mixture(self, text: str | None, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chosen languages, their proportions, and the proportions over all languages.

        Sets grow by the proportions over all languages while the penalised
        likelihood rises.  Ties go to the language that sorts first.  Empty
        where the text has no letter or nothing was learned.
        """
        x, n = grams(text)
        if not len(x) or not self.langs:
            return [], np.empty(0), np.zeros(len(self.langs))
        p, total = self.prob[x], n.sum()
        full, _ = _em(p, n, np.full(len(self.langs), 1 / len(self.langs)))
        order = np.argsort(-full, kind="stable")
        cost = penalty * 0.5 * np.log(total)
        singles = n @ np.log(p)
        best = int(np.argmax(singles))
        chosen, share, value = np.asarray([best]), np.ones(1), float(singles[best])
        for k in range(2, len(order) + 1):
            subset = order[:k]
            weights, fit = _em(p[:, subset], n, np.full(k, 1 / k))
            if fit - cost * (k - len(chosen)) <= value:
                break
            chosen, share, value = subset, weights, fit
        rank = np.argsort(-share, kind="stable")
        return [self.langs[i] for i in chosen[rank]], share[rank], full

    def predict(self, text: str | None) -> tuple[str, float]:
        """Main language and the proportion of the n-grams that speak for it among all languages; ``und`` and 0 without letters."""
        langs, _, full = self.mixture(text)
        if not langs:
            return "und", 0.0
        return langs[0], float(min(1.0, full[self.langs.index(langs[0])]))


def _em(p: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns of ``p`` for counts ``n``, and the log-likelihood."""
    total = n.sum()
    for _ in range(EM_STEPS):
        mix = p @ weights
        new = weights * ((n / mix) @ p) / total
        moved = np.abs(new - weights).max()
        weights = new
        if moved < 1e-3:
            break
    return weights, float(n @ np.log(p @ weights))


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", hold_out: tuple[int, int] = (4, 2), max_rows: int = TRAIN_ROWS) -> Model:
    """Count n-grams of at most about ``max_rows`` documents of each language.

    Documents whose id's crc32 mod ``hold_out[0]`` is ``hold_out[1]``, and
    those without a language or text, are left out.  Each language's documents
    are kept by a hash threshold set from its number of documents.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        (id_remainder("id", hold_out[0]) != hold_out[1]) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    found = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Model([], np.empty((1 << BITS, 0)))
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, int(SPACE * min(1.0, max_rows / n))).otherwise(limit)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(SPACE))  # by text too: a hot id must not enter as a whole
    chosen = durable(own.where(draw < limit).repartition(PARTITIONS), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x, n = grams(text)
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))[x] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

    langs = sorted(counts)
    table = np.zeros((1 << BITS, len(langs)))
    # A fixed-size table for each language and each of the sample's few partitions.
    for r in chosen.select("lang", "text").mapInArrow(count, "lang string, counts binary").toLocalIterator():
        table[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    release(chosen)
    return Model(langs, (table + SMOOTH) / (table.sum(0) + SMOOTH * (1 << BITS)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Add struct ``out_col``: ``lang``, ``score``, and the chosen set as ``langs`` and ``shares``.

    Null, empty and letterless texts are ``und`` with score 0.  Rows are
    independent, so repeated ones fare alike and an empty table gives none;
    texts are read whole; other columns pass through (one named like ``out_col`` is
    replaced).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 numbers for each language

    @F.arrow_udf("lang string, score double, langs array<string>, shares array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            langs, shares, full = held.value.mixture(text.as_py())
            if langs:
                rows.append((langs[0], float(min(1.0, full[held.value.langs.index(langs[0])])), langs, shares.tolist()))
            else:
                rows.append(("und", 0.0, [], []))
        kinds = {"lang": pa.string(), "score": pa.float64(), "langs": pa.list_(pa.string()), "shares": pa.list_(pa.float64())}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return docs.drop(out_col).withColumn(out_col, run(F.col(text_col)))
