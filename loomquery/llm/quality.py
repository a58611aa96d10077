"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by their class log-count ratios, and a linear
hinge-loss model is fitted on them by dual coordinate descent; a logistic curve
turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from .common import CACHED_BYTES, id_remainder, release, slices, worker_cache
from .training import logistic, sample

#: Hashed features.
BITS = 18
#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 8192

_RUNS = re.compile(r"([A-Z]+)|([^\W\d_A-Z]+)|(\d+)|(.)\4*", re.S)


def shape(token: str) -> str:
    """The token's outline: runs of capitals, other letters and digits become A, a and 0; other runs keep one character."""
    return "".join("A" if a else "a" if b else "0" if c else d for a, b, c, d in _RUNS.findall(token))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - BITS)


def _hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape hashes of tokens; the worker remembers those of short ones."""
    cache, older = worker_cache("quality")
    found = list(map(cache.get, tokens))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                t = tokens[i]
                found[i] = older.get(t) or xxh3_64_digest(t.lower()) + xxh3_64_digest(shape(t), 1)
                if len(t) <= CACHED_BYTES:
                    cache[t] = found[i]
    both = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a whole text: words of order 1 and 2, token shapes of order 1 to 3.

    A token equal to the one before it has a shape of its own.  Null, empty or
    blank text has no features.
    """
    tokens = text.split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    w, s = _hashes(tokens)
    s[1:][w[1:] == w[:-1]] ^= np.uint64(0x5851F42D4C957F2D)
    a, b = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
    grams = [w, w[:-1] * a + w[1:], s, s[:-1] * a + s[1:] * b, s[:-2] * a + s[1:-1] * b + s[2:]]
    found = _mix(np.concatenate(grams))
    if len(found) < 1 << (BITS - 4):
        return np.unique(found).astype(np.int64)
    out = np.zeros(1 << BITS, bool)
    out[found] = True
    return np.flatnonzero(out)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the class-conditional frequencies' ratio of each indicator; 0 where a feature never occurs."""
    count = np.full((2, 1 << BITS), 0.0)
    for x, label in zip(rows, y, strict=True):
        count[label, x] += 1
    p, q = count[1] + smooth, count[0] + smooth
    out = np.log(p / p.sum()) - np.log(q / q.sum())
    out[(count[0] + count[1]) == 0] = 0
    return out


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L1-loss linear support vector machine.

    A row holds the features that it has; their values are ``scale``'s, made
    to unit length.  ``y`` is +1 or -1, ``cost`` each row's upper bound.
    """
    w = np.zeros(len(scale))
    alpha = np.zeros(len(rows))
    size = np.asarray([unit_length(scale[x]) for x in rows])
    some = np.asarray([bool(scale[x].any()) for x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if not some[i]:
                continue
            x = rows[i]
            v = scale[x] / size[i]
            g = y[i] * (w[x] @ v) - 1
            pg = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] >= cost[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / (v @ v), 0), cost[i])
                w[x] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def unit_length(v: np.ndarray) -> float:
    """The length that values are divided by."""
    return max(float(np.sqrt(v @ v)), 1e-12)


@dataclass
class Model:
    """``scale`` is the log-count ratio, ``weight`` the fitted weights; probability = logistic(slope * margin + shift)."""

    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return 0.0
        v = self.scale[x]
        return float(self.weight[x] @ v) / unit_length(v)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0) -> Model:
    """Fit on four fifths of the rows and calibrate on the others.  With a single class, scores are constant."""
    if len(rows) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(rows) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    own = np.flatnonzero(~held)
    scale = log_count_ratio([rows[i] for i in own], y[own])
    share = np.asarray([(y[own] == 0).mean(), (y[own] == 1).mean()])
    cost = c * 0.5 / share[y[own]]
    w = dual_coordinate_descent([rows[i] for i in own], scale, 2 * y[own] - 1, cost)
    check = np.flatnonzero(held) if held.any() else own
    margins = np.asarray([w[rows[i]] @ scale[rows[i]] / unit_length(scale[rows[i]]) if len(rows[i]) else 0.0 for i in check])
    slope, shift = logistic(margins[:, None], y[check], ridge=1e-3)
    return Model(scale.astype(np.float32), w.astype(np.float32), float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", hold_out: tuple[int, int] = (5, 0), max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents whose id's crc32 mod ``hold_out[0]`` isn't ``hold_out[1]``."""
    allowed = id_remainder("id", hold_out[0]) != hold_out[1]
    chosen = sample(docs, labels, label_col, allowed, max_rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in slices(batches, "text"):
            for i, label, text in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "text")), strict=True):
                x = features(text)
                found.append((i, int(label > 0), x.astype(np.int32).tobytes()))
        found.sort()
        m = fit([np.frombuffer(x, np.int32) for _, _, x in found], np.asarray([y for _, y, _ in found], int))
        yield pa.RecordBatch.from_pydict({"scale": [m.scale.tobytes()], "weight": [m.weight.tobytes()], "slope": [m.slope], "shift": [m.shift]})

    # The sample is bounded, so one task fits the model, and the driver gets no more than its two arrays.
    got = chosen.coalesce(1).mapInArrow(fitted, "scale binary, weight binary, slope double, shift double").collect()
    release(chosen)
    if not got:
        return fit([], np.empty(0, int))
    r = got[0]
    return Model(np.frombuffer(r["scale"], np.float32), np.frombuffer(r["weight"], np.float32), r["slope"], r["shift"])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality_score", threshold: float = 0.3) -> DataFrame:
    """Add struct ``out_col`` (``score`` from 0 to 1, ``predicted`` 1 from ``threshold`` on).

    Texts without features (null, empty, blank) get the model's score at
    margin 0.  Rows are independent; other columns pass through (one named
    like ``out_col`` is replaced).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 arrays of 2^18 numbers, whatever the corpus

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())

    s = F.col("_s")
    packed = docs.drop(out_col).select(F.struct("*").alias("_row"), run(F.col(text_col)).alias("_s"))
    return packed.select("_row.*", F.struct(s.alias("score"), (s >= threshold).cast("int").alias("predicted")).alias(out_col))
