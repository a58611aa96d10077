"""Benchmark decontamination by one Aho-Corasick automaton over the test items' word windows.

The automaton's alphabet is the items' words, so each text is normalised and
scanned once, and a match's offsets are word offsets that map straight back to
characters of the original text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, word_list

WINDOW = 13
#: An automaton holds at most about this many words of windows; more items are dealt to further automata.
MAX_WINDOW_WORDS = 2_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"


class Automaton:
    """Word-level Aho-Corasick automaton of all windows of all items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in word_list(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                own = owners.setdefault(tuple(words[at : at + window]), set())
                if name is not None:
                    own.add(name)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.trie.add_word(key, (len(key), tuple(names)))
        if owners:
            self.trie.make_automaton()
        self.shortest = min(map(len, owners), default=0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word intervals [start, end) inside windows, and the items that own these windows."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        get = self.ids.get
        known = tuple([get(w, 0) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (size, names) in self.trie.iter(known):
            items.update(names)
            spans.append((end + 1 - size, end + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, str | None], ...], window: int) -> Automaton:
    return Automaton(list(items), window)


def _scanner(items, window: int):
    """A vectorised function: text and what earlier automata found -> ``RESULT``."""

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "hits": span, "spans": span}

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array, had_hits: pa.Array, had_items: pa.Array) -> pa.Array:
        automaton = _automaton(items.value, window)
        rows = []
        for text, hits, names in zip(texts, had_hits, had_items, strict=True):
            text, hits, names = text.as_py(), hits.as_py(), names.as_py()
            words = word_list(text)
            spans, found = automaton.scan(words)
            if hits:
                spans = merged(spans + [(h["start"], h["end"]) for h in hits])
            if names:
                found = found | set(names)
            where = []
            if spans:
                at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                where = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]
            rows.append((len(words), sum(b - a for a, b in spans), sorted(found), [{"start": a, "end": b} for a, b in spans], where))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return scan


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out_col: str = "leak",
    window: int = WINDOW,
    share: int = 20,
    max_window_words: int = MAX_WINDOW_WORDS,
) -> DataFrame:
    """Add struct ``out_col`` with the benchmark passages in each text.

    Fields: ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``items`` (ids as sorted strings), ``hits`` (word intervals), ``spans``
    (character intervals of the original text) and ``contaminated``
    (``n_hit > 0`` and ``share * n_hit >= n_words``).

    A window is ``window`` consecutive words of an item; an item of fewer, but
    not none, is one window.  Null or wordless texts and items have no words.
    Repeated items count once by id; an item with a null id marks words but is
    not listed.  An empty benchmark hits nothing, an empty table gives no
    rows, and other columns pass through (one named like ``out_col`` is
    replaced).

    The items are sent to the executors.  Their size is checked first: an
    automaton takes at most ``max_window_words`` words of windows, and where
    there are more, the items are dealt to several automata that scan one
    after the other, each with its own pass.
    """
    spark = docs.sparkSession
    item = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body")).where("body is not null")
    # Fewer than one word for every two bytes, each in at most `window` windows.
    size = item.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    groups = max(1, -(-size * window // (2 * max_window_words)))
    base = docs.drop(out_col)
    names = base.columns
    no_hits = F.lit(None).cast("array<struct<start:int,end:int>>")
    for g in range(groups):
        rows = item.where(F.pmod(F.xxhash64("item", "body"), F.lit(groups)) == g).distinct().collect()
        part = spark.sparkContext.broadcast(tuple(sorted(((r["item"], r["body"]) for r in rows), key=lambda r: (r[0] or "", r[1]))))
        had = (F.col(f"`{out_col}`.hits"), F.col(f"`{out_col}`.items")) if g else (no_hits, F.lit(None).cast("array<string>"))
        found = base.withColumn(out_col, _scanner(part, window)(F.col(text_col), *had))
        base = durable(found, "leaks") if groups > 1 else found
    o = f"`{out_col}`"
    verdict = (F.col(f"{o}.n_hit") > 0) & (F.lit(share) * F.col(f"{o}.n_hit") >= F.col(f"{o}.n_words"))
    return base.select(*[F.col(f"`{c}`") for c in names], F.col(o).withField("contaminated", verdict).alias(out_col))


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text by trying every place; for tests."""
    windows = []
    for name, text in items:
        words = word_list(text)
        windows += [(str(name), words[i : i + window]) for i in range(max(1, len(words) - window + 1) if words else 0)]
    out = []
    for text in texts:
        words = word_list(text)
        hit, names = np.zeros(len(words), bool), set()
        for name, w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit[i : i + len(w)] = True
                    names.add(name)
        out.append((len(words), int(hit.sum()), sorted(names)))
    return out
