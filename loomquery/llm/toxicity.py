"""Toxicity: noisy-channel restoration of obfuscated words, then a lexical score of the restored text.

A token that may be obfuscated becomes a lattice: each symbol offers the
letters it may stand for (leetspeak), a repeated one may be dropped
(repetition), a mark may be nothing or the end of a word, and letters set
apart are read as one run (spacing).  Viterbi decoding under a character
language model picks one reading: the model is a character trigram of all
words of the corpus, mixed with the frequencies of the words that speak for
the label, kept as a trie.  The words of the restored text are then scored
with weights learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHED_BYTES, id_remainder, release, slices, worker_cache
from .training import sample, sparse_logistic

#: Labelled rows that lexicon and weights are fitted on at most.
TRAIN_ROWS = 16_384
#: G-squared a word needs, and documents of the sample it must occur in.
MIN_G2, MIN_DOCS = 16.0, 3
#: Symbols of a token or run that are decoded together; a longer one is read in pieces of this length.
SPAN = 4096

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# Letters that a symbol commonly stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "*": ALPHABET,
}
LOG_LEET, LOG_DROP, LOG_CUT = math.log(0.05), math.log(0.2), math.log(0.2)
#: A mark outside the letters of a token, and a repeat in a run of three or more, cost nothing.
FREE = 0.0

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PAIR = re.compile(r"([^\s_])\1")
_DECOR = re.compile(r"^([\W_])\1+|([\W_])\2+$")
_REPEAT = re.compile(r"(.)\1+")
_NONE = -math.inf


def letters(token: str) -> str:
    """A lower-case token without the marks around it."""
    return _EDGE.sub("", token)


@dataclass
class CharModel:
    """Interpolated trigram model over a-z and the word edge."""

    table: np.ndarray  # [27, 27, 27] log-probabilities; 26 is the edge
    _flat: list[float] | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def counts(words) -> np.ndarray:
        out = np.zeros((27, 27, 27))
        for word in words:
            a = b = 26
            for ch in word:
                c = ord(ch) - 97
                if not 0 <= c < 26:
                    a = b = 26
                    continue
                out[a, b, c] += 1
                a, b = b, c
            out[a, b, 26] += 1
        return out

    @classmethod
    def fit(cls, counts: np.ndarray) -> CharModel:
        uni = counts.sum((0, 1)) + 1
        uni = uni / uni.sum()
        bi = counts.sum(0) + 5 * uni
        bi = bi / bi.sum(1, keepdims=True)
        tri = counts + 5 * bi
        return cls(np.log(tri / tri.sum(2, keepdims=True)))

    def flat(self) -> list[float]:
        """The table as a plain list."""
        if self._flat is None:
            self._flat = self.table.ravel().tolist()
        return self._flat

    def __getstate__(self):
        return {"table": self.table, "_flat": None}

    def logp(self, word: str) -> float:
        a = b = 26
        total = 0.0
        for ch in word:
            c = ord(ch) - 97
            if not 0 <= c < 26:
                return _NONE
            total += self.table[a, b, c]
            a, b = b, c
        return float(total + self.table[a, b, 26])


class Trie:
    """Words by their letters, as arrays over nodes; 0 is the root."""

    def __init__(self, words: dict[str, float]):
        self.step: dict[tuple[int, int], int] = {}
        parent, letter = [0], [26]
        self.word: dict[int, str] = {}
        for w in sorted(words):
            node = 0
            for ch in w:
                key = (node, ord(ch) - 97)
                if key not in self.step:
                    self.step[key] = len(parent)
                    parent.append(node)
                    letter.append(key[1])
                node = self.step[key]
            self.word[node] = w
        self.parent, self.letter = np.asarray(parent), np.asarray(letter)
        self.end = np.full(len(parent), _NONE)
        self.ends = {node: words[w] for node, w in self.word.items()}
        self.end[list(self.ends)] = list(self.ends.values())


_SAME = {ch: {ord(ch) - 97: 0.0} for ch in ALPHABET}
_LETTERS = {ch: {ord(a) - 97: LOG_LEET - (math.log(len(of)) if len(of) > 2 else 0) for a in of} for ch, of in LEET.items()}
_EMPTY: dict[int, float] = {}


@dataclass(slots=True)
class Column:
    """One symbol of a lattice: log cost of each letter, of nothing, and of a word's end here."""

    cost: dict[int, float]
    drop: float = _NONE
    cut: float = _NONE


def lattice(token: str, run: bool = False) -> Iterator[Column]:
    """A column for each symbol of a lower-case token, one by one; ``run``: of letters set apart, in which a word may end anywhere.

    A repeat may be dropped, freely in a run of three or more letters.  A mark
    may be nothing or a word's end, freely before the first and after the last
    letter.  A letter outside a-z has no reading and ends words.
    """
    inner = [i for i, ch in enumerate(token) if ch in ALPHABET]
    first, last = (inner[0], inner[-1]) if inner else (len(token), -1)
    for i, ch in enumerate(token):
        drop = cut = _NONE
        again = i > 0 and token[i - 1] == ch
        if ch in ALPHABET:
            cost = _SAME[ch]
            if again:
                drop = FREE if token[i - 2 : i] == ch * 2 or token[i + 1 : i + 2] == ch else LOG_DROP
        else:
            cost = _LETTERS.get(ch, _EMPTY)
            if not ch.isalnum():
                drop = FREE if not first < i < last else LOG_DROP
                cut = LOG_CUT
            elif not cost:
                cut = FREE
            elif again:
                drop = LOG_DROP
        yield Column(cost, drop, FREE if run and cost else cut)


def may_hold(columns: Iterable[Column], trie: Trie, run: bool, later: bool = True) -> bool:
    """Whether a reading of the lattice has a word of the trie; costs aside.  ``later``: a word may also begin after the first column."""
    live, ends = {0}, trie.word
    for col in columns:
        if run or col.cut > _NONE:
            if any(n in ends for n in live):
                return True
            live.add(0)
        step = {m for n in live for c in col.cost if (m := trie.step.get((n, c)))} if col.cost else set()
        if col.drop > _NONE:
            step |= live
        if run or col.cut > _NONE:
            step.add(0)
        elif not step and not later:
            return False
        live = step
    return any(n in ends for n in live)


#: Lattices of so few readings are decoded state by state, others by arrays; the results are the same.
FEW_LETTERS, FEW_COLUMNS = 3, 64


def decode(columns: list[Column], chars: CharModel, trie: Trie, run: bool = False, known_only: bool = False) -> tuple[list[str], float]:
    """The words of the best reading and its log-probability; each is a word of the trie or spelled by the trigram model.

    ``known_only`` leaves the latter out of the result, not out of the search.
    """
    if len(columns) <= FEW_COLUMNS and all(len(col.cost) <= FEW_LETTERS for col in columns):
        return _decode_few(columns, chars, trie, run, known_only)
    return _decode_many(columns, chars, trie, run, known_only)


def _decode_few(columns: list[Column], chars: CharModel, trie: Trie, run: bool, known_only: bool) -> tuple[list[str], float]:
    """States are -1 where a word may begin, 27 a + b after letters a and b, and 729 + the trie's node; each has its score, words and letters."""
    flat, step, ends, word = chars.flat(), trie.step, trie.ends, trie.word
    states: dict[int, tuple[float, tuple | None, tuple | None]] = {-1: (0.0, None, None)}

    def ended() -> tuple[float, tuple | None]:
        best, found = _NONE, None
        for key, (score, words, spelled) in states.items():
            if key >= 729:
                if (e := ends.get(key - 729)) is not None and score + e >= best:
                    best, found = score + e, (words, key - 729, None)
            elif key >= 0 and score + flat[key * 27 + 26] > best:
                best, found = score + flat[key * 27 + 26], (words, 0, spelled)
        return best, found

    for col in columns:
        if run and col.cost:
            score, link = ended()
            if -1 not in states or score > states[-1][0]:
                if link:
                    states[-1] = (score, link, None)
        out: dict[int, tuple[float, tuple | None, tuple | None]] = {}
        for key, (score, words, spelled) in states.items():
            for c, cost in col.cost.items():
                if key < 729:
                    of = 728 if key < 0 else key
                    new = of % 27 * 27 + c
                    value = score + flat[of * 27 + c] + cost
                    if new not in out or value > out[new][0]:
                        out[new] = (value, words, (c, spelled))
                node = 0 if key < 0 else key - 729 if key >= 729 else -1
                if node >= 0 and (m := step.get((node, c))):
                    value = score + cost
                    if 729 + m not in out or value > out[729 + m][0]:
                        out[729 + m] = (value, words, None)
            if col.drop > _NONE:
                value = score + col.drop
                if key not in out or value > out[key][0]:
                    out[key] = (value, words, spelled)
        if col.cut > _NONE and not (run and col.cost):
            score, link = ended()
            if -1 in states and states[-1][0] >= score:
                score, link = states[-1][0], states[-1][1]
            if (link or -1 in states) and (-1 not in out or score + col.cut > out[-1][0]):
                out[-1] = (score + col.cut, link, None)
        states = out
    score, link = ended()
    if -1 in states and (link is None or states[-1][0] > score):
        score, link = states[-1][0], states[-1][1]
    found = []
    while link:
        link, node, spelled = link
        if node:
            found.append(word[node])
        elif not known_only:
            own = []
            while spelled:
                own.append(ALPHABET[spelled[0]])
                spelled = spelled[1]
            found.append("".join(reversed(own)))
    return found[::-1], score


def _decode_many(columns: list[Column], chars: CharModel, trie: Trie, run: bool, known_only: bool) -> tuple[list[str], float]:
    table = chars.table
    spelled, since = np.full((27, 27), _NONE), np.zeros((27, 27), np.int64)
    known, begun = np.full(len(trie.parent), _NONE), np.zeros(len(trie.parent), np.int64)
    at, before = 0.0, 0  # best score of a word's start here, and the number of words read then
    words: list[tuple[int, int, int, int]] = []  # (words before, start, end, trie node or 0)
    starts: dict[int, int] = {0: 0}  # column -> words read when a word starts there

    def ended(t: int) -> tuple[float, tuple | None]:
        bg = spelled + table[:, :, 26]
        place = np.unravel_index(np.argmax(bg), bg.shape)
        own = known + trie.end
        node = int(np.argmax(own))
        if own[node] >= bg[place] and own[node] > _NONE:
            return float(own[node]), (int(begun[node]), t, node)
        if bg[place] > _NONE:
            return float(bg[place]), (int(since[place]), t, 0)
        return _NONE, None

    for t, col in enumerate(columns):
        if run and col.cost:
            score, word = ended(t)
            if score > at:
                words.append((starts[word[0]], *word))
                at, before = score, len(words)
        starts[t] = before
        next_spelled, next_since = np.full((27, 27), _NONE), np.zeros((27, 27), np.int64)
        if col.cost:
            cs = np.fromiter(col.cost, int)
            costs = np.fromiter(col.cost.values(), float)
            reach = spelled[:, :, None] + table[:, :, cs]
            top = reach.argmax(0)
            next_spelled[:, cs] = np.take_along_axis(reach, top[None], 0)[0] + costs
            next_since[:, cs] = since[top, np.arange(27)[:, None]]
            fresh = at + table[26, 26, cs] + costs
            new = cs[fresh > next_spelled[26, cs]]
            next_spelled[26, cs] = np.maximum(fresh, next_spelled[26, cs])
            next_since[26, new] = t
        next_known, next_begun = np.full(len(known), _NONE), np.zeros(len(known), np.int64)
        if col.cost and len(known) > 1:
            by_letter = np.full(27, _NONE)
            by_letter[list(col.cost)] = list(col.cost.values())
            from_root = trie.parent == 0
            next_known = np.where(from_root, at, known[trie.parent]) + by_letter[trie.letter]
            next_begun = np.where(from_root, t, begun[trie.parent])
        next_at = _NONE
        if col.drop > _NONE:
            stay = spelled + col.drop > next_spelled
            next_spelled[stay], next_since[stay] = spelled[stay] + col.drop, since[stay]
            stay = known + col.drop > next_known
            next_known[stay], next_begun[stay] = known[stay] + col.drop, begun[stay]
            next_at = at + col.drop
        next_before = before
        if col.cut > _NONE and not (run and col.cost):
            score, word = ended(t)
            score = max(score, at) + col.cut
            if score > next_at:
                if word and score - col.cut > at:
                    words.append((starts[word[0]], *word))
                    next_before = len(words)
                next_at = score
        spelled, since, known, begun, at, before = next_spelled, next_since, next_known, next_begun, next_at, next_before
    score, word = ended(len(columns))
    if word and score >= at:
        words.append((starts[word[0]], *word))
        at, before = score, len(words)
    out = []
    while before:
        before, start, end, node = words[before - 1]
        if node or not known_only:
            out.append(trie.word[node] if node else spell(columns[start:end], chars))
    return out[::-1], at


def spell(columns: list[Column], chars: CharModel) -> str:
    """The best spelling of a lattice as one word under the trigram model."""
    table = chars.table
    best = np.full((27, 27), _NONE)
    best[26, 26] = 0.0
    back = np.full((len(columns), 27, 27), 27, np.int8)  # the letter before last, or 27 where the symbol is dropped
    for t, col in enumerate(columns):
        step = np.full((27, 27), _NONE)
        if col.cost:
            cs = np.fromiter(col.cost, int)
            reach = best[:, :, None] + table[:, :, cs]
            top = reach.argmax(0)
            step[:, cs] = np.take_along_axis(reach, top[None], 0)[0] + np.fromiter(col.cost.values(), float)
            back[t][:, cs] = top
        if col.drop > _NONE:
            stay = best + col.drop > step
            step[stay] = best[stay] + col.drop
            back[t][stay] = 27
        best = step
    a, b = np.unravel_index(np.argmax(best + table[:, :, 26]), best.shape)
    out = []
    for t in range(len(columns) - 1, -1, -1):
        if (p := back[t, a, b]) != 27:
            out.append(ALPHABET[b])
            a, b = p, a
    return "".join(reversed(out))


def lone(token: str) -> str:
    """The one character of a token, its outer marks aside, or nothing."""
    core = token if len(token) == 1 else letters(token)
    return core.lower() if len(core) == 1 else ""


@dataclass
class Model:
    """``lexicon`` numbers the words that bear weights; ``weight`` ends with the intercept; ``prior`` is each word's log-frequency."""

    chars: CharModel
    lexicon: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    prior: dict[str, float] = field(default_factory=dict)
    trie: Trie = field(init=False, repr=False)

    def __post_init__(self):
        # A known word is no less likely than its letters, so the trie holds the best way to read it.
        self.trie = Trie({w: max(self.prior.get(w, math.log(1e-5)), self.chars.logp(w)) for w in self.lexicon if w.isascii() and w.isalpha()})
        self.single = {_REPEAT.sub(r"\1", w) for w in self.lexicon}
        self.name = f"toxicity {uuid.uuid4()}"

    def _read(self, token: str, run: bool, lazy: bool) -> list[str] | None:
        """Words of a lower-case token's best reading; with ``lazy`` none where no word of the lexicon is possible."""
        out = []
        for at in range(0, len(token), SPAN):
            part = token[at : at + SPAN]
            if lazy and not may_hold(lattice(part, run), self.trie, run, run or not part.isalnum()):
                continue
            out += decode(list(lattice(part, run)), self.chars, self.trie, run, lazy)[0]
        return out

    def plain(self, token: str) -> str | None:
        """The word of a lower-case token that needs no decoding: letters, marks at the end aside, that are not repeated or not as in another word.

        A run of one symbol at either end is decoration.
        """
        core = token.rstrip(".,;:?")
        if not core.isalpha():
            core = letters(token)
            if core in self.lexicon:
                return core
            core = _DECOR.sub("", token).rstrip(".,;:?")
            if not core.isalpha():
                return None
        if not _PAIR.search(core) or core in self.lexicon or not core.isascii():
            return core
        return None

    def reading(self, token: str, lazy: bool = False) -> list[str]:
        """The words that a white-space token is restored to, lower-case and without marks; with ``lazy`` those of the lexicon at least."""
        low = token.lower()
        core = self.plain(low)
        if core is not None:
            return [core]
        low = _DECOR.sub("", low)
        if lazy and low.isalpha() and _REPEAT.sub(r"\1", low) not in self.single:
            return []  # dropping repeats gives no known word
        return self._read(low, False, lazy)

    def _runs(self, single: dict[int, str]) -> Iterator[tuple[int, int, str]]:
        """Runs of three or more tokens that are single characters (place: character): first token, end, characters."""
        at = list(single)
        first = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] != at[k - 1] + 1:
                if k - first >= 3:
                    yield at[first], at[k - 1] + 1, "".join(single[i] for i in at[first:k])
                first = k

    def _token(self, token: str) -> tuple:
        """Nothing, or the token's one character and the numbers of the lexicon words that it is restored to."""
        found = tuple(i for w in self.reading(token, lazy=True) if (i := self.lexicon.get(w)) is not None)
        char = lone(token) if len(token) < 8 else ""
        return (char, found) if char or found else ()

    def hits(self, text: str | None) -> list[int]:
        """Numbers of the lexicon words of the restored text, sorted."""
        tokens = text.split() if text else []
        cache, older = worker_cache(self.name)
        read = list(map(cache.get, tokens))
        if None in read:
            for k, x in enumerate(read):
                if x is None:
                    t = tokens[k]
                    read[k] = cache.get(t)
                    if read[k] is None:
                        known = older.get(t)
                        read[k] = self._token(t) if known is None else known
                        if len(t) <= CACHED_BYTES:
                            cache[t] = read[k]
        special = [(k, x) for k, x in enumerate(read) if x]
        out = {i for _, x in special for i in x[1]}
        for _, _, run in self._runs({k: x[0] for k, x in special if x[0]}):
            out.update(i for w in self._read(run, True, True) if (i := self.lexicon.get(w)) is not None)
        return sorted(out)

    def score(self, text: str | None) -> float:
        z = self.weight[-1] + sum(self.weight[i] for i in self.hits(text))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))

    def restore(self, text: str | None) -> str:
        """The restored text: every token that was decoded is replaced by its reading, runs of letters set apart by theirs (null: empty)."""
        if not text:
            return ""
        parts = re.split(r"(\s+)", text)
        places = [i for i, p in enumerate(parts) if p and not p.isspace()]
        tokens = [parts[i] for i in places]
        done = set()
        for first, end, run in self._runs({k: c for k, t in enumerate(tokens) if len(t) < 8 and (c := lone(t))}):
            words = self._read(run, True, False)
            if any(w in self.lexicon for w in words):
                parts[places[first]] = " ".join(words)
                for k in range(first + 1, end):
                    parts[places[k]] = parts[places[k] - 1] = ""
                done.update(range(first, end))
        for k, i in enumerate(places):
            if k not in done and self.plain(tokens[k].lower()) is None:
                parts[i] = " ".join(self.reading(tokens[k])) or parts[i]
        return "".join(parts)


def plain_words(text: str | None) -> set[str]:
    """Distinct lower-case words without the marks around them, no decoding."""
    return {w for t in set(text.split()) if (w := letters(t.lower())) and w.isalpha()} if text else set()


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``CharModel.counts`` of the distinct plain words of all documents, labelled or not.

    Words are made distinct by Spark; at most 27^3 sums reach the driver.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # of this task
        for batch in slices(batches, "text"):
            fresh: set[str] = set()
            for text in batch.column("text"):
                if t := text.as_py():
                    fresh.update(t.split())
            words = {w for t in fresh if t not in seen and (w := letters(t.lower())).isascii() and w.isalpha()}
            if len(seen) > CACHE_ENTRIES:
                seen.clear()
            seen.update(t for t in fresh if len(t) <= CACHED_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], ["word"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3)
        for batch in batches:
            total += CharModel.counts(batch.column("word").to_pylist()).ravel()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell].astype(np.int64))], ["cell", "n"])

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(plain, "word string").distinct()
    rows = words.mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**3)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(27, 27, 27)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", hold_out: tuple[int, int] = (5, 0), max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents whose id's crc32 mod ``hold_out[0]`` isn't ``hold_out[1]``.

    The trigram model needs no labels and is counted over all documents.  The
    lexicon holds every word of the sample that speaks for the label
    (``MIN_G2``, ``MIN_DOCS``), however many there are; the bounded sample
    bounds them.  Weights come from a logistic regression on the words of the
    restored texts, fitted in one task.  Without labels or with one class,
    scores are constant.
    """
    chosen = sample(docs, labels, label_col, id_remainder("id", hold_out[0]) != hold_out[1], max_rows)
    chars = CharModel.fit(corpus_trigrams(docs))

    def doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = Counter(), Counter()
        n = [0, 0]
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                n[label > 0] += 1
                count[label > 0].update(plain_words(text.as_py()))
        count[0][""], count[1][""] = n
        words = list(count[0] | count[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([count[1][w] for w in words], pa.int64()), pa.array([count[0][w] for w in words], pa.int64())], ["word", "pos", "neg"]
        )

    counts = chosen.mapInArrow(doc_words, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = counts.where("word = ''").first()
    n1, n0 = (total["pos"], total["neg"]) if total else (0, 0)
    if not n1 or not n0:
        release(chosen)
        p = (n1 + 1) / (n1 + n0 + 2)
        return Model(chars, weight=np.asarray([math.log(p / (1 - p))]))

    def part(count, share):
        return F.when(count > 0, count * F.log(count / (share * (F.col("pos") + F.col("neg"))))).otherwise(0.0)

    rate = n1 / (n1 + n0)
    pos, neg = F.col("pos"), F.col("neg")
    held_words = (
        counts.where((F.col("word") != "") & (pos + neg >= MIN_DOCS) & (pos * n0 > neg * n1))
        .where(2 * (part(pos, rate) + part(neg, 1 - rate)) >= MIN_G2)
        .select("word", (pos + neg).alias("n"))
        .orderBy("word")
        .collect()  # words of the bounded sample
    )
    prior = {r["word"]: math.log(r["n"] / (100.0 * (n1 + n0))) for r in held_words}  # as of texts of a hundred words
    model = Model(chars, {w: i for i, w in enumerate(prior)}, np.zeros(len(prior) + 1), prior)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 27^3 numbers and the lexicon

    def doc_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hits = [held.value.hits(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(hits, pa.list_(pa.int32()))], ["id", "label", "hits"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, int(y > 0), x) for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in ("id", "label", "hits")), strict=True))
        w = sparse_logistic([x for _, _, x in rows], np.asarray([y for _, y, _ in rows], float), len(prior), ridge=0.5)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], ["weight"])

    hits = chosen.mapInArrow(doc_hits, "id long, label int, hits array<int>")
    model.weight = np.asarray(hits.repartition(1).mapInArrow(fitted, "weight array<double>").first()["weight"])
    release(chosen)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity", threshold: float = 0.5) -> DataFrame:
    """Add struct ``out_col`` (``score`` from 0 to 1, ``predicted`` 1 from ``threshold`` on).

    Null and empty texts get the score of a text without any lexicon word.
    Rows are independent; other columns pass through (one named like
    ``out_col`` is replaced).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 27^3 numbers and the lexicon of the bounded sample

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())

    s = F.col("_s")
    packed = docs.drop(out_col).select(F.struct("*").alias("_row"), run(F.col(text_col)).alias("_s"))
    return packed.select("_row.*", F.struct(s.alias("score"), (s >= threshold).cast("int").alias("predicted")).alias(out_col))
