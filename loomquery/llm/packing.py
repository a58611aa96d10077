"""Best-fit packing of token sequences with certified bin counts.

Texts become token ids, documents longer than a sequence are cut, and the
pieces are packed partition by partition with best-fit decreasing.  Dual
feasible functions give a lower bound of each partition's bin count: a
partition that meets it is certified and left alone.  Those with gaps exchange
the documents of their bins that are not full, and best-fit decreasing runs
again; a partition keeps its new bins only if they are fewer.  When that ends,
the same bound of all pieces together tells whether certified partitions could
still gain from each other (a partition of one length alone is certified
however much room its bins have); if so, the emptiest bins of all partitions
are exchanged in the same way.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_BYTES, chunks, durable, slices, worker_cache

CAPACITY = 2048
#: Pieces packed together: the size of a packing partition.
PARTITION_ROWS = 1 << 16
#: Exchanges go on while each closes this part of the gap to the bound of the whole.
PROGRESS = 0.01

#: Words of each of the two generations whose ids a worker remembers: some 100 MB at most, as a miss costs many times a hit.
CACHE_WORDS = 250_000

_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_UPPER = {c: c + 32 for c in [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]}


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Token ids of whole texts, word by word, equal to encoding the text at once.

    The tokenizer drops white space and never joins across it, so ids are
    remembered by white-space word.  A word of plain letters goes straight to
    the merge model; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = _byte_chars()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _all(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes, cache: dict[bytes, bytes], older: dict[bytes, bytes]) -> bytes:
        found = cache.get(word)
        if found is not None:
            return found
        if (found := older.get(word)) is not None:
            cache[word] = found
            return found
        if len(word) > 1 and word[-1] in b".," and (48 <= word[-2] <= 57 or 97 <= word[-2] <= 122):
            found = self._word(word[:-1], cache, older) + self._word(word[-1:], cache, older)  # a mark after a letter or digit is a piece of its own
        elif word.isalpha():  # a-z stand for themselves
            found = _packed([t.id for t in self.model.tokenize(word.decode())])
        else:
            text = word.decode()
            letters = text.translate(_UPPER)
            if _LETTERS.fullmatch(letters):
                letters = letters.encode().decode("latin-1").translate(self.chars)
                found = _packed([t.id for t in self.model.tokenize(letters)])
            else:
                found = self._all(text)
        if len(word) <= CACHED_BYTES:
            cache[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._all(text)
        words = text.encode("utf-8", "replace").lower().split()
        cache, older = worker_cache("packing " + self.path, CACHE_WORDS)
        found = list(map(cache.get, words))
        if None in found:
            word = self._word
            found = [word(w, cache, older) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


_WORKER: dict[str, WordIds] = {}


def _tokenizer(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and an end id, cut at ``capacity``.

    Null or empty text is the end id alone.  Repeated rows give repeated
    pieces; an empty table gives none.  Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokenizer(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            ids, number, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokens.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc_id)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    For each threshold t: lengths above capacity - t count as a whole bin,
    those below t as nothing, the others as themselves.  For each k: the
    length's share of a bin rounded down in (k + 1)-ths, over k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = np.concatenate([[0], np.cumsum(count * size)])
    number = np.concatenate([[0], np.cumsum(count)])
    t = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 33):
        exact = (size * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity): x where exact, else floor((k + 1) x / capacity) / k
        value = np.where(exact, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, int(-(-(count * value).sum() // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    some, fill = 0, []  # bit r of `some`: a bin with r free
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                some ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free -= n
        if free:
            if not open_bins[free]:
                some |= 1 << free
            open_bins[free].append(b)
    return bins, offsets, np.asarray(fill, np.int64)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, certified boolean, fill long"


def _whole_bins(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by ``sequence_id`` regrouped into tables of about ``rows`` rows that end with a sequence."""
    held: list[pa.Table] = []
    for table in chunks(batches, rows):
        table = pa.concat_tables([*held, table])
        ids = table["sequence_id"].to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        held = [table.slice(cut)]
        if cut:
            yield table.slice(0, cut)
    yield from held


def _pack(batches: Iterator[pa.RecordBatch], turn: int, rows: int, capacity: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, table in enumerate(_whole_bins(batches, rows) if turn else chunks(batches, rows)):
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        sequence, full, used = bins + (((turn << 24 | task) << 16 | k) << 18), fill[bins], len(fill)
        if turn:
            old = table["sequence_id"].to_numpy()
            before = len(np.unique(old))
            if before <= used:  # the exchange did not help here
                sequence, offsets, full, used = old, table["offset"].to_numpy(), table["fill"].to_numpy(), before
        certified = np.full(len(bins), used == lower_bound(lengths, capacity))
        base = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, value in (("sequence_id", sequence), ("offset", offsets), ("certified", certified), ("fill", full)):
            base = base.append_column(name, pa.array(value))
        yield from base.combine_chunks().to_batches()


def _opened(fills: dict[int, int], gap: int, share: int, capacity: int) -> int:
    """The fill up to which bins are opened: their free room is at least ``share`` times what the gap needs."""
    room = 0
    for fill in sorted(f for f in fills if f < capacity):
        room += fills[fill] * (capacity - fill)
        if room >= share * (gap + 1) * capacity:
            return fill
    return capacity - 1


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, progress: float = PROGRESS) -> DataFrame:
    """Give every piece (``doc_id, piece, start, length, ids_crc32``) a ``sequence_id`` and an ``offset``.

    ``certified`` tells that the piece's packing partition, without the full
    bins that it had set aside before, was packed in as few bins as any
    packing of it could be.  Packing partitions are runs of at most
    ``partition_rows`` rows, so a task's memory is bounded whatever the input,
    and hot ids or equal lengths cannot crowd one of them.  Each round is
    written out; only opened bins move, whole bins together.

    Partitions that are not certified exchange first, until all are or a round
    closes less than ``progress`` of the gap to the bound of the whole.  Then
    bins of all partitions are opened, the emptiest first; a round that brings
    nothing is followed by one that opens many more.  It ends when the whole
    meets its bound, or when opening every bin that is not full brings less
    than ``progress`` of the gap.  Ties and repeated rows are separate pieces;
    an empty table gives no rows.
    """
    if partition_rows > 1 << 16:
        raise ValueError("partition_rows is limited to 65536 by the layout of sequence ids")
    out = durable(parts.mapInArrow(lambda it: _pack(it, 0, partition_rows, capacity), PACKED), "packed")
    counts = out.groupBy("length").count().collect()  # at most `capacity` rows
    least = lower_bound(np.repeat([r["length"] for r in counts], [r["count"] for r in counts]).astype(np.int64), capacity)
    apart, share, limit, before = True, 2, 0, None
    for turn in range(1, 32):  # the layout of sequence ids ends here
        # One row of every bin has offset 0; two rows for each fill at most.
        bins = out.where("offset = 0").groupBy("fill", "certified").count().collect()
        total = sum(r["count"] for r in bins)
        stalled = before is not None and before - total <= progress * (before - least)
        if total <= least or stalled and not apart and limit == capacity - 1:
            break
        if apart and (stalled or not any(r["fill"] < capacity and not r["certified"] for r in bins)):
            apart, stalled = False, False
        before = total
        if apart:
            moves = ~F.col("certified") & (F.col("fill") < capacity)
        else:
            share = 8 * share if stalled else share
            fills: dict[int, int] = {}
            for r in bins:
                fills[r["fill"]] = fills.get(r["fill"], 0) + r["count"]
            limit = _opened(fills, total - least, share, capacity)
            moves = F.col("fill") <= limit
        moving = out.where(moves)
        n = max(1, -(-2 * moving.count() // partition_rows))
        # Bins stay whole: a partition holds all pieces of its bins, others every time.
        again = moving.repartition(n, F.xxhash64("sequence_id", F.lit(turn))).sortWithinPartitions("sequence_id")
        packed = durable(again.mapInArrow(lambda it, t=turn: _pack(it, t, partition_rows, capacity), PACKED), f"packed{turn}")
        out = out.where(~moves).unionByName(packed)
    return out.drop("fill")


def bound(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the lower bound of any packing of all pieces together (from their length counts)."""
    counts = packed.groupBy("length").count().collect()  # at most `capacity` rows
    lengths = np.repeat([r["length"] for r in counts], [r["count"] for r in counts]).astype(np.int64)
    return packed.select("sequence_id").distinct().count(), lower_bound(lengths, capacity)
