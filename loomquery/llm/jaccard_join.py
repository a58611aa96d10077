"""Exact n-gram Jaccard join by set-relation skipping.

Index level.  Shingles have one global order (rare first).  Two linked sets
share a shingle within both prefixes, and everything before their first common
shingle differs, so a pair is looked at only where its positions in an index
list leave room for a link.  Lists are read in blocks of set size, whole blocks
and whole lists that lie in one component are skipped.

Answer level.  Similar sets are gathered around a pivot, and each is kept as
its difference from the pivot.  A member's answers follow from the pivot's
incrementally: it links with the pivot if its difference is small enough; with
another member, the distance is that of the two differences.  Two members
whose differences have nothing in common link only if both link with the pivot
(see ``_differences``), so only members that share a difference are looked at,
by an index of the differences with the same position rule.

Only components are asked for, so pairs inside one are never looked at.  In a
few rounds every entry of a list first tries its likeliest partner in another
component; the pairs that are left between components are then all checked.
A list is read as a whole up to ``CHUNK`` entries, else in pairs of chunks, so
no task holds more than two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import CACHED_BYTES, durable, release, slices, trim, worker_cache


class Rule(NamedTuple):
    """Shingles of ``words`` words; two sets link when ``num * union <= den * intersection``."""

    words: int = 4
    num: int = 17
    den: int = 20

    def prefix_length(self, n: int) -> int:
        """Shingles of a set of ``n`` of which any linked set has at least one."""
        return n - -(-self.num * n // self.den) + 1

    def equal_only(self, n: int) -> bool:
        """Whether a set of ``n`` links with equal sets only."""
        return n * (self.den - self.num) < self.num

    def budget(self, a, b):
        """The largest symmetric difference of linked sets of these sizes (columns or arrays of whole numbers)."""
        if isinstance(a, Column):
            return a + b - 2 * F.ceil(F.lit(self.num) * (a + b) / F.lit(self.num + self.den))
        return a + b + 2 * (-self.num * (a + b) // (self.num + self.den))


#: The shingles and similarity of pipelines, where no contract says otherwise.
DEFAULT = Rule(5, 4, 5)
#: Share of the hash space whose shingles are counted and may come first in the order.
COUNTED = 0.30
#: Longest index list that is held to be counted; a longer one counts as this long.
LIST_ROWS = 1 << 20
#: Times that pivots are gathered around others.
PIVOT_ROUNDS = 2
#: Rounds of likely links at most, before all pairs that are left.
TRIAL_ROUNDS = 2
#: Entries of a list that are held at once; pairs of longer lists' parts are dealt out.
CHUNK = 1024
#: Bits of a set's sketch.
SKETCH = 512

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs of characters other than ASCII white space, A-Z
    lower-cased.  Fewer than ``words`` words make one shingle of them all; no
    words, none.
    """
    tokens = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    known, _ = worker_cache("jaccard_join")  # a hash is as quick as a second look
    found = list(map(known.get, tokens))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                found[i] = xxh3_64_intdigest(tokens[i])
                if len(tokens[i]) <= CACHED_BYTES:
                    known[tokens[i]] = found[i]
    h = np.asarray(found, np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _A + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set; equal sets have equal names."""
    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """For each of ``SKETCH`` buckets, whether an odd number of hashes falls in it.

    Two sketches differ in no more bits than their sets have different hashes.
    """
    return np.packbits(np.bincount((hashes >> np.uint64(17)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1).tobytes()


def _emitted(hashes: np.ndarray, counted: int, rule: Rule) -> tuple[int, int]:
    """How many smallest hashes are counted ones, and how many are indexed."""
    n_counted = int(np.searchsorted(hashes, np.uint64(counted)))
    return n_counted, max(n_counted, rule.prefix_length(len(hashes)))


def _members(docs: DataFrame, id_col: str, text_col: str, rule: Rule, counted: int) -> DataFrame:
    """``doc_id, sig, key, n, n_counted, tokens`` of every row.

    sig is a hash of the text, key is null for an empty set.  tokens are the
    indexed shingles; null for sets that only equal sets can link with, and
    for a set met before in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            key, n, c, tokens = [], [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), rule.words)
                own = set_key(h) if len(h) else None
                first, every = _emitted(h, counted, rule)
                key.append(own)
                n.append(len(h))
                c.append(first)
                tokens.append(None if rule.equal_only(len(h)) or own in seen else h[:every].view(np.int64))
                seen.add(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                ["doc_id", "sig", "key", "n", "n_counted", "tokens"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, sig long, key long, n int, n_counted int, tokens array<long>")


def _postings(members: DataFrame) -> DataFrame:
    """``token, key, late``: the indexed shingles of every set; ``late`` is the position of one that isn't counted, else -1."""
    rows = members.where("tokens is not null").select("key", "n_counted", F.posexplode("tokens").alias("at", "token"))
    return rows.select("token", "key", F.when(F.col("at") >= F.col("n_counted"), F.col("at")).otherwise(-1).alias("late"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, key) -> distinct rows of tokens in two sets or more, with the list's length.

    At most ``LIST_ROWS`` rows are held; a longer list is passed on as it comes.
    """
    names = ["token", "key", "late", "df"]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the list that may go on
    n, long, last = 0, False, None

    def out(token, key, late, df):
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.array(late), pa.array(np.minimum(df, LIST_ROWS).astype(np.int32))], names)

    def flush():
        if held and not long and n > 1:
            t, k, p = (np.concatenate(x) for x in zip(*held, strict=True))
            yield out(t, k, p, np.full(len(t), n))

    for batch in batches:
        t, k, p = (batch.column(c).to_numpy() for c in ("token", "key", "late"))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        if last is not None:
            new[0] = (t[0], k[0]) != last
        last = (t[-1], k[-1])
        t, k, p = t[new], k[new], p[new]
        if not len(t):
            continue
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        ends = np.concatenate([starts[1:], [len(t)]])
        first = 0
        if held and held[-1][0][0] == t[0]:
            first = 1
            part = (t[: ends[0]], k[: ends[0]], p[: ends[0]])
            n += int(ends[0])
            if long:
                yield out(*part, np.full(int(ends[0]), LIST_ROWS))
            else:
                held.append(part)
                if n >= LIST_ROWS:
                    yield out(*(np.concatenate(x) for x in zip(*held, strict=True)), np.full(n, LIST_ROWS))
                    long, held = True, held[-1:]
        if first < len(starts):
            yield from flush()
            size = np.repeat(ends - starts, ends - starts)
            whole = np.zeros(len(t), bool)
            whole[starts[first] : starts[-1]] = True
            whole &= size > 1
            if whole.any():
                yield out(t[whole], k[whole], p[whole], size[whole])
            held, n, long = [(t[starts[-1] :], k[starts[-1] :], p[starts[-1] :])], int(ends[-1] - starts[-1]), False
    yield from flush()


def _index(members: DataFrame, rule: Rule) -> DataFrame:
    """``token, key, n, pos``: every set's prefix shingles that another set has indexed too.

    Order: counted shingles by (list length, hash), then the others by hash.
    Shingles in one list only come first and cannot make a pair, so a set with
    a prefix full of them is not in the index at all.
    """
    sets = members.where("key is not null").groupBy("key").agg(F.min("n").alias("n"), F.min("n_counted").alias("n_counted"))
    shared = (
        _postings(members)
        .repartition("token")
        .sortWithinPartitions("token", "key")
        .mapInArrow(_shared, "token long, key long, late int, df int")
    )
    rank = Window.partitionBy("key").orderBy(F.col("late") >= 0, "df", "token")
    total = Window.partitionBy("key")
    in_list = F.when(F.col("late") < 0, 1)
    return (
        shared.join(sets, "key")
        .withColumn("early", F.count(in_list).over(total))
        .withColumn("pos", F.when(F.col("late") >= 0, F.col("late")).otherwise(F.col("n_counted") - F.col("early") + F.row_number().over(rank) - 1))
        .where(f"pos < n - ceil({rule.num} * n / {rule.den}) + 1")
        .select("token", "key", "n", F.col("pos").cast("int").alias("pos"))
    )


def _contents(docs: DataFrame, wanted: DataFrame, members: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """``key, hashes, sketch`` of the wanted keys, shingled anew from the texts of one document each."""
    lowest = -(1 << 63)
    ids = (
        members.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(lowest))).alias("id")).select("id").distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t.as_py(), rule.words) for t in batch.column("text")]
            keys = [set_key(h) if len(h) else None for h in sets]
            hashes = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), hashes, pa.array([sketch(h) for h in sets], pa.binary())], ["key", "hashes", "sketch"])

    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.col(text_col).alias("text"))
    found = own.join(ids, "id", "left_semi").select("text").mapInArrow(run, "key long, hashes array<long>, sketch binary")
    return found.where("key is not null").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _distances(pairs: DataFrame, contents: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (key_a, key_b) with ``linked``, and ``alike`` if half of the union is common."""
    a = contents.select(F.col("key").alias("key_a"), F.col("hashes").alias("hashes_a"))
    b = contents.select(F.col("key").alias("key_b"), F.col("hashes").alias("hashes_b"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    sizes = F.size("hashes_a") + F.size("hashes_b")
    return (
        pairs.join(a, "key_a").join(b, "key_b")
        .withColumn("common", both)
        .withColumn("linked", F.lit(rule.den) * F.col("common") >= F.lit(rule.num) * (sizes - F.col("common")))
        .withColumn("alike", 2 * F.col("common") >= sizes - F.col("common"))
        .drop("hashes_a", "hashes_b", "common")
    )


def _size_block(n: str, rule: Rule) -> Column:
    """Block of set sizes; blocks are wider than den / num, so linked sets are in the same block or in neighbours."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(rule.den / rule.num + 0.03))).cast("int")


def _clusters(index: DataFrame, contents: DataFrame, rule: Rule) -> DataFrame:
    """``key, n, centre, n_centre, dist, delta, sketch``: every set's pivot and its difference from it.

    In each round the pivot of an index list's size block is one of the
    centres there; every other centre tries the pivot that it shares most
    lists with, and is gathered there if a half of their union is common.  A
    set that the last pivot of its chain is too far from is its own.
    """
    keys = index.select("key", "n").distinct()
    at = durable(keys.withColumn("centre", F.col("key")), "clusters")
    entries = index.withColumn("block", _size_block("n", rule))
    for turn in range(PIVOT_ROUNDS):
        own = entries.join(at.where("key = centre").select("key"), "key", "left_semi").withColumn("draw", F.xxhash64("key", F.lit(turn)))
        pivots = own.groupBy("token", "block").agg(F.min(F.struct("draw", "key")).alias("p")).select("token", "block", F.col("p.draw").alias("low"), F.col("p.key").alias("pivot"))
        tries = (
            own.join(pivots, ["token", "block"])
            .where("low < draw")
            .groupBy("key", "pivot")
            .agg(F.count(F.lit(1)).alias("shared"))
            .groupBy("key")
            .agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"))
        )
        near = _distances(tries.select(F.col("key").alias("key_a"), F.col("pivot").alias("key_b")), contents, rule).where("alike")
        # A pivot may be gathered itself in the same round: follow the chains to their ends (draws fall along them).
        step = durable(near.select(F.col("key_a").alias("centre"), F.col("key_b").alias("up")), "chains")
        while True:
            above = step.select(F.col("centre").alias("up"), F.col("up").alias("up2"))
            longer = durable(step.join(above, "up", "left").select("centre", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "chains")
            release(step)
            step = longer
            if longer.where("moved").isEmpty():
                break
        moved = durable(at.join(step.drop("moved"), "centre", "left").select("key", "n", F.coalesce("up", "centre").alias("centre")), "clusters")
        release(at)
        release(step)
        at = moved
    own = contents.select("key", "hashes", "sketch")
    pivot = contents.select(F.col("key").alias("centre"), F.col("hashes").alias("pivot"))
    both = at.join(own, "key").join(pivot, "centre").withColumn("delta", F.concat(F.array_except("hashes", "pivot"), F.array_except("pivot", "hashes")))
    far = 3 * F.size("delta") > F.col("n") + F.size("pivot")
    return durable(
        both.select(
            "key", "n", F.when(far, F.col("key")).otherwise(F.col("centre")).alias("centre"), F.when(far, F.col("n")).otherwise(F.size("pivot")).alias("n_centre"),
            F.when(far, 0).otherwise(F.size("delta")).alias("dist"), F.when(far, F.array().cast("array<bigint>")).otherwise(F.col("delta")).alias("delta"), "sketch",
        ),
        "clusters",
    )


#: An entry of a list: set, its size, length and position in what is compared, and its cluster (null inside one).
ENTRY = ("list", "key", "n", "size", "pos", "centre")


def _differences(clusters: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """``ENTRY`` rows of the lists of each cluster's differences from its pivot.

    The distance of two members is that of their differences.  If these have
    nothing in common and the members a, b link, then |a| + |b| of the
    differences is at most c times the members' sizes, where c = (den - num) /
    (den + num).  As b is larger than the pivot by its difference at most, |a|
    is at most c times the sizes of a and the pivot: a links with the pivot,
    and so does b.  So only pairs that share a difference are left.  Clusters
    inside one component have no lists.
    """
    own = clusters.where("dist > 0").join(labels.select(F.col("node").alias("key"), "root"), "key")
    split = own.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("centre")
    rows = own.join(split, "centre", "left_semi").select("centre", "key", "n", "dist", F.explode("delta").alias("token"))
    frequent = rows.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rank = Window.partitionBy("key").orderBy("df", "token")
    every = Window.partitionBy("key")
    return (
        rows.join(frequent, ["centre", "token"])
        .withColumn("pos", (F.col("dist") - F.count(F.lit(1)).over(every) + F.row_number().over(rank) - 1).cast("int"))
        .where(F.col("pos") <= F.lit(rule.den - rule.num) * F.col("n") / F.lit(rule.num))  # no budget of this set is larger
        .select(F.xxhash64("centre", "token").alias("list"), "key", "n", F.col("dist").alias("size"), "pos", F.lit(None).cast("long").alias("centre"))
    )


def _open_lists(entries: DataFrame, labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Entries with their component ``root``, ``df`` and ``sketch``, without the lists inside one component or one cluster: these are skipped whole."""
    own = entries.join(labels.select(F.col("node").alias("key"), "root"), "key")
    ends = own.groupBy("list").agg(
        F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("centre").alias("low"), F.max("centre").alias("high")
    )
    left = own.join(ends.where("lo <> hi and (low is null or low <> high)").select("list", "df"), "list")
    return left.join(clusters.select("key", "sketch"), "key")


def _units(entries: DataFrame, rule: Rule) -> DataFrame:
    """Entries dealt to ``unit``s that are compared at once: a short list, or two chunks (``side`` 0 and 1) of a long one.

    Chunks are parts of one size block and one position block.  Two of them
    are paired only if their sizes, least positions, components and clusters
    leave room for a link.
    """
    cols = [*ENTRY[1:], "root", "sketch"]
    short = entries.where(f"df <= {CHUNK}").select(F.col("list").alias("unit"), F.lit(0).cast("byte").alias("side"), *cols)
    if entries.where(f"df > {CHUNK}").isEmpty():
        return short
    most = F.lit(rule.den - rule.num) * F.col("n") / F.lit(rule.num)
    long = entries.where(f"df > {CHUNK}").withColumn("block", _size_block("n", rule)).withColumn("step", F.floor(F.lit(8) * F.col("pos") / (most + 1)).cast("int"))
    parts = long.groupBy("list", "block", "step").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("long").alias("parts"))
    long = long.join(parts, ["list", "block", "step"]).withColumn("chunk", F.xxhash64("block", "step", F.pmod(F.xxhash64("key", "list"), "parts")))
    heads = long.groupBy("list", "block", "chunk").agg(
        F.min("pos").alias("pos"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("centre").alias("low"), F.max("centre").alias("high")
    )
    a = heads.select("list", *[F.col(c).alias(f"{c}_a") for c in heads.columns[1:]])
    b = heads.select("list", *[F.col(c).alias(f"{c}_b") for c in heads.columns[1:]])
    pairs = (
        a.join(b, "list")
        .where("abs(block_a - block_b) <= 1 and chunk_a <= chunk_b")
        .where(f"{rule.den} * most_a >= {rule.num} * least_b and {rule.den} * most_b >= {rule.num} * least_a")
        .where(F.col("pos_a") + F.col("pos_b") <= F.lit(rule.den - rule.num) * (F.col("most_a") + F.col("most_b")) / F.lit(rule.num + rule.den))
        .where("least(lo_a, lo_b) <> greatest(hi_a, hi_b) and (low_a is null or least(low_a, low_b) <> greatest(high_a, high_b))")
        .select("list", "chunk_a", "chunk_b", F.xxhash64("list", "chunk_a", "chunk_b").alias("unit"))
    )
    first = long.join(pairs.withColumnRenamed("chunk_a", "chunk"), ["list", "chunk"]).select("unit", F.lit(0).cast("byte").alias("side"), *cols)
    second = long.join(pairs.where("chunk_a <> chunk_b").withColumnRenamed("chunk_b", "chunk"), ["list", "chunk"]).select("unit", F.lit(1).cast("byte").alias("side"), *cols)
    return short.unionByName(first).unionByName(second)


def _compared(own: dict[str, np.ndarray], likely: bool, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of one unit that may link, and the bits in which their sketches differ.

    The elements before the first common one differ, and so do those after it
    that the longer remainder has in excess.  ``likely``: only the nearest
    partner of each entry.
    """
    a = np.flatnonzero(own["side"] == 0)
    b = np.flatnonzero(own["side"] == 1)
    alone = not len(b)
    b = a if alone else b
    n, pos, rest = own["n"], own["pos"], own["size"] - own["pos"]
    room = rule.budget(n[a][:, None], n[b][None, :])
    ok = pos[a][:, None] + pos[b][None, :] + np.abs(rest[a][:, None] - rest[b][None, :]) <= room
    ok &= own["root"][a][:, None] != own["root"][b][None, :]
    ok &= own["group"][a][:, None] != own["group"][b][None, :]
    if alone:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    near = np.empty(len(x), np.int64)
    bits = own["sketch"]
    for at in range(0, len(x), 1 << 16):
        part = slice(at, at + (1 << 16))
        near[part] = np.bitwise_count(bits[a[x[part]]] ^ bits[b[y[part]]]).sum(1)
    left = near <= room[x, y]
    x, y, near = a[x[left]], b[y[left]], near[left]
    if likely and len(x):
        keep = np.zeros(len(x), bool)
        for end in (x, y):
            order = np.lexsort((near, end))
            keep[order[np.concatenate([[True], end[order][1:] != end[order][:-1]])]] = True
        x, y, near = x[keep], y[keep], near[keep]
    return x, y, near


def _candidates(entries: DataFrame, likely: bool, rule: Rule) -> DataFrame:
    """``key_a, key_b, near``: pairs of different components that a list, their sizes, positions and sketches allow; some more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the unit that may go on

        def opened(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            whole = {c: table[c].to_numpy() for c in ("unit", "side", "key", "n", "size", "pos", "root")}
            centre = table["centre"]
            # Inside a cluster, each set is a group of its own.
            whole["group"] = np.where(centre.is_null().to_numpy(), whole["key"], centre.fill_null(0).to_numpy())
            whole["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            unit = whole.pop("unit")
            edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            out = []
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if end - at > 1:
                    x, y, near = _compared({c: v[at:end] for c, v in whole.items()}, likely, rule)
                    if len(x):
                        key = whole["key"][at:end]
                        out.append((np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), near))
            if out:
                arrays = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["key_a", "key_b", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if cut:
                yield from opened([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from opened(held)
        held = []
        trim()

    dealt = _units(entries, rule).repartition("unit").sortWithinPartitions("unit")
    found = dealt.mapInArrow(run, "key_a long, key_b long, near long")
    if not likely:
        return found.select("key_a", "key_b").distinct()
    # The nearest partner of every set, over all lists.
    ends = found.select(F.explode(F.array("key_a", "key_b")).alias("key"), F.struct("near", "key_a", "key_b").alias("p"))
    return ends.groupBy("key").agg(F.min("p").alias("p")).select("p.key_a", "p.key_b").distinct()


def _checked(pairs: DataFrame, clusters: DataFrame, contents: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: the linked ones of ``pairs``; inside a cluster by the two differences from the pivot, else by the sets."""
    own = clusters.select("key", "centre")
    placed = durable(
        pairs.join(own.withColumnsRenamed({"key": "key_a", "centre": "centre_a"}), "key_a").join(own.withColumnsRenamed({"key": "key_b", "centre": "centre_b"}), "key_b"), "pairs"
    )
    delta = clusters.select("key", "n", "delta")
    inside = (
        placed.where("centre_a = centre_b").select("key_a", "key_b")
        .join(delta.withColumnsRenamed({"key": "key_a", "n": "n_a", "delta": "delta_a"}), "key_a")
        .join(delta.withColumnsRenamed({"key": "key_b", "n": "n_b", "delta": "delta_b"}), "key_b")
        .where(F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b")) <= rule.budget(F.col("n_a"), F.col("n_b")))
    )
    across = _distances(placed.where("centre_a <> centre_b").select("key_a", "key_b"), contents, rule).where("linked")
    ends = (F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return inside.select(*ends).unionByName(across.select(*ends))


def _links(index: DataFrame, contents: DataFrame, rule: Rule) -> DataFrame:
    """``node, root``: the components of all indexed sets under links."""
    clusters = _clusters(index, contents, rule)
    labels = durable(clusters.select(F.col("key").alias("node"), F.col("key").alias("root")), "labels")
    direct = clusters.where("key <> centre").where(F.col("dist") <= rule.budget(F.col("n"), F.col("n_centre")))
    labels, _ = merged(labels, direct.select(F.col("key").alias("a"), F.col("centre").alias("b")))
    placed = index.join(clusters.select("key", "centre"), "key").select(F.col("token").alias("list"), "key", "n", F.col("n").alias("size"), "pos", "centre")
    entries = durable(placed.unionByName(_differences(clusters, labels, rule)), "entries")
    for likely in [*[True] * TRIAL_ROUNDS, False]:
        left = durable(_open_lists(entries, labels, clusters), "open")
        release(entries)
        entries = left.select(*ENTRY)  # what is inside one component by now need not be read again
        entries._loomquery_path = left._loomquery_path
        labels, some = merged(labels, _checked(_candidates(left, likely, rule), clusters, contents, rule))
        if likely and not some:
            labels, _ = merged(labels, _checked(_candidates(left, False, rule), clusters, contents, rule))
            break
    release(entries)
    release(clusters)
    return labels


def merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """``labels`` (node, root) after links (a, b) between nodes have joined their roots, and whether any did.

    Links between roots are first thinned to a forest in each partition.
    """
    of = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    to = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    pairs = links.join(of, "a").join(to, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    edges = durable(pairs.mapInArrow(_forest, "a long, b long"), "edges")
    if edges.isEmpty():
        release(edges)
        return labels, False
    tops = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    lower = edges.select(F.col("a").alias("node")).distinct()
    if not tops.select("node").unionByName(lower).groupBy("node").count().where("count > 1").isEmpty():
        nodes = lower.unionByName(tops.select("node")).distinct()
        tops = components(nodes, edges)  # trees of several partitions meet
    joined = labels.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    out = durable(joined.select("node", F.coalesce("top", "root").alias("root")), "labels")
    for old in (edges, tops, labels):
        release(old)
    return out, True


#: Links that a task thins at once.
FOREST = 1 << 17


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) -> for every node that has a smaller one in its tree, the link with the smallest; ``FOREST`` links at a time."""
    up: dict[int, int] = {}
    seen = 0

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def out() -> pa.RecordBatch:
        ends = [(top(x), x) for x in list(up)]
        ends = [(a, b) for a, b in ends if a != b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], pa.int64()), pa.array([b for _, b in ends], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= FOREST:
            yield out()
            up.clear()
            seen = 0
    if up:
        yield out()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root``: connected components of ``links`` (a, b) over ``nodes`` (node), by label falling and pointer jumping.

    Each round is written out; only whether there was a change reaches the driver.
    """
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = durable(nodes.select("node", F.col("node").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(around, "node", "left").select("node", F.least("root", "low").alias("up"), "root")
        # Also lower the label of the old root, so that whole trees move at once.
        hooks = lower.where("up < root").groupBy(F.col("root").alias("node")).agg(F.min("up").alias("hook"))
        hooked = durable(
            lower.join(hooks, "node", "left").select("node", F.least("up", "hook").alias("up"), "root"), "hooks"
        )
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = durable(hooked.join(jump, "up").select("node", F.col("top").alias("next"), "root"), "labels")
        release(hooked)
        release(labels)
        changed = not after.where("next <> root").isEmpty()
        labels = after.select("node", F.col("next").alias("root"))
        labels._loomquery_path = after._loomquery_path
        if not changed:
            release(both)
            return labels


def _roots(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``_members`` of the table, and ``node, root`` of the indexed sets; any other set is a component by itself."""
    counted = int(COUNTED * 2**64)
    members = durable(_members(docs, id_col, text_col, rule, counted), "members")
    index = durable(_index(members, rule), "index")
    active = index.select("key").distinct()
    contents = durable(_contents(docs, active, members, id_col, text_col, rule), "sets")
    labels = _links(index, contents, rule)
    release(index)
    release(contents)
    return members, labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Documents link by ``rule``; ``component_id`` is the smallest id reachable
    by links.  Documents with equal sets are one set from the start.

    Null, empty or wordless text: no shingles, linked with nothing, its own
    component.  Null ids are kept and never name a component unless all ids in
    it are null.  Repeated rows fall into one component.  An empty table gives
    no rows; other columns are ignored.

    Sets and shingles are named by 64-bit hashes, so unequal ones coincide
    with a chance of about n^2 / 2^65.
    """
    members, roots = _roots(docs, id_col, text_col, rule)
    named = members.where("key is not null")
    lowest = named.groupBy("key").agg(F.min("doc_id").alias("low"))
    by_set = roots.select(F.col("node").alias("key"), "root").join(lowest, "key")
    by_root = by_set.groupBy("root").agg(F.min("low").alias("root_low"))
    linked = by_set.join(by_root, "root").select("key", "root_low")
    named_sets = lowest.join(linked, "key", "left").select("key", F.coalesce("root_low", "low").alias("component_id"))
    return members.join(named_sets, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = DEFAULT) -> DataFrame:
    """One row of each component, the one with the smallest id (null last), then set; rows without words all stay.  Columns are unchanged.

    Rows are told apart by id and text, so those that share an id, or have
    none, fall together only if their texts are linked.
    """
    members, roots = _roots(docs, id_col, text_col, rule)
    named = members.where("key is not null").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "sig")).alias("k")
    keep = named.groupBy(F.coalesce("root", "key").alias("root")).agg(first).select(
        F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.none").alias("_none"), F.col("k.sig").alias("_sig"), F.lit(True).alias("_worded")
    )
    text, own = F.col(text_col), F.col(id_col).cast("long")
    worded = F.coalesce(text.rlike(r"[^ \t\n\r\x0B\f]"), F.lit(False))
    packed = docs.select(
        F.struct("*").alias("_row"), F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_none"), worded.alias("_worded"),
        F.when(worded, F.xxhash64(text)).otherwise(F.monotonically_increasing_id()).alias("_sig"),
    )
    row = ["_id", "_none", "_sig", "_worded"]
    # Rows of one id and text are one document; Spark limits them before the shuffle.
    single = packed.withColumn("_k", F.row_number().over(Window.partitionBy(*row).orderBy("_sig"))).where("_k = 1")
    return single.join(keep.withColumn("_kept", F.lit(True)), row, "left").where("_kept or not _worded").select("_row.*")
