"""Jaccard join, packing, WARC and the trained operators: brute force, round trips and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from loomquery.llm import jaccard_join, language_id, license_rules, packing, quality, queries, toxicity, warc
from loomquery.llm.common import py_id_remainder, word_list

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


# N-gram Jaccard join


def plain_components(rows, words=4, share=85):
    """(set size, smallest id in the component) of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=4, size=12, length=120):
    """Groups of texts that drift apart by a few words, around the threshold, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: rng.randrange(len(own) - 15, len(own))]
            if rng.random() < 0.3:
                base = own
            out.append(" ".join(own))
    for _ in range(10):
        own = [word() for _ in range(40)]
        out.append(" ".join(own[:20] + passage + own[20:]))
    rng.shuffle(out)
    return out


def test_join_equals_comparing_all_pairs(spark):
    texts = near_copies(1) + near_copies(2) + [None, "", " \t", "one", "One", "one two", "ONE two\nthree four", "one two three four", "a b c d e a b c d e a b c d"]
    rows = [(3 * i + 5, t) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("clash"), "n": F.lit(1)})
    got = sorted(tuple(r) for r in jaccard_join.join(docs).collect())
    want = plain_components(rows)
    assert len({c for _, _, c in want}) < len(want) - 10
    assert got == want


def test_join_by_another_rule(spark):
    rows = list(enumerate(near_copies(11) + ["a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j k"]))
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS), rule=jaccard_join.Rule(5, 4, 5)).collect())
    assert got == plain_components(rows, 5, 80)


@pytest.mark.parametrize("chunk", [7, 1024])
def test_join_of_a_hot_group_of_near_copies(spark, monkeypatch, chunk):
    """Hundreds of texts a few words from one base, most of them not linked with it; lists in parts and whole."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, rows = [word() for _ in range(90)], []
    spots = rng.sample(range(90), 8)
    for i in range(260):
        own = list(base)
        for at in rng.sample(spots, rng.choice([1, 2, 2, 3, 4])):
            own[at] = f"other{rng.randrange(3)}"
        for _ in range(rng.choice([0, 0, 1])):
            own[rng.randrange(90)] = word()
        rows.append((i, " ".join(own)))
    far = list(base)
    far[5:45] = [word() for _ in range(40)]
    rows += [(1000, " ".join(base)), (1001, " ".join(far)), (1002, " ".join(far[:-1]))]
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect())
    want = plain_components(rows)
    assert 5 < len({c for _, _, c in want}) < len(rows) - 50
    assert got == want


def test_join_of_a_very_long_text(spark):
    rng = random.Random(13)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = [*long[:30_000], *(f"x{i}" for i in range(1500)), *long[31_500:]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:40_000])), (4, "y" * 300_000), (5, "y" * 300_000 + " z")]
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == plain_components(rows) and got[1][2] == 1


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1)))
def test_sketches_differ_no_more_than_their_sets(common, a, b):
    x, y = (np.frombuffer(jaccard_join.sketch(np.asarray(sorted(common | s), np.uint64)), np.uint64) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len((common | a) ^ (common | b))


def test_merged_labels(spark):
    labels = spark.createDataFrame([(i, i - i % 3) for i in range(30)], "node long, root long")
    links = spark.createDataFrame([(1, 4), (5, 10), (20, 22), (7, 8), (22, 28), (29, 18)], "a long, b long").repartition(4)
    out, some = jaccard_join.merged(labels, links)
    assert some and {r["node"]: r["root"] for r in out.collect()} == {i: 0 if i < 6 or 9 <= i < 12 else 18 if 18 <= i < 24 or i >= 27 else i - i % 3 for i in range(30)}
    assert not jaccard_join.merged(out, links)[1]


def test_join_of_little(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c d e"), (4, "a b c d e"), (None, None)], DOCS)
    got = sorted((tuple(r) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 2, 4), (4, 2, 4), (None, 0, None)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_star_distances_never_lose_a_link(spark):
    """A drifting chain: each text links with the next only."""
    rng = random.Random(5)
    text = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(150)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(text)))
        text[(i * 6) % 150] = f"new{i}"
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == plain_components(rows)


def test_deduplicate_keeps_one_of_each_component(spark):
    rows = [(i, t, "x") for i, t in enumerate(near_copies(3, groups=2) + [None, ""])]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, key string")
    for rule, words, share in ((jaccard_join.DEFAULT, 5, 80), (jaccard_join.Rule(), 4, 85)):
        kept = jaccard_join.deduplicate(docs, rule=rule)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in plain_components([r[:2] for r in rows], words, share)})


def test_deduplicate_tells_rows_of_null_or_equal_id_apart(spark):
    rng = random.Random(8)
    t = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(5)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (1, t[2]), (7, t[3]), (7, t[2]), (7, t[4]), (None, t[4].upper())]
    rows += [(None, None), (None, None), (7, " \t"), (7, " \t"), (7, "\u00a0")]
    kept = jaccard_join.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    want = [(None, t[0]), (None, t[1]), (1, t[2]), (7, t[3]), (7, t[4]), (None, None), (None, None), (7, " \t"), (7, " \t"), (7, "\u00a0")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=0, max_size=6), min_size=1, max_size=8), st.integers(1, 5), st.integers(2, 6))
def test_shared_lists_across_batches(lists, size, limit):
    import pyarrow as pa

    rows = sorted((t, k) for t, keys in enumerate(lists) for k in keys)
    batches = [
        pa.RecordBatch.from_pydict({"token": pa.array([r[0] for r in part], pa.int64()), "key": pa.array([r[1] for r in part], pa.int64()), "late": pa.array([-1] * len(part), pa.int32())})
        for part in (rows[i : i + size] for i in range(0, len(rows), size))
    ]
    old, jaccard_join.LIST_ROWS = jaccard_join.LIST_ROWS, limit
    try:
        got = [tuple(r[c] for c in ("token", "key", "df")) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
    finally:
        jaccard_join.LIST_ROWS = old
    n = Counter(t for t, _ in set(rows))
    assert sorted(got) == sorted((t, k, min(n[t], limit)) for t, k in set(rows) if n[t] > 1)


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 39), (39, 35), (35, 30)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard_join.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 20 else 30 if i in (30, 35, 39) else i for i in range(40)}


# Packing


def first_fit_bins(lengths, cap):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= cap:
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bound_is_below_and_best_fit_above_the_optimum(lengths):
    x = np.asarray(sorted(lengths, reverse=True))
    best = first_fit_bins(x.tolist(), 20)
    bins, offsets, fill = packing.best_fit(x, 20)
    assert packing.lower_bound(x, 20) <= best <= len(fill)
    for b in range(len(fill)):
        at = 0
        for o, n in sorted(zip(offsets[bins == b], x[bins == b])):
            assert o == at
            at += n
        assert at == fill[b] <= 20


def sequences_are_sound(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [
        None, "", " \n", "Hello, World! it's 3.14 don't", "STRASSE straße Été naïve Ünder", "x" * 300, "a.b.c ... !? (c) 2024.", "é.,", "日本語 mixed text。",
        "tab\tnew\x0bline\x1cfs nbsp em", "<|endoftext|> special", "é combining İstanbul ΣΑΣ", "word " * 5000, "##$$%% 1,000.5,", "we'll they've I'd.",
    ]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {}
    for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), DOCS), queries.tokenizer_path()).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in enumerate(texts):
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(got[i]) == want


@pytest.mark.parametrize("rows", [64, 1000])
def test_packing_with_exchange(spark, rows):
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 2049, 900), np.full(300, 1025), np.full(200, 700), [2048, 1]])
    parts = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(parts, partition_rows=rows).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(lengths)))
    used = sequences_are_sound(out, 2048)
    assert used <= packing.lower_bound(lengths) * 1.01 + 2
    assert packing.pack(parts.limit(0)).count() == 0


def test_packing_leaves_certified_partitions_alone(spark):
    """Partitions that meet their bound keep their sequences while the others exchange."""
    rng = np.random.default_rng(4)
    good, bad = np.tile([1500, 548], 32), np.concatenate([rng.integers(600, 1100, 64) for _ in range(6)])
    lengths = np.concatenate([good, bad])
    rows = [(i, 0, 0, int(n), i, "clash", "clash") for i, n in enumerate(lengths)]
    parts = spark.createDataFrame([*rows, rows[0]], "doc_id long, piece int, start long, length long, ids_crc32 long, fill string, bin string").coalesce(1)
    out = packing.pack(parts, partition_rows=64).collect()
    assert sorted(r["doc_id"] for r in out) == sorted([0, *range(len(lengths))])
    assert all(r["sequence_id"] >> 58 == 0 for r in out if r["doc_id"] in range(1, 64)) and all(r["certified"] for r in out if r["doc_id"] in range(1, 64))
    assert any(r["sequence_id"] >> 58 for r in out)
    lengths = np.append(lengths, 1500)
    apart = sum(len(packing.best_fit(lengths[at : at + 64])[2]) for at in range(0, len(lengths), 64))
    assert packing.lower_bound(lengths) <= sequences_are_sound(out, 2048) < apart


# WARC


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "a\r\n\r\nb WARC/1.1", "<p>é</p>", "x" * 300_000, ""]
    urls = ["http://a/\r\nX: 1", None, "http://ü/ x", "u", "u", "u", "u", "u"]
    rows = [(i, urls[i], h) for i, h in enumerate(html)] + [(None, "n", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bytes", F.lit("clash"))
    index = warc.write_archives(pages)
    read = {r["page_id"]: r for r in warc.read_records(index).collect()}
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        r, data = read[i], (h or "").encode()
        assert r["intact"] and r["payload_bytes"] == len(data) and r["payload_digest"] == warc.digest32(data)
        keeper = largest[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == keeper else ("revisit", keeper))
        assert r["payload"] is None if i != keeper else bytes(r["payload"]) == data
    archives = {r["archive"] for r in index.collect()}
    heads = {}
    for name in archives:
        data = open(name.removeprefix("file:"), "rb").read() if name.startswith("file:/") and not name.startswith("file://") else open(name.removeprefix("file://"), "rb").read()
        while data:
            one = zlib.decompressobj(31)
            raw, data = one.decompress(data), one.unused_data
            lines = [x.partition(": ")[::2] for x in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]]
            heads[dict(lines)["WARC-Record-ID"]] = dict(lines)
    assert sum(h["WARC-Type"] == "warcinfo" for h in heads.values()) == len(archives)
    revisits = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert revisits and all(heads[h["WARC-Refers-To"]]["WARC-Type"] == "response" for h in revisits)
    assert read[0]["url"] == "http://a/%0D%0AX:%201" and read[1]["url"] == "urn:page:1"
    twice = spark.createDataFrame([(4, "u", "same"), (4, "u", "same"), (3, "u", "same")], "page_id long, url string, html string")
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, twice).collect())
    assert kinds == [(3, "revisit", 4), (4, "response", None), (4, "response", None)]
    some = warc.read_records(index.where("page_id in (2, 6)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 6]
    loose = warc.read_records(warc.write_archives(pages, min_revisit_bytes=6)).collect()
    assert all(r["record_type"] == "response" for r in loose if r["payload_bytes"] < 6)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_ranges_join_close_records():
    rows = [{"archive": "a", "offset": o, "length": n} for o, n in ((0, 10), (10, 10), (100_000, 10), (100_010, 5))] + [{"archive": "b", "offset": 0, "length": 3}]
    assert [len(x) for x in warc._ranges(rows)] == [2, 2, 1]


# Trained operators


def test_language_mixture(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    text = lambda lang, n: " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(list(alphabets) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb", "cc"]
    langs, shares, _ = model.mixture(text("aa", 60) + " " + text("cc", 30))
    assert langs == ["aa", "cc"] and abs(shares[0] - 2 / 3) < 0.05
    assert model.mixture(text("bb", 40))[0] == ["bb"]
    tied = language_id.Model(["x", "y"], np.full((1 << language_id.BITS, 2), 1e-4))
    assert tied.mixture("abc")[0] == ["x"]
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, text("bb", 3)), (5, "A" * 200_000), (5, "A" * 200_000)], DOCS).withColumn("language", F.lit(0))
    got = {r["doc_id"]: r["language"] for r in language_id.identify(asked, model).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang"] == "bb" and got[5]["lang"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.train(docs.limit(0)).predict("abc") == ("und", 0.0)
    assert language_id.identify(asked.limit(0), model).count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (py_id_remainder(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_log_count_ratio_and_coordinate_descent():
    rows = [np.asarray(x) for x in ([1, 2], [1, 3], [4, 5], [4, 6])]
    y = np.asarray([1, 1, 0, 0])
    r = quality.log_count_ratio(rows, y)
    assert r[1] > r[2] > 0 > r[5] > r[4] and r[7] == 0
    values = [r[x] / np.sqrt(r[x] @ r[x]) for x in rows]
    w = quality.dual_coordinate_descent(rows, r, 2 * y - 1, np.ones(4), epochs=50)
    assert all((w[x] @ v) * s >= 1 - 1e-2 for x, v, s in zip(rows, values, 2 * y - 1))


def labelled(spark, texts, column):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts) if y is not None] + [(None, 1), (5, None), (10_000, 0)], f"doc_id long, {column} int")
    return docs, labels


def test_quality_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(40))
    texts = [(good(), 1) if i % 4 else (bad(), 0) for i in range(300)] + [(None, None), ("", 1), (" ", None)]
    docs, labels = labelled(spark, texts, "quality")
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r["quality_score"] for r in quality.score(docs.withColumn("quality_score", F.lit(1)), model).collect()}
    held = [i for i in range(300) if py_id_remainder(i, 5) == 0]
    assert all(rows[i]["predicted"] == texts[i][1] for i in held)
    assert rows[300] == rows[301] == rows[302] and all(0 <= r["score"] <= 1 for r in rows.values())
    constant = quality.train(docs, labels.where("quality = 1"))
    assert constant.score("x") == constant.score(None) > 0.9
    assert quality.train(docs, labels.limit(0)).score("x") == 0.5
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_restores_obfuscated_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abdehilnorstuw", k=rng.randint(2, 8)))
    rude = ["vilegrub", "mudbrain", "stinkhead"]

    def text(extra=None):
        words = [word() for _ in range(30)]
        if extra:
            words.insert(rng.randrange(30), extra)
        return " ".join(words)

    texts = [(text(rng.choice(rude)), 1) if i % 3 == 0 else (text(), 0) for i in range(400)] + [(None, None), ("", 0)]
    docs, labels = labelled(spark, texts, "toxic")
    model = toxicity.train(docs, labels)
    assert set(rude) <= set(model.lexicon)
    clean = model.score(text())
    assert clean < 0.5 and model.score(None) == model.score("") == model.score("zzz")
    for bad in ("v1l3grub", "VILEGRUB!!", "viiilegrub", "v i l e g r u b", "v.i.l.e.g.r.u.b", "mudbr@in,", "$tinkhead", "st1nkh34d", "mu*brain"):
        assert model.score(text(bad)) > 0.5, bad
    assert model.restore("a mudbr41n b") == "a mudbrain b" and model.restore(None) == ""
    clash = docs.withColumns({"toxicity": F.lit(1), "_row": F.lit("x"), "_s": F.lit(2.0)})
    assert toxicity.score(clash, model).columns == ["doc_id", "text", "_row", "_s", "toxicity"]
    rows = {r["doc_id"]: r["toxicity"] for r in toxicity.score(clash, model).collect()}
    held = [i for i in range(400) if py_id_remainder(i, 5) == 0]
    assert all(rows[i]["predicted"] == texts[i][1] for i in held)
    assert toxicity.train(docs, labels.limit(0)).score("x") == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert model.score("a" * 100_000) == clean


def test_toxicity_reads_marked_spacing_and_doubled_letters():
    rng = random.Random(1)
    words = ["stupid", "idiot", "moron", "plain", "ass"]
    others = ["".join(rng.choice("bcdfghklmnprstw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "s", "t"]) for _ in range(3000)]
    model = toxicity.Model(toxicity.CharModel.fit(toxicity.CharModel.counts([*words, "a", "you", *others])), {w: i for i, w in enumerate(words)}, prior=dict.fromkeys(words, -7.0))
    for text, hit in (
        ("you s t u p i d.", 0), ('a "s t u p i d', 0), ('"s t u p i d!"', 0), ("s. t. u. p. i. d.", 0), ("so stuupid", 0), ("an idiiot!", 1), ("idiott,", 1),
        ("st00pid st1ip", None), ("m o r r o n", 2), ("m00ron", 2), ("mooroon", 2), ("m0rr0n", 2), ("as", None), ("aass", 4), ("plan", None), ("pllaain", 3),
    ):
        assert model.hits(text) == ([] if hit is None else [hit]), text
    assert model.restore("u stuup1d, m o r o n end\n1d10t plan") == "u stupid moron end\nidiot plan"


def test_decoding_equals_trying_every_reading():
    """Short lattices: the decoder's score and words against all spellings and cuts."""
    rng = random.Random(3)
    chars = toxicity.CharModel.fit(toxicity.CharModel.counts(["bad", "dab", "ab", "cab", "abba", "bead"] * 3))
    lexicon = {"bad": -4.0, "dab": -6.0, "abba": -5.0, "a": -3.0}
    trie = toxicity.Trie(lexicon)

    def best(columns, run):
        found = (-np.inf, None)

        def go(i, score, word, words):
            nonlocal found
            def closed():
                if not word:
                    return [(score, words)]
                return [(score + chars.logp(word), [*words, word]), *([(score + lexicon[word], [*words, word])] if word in lexicon else [])]

            if i == len(columns):
                found = max([found, *closed()], key=lambda x: x[0])
                return
            col = columns[i]
            for c, cost in col.cost.items():
                go(i + 1, score + cost, word + "abcdefghijklmnopqrstuvwxyz"[c], words)
                if run and word:
                    for s, w in closed():
                        go(i + 1, s + cost, "abcdefghijklmnopqrstuvwxyz"[c], w)
            if col.drop > -np.inf:
                go(i + 1, score + col.drop, word, words)
            if col.cut > -np.inf and not (run and col.cost):
                for s, w in closed():
                    go(i + 1, s + col.cut, "", w)

        go(0, 0.0, "", [])
        return found

    for k in range(150):
        token, run = "".join(rng.choices("abd4-8!@", k=rng.randint(1, 6))), k % 3 == 0
        columns = list(toxicity.lattice(token, run))
        words, score = toxicity._decode_few(columns, chars, trie, run, False)
        many, same = toxicity._decode_many(columns, chars, trie, run, False)
        assert abs(score - same) < 1e-6 and (words == many or len({score, same}) == 1 or abs(score - same) < 1e-9), token
        want, spelled = best(columns, run)
        assert abs(score - want) < 1e-6, token
        assert words == spelled or abs(score - want) < 1e-6
        if any(w in lexicon for w in words):
            assert toxicity.may_hold(columns, trie, run) and toxicity.may_hold(columns, trie, run, run or not token.isalnum()), token


def test_toxicity_reads_long_tokens_in_linear_time():
    words = {"stupid": 0, "idiot": 1}
    model = toxicity.Model(toxicity.CharModel.fit(toxicity.CharModel.counts(["stupid", "idiot", "other"])), words)
    assert model.hits("a" + "*" * 20_000 + "b") == [] and model.hits("*@" * 5000 + "-id10t") == [1]
    assert model.hits(" ".join("a" * 5000)) == []


def test_toxicity_character_model_covers_all_documents(spark):
    texts = [("plain words here", 0), ("Kilt, kilts! kilt", None), (None, None), ("", None), ("milk silk x1y É wilt.", None)]
    docs, labels = labelled(spark, texts, "toxic")
    want = toxicity.CharModel.counts({"plain", "words", "here", "kilt", "kilts", "milk", "silk", "wilt"})
    assert (toxicity.corpus_trigrams(docs.repartition(3)) == want).all()
    for own in (labels, labels.limit(0)):
        model = toxicity.train(docs, own)
        assert np.allclose(model.chars.table, toxicity.CharModel.fit(want).table)
        assert model.reading("k1lt") == ["kilt"] and model.reading("m1lk") == ["milk"]
    assert not toxicity.corpus_trigrams(docs.limit(0)).any()


# Pipeline


def plain_contaminated(texts, items, window=13):
    """The ids whose texts hold benchmark windows over a twentieth of their words."""
    windows = {}
    for item in items:
        w = word_list(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(len(w[i : i + window]), set()).add(tuple(w[i : i + window]))
    out = set()
    for d, t in texts:
        w = word_list(t)
        hit = {p for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for p in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_pipeline_stages_in_turn(spark):
    """Each stage against a plain version of its rule, over all that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            lexicon = {w: model.weight[i] for w, i in model.lexicon.items()}
            want = set()
            for d, t in before:
                words = {w for part in model.restore(t).lower().split() for w in [toxicity.letters(part), part.strip(".,;:?")]}
                z = model.weight[-1] + sum(lexicon.get(w, 0) for w in words)
                want |= {d} if z < 0 else set()
        elif name == "quality_classifier":
            model = quality.train(docs, labels)
            want = {d for d, t in before if model.score(t) >= 0.3}
        elif name == "ngram_jaccard_join":
            want = {c for _, _, c in plain_components(before, 5, 80)}
        else:
            want = {d for d, _ in before} - plain_contaminated(before, items)
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        assert {r["doc_id"] for r in docs.collect()} == want, name
        assert 0 < len(want) <= len(before), name
    keep = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert all(d == c for d, _, c in keep)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    sequences_are_sound(rows, 2048)
    spark.catalog.clearCache()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, copies, long texts and columns named like anything inside the stages."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abdehilnorstuw", k=rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    texts = [good() if i % 5 else good() + " vilegrub" if i % 2 else " ".join(word().upper() + "!!" for _ in range(40)) for i in range(200)]
    labels = [(i, int("!!" not in t), int("vilegrub" in t)) for i, t in enumerate(texts)]
    leak = good()
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, None), (None, ""), (None, good()), (1, texts[1]), (1, texts[1]), (500, texts[2]), (501, leak), (502, good() + " v1legrub"), (503, " ".join(word() for _ in range(30_000)))]
    names = ["verdict", "Verdict_", "_row", "_s", "_toxicity", "_leak", "_id", "_sig", "key", "score", "a.b"]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text", *[F.concat(F.lit(f"{n} "), F.coalesce(F.substring("text", 1, 9), F.lit("-"))).alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", leak), (None, "nothing of it")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).persist()
        assert left.columns == docs.columns
        kept[name] = [tuple(r) for r in left.collect()]
        assert set(kept[name]) <= {tuple(r) for r in docs.collect()}
    bad = {i for i, _, t in labels if t} | {502}
    assert {r[0] for r in kept["toxicity"]} == {r[0] for r in rows} - bad
    assert not any("!!" in (r[1] or "") for r in kept["quality_classifier"])
    ids = Counter(r[0] for r in kept["ngram_jaccard_join"])
    assert ids[1] == 1 and ids[500] == 0 and ids[2] == 1 and sum(r[0] is None and r[1] not in (None, "") for r in kept["ngram_jaccard_join"]) == 1
    assert {r[0] for r in kept["benchmark_decontamination"]} == set(ids) - {501} and 503 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in kept["benchmark_decontamination"]}
    sequences_are_sound(packed, 2048)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    spark.catalog.clearCache()


def plain_dual(x, y, cost, steps=20_000):
    """Projected gradient ascent on the dual of the hinge-loss problem, all rows at once."""
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(len(y))
    rate = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(steps):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, cost)
    return (alpha * y) @ x


def test_coordinate_descent_equals_a_plain_solver():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, rng.integers(2, 8), replace=False)) for _ in range(25)]
    scale = np.zeros(1 << quality.BITS)
    scale[:30] = rng.standard_normal(30)
    y = np.where(rng.random(25) < 0.4, 1, -1)
    dense = np.zeros((25, 30))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / np.linalg.norm(scale[r])
    cost = rng.uniform(0.3, 1.5, 25)
    w = quality.dual_coordinate_descent(rows, scale, y, cost, epochs=400)
    assert np.abs(w[:30] - plain_dual(dense, y, cost)).max() < 0.02 and not w[30:].any()


def test_sparse_logistic_equals_the_dense_one():
    from loomquery.llm.training import logistic, sparse_logistic

    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(80)]
    x = np.zeros((80, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = (rng.random(80) < 0.3 + 0.4 * x[:, 2]).astype(float)
    assert np.abs(sparse_logistic(rows, y, 12, ridge=0.5) - logistic(x, y, ridge=0.5)).max() < 1e-4


def test_mixture_equals_plain_expectation_maximisation():
    """Proportions by a loop over single n-grams, with the language set chosen among all subsets of the best order."""
    rng = np.random.default_rng(4)
    prob = rng.dirichlet(np.full(1 << language_id.BITS, 0.5), 3).T + 1e-9
    model = language_id.Model(["a", "b", "c"], prob)
    for text in ("some words of a text", "zzz yyy xxx", "a", "Ein Satz und une phrase"):
        x, n = language_id.grams(text)
        w = np.full(3, 1 / 3)
        for _ in range(language_id.EM_STEPS):
            new = np.zeros(3)
            for g, k in zip(x, n):
                part = [w[j] * prob[g, j] for j in range(3)]
                new += k * np.asarray(part) / sum(part)
            new /= n.sum()
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-3:
                break
        langs, shares, full = model.mixture(text)
        assert np.abs(full - w).max() < 1e-9
        assert langs and abs(sum(shares) - 1) < 1e-6 and langs[0] in model.langs


# The contract's queries themselves


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_license_query_against_every_rule_tried_everywhere(spark):
    from test_row_operators import plain_scan

    rules, texts = license_rules.rules(), documents(spark)
    rows = {r["doc_id"]: r for r in queries.op1_license_scan(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        n, kept = plain_scan(t, rules)
        base = [d for d in kept if d[5]]
        assert (rows[i]["n_words"], rows[i]["n_base"], rows[i]["n_detections"]) == (n, len(base), len(kept))
        assert rows[i]["labels"] == ",".join(sorted({d[4] for d in kept})) and rows[i]["base_labels"] == ",".join(sorted({d[4] for d in base}))


def test_packing_query_holds_every_token(spark):
    from tokenizers import Tokenizer

    tok, texts = Tokenizer.from_file(queries.tokenizer_path()), documents(spark)
    rows = queries.op4_packing(spark, SF).collect()
    sequences_are_sound(rows, 2048)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in texts.items():
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(got[i]) == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]


def test_media_query_gives_back_every_byte(spark):
    import hashlib

    texts = documents(spark)
    for r in queries.op7_media_columns(spark, SF).collect():
        data = (texts[r["doc_id"]] or "").encode()
        whole = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert f"frames={len(whole) // 576};" in r["feature"] and "id3v1=true" in r["feature"] and "crc_bad=0" in r["feature"]


@pytest.mark.parametrize("query, threshold", [(queries.op8_toxicity, 0.5), (queries.op9_quality_classifier, 0.3)])
def test_classifier_queries(spark, query, threshold):
    rows, texts = query(spark, SF).collect(), documents(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) and r["held_out"] == (py_id_remainder(r["doc_id"], 5) == 0) for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["score"]) == r["score"]


def test_worker_caches_keep_two_generations_of_one_operator():
    from loomquery.llm import common

    common.worker_cache("a")[0].update({k: k for k in range(3)})
    recent, older = common.worker_cache("a", entries=3)
    assert not recent and older == {0: 0, 1: 1, 2: 2}
    recent[9] = 9
    assert common.worker_cache("a", entries=3)[0] is recent
    assert common.worker_cache("b") == ({}, {})
