"""License scan, decontamination, media columns and sharding: brute force and edge cases."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomquery.llm import decontaminate, license_rules, license_scan, mpeg_audio, sharding
from loomquery.llm.common import word_list

DOCS = "doc_id long, text string"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# License scan


def plain_scan(text, rules):
    """Every match of every rule, then pairwise suppression; as slow as it is simple."""
    words = [w.decode() for w in word_list(text)]
    norm = f" {' '.join(words)} "
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r["regex"], norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m.group().count(" "), r["priority"], k, r["label"], r["base"]))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = [
        d for i, d in enumerate(found)
        if d[5] or not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in found[:i])
    ]
    return len(words), kept


LICENSE_TEXTS = [
    None, "", " \n\t", "...", "All rights reserved.", "Licensed under CC BY-NC 4.0. cc-by cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Copyright (c) 2019 Someone. All Rights Reserved. all rights reserved",
    "SPDX-License-Identifier: BSD-3-Clause", "GENERAL PUBLIC LICENSÉ general public license",
    "public domain", "gnu lesser general public license version 2.1", "ccé by", "cc by",
    "word " * 3000 + "all rights reserved " * 700,
]


def test_license_scan_equals_brute_force(spark):
    rules = license_rules.rules()
    docs = table(spark, LICENSE_TEXTS)
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(LICENSE_TEXTS):
        n, kept = plain_scan(text, rules)
        r = got[i]
        assert r["n_words"] == n
        assert [(d["first_word"], d["end_word"], d["priority"], d["rule"], d["label"], d["base"]) for d in r["detections"]] == kept
        base = [d for d in kept if d[5]]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None))
        assert list(r["labels"]) == sorted({d[4] for d in kept}) and list(r["base_labels"]) == sorted({d[4] for d in base})
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(kept)


def test_license_rules_are_gated_soundly():
    rules = license_rules.rules()
    assert len(rules) > 200
    for text in LICENSE_TEXTS:
        norm = f" {' '.join(w.decode() for w in word_list(text))} "
        for r in rules:
            for m in re.finditer(r["regex"], norm):
                around = m.group() + " "
                assert r["keyword"] in around, r
                assert any(a in around for a in license_rules.ANCHORS), r


def rule_sample(parsed, rng):
    """A string that a parsed regular expression matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[0]
            out += "x" if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])
        elif name == "BRANCH":
            out += rule_sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += rule_sample(arg[-1], rng)
        elif name == "MAX_REPEAT":
            low, high, body = arg
            out += "".join(rule_sample(body, rng) for _ in range(rng.randint(low, min(high, low + 1))))
        else:
            assert name == "ASSERT", name
    return out


def test_license_gates_are_implied_by_every_rule():
    rng = random.Random(1)
    for r in license_rules.rules():
        parsed = re._parser.parse(r["regex"])
        norms = {f" {' '.join(rule_sample(parsed, rng).split())} " for _ in range(60)}
        norms = [n for n in norms if re.search(r["regex"], n)]
        assert norms, r
        for norm in norms:
            assert r["keyword"] in norm, (r, norm)
            assert any(a in norm for a in license_rules.ANCHORS), (r, norm)


def test_license_scan_of_lone_short_forms(spark):
    texts = ["http://creativecommons.org/publicdomain/zero/1.0/", "MIT No Attribution", "CreativeML OpenRAIL-M", "a trail map"]
    rows = {r["doc_id"]: r["license"] for r in license_scan.scan(table(spark, texts)).collect()}
    assert [list(rows[i]["labels"]) for i in range(4)] == [["cc0"], ["mit-0"], ["openrail"], []]


def test_license_scan_keeps_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "all rights reserved", "x", 5), (1, "all rights reserved", "x", 5)], "doc_id long, text string, license string, `odd name` int")
    rows = license_scan.scan(docs).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["odd name"] == 5 and rows[0]["license"]["n_base"] == 1
    assert license_scan.scan(docs.limit(0)).count() == 0


# Decontamination

ITEMS = [(1, "a b c d e f g h i j k l m n o"), (2, "short item"), (3, None), (4, ""), (5, "A, b; c d e f g h i j k l m"), (6, "x " * 20), (2, "short item")]
LEAK_TEXTS = [
    None, "", "nothing at all", "short item", "a short item!", "shorts item", "zz A B-C d e f g h i j k l m n o p", "b c d e f g h i j k l m n",
    "b c d e f g h i j k l m", "x " * 40, "x " * 12, "filler " * 100 + "short item", "é short\nITEM é",
]


def test_decontamination_equals_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, LEAK_TEXTS)
    want = decontaminate.brute_force(LEAK_TEXTS, ITEMS)
    for limit in (decontaminate.MAX_WINDOW_WORDS, 60):  # one automaton, and several
        got = {r["doc_id"]: r["leak"] for r in decontaminate.scan(docs, bench, max_window_words=limit).collect()}
        for i, text in enumerate(LEAK_TEXTS):
            r = got[i]
            assert (r["n_words"], r["n_hit"], list(r["items"])) == want[i]
            assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
            covered = sum(len(word_list(text[s["start"] : s["end"]])) for s in r["spans"])
            assert covered == r["n_hit"]


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, LEAK_TEXTS)
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("leak.n_hit > 0 or leak.contaminated").count() == 0
    clash = docs.withColumn("leak", F.lit("x")).withColumn("item_id", F.lit(1))
    assert decontaminate.scan(clash, bench).columns == ["doc_id", "text", "item_id", "leak"]


def test_decontamination_item_without_id_marks_words_only(spark):
    bench = spark.createDataFrame([(None, "lost item"), (None, "short item"), (2, "short item"), (7, "other item")], "item_id long, text string")
    docs = table(spark, ["a lost item", "short item, other item, lost item"])
    for limit in (decontaminate.MAX_WINDOW_WORDS, 20):
        got = {r["doc_id"]: r["leak"] for r in decontaminate.scan(docs, bench, max_window_words=limit).collect()}
        assert (got[0]["n_hit"], list(got[0]["items"])) == (2, []) and got[0]["contaminated"]
        assert (got[1]["n_hit"], list(got[1]["items"])) == (6, ["2", "7"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=4), st.lists(st.text("ab ", max_size=30), min_size=1, max_size=4))
def test_automaton_on_small_alphabets(texts, items):
    numbered = list(enumerate(items))
    automaton = decontaminate.Automaton([(str(i), t) for i, t in numbered], 4)
    for text, want in zip(texts, decontaminate.brute_force(texts, numbered, 4)):
        spans, found = automaton.scan(word_list(text))
        assert (sum(b - a for a, b in spans), sorted(found)) == want[1:]


# Media columns


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_mpeg_round_trip(data):
    media = mpeg_audio.pack(data)
    s = mpeg_audio.parse(media)
    assert mpeg_audio.unpack(media, s) == mpeg_audio.padded(data)
    blocks = len(mpeg_audio.padded(data)) // 576
    assert len(s.frames) == blocks == s.table["frames"] == s.crc_ok and not s.crc_bad and not s.skipped and not s.truncated
    assert s.seconds * 16000 == blocks * 576 and s.id3v1 and s.id3v2["TLEN"] == str(blocks * 36)
    assert len(s.table["toc"]) == 100


def test_mpeg_headers_against_known_frames():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x64]))  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert (h.version, h.layer, h.kbps, h.rate, h.samples, h.length, h.protected, h.channels) == (1, 3, 128, 44100, 1152, 417, False, 2)
    h = mpeg_audio.header(bytes([0xFF, 0xFD, 0xA4, 0x04]))  # MPEG-1 layer II, 192 kbit/s, 48 kHz
    assert (h.layer, h.kbps, h.rate, h.length) == (2, 192, 48000, 576)
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None and mpeg_audio.header(b"") is None
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_mpeg_resynchronises_and_finds_damage():
    data = bytes(range(200)) * 20
    media = mpeg_audio.pack(data)
    clean = mpeg_audio.parse(media)
    cut = clean.frames[3]
    junk = mpeg_audio.parse(media[:cut] + b"\xff\xf2junk\xff" * 5 + media[cut:])
    assert len(junk.frames) == len(clean.frames) and junk.skipped == 35
    bad = bytearray(media)
    bad[clean.frames[2] + 8] ^= 1
    assert mpeg_audio.parse(bytes(bad)).crc_bad == 1
    short = mpeg_audio.parse(media[: clean.frames[-1] + 30])
    assert short.truncated and len(short.frames) == len(clean.frames) - 1
    assert mpeg_audio.parse(b"").frames == [] and mpeg_audio.parse(b"no audio here").frames == []
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]).ljust(417, b"\0")
    vbri = frame[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 417 * 3, 3, 2, 1, 2, 1) + struct.pack(">HH", 417, 834)
    s = mpeg_audio.parse(vbri.ljust(417, b"\0") + frame * 3)
    assert s.table["kind"] == "VBRI" and s.table["frames"] == 3 and len(s.frames) == 3 and s.samples == 3 * 1152


def test_media_columns(spark):
    texts = [None, "", "abc", "abc", "é" * 288, "x" * 577, "long " * 20_000]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in mpeg_audio.decode(mpeg_audio.encode(docs)).collect()}
    for i, t in enumerate(texts):
        want = mpeg_audio.padded((t or "").encode())
        a = rows[i]["audio"]
        assert a["payload_sha256"] == hashlib.sha256(want).hexdigest() and a["payload_bytes"] == len(want)
        assert a["tail_crc32"] == zlib.crc32(want[-32:]) and a["media_sha256"] == hashlib.sha256(rows[i]["media"]).hexdigest()
        assert len(a["offsets"]) == a["frames"] and a["duration_us"] == a["frames"] * 36_000
    assert rows[2]["media"] == rows[3]["media"] and rows[0]["media"] == rows[1]["media"]
    nothing = spark.createDataFrame([(1, None)], "id long, media binary")
    assert mpeg_audio.decode(nothing).first()["audio"] is None
    assert mpeg_audio.encode(docs.limit(0)).count() == 0


# Sharding


@pytest.mark.parametrize("partitions", [1, 7])
def test_sharding_is_contiguous_and_balanced(spark, partitions):
    rng = np.random.default_rng(1)
    texts = [None, ""] + ["é" * int(n) for n in rng.integers(0, 400, 400)]
    docs = table(spark, texts).withColumns({"part": F.lit(9), "size": F.lit("clash")})
    rows = sorted(sharding.shard_by_bytes(docs, 8, partitions=partitions).collect())
    sizes = [len((t or "").encode()) + 8 for t in texts]
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows] == [(i, s, zlib.crc32((t or "").encode())) for i, (s, t) in enumerate(zip(sizes, texts))]
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(sizes) / 8) <= max(sizes)


def test_sharding_of_ties_and_nothing(spark):
    docs = spark.createDataFrame([(7, "same")] * 300 + [(None, "x")], DOCS)
    rows = sharding.shard_by_bytes(docs, 4, partitions=5).collect()
    assert len(rows) == 301
    for k in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots))) and 70 <= len(slots) <= 80
    assert sharding.shard_by_bytes(docs.limit(0), 4).count() == 0
