"""What every operator must stand: clashing column names, long texts, ids that are no numbers, memory and files that
are left behind; and results that SQL can't express against plain versions."""

import hashlib
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import byte_bpe, decontaminate, licenses, media, near_dups, spans, suffix_dedup, token_counts, toxicity, url_filter, util, word_windows
from tests.llm import brute
from tests.llm.test_operators import brute_classes, plain_encoding, same, texts

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, or return.
NAMES = "own given score key dir row class_id node label n band id grade body held points parts none first url host path rule text2 hits kept license how chunk bytes rows lines passages is_license cols total media payload error words".split()


def wide(spark, rows, kind="doc_id long, text string", extra=NAMES):
    """rows with an extra column of each name, all of them holding that name."""
    return spark.createDataFrame(rows, kind).select("*", *(F.lit(n).alias(n) for n in extra)).repartition(2)


ROWS = [(2, "a b c d e f"), (1, "a b c d e f"), (None, None), (3, ""), (3, ""), (4, "MIT License")]


def test_clashing_names(spark):
    df = wide(spark, ROWS)
    model = toxicity.train(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    found = {
        "suffix": suffix_dedup.suffix_dedup(df, window=5, gram=3), "words": word_windows.substring_dedup(df, window=3, gram=2), "cut": suffix_dedup.without_repeats(df, window=5, gram=3),
        "bpe": byte_bpe.tokenize(df), "counts": token_counts.count_tokens(df), "toxicity": toxicity.score(df, model), "decontaminate": decontaminate.decontaminate(df, items, window=3),
        "first": near_dups.keep_first(df), "licenses": licenses.scan_licenses(df.drop("path").withColumn("path", F.lit("a/b"))),
        "urls": url_filter.filter_urls(df.drop("url").withColumn("url", F.col("text"))),
    }
    returned = {"kept", "hits", "score", "license", "how", "host", "path", "rule", "grade", "url"}
    for name, out in found.items():
        rows = out.collect()
        assert len(rows) == (5 if name == "first" else len(ROWS)), name
        assert len(set(out.columns)) == len(out.columns), name
        assert all(r[n] == n for r in rows for n in NAMES if n in out.columns and n not in returned), name
    assert near_dups.near_dups(df).count() == len(ROWS)


@pytest.mark.parametrize("call", [near_dups.near_dups, near_dups.keep_first, suffix_dedup.suffix_dedup, word_windows.substring_dedup, lambda df: media.store_media(df, "file:///nowhere")])
def test_ids_must_be_whole_numbers(spark, call):
    with pytest.raises(ValueError, match="whole numbers"):
        call(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def long_text(seed, words):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**5)}" for _ in range(words))


def test_long_texts(spark, tmp_path):
    """Megabytes in one row, of which a part stands in another row."""
    a, b = long_text(1, 500_000), long_text(2, 3000)
    rows = [(2, a + "\n" + b), (1, b), (3, a.replace("a", "b", 50)), (4, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(a) > 2 * spans.BLOCK_BYTES
    cut = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert cut[2].n_removed >= len(b) and cut[1].n_removed == 0 and cut[3].n_removed > 0.9 * len(a) and cut[4].n_removed == 0
    words = {r.doc_id: (r.n_words, r.n_removed) for r in word_windows.substring_dedup(df).collect()}
    assert words[2] == (503_000, 3000) and words[1] == (3000, 0) and words[4] == (1, 0)
    assert {r.doc_id: r.class_id for r in near_dups.near_dups(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    found = decontaminate.decontaminate(df, spark.createDataFrame([(9, b)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found} == {1: (3000, 3000), 2: (503_000, 3000), 3: (500_000, 0), 4: (1, 0)}
    model = toxicity.Model({"zzz": 1.0}, np.array([0.5]), 0.9)
    assert toxicity.score(df, model).filter("rejected").count() == 0
    media.store_media(df, f"file://{tmp_path}/long")
    assert media.with_features(media.read_media(spark, f"file://{tmp_path}/long", 1 << 20), strict=True).count() == 4
    assert {r.doc_id: r.n_tokens for r in byte_bpe.tokenize(df.filter("doc_id = 1")).collect()} == {1: len(plain_encoding().encode_ordinary(b))}
    assert token_counts.count_tokens(df).filter("n_words = 503000").count() == 1
    paths = df.withColumn("path", F.lit("LICENSE")).withColumn("text", F.concat("text", F.lit("\nMIT License")))
    assert licenses.scan_licenses(paths).filter("license = 'MIT' and how = 'header'").count() == 4
    urls = spark.createDataFrame([(1, "x://a.org/" + "y" * 200_000), (2, "x://b.com/de/" + "z" * 9)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(urls).collect()} == {1: "allow", 2: "block"}


@pytest.mark.parametrize("kind", [spans.Kind("byte", 50, 20), spans.Kind("word", 13, 3)])
def test_pieces_of_a_long_document_hold_every_window(monkeypatch, kind):
    text = np.frombuffer((long_text(3, 900) + " b" * 300).encode(), np.uint8)

    def windows():
        found = spans.scan(kind, text, np.array([0, len(text)]))
        return {(int(u) + i) for u, n in zip(found.unit, found.count, strict=True) for i in range(n)}, {found.data[a : a + s].tobytes() for a, s in zip(found.begin, found.size, strict=True)}

    whole, _ = windows()
    monkeypatch.setattr(spans, "BLOCK_BYTES", 700)
    pieces, strings = windows()
    assert whole == pieces and len(whole) > 1000 and all(s in text.tobytes() for s in strings)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_hot_windows_meet_in_two_rounds(spark, monkeypatch, unit):
    monkeypatch.setattr(spans, "CHUNK_BYTES", 300)
    rows = texts(11) + [(i, "one and the same long line of boilerplate that stands in each of the many texts here") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kind, evaluate, plain = (spans.Kind("byte", 50, 20), suffix_dedup.interval_classes(50), brute.byte_dedup) if unit == "byte" else (spans.Kind("word", 13, 3), word_windows.sorted_windows(13), brute.word_dedup)
    out = spans.cut_repeats(df, "doc_id", "text", kind, evaluate, hot=2, part_chunks=3)
    columns = ["doc_id", "n_units", "n_removed", *["n_spans"] * (unit == "byte")]
    assert same(map(tuple, out.select(*columns, F.sha2("kept", 256)).collect()), plain(rows))


def test_nested_items_of_any_depth():
    items = [(str(k), ("a " * k + "b").encode()) for k in range(1, 2500)]
    auto = decontaminate.Automaton(items, 10)
    ((n, hit, found),) = decontaminate.scan(auto, [b"a a b"])
    assert (n, hit.tolist(), found) == (3, [0, 1, 2], {"1", "2"})


def test_workers_keep_nothing():
    util.powers(util.U64(3), 1000)
    assert util._tables
    list(util.tidy(lambda batches: iter([1]))([]))
    assert not util._tables
    for module in (byte_bpe, token_counts, toxicity, near_dups, decontaminate):
        assert not any(hasattr(x, "cache_info") for x in vars(module).values()), module


def test_caches_are_bounded_by_bytes(monkeypatch):
    import public_tokenizers

    codec, plain = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN), plain_encoding()
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    for seed in range(30):
        text = long_text(seed, 40)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
        assert codec.held <= 20_000 or len(codec.known) <= 400


def test_shared_folder(spark, tmp_path):
    kept = util.stored(spark.range(3), "kept")
    path = kept.stored_in.removeprefix("file://")
    assert spark.sparkContext.applicationId in path and os.path.exists(path) and kept.count() == 3
    util.discard(kept)
    assert not os.path.exists(path)

    class Context:
        master = "spark://far"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        util.shared_dir(Session)


def test_near_dups_leaves_few_tables(spark):
    rows = [(i, f"w{i % 7} and some more words that are quite the same in all of these {i % 3}") for i in range(60)]
    before = set(os.listdir(util.shared_dir(spark).removeprefix("file://"))) if os.path.exists(util.shared_dir(spark).removeprefix("file://")) else set()
    out = near_dups.near_dups(spark.createDataFrame(rows, "doc_id long, text string"))
    left = set(os.listdir(util.shared_dir(spark).removeprefix("file://"))) - before
    assert len(left) <= 6, left
    assert same([(r.doc_id, r.class_id) for r in out.collect()], brute_classes(rows))


def test_severity_equals_plain_model(spark):
    """Scores from the fitted weights alone, spelled out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.weights and len(model.thresholds) == 2
    got = toxicity.score(docs.select("doc_id", "text"), model).collect()
    for r in got:
        eta = 0.0
        for word in {w for w in re.findall(r"[^\W_]+", (r.text or "").lower())}:
            eta += model.weights.get(word, 0.0) + sum(model.weights.get(word[:n] + "-", 0.0) for n in (3, 4, 5, 6) if n < len(word))
        chances = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        assert math.isclose(r.severity, sum(chances), abs_tol=1e-9)
        assert r.rejected == (sum(chances) >= model.reject) or math.isclose(sum(chances), model.reject, abs_tol=1e-9)
        assert r.grade == sum(p > 0.5 for p in chances) or any(math.isclose(p, 0.5, abs_tol=1e-9) for p in chances)


def test_grades_come_from_labels(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        grade = i % 3
        rows.append((i, " ".join([f"w{r.randrange(40)}" for _ in range(20)] + ["nasty"] * (grade > 0) + ["vile"] * (grade > 1))))
        labels.append((i, int(grade > 0), 0 if grade == 2 else 1))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, table)
    grades = {x.doc_id: x.grade for x in toxicity.score(docs, model).collect()}
    assert sum(grades[i] == i % 3 for i in grades) > 890
    assert len(toxicity.train(docs, table.drop("quality")).thresholds) == 1


def plain_png(payload):
    """A PNG written down from its specification: grey, 8 bits, rows of 576 samples, each behind a zero."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")


def plain_feature(payload):
    n, total, squares = len(payload), sum(payload), sum(b * b for b in payload)
    bins = [sum(1 for b in payload if b // 16 == k) * 1000 // n for k in range(16)]
    return f"{total * 1000 // n}:{int(math.sqrt((squares * n - total * total) / n**2) * 1000)}:" + ",".join(map(str, bins))


def test_media_query_equals_plain_version(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for i, t in docs:
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        m = plain_png(p)
        want.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), plain_feature(p)))
    got = media.query(spark, SF).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert same(map(tuple, got.collect()), want)


def test_lost_members_fail_the_query(spark, tmp_path):
    folder = f"file://{tmp_path}/lost"
    media.store_media(spark.createDataFrame([(1, "a" * 600), (2, "b" * 600)], "doc_id long, text string").coalesce(1), folder)
    shard = next((tmp_path / "lost").glob("shard-*"))
    data = bytearray(shard.read_bytes())
    data[60] ^= 255
    shard.write_bytes(data)
    assert media.with_features(media.read_media(spark, folder, attempts=1)).filter("error is not null").count() == 1
    with pytest.raises(Exception, match="can't be read"):
        media.with_features(media.read_media(spark, folder, attempts=1), strict=True).count()


def test_license_texts(spark):
    grant = 'Copyright (c) 2013 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal'
    files = [
        ("m/LICENSE", grant), ("b/LICENSE", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"), ("s/a.c", "// SPDX-License-Identifier: MIT"),
        ("s/b.c", "# SPDX-License-Identifier: Apache-2.0"), ("s/c.c", "driver's license"), ("s/d.c", "public license"), ("s/e.c", "ich gehe mit dir"), ("m/x.c", "int x;"), ("b/x.c", "int x;"),
        ("w/a.c", "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of the MPL was not distributed */\nint main() {}"), ("z/copying", "...\n\nApache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n" + "x " * 500),
    ]
    got = {r.path: (r.license, r.how) for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "m/LICENSE": ("MIT", "header"), "b/LICENSE": ("BSD-3-Clause", "header"), "s/a.c": ("MIT", "header"), "s/b.c": ("Apache-2.0", "header"), "s/c.c": (None, None), "s/d.c": (None, None), "s/e.c": (None, None),
        "m/x.c": ("MIT", "inherited"), "b/x.c": ("BSD-3-Clause", "inherited"), "w/a.c": ("MPL-2.0", "header"), "z/copying": ("Apache-2.0", "header"),
    }


def test_url_model_reads_the_whole_url(spark):
    """URLs that differ only behind the path, or have no scheme, get verdicts of their own; the model grows with them."""
    rows = [f"x://a{i}.org/p?good=yes{i}" for i in range(60)] + [f"x://b{i}.com/de/p?bad=spam{i}" for i in range(60)]
    rows += ["x://c.net/p?good=yes9", "x://c.net/p?bad=spam9", "good=yes", "bad=spam"]
    got = {r.url: r.verdict for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in rows], "url string")).collect()}
    assert [got[u] for u in rows[-4:]] == ["allow", "block", "allow", "block"]


def test_planted_near_copies_are_found(spark):
    """Recall against all pairs at the similarity of 0.8: every hundredth document against all of sf0.01."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(5)
    for i, (_, t) in enumerate(rows[:100:4]):
        w = (t or "").split()
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((10_000 + i, " ".join(w)))
    got = {x.doc_id: x.class_id for x in near_dups.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert same(got.items(), brute_classes(rows))


def test_buckets_are_dealt_out_evenly(spark):
    for buckets, parts in ((102, 51), (24, 12), (7, 4), (1000, 211)):
        labels = spans.even_labels(buckets, parts)
        assert len(set(labels.tolist())) == buckets
        rows = spark.createDataFrame([(int(x),) for x in labels], "label long").select(F.pmod(F.hash("label"), F.lit(parts)).alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in rows) == -(-buckets // parts)
