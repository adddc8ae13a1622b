"""Each operator against a plain version on small inputs with nulls, repeats, ties, empty and long texts."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tandem.llm import byte_bpe, decontaminate, licenses, media, near_dups, registry, spans, suffix_dedup, token_counts, toxicity, url_filter, word_windows
from tests.llm import brute
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept int, n_words string"


def texts(seed, n=120):
    """Passages that repeat, runs of one word, repeated rows and ids, nulls, empty texts and odd white space."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = [r.choice(words) + r.choice([" ", "  ", "\n", "\x1c "]) for _ in range(2000)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            a = r.randint(0, 1900)
            parts += base[a : a + r.randint(1, 60)] + ["aa "] * (r.randint(1, 80) if r.random() < 0.3 else 0)
        rows.append((r.choice([i, i, i, i // 2, None]), r.choice(["".join(parts)] * 9 + [None, ""])))
    return rows + rows[:10]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("hot", [4096, 2])
def test_byte_windows(spark, hot):
    rows = texts(1)
    out = spans.cut_repeats(frame(spark, rows), "doc_id", "text", spans.Kind("byte", 50, 20), suffix_dedup.interval_classes(50), hot)
    assert same(map(tuple, out.select("doc_id", "n_units", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), brute.byte_dedup(rows))


@pytest.mark.parametrize("hot", [4096, 2])
def test_word_windows(spark, hot):
    rows = texts(2)
    out = spans.cut_repeats(frame(spark, rows), "doc_id", "text", spans.Kind("word", 13, 3), word_windows.sorted_windows(13), hot)
    assert same(map(tuple, out.select("doc_id", "n_units", "n_removed", F.sha2("kept", 256)).collect()), brute.word_dedup(rows))


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion_alone(seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab") for _ in range(80))
    docs = [(r.choice([0, 1, 2, 3]), base[a : a + r.randint(6, 60)].encode()) for a in (r.randint(0, 20) for _ in range(5))]
    which, window = suffix_dedup.interval_classes(6)(np.frombuffer(b"".join(t for _, t in docs), np.uint8), np.array([len(t) for _, t in docs]), np.array([i for i, _ in docs]))
    want = {(k, p) for k, (i, t) in enumerate(docs) for p in range(len(t) - 5) if any(j < i and t[p : p + 6] in u for j, u in docs)}
    assert set(zip(which.tolist(), window.tolist(), strict=True)) == want and len(want) == len(which)


def test_dedup_queries_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert same(map(tuple, suffix_dedup.query(spark, SF).collect()), brute.byte_dedup(rows))
    assert same(map(tuple, word_windows.query(spark, SF).collect()), brute.word_dedup(rows))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert same(map(tuple, decontaminate.query(spark, SF).collect()), brute.contamination(rows, bench))


def test_dedup_keeps_columns_and_empty_tables(spark):
    df = frame(spark, [(1, "a b"), (1, "a b")])
    assert set(suffix_dedup.suffix_dedup(df).columns) == {"doc_id", "text", "n_words", "n_bytes", "n_removed", "n_spans", "kept"}
    assert suffix_dedup.suffix_dedup(df).count() == 2 and suffix_dedup.suffix_dedup(df.limit(0)).collect() == []
    assert word_windows.substring_dedup(df).first().kept == "a b" and word_windows.substring_dedup(df.limit(0)).collect() == []
    assert suffix_dedup.without_repeats(df).columns == df.columns


@pytest.mark.parametrize("window, block", [(4, 1 << 19), (5, 40)])
def test_decontamination(spark, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(3)
    words = ["a", "B", "é", "x1", "Zz"]
    docs = [(r.choice([i, None]), r.choice([None, "", *[" ".join(r.choice(words) + r.choice(["", " -", ",\n"]) for _ in range(r.randint(1, 40)))] * 8])) for i in range(100)]
    items = [(r.choice([i, None, 1]), r.choice([None, "...", *[" ".join(r.choice(words) for _ in range(r.randint(2, 9)))] * 8])) for i in range(12)]
    found = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=window).collect()
    got = [(x.doc_id, x.n_words, x.n_hit, len(x["items"]), brute.sha(",".join(x["items"]).encode()), x.n_hit > 0) for x in found]
    assert same(got, brute.contamination(docs, items, window))
    assert all(x.cleaned == x.text for x in found if not x.n_hit)
    assert all(len(decontaminate.words_of(x.cleaned.encode())) == x.n_words - x.n_hit for x in found if x.n_hit)


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit) for x in decontaminate.decontaminate(frame(spark, [(1, "a b")]), none).collect()] == [(2, 0)]


def plain_encoding():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark):
    plain, r = plain_encoding(), random.Random(4)
    odd = ["don't I'LL 123abc½²\t\n\n x", "漢字かな😀👍🏽", "a" * 5000, "\x00\x1c\ufeff", " " * 100 + "x", "<|endoftext|>"]
    odd += ["".join(chr(r.choice([r.randrange(0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x30000)])) for _ in range(100)) for _ in range(60)]
    rows = texts(5, 40) + [(i, t) for i, t in enumerate(odd)]
    want = [(i, t, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows]
    got = byte_bpe.tokenize(frame(spark, rows)).collect()
    assert same([(x.doc_id, x.text, bytes(x.ids)) for x in got], want)
    assert all(bytes(x.decoded) == (x.text or "").encode() and x.n_tokens == len(x.ids) // 4 for x in got)
    assert byte_bpe.tokenize(frame(spark, rows).limit(0)).collect() == []


def test_token_counts_equal_greedy_search(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    first, rest = {p for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
    rows = texts(6, 40) + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()] + [(7, "\U00012345 x" + "y" * 3000)]
    want = []
    for i, t in rows:
        n = [brute.greedy(w.decode(), first, rest) for w in (t or "").encode().split()]
        want.append((i, len(n), sum(map(abs, n)), n.count(-1)))
    assert same([(x.doc_id, x.n_words, x.n_tokens, x.n_unknown) for x in token_counts.count_tokens(frame(spark, rows)).collect()], want)


def test_media_round_trip_and_single_member_failure(spark, tmp_path):
    rows = texts(7, 60) + [(1, "x" * 576), (2, "x" * 577)]
    folder = f"file://{tmp_path}/archive"
    media.store_media(frame(spark, rows, 3), folder)
    got = media.read_media(spark, folder, range_bytes=3000).collect()
    want = [(i, media.padded((t or "").encode())) for i, t in rows]
    assert same([(x.id, bytes(x.payload)) for x in got], want) and all(x.error is None and media.from_png(bytes(x.media)) == bytes(x.payload) for x in got)
    assert all(len(p) % 576 == 0 and p for _, p in want)
    features = media.with_features(media.read_media(spark, folder)).filter("id = 2 and n_bytes = 577").first()
    payload = media.padded(b"x" * 577)
    assert (features.payload_bytes, features.payload_sha256, features.tail_crc32) == (1152, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    shard = max((tmp_path / "archive").glob("shard-*"), key=lambda p: p.stat().st_size)
    data = bytearray(shard.read_bytes())
    data[40] ^= 255
    shard.write_bytes(data)
    broken = media.read_media(spark, folder, attempts=2).collect()
    assert sum(x.error is not None for x in broken) == 1 and len(broken) == len(rows)


def test_media_of_an_empty_table(spark, tmp_path):
    media.store_media(frame(spark, [(1, "a")]).limit(0), f"file://{tmp_path}/none")
    assert media.read_media(spark, f"file://{tmp_path}/none").collect() == []


def test_bag_minhash_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    off = []
    for _ in range(200):
        key = np.unique(r.integers(0, 1 << 48, 60).astype(np.uint64))
        a = r.integers(0, 9, len(key))
        b = np.where(r.random(len(key)) < 0.6, a, r.integers(0, 9, len(key)))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = near_dups.bag_minhash(doc, np.concatenate([key[a > 0], key[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 96)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.07


def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = decontaminate.words_of((t or "").encode())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    ids = {g: min((x for x in xs if x is not None), default=None) for g, xs in groups.items()}
    return [(rows[i][0], ids[find(i)]) for i in range(len(rows))]


def test_near_dups_equal_brute_force(spark):
    r = random.Random(8)
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:120]
    words = rows[0][1].split()
    for i in range(40):  # near copies, some near to each other only
        w = list(words)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, "a b c"), (2001, "A, b: c"), (None, "a b c"), (None, None), (2002, ""), (2002, ""), *[rows[5]] * 3]
    df = frame(spark, rows)
    got = [(x.doc_id, x.class_id) for x in near_dups.near_dups(df).collect()]
    assert same(got, brute_classes(rows))
    kept = near_dups.keep_first(df)
    worded = {c for (i, t), (_, c) in zip(rows, brute_classes(rows), strict=True) if decontaminate.words_of((t or "").encode())}
    assert sorted(x.doc_id for x in kept.collect() if decontaminate.words_of((x.text or "").encode())) == sorted(worded)
    assert kept.columns == df.columns and sum(not x.text for x in kept.collect()) == 3
    assert near_dups.near_dups(df.limit(0)).collect() == []


def test_toxicity_holds_out_of_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, rest = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    model = toxicity.train(docs, fit)
    assert (np.diff(model.thresholds) > 0).all()
    cells = {(x.toxic, x.rejected): x["count"] for x in toxicity.score(docs.select("doc_id", "text"), model).join(rest, "doc_id").groupBy("toxic", "rejected").count().collect()}
    assert cells[1, True] / (cells[1, True] + cells.get((1, False), 0)) > 0.85
    assert cells.get((0, True), 0) / (cells.get((0, True), 0) + cells[0, False]) < 0.03
    odd = frame(spark, [(None, None), (1, ""), (1, "idiot moron scum"), (1, "idiot moron scum")])
    got = [(x.doc_id, x.rejected, x.severity) for x in toxicity.score(odd, model).collect()]
    assert Counter(x[:2] for x in got) == {(None, False): 1, (1, False): 1, (1, True): 2} and len({x[2] for x in got}) == 2
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_ordinal_fit_recovers_shared_weights():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 2))
    grade = (x @ [2.0, -1.0] + r.logistic(size=4000) > np.array([[-1.0], [1.5]])).sum(0)
    row, col = np.divmod(np.arange(x.size), 2)
    w, t = toxicity.fit_ordinal(toxicity.Sparse(row, col, x.ravel(), x.shape), grade, 3, 0.0, 1500)
    assert np.allclose(w, [2, -1], atol=0.2) and np.allclose(t, [-1, 1.5], atol=0.2)


def test_urls(spark):
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, ""), (4, "HTTP://EXAMPLE.ORG/es/x?y"), (5, "a://b.ORG#/"), (7, "x://y.net?u=http://z.org/"), (8, "x://notexample.org/es/"), (9, "x://a.com/fr/"), (9, "x://com/de/1")], "page_id long, url string")
    got = {(x.page_id, x.url): (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(odd).collect()}
    assert got[4, "HTTP://EXAMPLE.ORG/es/x?y"] == ("example.org", "/es/x", "example.org/es/", "block") and got[5, "a://b.ORG#/"][:3] == ("b.org", "", None)
    assert got[7, "x://y.net?u=http://z.org/"][:3] == ("y.net", "", None) and got[8, "x://notexample.org/es/"][2:] == ("org/", "allow") and got[9, "x://com/de/1"][2:] == ("com/de/", "block") and got[1, None][:3] == ("", "", None)
    assert url_filter.filter_urls(odd).count() == 10 and url_filter.filter_urls(odd.limit(0)).collect() == []


def test_licenses(spark):
    files = spark.createDataFrame(
        [(None, "MIT License"), ("a/b/c.py", None), ("LICENSE", "x\nReleased under the MIT License"), ("a/x.py", ""), ("a/x.py", ""), ("a/COPYING", "Licensed under the Apache License, Version 2.0"), ("x.py", "y" * 100_000), ("b/z.py", "a licensed zebra")], "path string, text string"
    )
    got = sorted((x.path or "", x.license, x.how) for x in licenses.scan_licenses(files).collect())
    assert got == [("", "MIT", "header"), ("LICENSE", "MIT", "header"), ("a/COPYING", "Apache-2.0", "header"), ("a/b/c.py", "Apache-2.0", "inherited"), ("a/x.py", "Apache-2.0", "inherited"), ("a/x.py", "Apache-2.0", "inherited"), ("b/z.py", "MIT", "inherited"), ("x.py", "MIT", "inherited")]
    assert licenses.scan_licenses(files.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == []
