"""run() as a whole against plain versions of its stages, one after the other."""

import random
import re

import numpy as np

import corpus_pipeline as cp
from tandem.llm import toxicity
from tests.llm import brute
from tests.llm.test_operators import brute_classes, plain_encoding


def plain_cut(text, hit):
    """A text without its hit words, each run of them up to the next word."""
    spans = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, i, done = b"", 0, 0
    while i < len(spans):
        j = i
        while j < len(spans) and hit[j]:
            j += 1
        if j > i:
            out += text[done : spans[i][0]]
            done = spans[j][0] if j < len(spans) else len(text)
        i = max(j, i + 1)
    return out + text[done:]


def hit_words(text, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())  # noqa: E731 - bytes: A-Z only
    found, own = [False] * len(words(text)), words(text)
    for item in items:
        w = words(item)
        n = min(window, len(w))
        windows = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
        for p in range(len(own) - n + 1 if n else 0):
            if tuple(own[p : p + n]) in windows:
                found[p : p + n] = [True] * n
    return found


def test_run_equals_plain_stages(spark, tmp_path):
    r = random.Random(7)
    vocabulary = [f"w{r.randrange(3000)}" for _ in range(800)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(14)) for i in range(5)]
    shared = text(30)
    rows = []
    for i in range(120):
        t = text(r.randint(20, 60))
        if i % 6 == 0:
            t += " nasty scum " + r.choice(["nasty", "scum"])
        if i % 10 == 1:
            t += " " + shared + " " + text(5)
        if i % 15 == 2:
            t += "! " + items[i % 5][1].upper() + ", " + text(4)
        rows.append((i, t))
    rows += [(200 + i, rows[i * 7][1] + " more") for i in range(10)] + [(300 + i, rows[i * 5][1]) for i in range(10)] + [(400, None), (401, ""), (402, "nasty"), (403, items[3][1])]
    docs = spark.createDataFrame([(*x, "en", "s", len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(i % 6 == 0), 1) for i in range(120)]
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in cp.run(spark, str(tmp_path)).collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def severity(t):
        words = {w for w in re.findall(r"[^\W_]+", (t or "").lower())}
        eta = sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "-" for n in (3, 4, 5, 6) if n < len(w))])
        return sum(1 / (1 + np.exp(k - eta)) for k in model.thresholds)

    kept = [(i, t) for i, t in rows if severity(t) < model.reject]
    assert {i for i, _ in rows} - {i for i, _ in kept} == {i for i, t in rows if t and ("nasty" in t or "scum" in t)}
    classes = dict(zip((i for i, _ in kept), (c for _, c in brute_classes(kept)), strict=True))
    kept = [(i, t) for i, t in kept if not (t or "").strip() or classes[i] == i]
    whole = {i: (t or "").encode() for i, t in kept}
    cut = {}
    for i, t in whole.items():
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if any(t[p : p + 50] in other for j, other in whole.items() if j < i):
                gone[p : p + 50] = [True] * 50
        cut[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g)
    plain, want = plain_encoding(), {}
    for i, t in cut.items():
        hit = hit_words(t, [x.encode() for _, x in items])
        if sum(hit) <= 0.5 * len(hit):
            t = plain_cut(t, hit)
            ids = plain.encode_ordinary(t.decode())
            want[i] = (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t))
    assert got == want and len(rows) - 20 > len(want) > 80 and any(len(whole[i]) > len(cut[i]) for i in cut) and 403 not in want
