"""MinHash near-dedup (operator 5): BagMinHash signatures of word shingles, banding, and exact verification.

A text is the multiset of its shingles of five words. BagMinHash: every shingle owns independent Poisson processes, one
on each of the weight intervals [0, 1), [1, 2), [2, 4), [4, 8) ..., with a rate equal to the interval's length; a point
has a time, a component and a weight below which it lies. A text that has the shingle w times sees the points of weight
below w. A component's signature is its first point, so two texts agree in it with a chance equal to their weighted
Jaccard similarity. Points are generated in order of time, and only as long as some component may still wait for one.

Texts that share at least SHARED of BANDS bands of ROWS components are candidates. Texts with equal words are one node
from the start. In each band's group, all are compared with a hub, the most central member; then, where a group still
holds several classes, with two other hubs. What is still open then is compared whole: the members of a group are dealt
into blocks, and each two blocks meet once, where every candidate pair of different classes is found by bands and sizes
and only then by texts. So rows follow members and blocks, not pairs, and no candidate pair is left out. Every pair is
verified by its multisets' overlap, counted over shingles of 48 bits. Classes are the connected components of verified
pairs. A group's rows in its band's joins can be split by adaptive execution: one side has each key once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.decontaminate import _TO_SPACE
from tandem.llm.spans import split_words, unit_hashes
from tandem.llm.util import U64, SpanHash, discard, integral, mix, ranges, slices, stored, text_bytes, tidy

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS, SHARED = 4, 24, 2
SLICE_BYTES = 1 << 20
MAX_ROUNDS = 60
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19  # of one block; two blocks are in memory at once
PAIR_CELLS = 1 << 22
_FOLD = np.frombuffer(_TO_SPACE, np.uint8)
_HASH = U64(0xFFFFFFFFFFFF)  # shingles are kept to 48 bits within a text


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of folded texts: document, hash, count; and the number of words of each document. A text of
    fewer words, but not none, is one shingle."""
    text = split_words(data, offsets)
    words = unit_hashes(text, SpanHash(text.data))
    number = np.diff(text.first)
    n = len(words) - size + 1
    value = np.zeros(max(n, 0), U64)
    for i in range(size if n > 0 else 0):
        value = value * U64(0xD6E8FEB86659FD93) + words[i : i + n]
    count = np.maximum(number - size + 1, 0)
    doc = np.repeat(np.arange(len(number)), count)
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(text.first[:-1] - (ends - count), count)
    key = mix(value[at]) & _HASH if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((number > 0) & (number < size))
    if len(short):
        few = np.array([int.from_bytes(hashlib.blake2b(words[text.first[d] : text.first[d + 1]].tobytes(), digest_size=6).digest(), "little") for d in short.tolist()], U64)
        doc, key = np.append(doc, short), np.append(key, few)
    # a slice has fewer than 65536 documents, so both fit one number
    both = np.sort(doc.astype(U64) << U64(48) | key)
    head = np.ones(len(both), bool)
    head[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(head)
    return (both[at] >> U64(48)).astype(np.int64), both[at] & _HASH, np.diff(np.append(at, len(both))), number


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of weighted sets given as rows (doc, key, weight); 0 where a set is empty."""
    total = np.bincount(doc, weights=weight, minlength=docs)
    out = np.zeros(docs * size, U64)
    limit = np.zeros(docs)
    todo = total > 0
    limit[todo] = size * (np.log(size) + 8) / total[todo]
    levels = np.frexp(np.maximum(weight, 1) - 0.5)[1].clip(0)  # intervals above the first that w reaches into
    while todo.any():
        first = np.full(docs * size, np.inf)
        name = np.zeros(docs * size, U64)
        keep = todo[doc]
        rows = np.flatnonzero(keep)
        some = np.repeat(rows, levels[rows] + 1)
        ends = np.cumsum(levels[rows] + 1)
        level = np.arange(len(some)) - np.repeat(ends - levels[rows] - 1, levels[rows] + 1)
        rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
        seed = mix(key[some] * U64(64) + level.astype(U64) + U64(1))
        time, step = np.zeros(len(some)), 0
        while len(some):
            step += 1
            point = mix(seed + U64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((point >> U64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            alive = time < limit[doc[some]]
            some, level, rate, seed, time, point = (x[alive] for x in (some, level, rate, seed, time, point))
            other = mix(point + U64(0xA5A5A5A5A5A5A5A5))
            cell = doc[some] * size + (other % U64(size)).astype(np.int64)
            inside = level == 0
            if not inside.all():
                spot = rate + (mix(other + U64(7)) >> U64(11)).astype(float) * 2.0**-53 * rate
                inside |= spot < weight[some]
            cell, when, what = cell[inside], time[inside], other[inside]
            np.minimum.at(first, cell, when)
            won = first[cell] == when
            name[cell[won]] = what[won]
        full = np.isfinite(first).reshape(docs, size).all(1) & todo
        out.reshape(docs, size)[full] = name.reshape(docs, size)[full]
        todo &= ~full
        limit *= 2
    return out.reshape(docs, size)


def folded(part: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column(text_col))
    return _FOLD[data], offsets


def node_names(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes | None], list[bytes]]:
    """For each folded text a digest of its words (null without any), and its words joined by spaces."""
    text = split_words(data, offsets)
    raw = text.data.tobytes()
    at = np.concatenate([text.starts, [len(raw)]])[text.first].tolist()
    parts = [raw[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [hashlib.md5(p).digest() if p else None for p in parts], parts


def signer(id_col: str, text_col: str):
    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch, text_col, SLICE_BYTES):
                for a in range(0, whole.num_rows, 60_000):
                    part = whole.slice(a, 60_000)
                    data, offsets = folded(part, text_col)
                    doc, key, weight, _ = shingles(data, offsets)
                    marks = bag_minhash(doc, key, weight, part.num_rows, ROWS * BANDS).reshape(-1, BANDS, ROWS)
                    bands = np.zeros(marks.shape[:2], U64) + np.arange(1, BANDS + 1, dtype=U64)
                    for i in range(ROWS):
                        bands = mix(bands * U64(0xD6E8FEB86659FD93) + marks[:, :, i])
                    names, _ = node_names(data, offsets)
                    total = np.bincount(doc, weights=weight, minlength=part.num_rows).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(names, pa.binary()), pa.array(total), lists], ["id", "node", "total", "bands"])

    return sign


def namer(text_col: str, blob: bool):
    """Adds node, and with blob replaces the text by its words, compressed."""

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                names, texts = node_names(*folded(part, text_col))
                if blob:
                    press = zstandard.ZstdCompressor(level=3).compress
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.binary()), pa.array([press(t) for t in texts], pa.binary())], ["id", "node", "words"])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.binary())], [*part.schema.names, "__node"])

    return name


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted keys, counts)."""
    i = np.searchsorted(b[0], a[0]).clip(max=len(b[0]) - 1)
    common = b[0][i] == a[0]
    least = np.minimum(a[1], b[1][i])[common].sum()
    return least / (a[1].sum() + b[1].sum() - least)


def verifier(similarity: float):
    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None

        def multiset(words: bytes) -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(words), np.uint8)
            _, key, count, _ = shingles(raw, np.array([0, len(raw)]))
            return key, count

        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    last, kept = a, multiset(x.as_py())
                good.append(overlap(kept, multiset(y.as_py())) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of all nodes of edges (a, b): the smallest node of the component, by spreading the smallest label
    to neighbours and then taking the label's own label, until nothing changes. Also the table that it is read from."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("l"))
        spread = labels.join(near, labels["node"] == near["n"]).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        of = labels.select(F.col("node").alias("m"), F.col("label").alias("up"))
        after = stored(spread.join(of, spread["label"] == of["m"]).select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(kept)
        kept, labels = after, after.select("node", "label")
        if after.filter("old != label").isEmpty():
            discard(both)
            return labels, kept
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by (band, p, q) as tables of whole groups, with each group's first and last row + 1."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "p", "q")])
        return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(c)[row].as_py() for c in ("band", "p", "q"))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(held[0], 0) == last:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        cuts = bounds(table).tolist()
        if cuts:
            yield table.slice(0, cuts[-1]), list(zip([0, *cuts[:-1]], cuts, strict=True))
        held = table.slice(cuts[-1] if cuts else 0).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        cuts = [0, *bounds(table).tolist(), table.num_rows]
        yield table, list(zip(cuts[:-1], cuts[1:], strict=True))


def candidates(bands: np.ndarray, total: np.ndarray, label: np.ndarray, block: np.ndarray, band: int, p: int, q: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows, of blocks p and q, of different classes that share SHARED bands, this one as the first of
    them, and whose sizes allow the similarity. So each pair of a group is found at one band and one pair of blocks."""
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    found = []
    step = max(1, PAIR_CELLS // max(1, len(right) * BANDS))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        fits = label[rows][:, None] != label[right][None, :]
        fits &= np.minimum(total[rows][:, None], total[right][None, :]) >= similarity * np.maximum(total[rows][:, None], total[right][None, :])
        if p == q:
            fits &= rows[:, None] < right[None, :]
        i, j = np.nonzero(fits)
        i, j = rows[i], right[j]
        for a in range(0, len(i), PAIR_CELLS // BANDS):
            x, y = i[a : a + PAIR_CELLS // BANDS], j[a : a + PAIR_CELLS // BANDS]
            equal = bands[x] == bands[y]
            good = (equal.sum(1) >= SHARED) & (bands[x, equal.argmax(1)] == band)
            found.append((x[good], y[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def pairer(similarity: float):
    """From rows (band, p, q, block, node, total, label, bands) those that have a candidate, with their place in the
    group and the places of their partners that come after them."""

    @tidy
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches):
            key = {c: table.column(c).to_numpy() for c in ("band", "p", "q", "block", "total")}
            label = table.column("label").combine_chunks().dictionary_encode()
            code = label.indices.to_numpy()
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            rows, place, mates = [], [], []
            for a, b in groups:
                x, y = candidates(bands[a:b], key["total"][a:b], code[a:b], key["block"][a:b], key["band"][a], key["p"][a], key["q"][a], similarity)
                if not len(x):
                    continue
                used = np.unique(np.concatenate([x, y]))
                x, y = np.searchsorted(used, x), np.searchsorted(used, y)
                order = np.argsort(x, kind="stable")
                ends = np.searchsorted(x[order], np.arange(len(used) + 1))
                partners = y[order]
                rows.append(used + a)
                place.append(np.arange(len(used)))
                mates += [partners[ends[k] : ends[k + 1]] for k in range(len(used))]
            if rows:
                kept = table.select(["band", "p", "q", "node", "label"]).take(pa.array(np.concatenate(rows)))
                lengths = np.cumsum([0, *map(len, mates)])
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(mates), pa.int32()))
                out = kept.append_column("place", pa.array(np.concatenate(place), pa.int32())).append_column("mates", lists)
                yield from out.combine_chunks().to_batches()

    return pair


def tokens_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of compressed texts, numbered, those that a text has again as others; and the n + 1 offsets."""
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(w), np.uint8) for w in words]
    parts = []
    for a in range(0, len(raw), 60_000):
        some = raw[a : a + 60_000]
        doc, key, count, _ = shingles(np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
        again = ranges(np.zeros(len(count), np.int64), count.astype(np.int64))
        parts.append((np.repeat(doc, count) + a, np.repeat(key, count), again))
    doc, key, again = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((again, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (again[order][1:] != again[order][:-1])
    token = np.empty(len(order), np.int64)
    token[order] = np.cumsum(new) - 1
    return token, np.searchsorted(doc, np.arange(len(words) + 1))


def linked(words: list[bytes], label: np.ndarray, mates: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of one group's candidates at the similarity; pairs that others have linked by then are not compared."""
    token, first = tokens_of(words)
    size = np.diff(first)
    mark = np.zeros(int(token.max()) + 1 if len(token) else 0, np.int64)
    class_, links = np.array(label), []
    for i, others in enumerate(mates):
        others = others[class_[others] != class_[i]]
        if not len(others):
            continue
        mark[token[first[i] : first[i + 1]]] = 1
        ends = np.cumsum(size[others])
        at = 0
        while at < len(others):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_CELLS, "right")))
            some = others[at:to]
            hits = np.concatenate([[0], np.cumsum(mark[token[ranges(first[some], size[some])]])])
            stops = np.cumsum(size[some])
            least = hits[stops] - hits[stops - size[some]]
            for j in some[least / (size[i] + size[some] - least) >= similarity].tolist():
                if class_[j] != class_[i]:
                    links.append((i, j))
                    class_[class_ == class_[j]] = class_[i]
            at = to
        mark[token[first[i] : first[i + 1]]] = 0
    return links


def linker(similarity: float):
    @tidy
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches):
            for a, b in groups:
                part = table.slice(a, b - a).sort_by("place").combine_chunks()
                label = part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
                mates = [np.asarray(m, np.int64) for m in part.column("mates").to_pylist()]
                links = linked(part.column("words").to_pylist(), label, mates, similarity)
                if links:
                    node = part.column("node").combine_chunks()
                    yield pa.RecordBatch.from_arrays([node.take(pa.array([x for x, _ in links])), node.take(pa.array([y for _, y in links]))], ["a", "b"])

    return link


def all_links(keyed: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different classes of labels, over all candidate pairs of every group that holds several."""
    marked = keyed.join(labels, "node")
    open_ = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("total").alias("size")).filter("low != high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    dealt = marked.select("node", "band", "label").join(open_.select("band", blocks.alias("blocks")), "band")
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "label")
    dealt = dealt.join(nodes.select("node", "total", "bands"), "node").select("band", "p", "q", "block", "node", "total", "label", "bands")
    dealt = dealt.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    found = stored(dealt.mapInArrow(pairer(similarity), "band long, p int, q int, node binary, label binary, place int, mates array<int>"), "near-candidates")
    both = found.join(texts, "node").select("band", "p", "q", "node", "label", "place", "mates", "words")
    both = both.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    links = stored(both.mapInArrow(linker(similarity), "a binary, b binary"), "links-rest")
    discard(found)
    return links


def hub_links(keyed: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, hub: Column, similarity: float, name: str) -> DataFrame:
    """Links (a, b) between each open group's hub and its other classes. Pairs are thinned by sizes and bands before
    any text is fetched."""
    marked = keyed.join(labels, "node")
    open_ = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), hub.alias("hub")).filter("low != high").select("band", "hub")
    pairs = marked.join(open_, "band").filter("label != hub.label").select(F.col("hub.node").alias("a"), F.col("hub.total").alias("s"), F.col("node").alias("b"), F.col("total").alias("t"))
    pairs = pairs.filter(F.least("s", "t") >= similarity * F.greatest("s", "t")).select("a", "b").distinct()
    for side in "ba":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("bands").alias(f"{side}_bands")), side)
    pairs = pairs.filter(F.size(F.array_intersect("a_bands", "b_bands")) >= SHARED).select("a", "b")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    return stored(both.select("a", "b", "x", "y").mapInArrow(verifier(similarity), "a binary, b binary"), name)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) of every row of docs, and nodes (node, first_id, class_id, label): first_id is the smallest
    id of the texts with these words, class_id the smallest of the class, which several classes may have (or null), label
    the class itself; node is null for a text without words."""
    integral(docs, id_col)
    signed = stored(docs.select(id_col, text_col).mapInArrow(signer(id_col, text_col), "id long, node binary, total long, bands array<long>"), "signatures")
    nodes = stored(signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.first("total").alias("total"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", "total", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(banded.join(groups, "band"), "shared-bands")
    # how central a node is: the sizes of its bands' groups; an original outweighs its copies, which left some of them
    central = stored(shared.groupBy("node").agg(F.sum("n").alias("central")), "central")
    members = central.select("node")
    needed = members.join(nodes.select("node", "first_id"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(namer(text_col, True), "id long, node binary, words binary")
    texts = texts.join(needed, (texts["node"] == needed["node"]) & texts["id"].eqNullSafe(needed["first_id"])).select(needed["node"], "words")
    texts = stored(texts.dropDuplicates(["node"]), "near-texts")
    keyed = stored(shared.select("node", "total", "band").join(central, "node"), "keyed")
    discard(shared)
    labels, kept = members.withColumn("label", F.col("node")), None
    edges: list[DataFrame] = []
    member = F.struct("central", "node", "total", "label")
    by_node = F.struct("node", "central", "total", "label")
    finders = [
        *(lambda labels, hub=hub, i=i: hub_links(keyed, nodes, texts, labels, hub, similarity, f"links-{i}") for i, hub in enumerate((F.max(member), F.min(by_node), F.max(by_node)))),
        lambda labels: all_links(keyed, nodes, texts, labels, similarity),
    ]
    for find in finders:
        found = find(labels)
        edges.append(found)
        if found.isEmpty():
            continue
        found, table = components(reduce(DataFrame.unionAll, edges))
        joined = stored(members.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "classes")
        discard(table, kept)
        labels = kept = joined
    discard(*edges, texts, keyed)
    classes = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    return signed.select("id", "node"), classes.join(least, "label").select("node", "first_id", "class_id", "label")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The class of near-duplicates of each document: (id, class_id, first).

    One row for each row of docs; class_id is the smallest id of the class, first is true for rows with that id. Words
    are those of decontamination (folded, digits, letters and all beyond ASCII); a text of fewer words than a shingle is
    one shingle. A text without words (null too) is a class of its own with its own id. Ids are whole numbers (ValueError
    else); null ids come after others: a class of null ids alone has a null class_id and no first. Repeated rows are
    members of one class. Texts of any length are taken whole. An empty table gives an empty result; other columns of
    docs don't matter, whatever their names.
    """
    members, classes = near_classes(docs, id_col, text_col, similarity)
    # texts without words have no partner; their keys are spread
    key = F.coalesce("node", F.concat(F.lit("-"), F.xxhash64("id", F.monotonically_increasing_id()).cast("string")).cast("binary"))
    out = members.withColumn("node", key).join(classes, "node", "left").select("id", F.when(F.col("class_id").isNull() & F.col("first_id").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("first", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False))).withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: of its smallest id. Rows without words all stay, as do all columns, whatever
    their names (but for names that begin with __)."""
    _, classes = near_classes(docs, id_col, text_col, similarity)
    # the row that stands for a class has its smallest id; of several nodes with that id, the smallest node
    heads = classes.filter(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("node").alias("__head"), F.first("class_id").alias("__class"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    # texts without words all stay, so each has a key of its own
    own = F.concat_ws("-", F.lit(""), F.col(f"`{id_col}`").cast("string"), F.monotonically_increasing_id().cast("string")).cast("binary")
    named = docs.mapInArrow(namer(text_col, False), f"{schema}, __node binary").withColumn("__key", F.coalesce("__node", own))
    kept = named.join(heads.drop("label"), (F.col("__key") == F.col("__head")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__class")), "left")
    return kept.filter("__node is null or __head is not null").dropDuplicates(["__key", id_col]).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
