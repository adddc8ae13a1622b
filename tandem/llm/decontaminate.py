"""Benchmark decontamination (operator 2): a generalised suffix automaton of the items reads the documents' words.

The automaton holds every run of words of its items. While a document's words stream through it, it knows the longest
run that ends at each word; where that reaches a window, the window's words are hit and its items are noted.

Items of up to BLOCK_BYTES make one automaton, which is broadcast. More items are dealt into blocks of that size, whose
automata are broadcast one after the other, each gone before the next comes. They don't read the documents again: one
pass keeps the runs of words that may hold a window, by a bitmap of fixed size over hashes of all items' windows, and
only these runs stream through the automata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.spans import Text, split_words, unit_hashes
from tandem.llm.util import U64, SpanHash, discard, mix, slices, stored, text_bytes, tidy

WINDOW = 10
BLOCK_BYTES = 512 << 10  # of item texts in one automaton; more items are taken in blocks
BITS = 1 << 26  # of the bitmap of windows, 8 MB
PAGE = 1 << 16  # bits that one row has while the bitmap is made
SLICE_BYTES = 4 << 20
_PAIRS = 1 << 22

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if _WORD.fullmatch(bytes([b])) else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; all that stands between them becomes a space first."""
    return text.translate(_TO_SPACE).split() if text else []


class Automaton:
    """Generalised suffix automaton over words, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, dict[int, set[str]]] = {}
        self.chains: dict[int, list[tuple[int, frozenset[str]]]] = {}
        texts = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words_of(t)]) for i, t in items]
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(len(w), window) for _, w in texts if w), default=0)
        for item, words in texts:
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if size else 0):
                state = 0
                for w in words[start : start + size]:
                    state = self.next[state][w]
                self.ends.setdefault(state, {}).setdefault(size, set()).update([item] if item is not None else [])
        self.pairs = np.zeros(_PAIRS, bool)
        for _, words in texts:
            x = np.array(words, np.int64)
            self.pairs[self.pair(x[:-1], x[1:])] = True

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64)) % U64(_PAIRS)).astype(np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def chain(self, state: int) -> list[tuple[int, frozenset[str]]]:
        """Windows that end where this state's longest run ends: their lengths, shortest first, and items."""
        todo, at = [], state
        while at > 0 and at not in self.chains:
            todo.append(at)
            at = self.link[at]
        found = self.chains[at] if at > 0 else []
        for at in reversed(todo):
            own = sorted((n, frozenset(i)) for n, i in self.ends.get(at, {}).items())
            found = self.chains[at] = found + own if own else found
        return found

    def read(self, words: list[int], hit: np.ndarray, items: set[str]) -> None:
        """Stream words; mark those inside a window in hit and add the windows' items."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            for size, whose in self.chain(state) if state else ():
                if size <= matched:
                    hit[i + 1 - size : i + 1] = True
                    items |= whose


def scan(auto: Automaton, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[str]]]:
    """Of each text: how many words, which are hit (indices), which items."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    ends = np.cumsum(sizes)
    out: list[tuple[int, np.ndarray, set[str]]] = [(len(x), np.zeros(0, np.int64), set()) for x in lists]
    total = int(ends[-1]) if len(ends) else 0
    if not total or not auto.shortest:
        return out
    ids = np.concatenate([np.fromiter(map(auto.ids.get, x, repeat(-1)), np.int64, len(x)) for x in lists])
    # only runs of words whose neighbours are neighbours in some item can hold a window
    known = ids >= 0
    joint = np.zeros(total, bool)  # with the word before
    joint[1:] = known[1:] & known[:-1]
    joint[(ends - sizes)[sizes > 0]] = False
    at = np.flatnonzero(joint)
    joint[at] = auto.pairs[auto.pair(ids[at - 1], ids[at])]
    head = np.flatnonzero(known & ~joint)
    stop = known.copy()
    stop[:-1] &= ~joint[1:]
    size = np.flatnonzero(stop) + 1 - head
    for a, n in zip(head[size >= auto.shortest].tolist(), size[size >= auto.shortest].tolist(), strict=True):
        hit, items = np.zeros(n, bool), set()
        auto.read(ids[a : a + n].tolist(), hit, items)
        if hit.any():
            doc = int(np.searchsorted(ends, a, "right"))
            count, before, whose = out[doc]
            first = int(ends[doc] - sizes[doc])
            out[doc] = (count, np.append(before, np.flatnonzero(hit) + a - first), whose | items)
    return out


def cut(text: bytes, hit: np.ndarray, longest: int) -> bytes:
    """Without the runs of more than `longest` hit words, each up to the next word."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TO_SPACE))]
    breaks = np.flatnonzero(np.diff(hit) > 1)
    out, done = [], 0
    for a, b in zip(hit[np.append(0, breaks + 1)].tolist(), hit[np.append(breaks, len(hit) - 1)].tolist(), strict=True):
        if b - a + 1 > longest:
            out.append(text[done : at[a][0]])
            done = at[b + 1][0] if b + 1 < len(at) else len(text)
    return b"".join([*out, text[done:]])


def windows(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every run of `size` words of one document, and the runs' hashes."""
    words = unit_hashes(text, SpanHash(text.data))
    n = max(len(words) - size + 1, 0)
    value = np.zeros(n, U64)
    for i in range(size if n else 0):
        value = value * U64(0xD6E8FEB86659FD93) + words[i : i + n]
    doc = np.searchsorted(text.first, np.arange(n), "right")
    at = np.flatnonzero(text.first[doc] - np.arange(n) >= size) if n else np.zeros(0, np.int64)
    return at, mix(value[at] + U64(size))


def folded(column: pa.Array) -> Text:
    data, offsets = text_bytes(column)
    return split_words(np.frombuffer(_TO_SPACE, np.uint8)[data], offsets)


def window_bits(window: int):
    """From items: the sizes of their windows and the windows' places in the bitmap, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = folded(batch.column("text"))
            number = np.diff(text.first)
            for size in np.unique(np.minimum(number[number > 0], window)).tolist():
                at, name = windows(text, size)
                # items of more words have windows of full size only
                own = np.isin(np.searchsorted(text.first, at, "right") - 1, np.flatnonzero(np.minimum(number, window) == size))
                places = np.unique((name[own] % U64(BITS)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), size), pa.int32()), pa.array(places // PAGE), pa.array(places % PAGE, pa.int32())], ["size", "page", "place"])

    return run


def page_of(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(PAGE, bool)
    bits[rows.column("place").to_numpy()] = True
    return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def candidate_runs(text_col: str, bitmap, sizes: list[int]):
    """Runs of words of each row that may hold windows: (row, first, words)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                text = folded(part.column(text_col))
                step = np.zeros(len(text.starts) + 1, np.int64)
                for size in sizes:
                    at, name = windows(text, size)
                    place = (name % U64(BITS)).astype(np.int64)
                    at = at[bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 > 0]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + size, -1)
                inside = np.cumsum(step)[:-1] > 0
                doc = np.searchsorted(text.first, np.arange(len(inside)), "right") - 1
                new = np.ones(len(inside), bool)
                new[1:] = doc[1:] != doc[:-1]
                head = inside.copy()
                head[1:] &= ~inside[:-1] | new[1:]
                tail = inside.copy()
                tail[:-1] &= ~inside[1:] | new[1:]
                first, last = np.flatnonzero(head), np.flatnonzero(tail)
                rows, raw = part.column("__row").to_numpy()[doc[first]], text.data.tobytes()
                words = [raw[a:b] for a, b in zip(text.starts[first].tolist(), text.ends[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(first - text.first[doc[first]], pa.int64()), pa.array(words, pa.binary())], ["row", "first", "words"])

    return run


def automaton(items: DataFrame, window: int) -> Automaton:
    """Of a block's items, which are at most BLOCK_BYTES and one item."""
    return Automaton([tuple(r) for r in items.select("id", "text").sort("id", "text").collect()], window)


def by_blocks(docs: DataFrame, items: DataFrame, blocks: int, text_col: str, window: int) -> DataFrame:
    """docs with __row, items and hits, for items of several blocks."""
    spark = docs.sparkSession
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), "benchmark")
    places = stored(items.select("text").mapInArrow(tidy(window_bits(window)), "size int, page long, place int").distinct(), "benchmark-windows")
    sizes = sorted(r["size"] for r in places.select("size").distinct().collect())
    bits = np.zeros(BITS // 8, np.uint8)
    for r in places.select("page", "place").groupBy("page").applyInArrow(page_of, "page long, bits binary").collect():
        bits[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    rowed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "documents-by-row")
    runs = stored(rowed.select("__row", text_col).mapInArrow(candidate_runs(text_col, bitmap, sizes), "row long, first long, words binary"), "benchmark-runs")
    bitmap.destroy()
    found = []
    for block in range(blocks):
        auto = spark.sparkContext.broadcast(automaton(items.filter(F.col("block") == block), window))

        @tidy
        def read(batches: Iterator[pa.RecordBatch], auto=auto) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, hits, whose = [], [], []
                for row, first, (_, hit, ids) in zip(batch.column("row").to_pylist(), batch.column("first").to_pylist(), scan(auto.value, batch.column("words").to_pylist()), strict=True):
                    if len(hit):
                        rows.append(row)
                        hits.append(hit + first)
                        whose.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(whose, pa.list_(pa.string()))], ["row", "hits", "items"])

        found.append(stored(runs.mapInArrow(read, "row long, hits array<long>, items array<string>"), f"benchmark-hits-{block}"))
        auto.destroy()
    merged = reduce(DataFrame.unionAll, found).groupBy(F.col("row").alias("__row"))
    merged = stored(merged.agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"__{c}") for c in ("items", "hits"))), "benchmark-found")
    discard(items, places, runs, *found)
    return rowed.join(merged, "__row", "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, longest: int = 0, coverage: float = 0.5, cleaned: bool = True) -> DataFrame:
    """Find words of docs inside windows of `window` words of benchmark items; an item of fewer words is one window.

    Returns every row and column of docs with n_words, n_hit (long), items (array of string, sorted), hits (array of
    word indices), with `cleaned` cleaned (text without runs of more than `longest` hit words) and excessive (boolean: more than
    `coverage` of its words are hit); columns of docs with these names are replaced, others may have any name but __row,
    __items and __hits. Words are case-folded for A-Z and consist of digits, letters and everything beyond ASCII. Null
    and empty texts have no words, and their cleaned text is themselves; texts of any length are read whole. Items
    without words have no window; an item whose id is null hits, but is not listed; rows of one item id count once. Rows
    of docs are judged each by itself, whatever their ids. Without items nothing is hit; an empty table gives an empty
    result.
    """
    docs = docs.drop("n_words", "n_hit", "items", "hits", "cleaned", "excessive")
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    auto = docs.sparkSession.sparkContext.broadcast(automaton(items, window)) if blocks == 1 else None
    found = by_blocks(docs, items, blocks, text_col, window) if blocks > 1 else docs

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                if auto:
                    numbers, hits, whose = zip(*scan(auto.value, texts), strict=True)
                    whose = [sorted(x) for x in whose]
                else:
                    numbers = [len(words_of(t)) for t in texts]
                    hits, whose = ([x or [] for x in part.column(c).to_pylist()] for c in ("__hits", "__items"))
                new = [pa.array(numbers, pa.int64()), pa.array(whose, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64()))]
                if cleaned:
                    new.append(pa.array([cut(t, np.array(h), longest) if len(h) else t for t, h in zip(texts, hits, strict=True)], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], [*names, "n_words", "items", "hits", *["cleaned"] * cleaned])

    out = found.mapInArrow(run, f"{schema}, n_words long, items array<string>, hits array<long>" + ", cleaned string" * cleaned)
    return out.withColumn("n_hit", F.size("hits").cast("long")).withColumn("excessive", F.col("n_hit") > F.lit(coverage) * F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cleaned=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as ws from documents),
it as (select item_id, {_SQL_WORDS} as ws from benchmark),
iw as (select distinct item_id, s, list_slice(ws, i, i + s - 1) as win from (select item_id, ws, least({WINDOW}, len(ws)) as s, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) as i from it where len(ws) > 0)),
sizes as (select distinct s from iw),
x as (select r, i, s, list_slice(ws, i, i + s - 1) as win from (select r, ws, s, unnest(range(1, len(ws) - s + 2)) as i from d, sizes where len(ws) >= s)),
h as (select r, i, s, item_id from x join iw using (s, win)),
c as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + s)) as j from h) group by r),
t as (select r, list_sort(list(distinct cast(item_id as varchar))) as ids from h where item_id is not null group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(ids), 0) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join t using (r)
"""
