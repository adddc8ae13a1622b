"""Exact search for windows that repeat across documents, by super-k-mer exchange.

A window is W consecutive units (bytes or words) of one document. Its minimiser is the smallest hash among its
spans of m units; consecutive windows that share a minimiser form one super-k-mer, whose text travels as one string.

1. pack:   documents become chunks of a few MB (all columns, compressed), stored in the shared folder. Their bytes
           give the number of buckets, so that a bucket's share of the text stays the same at any size.
2. count:  each chunk sends its distinct minimisers to their buckets, with the number of documents that have them.
           A bucket tells each chunk which of its minimisers others have too, and which are hot.
3. send:   super-k-mers of repeated minimisers go to buckets. Equal strings of one chunk travel once, for the smallest
           doc_id; the others of larger doc_id are decided on the spot. Windows of a hot minimiser are dealt out one by
           one by their own hash; where there are many chunks, first to parts of a bucket.
4. judge:  an evaluator finds, in each bucket, windows that also start in a document with a smaller doc_id. A part of
           hot windows settles all but its smallest doc_id of each window; the parts' smallest meet in a second round.
           So a window that stands in every chunk costs a bucket one string for each part.
5. apply:  verdicts return to their chunk, where the documents are cut.

Nothing but two sums is collected to the driver; every step is a function of its input, so lost tasks are simply run
again. Minimisers are kept to 48 bits: a chance collision only sends more strings, it never changes a verdict. Texts are
hashed in blocks; a long document in pieces that overlap by a window less one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.util import NULL_ID, U64, SpanHash, binary_column, integral, mix, partitions, ranges, release, slices, sliding_min, stored, text_bytes, tidy

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 60_000  # a document's place in its chunk takes 16 bits
BUCKET_BYTES = 64 << 20  # of all texts that one bucket stands for, at most
HOT = 4096  # runs of one minimiser beyond which its windows are dealt out one by one, in small buckets;
HOT_BYTES = 512  # in large ones a run for each so many bytes of the bucket's share
PART_CHUNKS = 1024  # chunks whose hot windows meet in one part of a bucket
BLOCK_BYTES = 1 << 20  # of a chunk's texts that are hashed at a time
BATCH_BYTES = 512 << 10  # of strings that an evaluator gets at a time

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Kind:
    """What a window is: `window` units of bytes or words, with minimisers of `gram` units."""

    unit: str
    window: int
    gram: int


@dataclass
class Text:
    """A chunk's texts as units. data: their bytes (words: each followed by one space); starts, ends: of each unit in
    data; first: the first unit of each document, and the number of all units."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Text:
    """Words are what stands between white space; a document's end ends its last word."""
    n = len(data)
    space = _IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    head = ~space
    head[1:] &= space[:-1] | begins[1:]
    starts = np.flatnonzero(head)
    tail = ~space
    tail[:-1] &= space[1:] | begins[1:]
    ends = np.flatnonzero(tail) + 1
    lengths = ends - starts
    at = np.cumsum(lengths + 1)
    out = np.full(int(at[-1]) if len(at) else 0, 32, np.uint8)
    begin = at - lengths - 1
    gap = np.ones(len(out), bool)
    gap[at - 1] = False
    out[gap] = data[~space]
    return Text(out, begin, at - 1, np.searchsorted(starts, offsets))


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> Text:
    at = np.arange(len(data) + 1, dtype=np.int64)
    return Text(data, at[:-1], at[1:], offsets)


def split(kind: Kind, data: np.ndarray, offsets: np.ndarray) -> Text:
    return split_words(data, offsets) if kind.unit == "word" else split_bytes(data, offsets)


@dataclass
class Runs:
    """Super-k-mers: the first window of each, how many windows, the document, the minimiser (48 bits)."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    value: np.ndarray


def unit_hashes(text: Text, hashes: SpanHash) -> np.ndarray:
    return hashes.of(text.starts, text.ends)


def grams(kind: Kind, text: Text, hashes: SpanHash) -> np.ndarray:
    if kind.unit == "byte":
        return hashes.rolling(kind.gram)
    words = unit_hashes(text, hashes)
    n = len(words) - kind.gram + 1
    out = np.zeros(max(n, 0), U64)
    for i in range(kind.gram if n > 0 else 0):
        out = out * U64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def super_kmers(kind: Kind, text: Text, hashes: SpanHash) -> Runs:
    most = kind.window - kind.gram + 1
    units = len(text.starts)
    none = np.zeros(0, np.int64)
    if units < kind.window:
        return Runs(none, none, none, np.zeros(0, U64))
    low = sliding_min(grams(kind, text, hashes), most) >> U64(16)
    begin, end = text.first[:-1], text.first[1:] - kind.window + 1
    has = end > begin
    step = np.zeros(units + 1, np.int8)
    step[begin[has]] += 1
    step[end[has]] -= 1
    valid = np.cumsum(step, dtype=np.int8)[: len(low)] > 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(head)
    if not len(start):
        return Runs(none, none, none, np.zeros(0, U64))
    # a run ends before the next head or before the first window that crosses a document's end
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
    count = np.flatnonzero(tail) - start + 1
    parts = -(-count // most)  # periodic texts have long runs; the strings stay short
    if (parts > 1).any():
        which = np.repeat(np.arange(len(start)), parts)
        part = ranges(np.zeros(len(start), np.int64), parts)
        start, count = start[which] + part * most, np.minimum(most, count[which] - part * most)
    return Runs(start, count, np.searchsorted(text.first, start, "right") - 1, low[start])


# ---- wire formats -------------------------------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: high bytes of small numbers cost nothing."""
    parts = [np.int64(len(arrays)).tobytes()]
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts.append(np.array([ord(x.dtype.char), x.dtype.itemsize, len(x)], np.int64).tobytes())
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        char, size, n = np.frombuffer(raw, np.int64, 3, at).tolist()
        at += 24
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(chr(char))))
        at += n * size
    return out


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks()


# ---- the steps ----------------------------------------------------------------------------------------------------


def packer(text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, text_col, CHUNK_BYTES):
                for at in range(0, part.num_rows, CHUNK_ROWS):
                    some = part.slice(at, CHUNK_ROWS)
                    size = pa.compute.sum(pa.compute.binary_length(some.column(text_col))).as_py() or 0
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([size], pa.int64()), pa.array([pack_rows(some)], pa.binary())], ["chunk", "bytes", "rows"])
                    n += 1

    return pack


def load(blob: bytes, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows, their ids, their texts joined, and where these begin."""
    rows = unpack_rows(blob)
    ids = pa.compute.fill_null(rows.column(id_col).cast(pa.int64()), NULL_ID).to_numpy()
    return rows, ids, *text_bytes(rows.column(text_col))


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_BYTES, which are hashed together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, last
        first = last


def segments(kind: Kind, text: Text) -> Iterator[tuple[int, Text]]:
    """A block as it is, or a single long document in pieces, each with its first unit. Pieces overlap by a window less
    one unit, so that every window lies in one of them."""
    units = len(text.starts)
    if len(text.first) > 2 or len(text.data) <= 2 * BLOCK_BYTES or not units:
        yield 0, text
        return
    cuts = np.unique(np.searchsorted(text.starts, np.arange(0, len(text.data), BLOCK_BYTES)))
    cuts = np.append(cuts[cuts < units], units)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        last = min(b + kind.window - 1, units)
        lo, hi = int(text.starts[a]), int(text.ends[last - 1])
        yield a, Text(text.data[lo:hi], text.starts[a:last] - lo, text.ends[a:last] - lo, np.array([0, last - a]))


@dataclass
class Scan:
    """All super-k-mers of a chunk: document, first window (by the document's units), windows, minimiser; the place and
    size of their strings in data, and the strings' hashes. data has the texts as `split` makes them."""

    doc: np.ndarray
    unit: np.ndarray
    count: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    name: np.ndarray
    data: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Scan:
        return Scan(*(getattr(self, f)[which] for f in ("doc", "unit", "count", "value", "begin", "size", "name")), self.data)


def scan(kind: Kind, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> Scan:
    """hot: values whose windows become strings of their own; only these are returned then."""
    parts, texts, base = [], [], 0
    for a, b in blocks(offsets):
        text = split(kind, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for unit, piece in segments(kind, text):
            hashes = SpanHash(piece.data)
            runs = super_kmers(kind, piece, hashes)
            if hot is not None:
                keep = np.isin(runs.value, hot)
                n = runs.count[keep]
                runs = Runs(ranges(runs.start[keep], n), np.ones(int(n.sum()), np.int64), np.repeat(runs.doc[keep], n), np.repeat(runs.value[keep], n))
            begin = piece.starts[runs.start]
            end = piece.ends[runs.start + runs.count + kind.window - 2]
            shift = base + (int(text.starts[unit]) if unit else 0)
            parts.append((runs.doc + a, runs.start - piece.first[runs.doc] + unit, runs.count, runs.value, begin + shift, end - begin, hashes.of(begin, end)))
        texts.append(text.data)
        base += len(text.data)
    kinds = (np.int64, np.int64, np.int64, U64, np.int64, np.int64, U64)
    return Scan(*(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)), np.concatenate(texts) if texts else data)


def by_bucket(runs: Scan, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct minimisers with documents and runs, in order of bucket and value."""
    key = np.sort(runs.value << U64(16) | runs.doc.astype(U64))
    value = key >> U64(16)
    head = np.ones(len(key), bool)
    head[1:] = value[1:] != value[:-1]
    new_doc = np.ones(len(key), np.int64)
    new_doc[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    docs = np.add.reduceat(new_doc, at) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    value = value[at]
    bucket = (mix(value.copy()) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    return bucket[order], value[order], docs[order], count[order]


def counter(kind: Kind, id_col: str, text_col: str, buckets: int):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, data, offsets = load(blob.as_buffer(), id_col, text_col)
                bucket, value, docs, runs = by_bucket(scan(kind, data, offsets), buckets)
                if not len(bucket):
                    continue
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                names, blobs = bucket[at].tolist(), []
                for i, j in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
                    blobs.append(squeeze(np.diff(value[i:j], prepend=U64(0)), np.minimum(docs[i:j], 2).astype(np.uint8), np.minimum(runs[i:j], 65535).astype(np.uint16)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([chunk] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    return count


def flagger(hot: int):
    def flag(key: tuple, rows: pa.Table) -> pa.Table:
        """Of each chunk's minimisers in this bucket: 0 if no other document has it, 1 if others have, 2 if it is hot."""
        parts = [unsqueeze(blob.as_buffer()) for blob in rows.column("blob")]
        sizes = [len(p[0]) for p in parts]
        release()  # of the bucket before
        value = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        order = np.argsort(value, kind="stable")
        value = value[order]
        head = np.ones(len(value), bool)
        head[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(head)
        docs = np.add.reduceat(np.concatenate([p[1] for p in parts]).astype(np.int64)[order], at)
        runs = np.add.reduceat(np.concatenate([p[2] for p in parts]).astype(np.int64)[order], at)
        flags = np.empty(len(value), np.uint8)
        flags[order] = np.repeat(np.where(docs < 2, 0, np.where(runs > hot, 2, 1)).astype(np.uint8), np.diff(np.append(at, len(value))))
        found = [(c, squeeze(f)) for c, f in zip(rows.column("chunk").to_pylist(), np.split(flags, np.cumsum(sizes)[:-1]), strict=True) if f.any()]
        bucket = key[0].as_py()
        return pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "bucket": pa.array([bucket] * len(found), pa.int32()), "blob": pa.array([b for _, b in found], pa.binary())})

    return flag


def same_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each span equals, byte by byte, the span at index first."""
    differs = data[ranges(begin, size)] != data[ranges(begin[first], size)]
    ends = np.cumsum(size)
    return np.diff(np.concatenate([[0], np.cumsum(differs)])[np.concatenate([[0], ends])]) == 0


def long_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of a bigint column (32-bit Murmur3), by which it deals rows out."""
    u, mask = np.uint64, np.uint64(0xFFFFFFFF)

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << u(n) | v >> u(32 - n)) & mask

    h = np.full(len(x), seed, u)
    x = x.astype(u)
    for word in (x & mask, x >> u(32)):
        k = turn(word * u(0xCC9E2D51) & mask, 15) * u(0x1B873593) & mask
        h = (turn(h ^ k, 13) * u(5) + u(0xE6546B64)) & mask
    h ^= u(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> u(shift)) * u(factor) & mask
    return (h ^ h >> u(16)).astype(np.uint32).view(np.int32)


def even_labels(buckets: int, parts: int) -> np.ndarray:
    """Numbers for buckets that Spark deals out evenly over `parts` partitions, where few plain numbers would meet by
    chance: bucket i goes to partition i modulo parts."""
    need, tried = -(-buckets // parts), 0
    while True:
        tried = max(2 * tried, parts * (need + 8 * int(need**0.5) + 16))
        where = long_hash(np.arange(tried)) % parts
        if np.bincount(where, minlength=parts).min() >= need:
            break
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(parts))
    i = np.arange(buckets)
    return order[first[i % parts] + i // parts]


HOT_KEYS = 1 << 40  # keys from here on are parts of hot windows


def sender(kind: Kind, id_col: str, text_col: str, labels: np.ndarray, hot_parts: int):
    """labels: the key of each bucket. Hot windows' keys are HOT_KEYS and more, by bucket and part, if there are parts."""
    buckets = len(labels)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, flags in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                _, ids, data, offsets = load(blob.as_buffer(), id_col, text_col)
                runs = scan(kind, data, offsets)
                mark = marks(runs, flags, buckets)
                some = runs[mark == 1]
                yield from strings(chunk, ids, some, mix(some.value + U64(1)), labels, labels)
                if (mark == 2).any():
                    hot = scan(kind, data, offsets, np.unique(runs.value[mark == 2]))
                    part = int(mix(np.array([chunk], U64))[0] % U64(hot_parts))
                    yield from strings(chunk, ids, hot, hot.name, labels, HOT_KEYS + np.arange(buckets) * hot_parts + part if hot_parts > 1 else labels)

    return send


def marks(runs: Scan, flags: list[dict], buckets: int) -> np.ndarray:
    """The flag of each run, from those of the chunk's distinct minimisers."""
    bucket, value, _, _ = by_bucket(runs, buckets)
    mark = np.zeros(len(value), np.uint8)
    for x in flags:
        lo, hi = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
        mark[lo:hi] = unsqueeze(x["blob"])[0]
    order = np.argsort(value)
    return mark[order][np.searchsorted(value[order], runs.value)]


def leaders(data: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string the index of an equal one with the smallest id (itself, if it is that one)."""
    order = np.lexsort((ids, name))
    head = np.ones(len(order), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    lead = np.arange(len(order))
    check = np.flatnonzero(~head & (size[order] == size[first]))
    if len(check):
        a, b, n = order[check], first[check], len(check)
        equal = same_strings(data, np.append(begin[a], begin[b]), np.append(size[a], size[b]), np.tile(np.arange(n) + n, 2))[:n]
        lead[a[equal]] = b[equal]
    return lead


def strings(chunk: int, ids: np.ndarray, runs: Scan, place: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets, by their keys. Equal strings travel once; those of a larger doc_id are decided here."""
    buckets = len(labels)
    if not len(runs.doc):
        return
    own = ids[runs.doc]
    later = own > own[leaders(runs.data, runs.begin, runs.size, runs.name, own)]
    names = ["bucket", "chunk", "decided", "blob"]
    if later.any():
        x = runs[later]
        yield pa.RecordBatch.from_arrays([pa.array([labels[chunk % buckets]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([True]), pa.array([squeeze(x.doc.astype(np.uint16), x.unit.astype(np.uint32), x.count.astype(np.uint32))], pa.binary())], names)
    bucket = (place % U64(buckets)).astype(np.int64)
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    bucket, sub = bucket[sent], (place >> U64(40)).astype(np.uint16)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        x = runs[sent[i:j]]
        blobs.append(squeeze(own[sent[i:j]], x.doc.astype(np.uint16), x.unit.astype(np.uint32), sub[sent[i:j]], x.size.astype(np.uint32), x.count.astype(np.uint8), runs.data[ranges(x.begin, x.size)]))
    n = len(at)
    yield pa.RecordBatch.from_arrays([pa.array(keys[bucket[at]], pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([False] * n), pa.array(blobs, pa.binary())], names)


#: From strings (joined bytes, their sizes, their doc_ids): which windows also start in a smaller doc_id, as indices of
#: strings and of windows within them.
Evaluator = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def verdict_rows(chunk: np.ndarray, doc: np.ndarray, unit: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Removed windows as runs, a blob for each chunk."""
    if not len(chunk):
        return [], []
    order = np.lexsort((unit, doc, chunk))
    c, d, at = chunk[order], doc[order], unit[order]
    head = np.ones(len(c), bool)
    head[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)
    h = np.flatnonzero(head)
    last = np.append(h[1:], len(c)) - 1
    count = at[last] - at[h] + 1
    new = np.flatnonzero(np.diff(c[h], prepend=-1))
    blobs = [squeeze(d[h[i:j]].astype(np.uint16), at[h[i:j]].astype(np.uint32), count[i:j].astype(np.uint32)) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True)]
    return c[h[new]].tolist(), blobs


def judged(home: list[int], blobs: list[bytes]) -> pa.Table:
    """home: the chunk that a verdict goes to, or, below 0, the bucket in which smallest doc_ids meet."""
    return pa.table({"home": pa.array(home, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def judge_with(evaluate: Evaluator, hot_parts: int):
    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        release()  # of the bucket before
        bucket = key[0].as_py()
        decided = rows.column("decided").to_numpy(zero_copy_only=False)
        names = rows.column("chunk").to_numpy()
        home, blobs = names[decided].tolist(), [rows.column("blob")[i].as_py() for i in np.flatnonzero(decided).tolist()]
        open_rows = np.flatnonzero(~decided)
        if len(open_rows):
            parts = [unsqueeze(rows.column("blob")[i].as_buffer()) for i in open_rows.tolist()]
            chunk = np.repeat(names[open_rows], [len(p[0]) for p in parts])
            ids, doc, unit, sub, size, count = (np.concatenate([p[k] for p in parts]) for k in range(6))
            data, size = np.concatenate([p[6] for p in parts]), size.astype(np.int64)
            if bucket < HOT_KEYS:
                which, window = decide(evaluate, data, size, ids, sub, count.astype(np.int64))
            else:
                which, same = smallest(data, size, ids)
                window = np.zeros(len(which), np.int64)
                begin = np.cumsum(size) - size
                home.append(-1 - (bucket - HOT_KEYS) // hot_parts)
                blobs.append(squeeze(ids[same], size[same], data[ranges(begin[same], size[same])], chunk[same], doc[same], unit[same]))
            more = verdict_rows(chunk[which], doc[which], unit[which].astype(np.int64) + window)
            home, blobs = home + more[0], blobs + more[1]
        return judged(home, blobs)

    return judge


def smallest(data: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings that are one window each: those that an equal one of a smaller id beats, and the others."""
    begin = np.cumsum(size) - size
    lead = leaders(data, begin, size, string_hashes(data, begin, size), ids)
    return np.flatnonzero(ids > ids[lead]), np.flatnonzero(ids == ids[lead])


def meet(key: tuple, rows: pa.Table) -> pa.Table:
    """The second round of hot windows: the parts' smallest doc_ids of one bucket; verdicts pass as they are."""
    if key[0].as_py() >= 0:
        return rows.select(["home", "blob"])
    parts = [unsqueeze(blob.as_buffer()) for blob in rows.column("blob")]
    ids, size, data, chunk, doc, unit = (np.concatenate([p[k] for p in parts]) for k in range(6))
    which, _ = smallest(data, size, ids)
    return judged(*verdict_rows(chunk[which], doc[which], unit[which].astype(np.int64)))


def decide(evaluate: Evaluator, data: np.ndarray, size: np.ndarray, ids: np.ndarray, sub: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal strings of different chunks are evaluated once, for the smallest id."""
    begin = np.cumsum(size) - size
    lead = leaders(data, begin, size, string_hashes(data, begin, size), ids)
    gone = np.flatnonzero(ids > ids[lead])
    found = [(np.repeat(gone, count[gone]), ranges(np.zeros(len(gone), np.int64), count[gone]))]
    one = np.flatnonzero(lead == np.arange(len(lead)))
    one = one[np.argsort(sub[one], kind="stable")]
    # others of the same id as their leader share its verdict
    same = np.flatnonzero((ids == ids[lead]) & (lead != np.arange(len(lead))))
    same = same[np.argsort(lead[same], kind="stable")]
    for part in batches_of(sub[one], size[one]):
        some = one[part]
        which, window = evaluate(data[ranges(begin[some], size[some])], size[some], ids[some])
        which = some[which]
        a, b = (np.searchsorted(lead[same], which, side) for side in ("left", "right"))
        found += [(which, window), (same[ranges(a, b - a)], np.repeat(window, b - a))]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(2))


def string_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.concatenate([SpanHash(data[a:b]).of(begin[i:j] - a, begin[i:j] + size[i:j] - a) for i, j, a, b in spans_of(begin, size)])


def spans_of(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of strings, and of their bytes, of about BLOCK_BYTES."""
    for i, j in blocks(np.append(begin, begin[-1] + size[-1])):
        yield i, j, int(begin[i]), int(begin[j - 1] + size[j - 1])


def batches_of(sub: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Parts of about BATCH_BYTES bytes that keep equal subs together."""
    heads = np.append(np.flatnonzero(np.diff(sub.astype(np.int64), prepend=-1)), len(sub))
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if i > first and total[j] - total[first] > BATCH_BYTES:
            yield slice(first, i)
            first = i
    if first < len(sub):
        yield slice(first, len(sub))


def coverage(first: np.ndarray, window: int, blobs: list[bytes]) -> np.ndarray:
    """Which units of a chunk some removed window covers."""
    step = np.zeros(int(first[-1]) + 1, np.int32)
    for blob in blobs:
        doc, unit, count = unsqueeze(blob)
        at = first[doc.astype(np.int64)] + unit.astype(np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + count.astype(np.int64) + window - 1, -1)
    return np.cumsum(step[:-1], out=step[:-1]) > 0


def sums_at(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many flags there are before each place."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[places].astype(np.int64)


#: From a chunk's rows and what was found of them (n_units, n_removed, n_spans, kept): the rows to return.
Finish = Callable[[pa.Table, dict[str, pa.Array]], pa.Table]


def applier(kind: Kind, id_col: str, text_col: str, finish: Finish | None):
    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, _, data, offsets = load(blob.as_buffer(), id_col, text_col)
                text = split(kind, data, offsets)
                first = text.first
                gone = coverage(first, kind.window, spans or [])
                total = sums_at(gone, first)
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[first[:-1][first[:-1] < len(gone)]] = gone[first[:-1][first[:-1] < len(gone)]]
                heads = sums_at(head, first)
                del head
                if kind.unit == "byte":
                    kept, at = text.data[~gone], first - total
                else:
                    size = text.ends - text.starts + 1
                    size[gone] = 0
                    keep = np.repeat(~gone, text.ends - text.starts + 1)
                    ends = np.concatenate([[0], np.cumsum(size)])[first]
                    some = np.flatnonzero(np.diff(ends))  # their last space goes
                    last = np.zeros(int(ends[-1]), bool)
                    last[ends[1:][some] - 1] = True
                    kept = text.data[keep][~last]
                    at = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
                counts = {"n_units": np.diff(first), "n_removed": np.diff(total), "n_spans": np.diff(heads)}
                found = {n: pa.array(x, pa.int64()) for n, x in counts.items()} | {"kept": binary_column(kept, at, pa.binary())}
                out = finish(rows, found) if finish else pa.table([*rows.columns, *found.values()], [*rows.column_names, *found])
                yield from out.to_batches()

    return apply


def cut_repeats(docs: DataFrame, id_col: str, text_col: str, kind: Kind, evaluate: Evaluator, hot: int | None = None, part_chunks: int = PART_CHUNKS, finish: Finish | None = None) -> DataFrame:
    """docs with n_units, n_removed, n_spans (long) and kept (binary); these names replace columns that docs has. finish
    makes rows with the columns of docs from them instead. hot: runs beyond which a minimiser is hot, by default from the
    buckets' share of the text."""
    integral(docs, id_col)
    docs = docs if finish else docs.drop("n_units", "n_removed", "n_spans", "kept")
    chunks = stored(docs.mapInArrow(packer(text_col), "chunk long, bytes long, rows binary"), "chunks")
    size, number = chunks.agg(F.sum("bytes"), F.count("*")).first()
    buckets = max(2 * partitions(docs.sparkSession), -(-(size or 0) // BUCKET_BYTES), 1)
    hot = max(HOT, (size or 0) // buckets // HOT_BYTES) if hot is None else hot
    hot_parts = -(-number // part_chunks)
    labels = even_labels(buckets, max(partitions(docs.sparkSession), 1))
    chunks = chunks.select("chunk", "rows")
    flags = (
        chunks.mapInArrow(counter(kind, id_col, text_col, buckets), "bucket int, chunk long, blob binary")
        .groupBy("bucket").applyInArrow(flagger(hot), "chunk long, bucket int, blob binary")
        .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("flags"))
    )
    verdicts = (
        chunks.join(flags.hint("shuffle_hash"), "chunk")
        .mapInArrow(sender(kind, id_col, text_col, labels, hot_parts), "bucket long, chunk long, decided boolean, blob binary")
        .groupBy("bucket").applyInArrow(judge_with(evaluate, hot_parts), "home long, blob binary")
    )
    if hot_parts > 1:
        verdicts = verdicts.groupBy("home").applyInArrow(meet, "home long, blob binary")
    spans = verdicts.groupBy(F.col("home").alias("chunk")).agg(F.collect_list("blob").alias("spans"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (
        chunks.join(spans.hint("shuffle_hash"), "chunk", "left").select("rows", "spans")
        .mapInArrow(applier(kind, id_col, text_col, finish), schema if finish else f"{schema}, n_units long, n_removed long, n_spans long, kept binary")
    )
