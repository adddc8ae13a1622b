"""Suffix-array dedup over bytes (operator 3): bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.spans import Kind, cut_repeats
from tandem.llm.util import U64, ranges

WINDOW = 50
GRAM = 20


def suffix_order(data: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of joined strings and the rank of each suffix. data: 0 ends each string; left: bytes from each
    place to its string's end. Ends differ from each other and stand in order of the strings."""
    n = len(data)
    bits = U64(max(1, int(n).bit_length()))
    index = np.arange(n, dtype=U64)
    small = 3 * int(bits) <= 63
    mask = (U64(1) << bits) - U64(1)

    def ranked(key: np.ndarray) -> np.ndarray:
        """Dense ranks from 1."""
        if small:
            s = np.sort(key << bits | index)
            order, key = (s & mask).astype(np.int64), s >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        step = np.ones(n, np.int64)
        step[1:] = key[1:] != key[:-1]
        rank = np.empty(n, U64)
        rank[order] = np.cumsum(step).astype(U64)
        return rank

    four = np.zeros(n, U64)
    for i in range(4):  # what lies beyond a string's end counts as 0
        part = np.zeros(n, U64)
        part[: n - i] = data[i:]
        part[left < i] = 0
        four = four << U64(8) | part
    rank, have = ranked(four), 4
    while have < longest + 1:
        nxt = np.zeros(n, U64)
        nxt[: n - have] = rank[have:]
        nxt[left < have] = 0
        rank = ranked(rank << bits | nxt)
        have *= 2
    s = np.argsort(rank << bits | index) if not small else (np.sort(rank << bits | index) & mask).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[s] = np.arange(n)
    return s, rank


def bounded_lcp(data: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, strings: int, least: int) -> np.ndarray:
    """Where, in suffix order, neighbours share fewer than `least` bytes.

    Intervals of suffixes that start with one string w are expanded backward, breadth first: for each byte c before
    them, the interval of cw follows from the last-to-first map. All strings of one length are expanded together, so
    boundaries appear by increasing common prefix; an interval whose end is known already isn't expanded further, and
    the search stops at `least`. Every boundary ends one expansion, so the work grows with the number of bytes.
    """
    n = len(data)
    before = data[suffixes - 1]  # place -1 is the last string's end: no byte before the first place
    last_to_first = rank[suffixes - 1]
    first = data[suffixes]
    known = np.zeros(n + 1, bool)
    known[: strings + 1] = True  # the ends of strings
    known[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    owner = np.empty(n, np.int32)
    for shared in range(least):
        if shared == 1:  # each string's end is a byte of its own
            lo, hi = np.append(np.arange(strings), lo), np.append(np.arange(strings) + 1, hi)
        place = ranges(lo, hi - lo)
        who = np.repeat(np.arange(len(lo), dtype=np.int32), hi - lo)
        keep = before[place] != 0
        to = last_to_first[place[keep]]
        owner[to] = who[keep]
        to = np.sort(to)
        if not len(to):
            break
        head = np.ones(len(to), bool)
        head[1:] = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]])
        at = np.flatnonzero(head)
        lo, hi = to[at], to[np.append(at[1:], len(to)) - 1] + 1
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        known[hi] = True
    known[n] = True
    return known


def interval_classes(window: int):
    def evaluate(text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strings = len(size)
        end = np.cumsum(size + 1)
        data = np.zeros(int(end[-1]), np.uint8)
        own = np.ones(len(data), bool)
        own[end - 1] = False
        # UTF-8 has no byte 255, so adding one frees 0 for the ends of strings
        data[own] = text + np.uint8(1)
        string = np.repeat(np.arange(strings), size + 1)
        left = end[string] - 1 - np.arange(len(data))
        suffixes, rank = suffix_order(data, left, int(size.max()))
        known = bounded_lcp(data, suffixes, rank, strings, window)
        head = known[:-1]
        at = np.flatnonzero(head)
        id_at = ids[string[suffixes]]
        least = np.repeat(np.minimum.reduceat(id_at, at), np.diff(np.append(at, len(data))))
        hit = suffixes[(id_at > least) & (left[suffixes] >= window)]
        return string[hit], hit - (end[string[hit]] - size[string[hit]] - 1)

    return evaluate


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove bytes covered by strings of `window` bytes that also start in a document with a smaller id.

    Returns every row and column of docs with n_bytes, n_removed, n_spans (maximal removed runs, long) and kept (binary:
    the remaining bytes, which may cut a character); columns of docs with these names are replaced. Null text is empty.
    Ids are whole numbers (ValueError else). A null id comes after every other id and rows of one id never remove each
    other's bytes. Repeated rows are judged each by itself. Texts of any length are taken whole; a row must fit a task's
    memory several times. An empty table gives an empty result.
    """
    out = cut_repeats(docs, id_col, text_col, Kind("byte", window, gram), interval_classes(window))
    return out.drop("n_bytes").withColumnRenamed("n_units", "n_bytes")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeats cut from their texts. Bytes left of a character that was cut in two go too; texts without a
    repeat stay as they are, null ones too. Every other column stays, whatever its name."""
    names = docs.columns

    def decode(rows: pa.Table, found: dict[str, pa.Array]) -> pa.Table:
        texts = [k.decode(errors="ignore") if n else t for t, k, n in zip(rows.column(text_col).to_pylist(), found["kept"].to_pylist(), found["n_removed"].to_pylist(), strict=True)]
        return pa.table([pa.array(texts, pa.string()) if c == text_col else rows.column(c) for c in names], names)

    return cut_repeats(docs, id_col, text_col, Kind("byte", window, gram), interval_classes(window), finish=decode)


ORACLE_SQL = f"""
with w as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
x as (select r, doc_id, i, array_slice(b, i, i + {WINDOW - 1}) as win from (select *, unnest(range(1, octet_length(b) - {WINDOW - 2})) as i from w where octet_length(b) >= {WINDOW})),
m as (select win, min(doc_id) as least from x group by win),
h as (select r, i from x join m using (win) where doc_id > least),
s as (select r, i, i > coalesce(max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding), -1000) + {WINDOW} as head from h),
g as (select r, i, sum(cast(head as int)) over (partition by r order by i) as g from s),
runs as (select r, min(i) as a, max(i) + {WINDOW} as z from g group by r, g),
n as (select r, sum(z - a) as removed, count(*) as spans from runs group by r),
gaps as (select r, lag(z, 1, 1) over (partition by r order by a) as a, a as z from runs union all select r, max(z), octet_length(any_value(b)) + 1 from runs join w using (r) group by r),
k as (select r, string_agg(case when z > gaps.a then hex(array_slice(b, gaps.a, z - 1)) else '' end, '' order by gaps.a) as kept from gaps join w using (r) group by r)
select doc_id, octet_length(b) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, case when kept is null then sha256(b) else sha256(unhex(kept)) end as kept_sha256
from w left join n using (r) left join k using (r)
"""
