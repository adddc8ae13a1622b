"""Substring dedup over word windows (operator 9): super-k-mer partitioning, sorting in the buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.spans import Kind, cut_repeats, same_strings, split_words, unit_hashes
from tandem.llm.util import U64, SpanHash, mix, ranges

WINDOW = 13
GRAM = 3


def sorted_windows(window: int):
    def evaluate(data: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort the windows of all strings; in each class of equal ones, those of a doc_id above the smallest are hits."""
        text = split_words(data, np.concatenate([[0], np.cumsum(size)]))
        words = unit_hashes(text, SpanHash(text.data))
        count = np.maximum(np.diff(text.first) - window + 1, 0)
        string = np.repeat(np.arange(len(size)), count)
        at = ranges(text.first[:-1], count)
        if not len(at):
            return at, at
        n = len(words) - window + 1
        name = np.zeros(n, U64)
        for i in range(window):
            name = name * U64(0xA0761D6478BD642F | 1) + words[i : i + n]
        name = mix(name)[at]
        order = np.lexsort((ids[string], name))
        name = name[order]
        head = np.ones(len(order), bool)
        head[1:] = name[1:] != name[:-1]
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = np.flatnonzero(ids[string[order]] > ids[string[first]])
        a, b = at[order[later]], at[first[later]]
        begin = text.starts[np.concatenate([a, b])]
        length = text.ends[np.concatenate([a, b]) + window - 1] - begin
        m = len(later)
        equal = length[:m] == length[m:]
        if equal.any():
            i = np.flatnonzero(equal)
            pair = np.concatenate([i, i + m])
            equal[i] = same_strings(text.data, begin[pair], length[pair], np.tile(np.arange(len(i)) + len(i), 2))[: len(i)]
        if not equal.all():  # two texts with one 64-bit hash: count this batch by the words themselves
            return by_words(text, string, at, ids, window)
        hit = order[later]
        return string[hit], at[hit] - text.first[string[hit]]

    return evaluate


def by_words(text, string: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    raw = text.data.tobytes()
    spans = [raw[a:b] for a, b in zip(text.starts[at].tolist(), text.ends[at + window - 1].tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for s, i in zip(spans, ids[string].tolist(), strict=True):
        least[s] = min(i, least.get(s, i))
    hit = np.array([i > least[s] for s, i in zip(spans, ids[string].tolist(), strict=True)], bool)
    return string[hit], (at - text.first[string])[hit]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove words covered by windows of `window` words that also start in a document with a smaller id.

    Words are maximal runs of anything but white space (space, tab to carriage return); they are compared unchanged.
    Returns every row and column of docs with n_words, n_removed, n_spans (long) and kept (string: kept words joined by
    one space); columns of docs with these names are replaced. Null text has no words. Ids are whole numbers (ValueError
    else). A null id comes after every other id and rows of one id never remove each other's words. Repeated rows are
    judged each by itself. Texts of any length are taken whole; a row must fit a task's memory several times. An empty
    table gives an empty result.
    """
    out = cut_repeats(docs, id_col, text_col, Kind("word", window, gram), sorted_windows(window))
    return out.drop("n_words").withColumnRenamed("n_units", "n_words").withColumn("kept", F.col("kept").cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
x as (select r, doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) as win from (select *, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})),
m as (select win, min(doc_id) as least from x group by win),
h as (select r, i from x join m using (win) where doc_id > least),
c as (select distinct r, j from (select r, unnest(range(i, i + {WINDOW})) as j from h)),
u as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
k as (select r, string_agg(word, ' ' order by j) as kept, count(*) as n from u anti join c using (r, j) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (r)
"""
