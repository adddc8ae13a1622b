"""Near-dedup where most texts of a group are near to some others only, none of them to all."""

import random

import pytest

from tandem.llm import near_dups
from tests.llm.test_operators import brute_classes, frame, same


def cloud(seed, n, edits=3, size=200):
    """Copies of one text that is not among them, each with its own edits: similar at 0.7 to 0.85 to each other."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        copy = list(words)
        for k in r.sample(range(size), edits):
            copy[k] = f"new{i}x{k}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("rows_of_block", [1024, 16])
def test_links_far_from_all_hubs(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", rows_of_block)
    rows = cloud(1, 200)
    want = brute_classes(rows)
    assert 1 < len({c for _, c in want}) < 60  # comparing with hubs alone leaves 61
    assert same([(x.doc_id, x.class_id) for x in near_dups.near_dups(frame(spark, rows)).collect()], want)


def test_classes_with_one_id_all_stay(spark):
    rows = [(None, f"quite another text of six words {i}a {i}b") for i in range(3)]
    rows += [(7, f"and some more words that differ {i}c {i}d {i}e") for i in range(3)]
    rows += [(None, rows[0][1]), (7, rows[3][1]), (9, rows[3][1])]
    kept = near_dups.keep_first(frame(spark, rows)).collect()
    assert same([(x.doc_id, x.text) for x in kept], rows[:6])
