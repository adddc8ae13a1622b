"""Token counts by a linear longest-match automaton (operator 4).

The vocabulary's trie gets, for each node, a failure link and the number of pieces that taking it pops. Reading a word
then moves forward by one character at a time and never back, and adds up popped counts: the number of greedy
longest-match pieces without building any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tandem.llm.util import slices, tidy

VOCABULARY = "piece_bpe_32k.model"
START = "▁"  # pieces that begin a word start with this
SLICE_BYTES = 4 << 20
CACHE_BYTES = 32 << 20  # of words and their counts, as held, that a task keeps
ENTRY_BYTES = 120  # of one word and its count beside its letters
UNKNOWN = -1


class Automaton:
    """Pieces that begin a word hang from node 0, all others from node 1."""

    def __init__(self, pieces: list[str]):
        self.child: dict[tuple[int, str], int] = {}
        self.fail: list[int | None] = [None, None]
        self.pops = [0, 0]
        final, level = [False, False], [(0, None, None), (1, None, None)]
        levels: list[list[tuple[int, int, str]]] = []
        for piece in pieces:
            if not piece:
                continue
            at = 0 if piece[0] == START else 1
            for depth, c in enumerate(piece):
                to = self.child.get((at, c))
                if to is None:
                    to = self.child[at, c] = len(final)
                    final.append(False)
                    self.fail.append(None)
                    self.pops.append(0)
                    while len(levels) <= depth:
                        levels.append([])
                    levels[depth].append((to, at, c))
                at = to
            final[at] = True
        for level in levels:  # breadth first: the links of shorter strings are known
            for node, parent, c in level:
                if final[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                back, pops = self.fail[parent], self.pops[parent]
                while back is not None and (back, c) not in self.child:
                    pops += self.pops[back]
                    back = self.fail[back]
                if back is not None:
                    self.fail[node], self.pops[node] = self.child[back, c], pops

    def count(self, word: str) -> int:
        """Greedy pieces of a word that stands behind START; UNKNOWN if some part is no piece."""
        at, total, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for c in START + word:
            while (to := child.get((at, c))) is None:
                if fail[at] is None:
                    return UNKNOWN
                total += pops[at]
                at = fail[at]
            at = to
        while at != 1:
            if fail[at] is None:
                return UNKNOWN
            total += pops[at]
            at = fail[at]
        return total


def automaton(path: str) -> Automaton:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Automaton([model.id_to_piece(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))])


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Greedy longest-match piece counts of each text by the vocabulary in `path` (a file that every executor has).

    Words stand between white space (space, tab to carriage return). A word that the pieces can't spell counts as one
    unknown token. Returns every row and column of docs with n_words, n_tokens and n_unknown (long); columns of docs
    with these names are replaced. Null and empty texts have no words. Rows are treated each by itself, texts whole,
    however long. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("n_words", "n_tokens", "n_unknown")
    names = docs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        count, held = automaton(path).count, 0
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                rows = []
                for text in part.column(text_col).cast(pa.binary()).to_pylist():
                    words = text.split() if text else []
                    if new := set(words).difference(counts):
                        size = sum(map(len, new)) + ENTRY_BYTES * len(new)
                        if held + size > CACHE_BYTES:
                            counts, held, new = {}, 0, set(words)
                        held += size
                        counts.update((w, count(w.decode())) for w in new)
                    found = list(map(counts.__getitem__, words))
                    unknown = found.count(UNKNOWN)
                    rows.append((len(words), sum(found) + 2 * unknown, unknown))
                table = np.array(rows, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(table[:, i]) for i in range(3))], [*names, "n_words", "n_tokens", "n_unknown"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
