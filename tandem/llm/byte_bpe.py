"""Byte-level BPE encoding and decoding (operator 8).

The vocabulary's ranks become a sentencepiece BPE model: each piece is the token's bytes mapped to printable characters,
its score the negative rank, so that merging by best score is merging by lowest rank. Pre-tokens are encoded one by
one; ids are the ranks. Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.util import binary_column, slices, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE_BYTES = 2 << 20
CACHE_BYTES = 32 << 20  # of pre-tokens and their ids, as held, that a task keeps
ENTRY_BYTES = 200  # of one pre-token and its ids beside their letters


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value & (1 << 64) - 1)


def varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model in which the piece of id i is tokens[i]; the unknown piece comes last."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    parts = [field(1, field(1, "".join(chars[b] for b in t).encode()) + field(2, -float(i)) + field(3, normal)) for i, t in enumerate(tokens)]
    parts.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, unknown)))
    trainer = field(3, bpe) + field(4, len(tokens) + 1) + field(40, len(tokens)) + field(41, -1) + field(42, -1) + field(43, -1)
    normalizer = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(parts) + field(2, trainer) + field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.find = regex.compile(pattern).findall
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        if new := list(set(pieces).difference(self.known)):
            size = sum(map(len, new)) * 4 + ENTRY_BYTES * len(new)
            if self.held + size > CACHE_BYTES:
                self.known, self.held, new = {}, 0, list(set(pieces))
            self.held += size
            mapped = [p.encode().decode("latin-1").translate(self.characters) for p in new]
            for piece, ids in zip(new, self.model.encode(mapped, num_threads=1), strict=True):
                self.known[piece] = np.array(ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # the place in the joined vocabulary moves by one within a token, and jumps between tokens
        step = np.ones(total, np.int64)
        if total:
            step[0] = self.starts[ids[0]]
            step[ends[:-1]] = self.starts[ids[1:]] - self.starts[ids[:-1]] - sizes[:-1] + 1
        return self.joined[np.cumsum(step)]


def tokenize(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, decode: bool = True) -> DataFrame:
    """Encode each text by the ranks in `path` (a file that every executor has), each match of `pattern` by itself and
    without special tokens; then decode the ids again.

    Returns every row and column of docs with n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) and,
    with decode, decoded (binary); columns of docs with these names are replaced. Null and empty texts have no tokens.
    Rows are treated each by itself, whatever their ids; a text is encoded whole, however long. An empty table gives an
    empty result.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    docs = docs.drop("n_tokens", "ids", "decoded")
    names = docs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                ids = [bpe.encode(t) if t else b"" for t in part.column(text_col).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64) // 4
                columns = [*part.columns, pa.array(sizes), pa.array(ids, pa.binary())]
                if decode:
                    flat = np.frombuffer(b"".join(ids), "<u4")
                    at = np.concatenate([[0], np.cumsum(bpe.sizes[flat])])[np.concatenate([[0], np.cumsum(sizes)])]
                    columns.append(binary_column(bpe.decode(flat), at, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids", *["decoded"] * decode])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, n_tokens long, ids binary" + ", decoded binary" * decode)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
