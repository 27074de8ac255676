"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 8).

Each pre-token is merged by a segment tree over the ranks of its adjacent pairs: the root holds
the leftmost pair of lowest rank, a merge updates a logarithmic number of nodes, and the work on
a pre-token of n bytes is O(n log n), also for one that fills a whole document. Short pre-tokens
repeat, so each worker keeps a bounded memory of their encodings; it never changes a result.

The vocabulary is fixed in size (50,256 entries, under 1 MB), so its file is read once on the
driver and broadcast. Null and empty texts give an empty list. Text that looks like a special
token is ordinary text. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The split pattern and the vocabulary of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = 1 << 62
_MEMORY = 1 << 17


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: merge the leftmost pair of lowest rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << max(0, (n - 1).bit_length())
    # A node holds rank * width + position, so the minimum is the lowest rank, leftmost first.
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int) -> None:
        j = after[i]
        rank = ranks.get(parts[i] + parts[j]) if j < n else None
        k = width + i
        tree[k] = _NONE if rank is None else rank * width + i
        k >>= 1
        while k:
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] % width
        j = after[i]
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        after[j] = n
        put(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts with one vocabulary; ``memory`` bounds how many short pre-tokens are remembered."""

    def __init__(self, ranks: dict[bytes, int], memory: int = _MEMORY):
        import regex

        self.ranks, self.memory, self.known = ranks, memory, {}
        self.split = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge_ranks(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 32:
                    if len(known) >= self.memory:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every row, one row a row of the input."""
    with open(vocabulary, "rb") as file:
        data = documents.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(data.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(read_ranks(data.value))
        encoder = _ENCODERS[key]
        for texts in batches:
            yield texts.map(encoder.encode, na_action=None)

    text = F.col(text_col)
    return documents.select(
        F.col(id_col),
        F.when(text.isNull() | (text == ""), F.array().cast("array<int>")).otherwise(encode(F.coalesce(text, F.lit("")))).alias("ids"),
    )
