"""Byte-level BPE of whole corpora by a public vocabulary.

Merging follows a segment tree over the ranks of adjacent pairs: its root is the leftmost pair of lowest rank; a merge updates at most
three leaves, each in logarithmic time, until no pair can be merged. A piece of text without white space, however long, thus takes
O(n log n). Each distinct piece is merged once in a worker; the pieces of a text come from the vocabulary's pattern.

Defined cases: a null or empty text has no ids; unpaired surrogates can't occur in Spark strings; a text of blanks has the ids of its
blanks. Other columns of the input pass through `token_counts` and never clash, as results are built from the key and text alone.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import once, spread

TOKENIZERS = "/opt/tokenizers"
#: Pieces a worker keeps; beyond that it begins anew, so that memory is bounded whatever the corpus.
KEPT_PIECES = 400_000
#: White space as Unicode defines it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(initial: str) -> str:
    """A character class's body: all code points whose category starts with `initial`."""
    found, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            found.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def piece_pattern() -> str:
    """The vocabulary's splitting pattern, for Python's own `re`: letters and numbers are spelled out as ranges."""
    letter, number = _ranges("L"), _ranges("N")
    return f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece."""
    n = len(word)
    if n == 1:
        return (ranks[word],)
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size
    after, before = list(range(1, n + 2)), list(range(-1, n))
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # the smaller place wins among equal ranks
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            value = value if value < other else other
            if tree[k] == value:
                return
            tree[k] = value

    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        k = after[j]
        after[i], before[k] = k, i
        if j < n - 1 or tree[size + j] < none:
            put(j, none)
        r = get(word[i : after[k]]) if k < n else None
        put(i, none if r is None else r * size + i)
        if (h := before[i]) >= 0:
            r = get(word[h:k])
            put(h, none if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(out)


class Pieces(dict):
    """Ids of each piece seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = self[piece] = merge(piece.encode("utf-8"), self.ranks)
        return ids


class Lengths(dict):
    """Numbers of ids of each piece seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT_PIECES:
            self.clear()
        n = self[piece] = len(merge(piece.encode("utf-8"), self.ranks))
        return n


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(once(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row for each key: `key`, `ids array<int>`, without special tokens."""
    ranks, pattern = df.sparkSession.sparkContext.broadcast(load_ranks(name, folder)), piece_pattern()
    kind = df.schema[key].dataType

    def run(batches):
        pieces, split = Pieces(ranks.value), re.compile(pattern).findall
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(pieces.__getitem__, split(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["k", "ids"])

    return _prepared(df, key, text).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row for each key: `key`, the columns to keep, `n_tokens bigint`; 0 for a null or empty text."""
    ranks, pattern = df.sparkSession.sparkContext.broadcast(load_ranks(name, folder)), piece_pattern()
    src = spread(once(df.select(key, *keep, F.col(text).alias("__text")), key))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches):
        lengths, split = Lengths(ranks.value), re.compile(pattern).findall
        for b in batches:
            n = [sum(map(lengths.__getitem__, split(t))) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return src.mapInArrow(run, schema)
