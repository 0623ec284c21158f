"""Encoding of whole texts with a public byte-level BPE vocabulary.

A word's merges run over a contiguous array of part boundaries with the rank of every
adjacent pair beside it: scan for the smallest rank, delete the boundary, refresh the
two ranks next to it. Words of more than ``SHORT`` bytes, where scanning would be
quadratic, take the same merges from a heap. The ids of short words are remembered, so
a text costs about one dictionary look-up a word.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORT = 200
REMEMBER = 1 << 17
_NONE = 1 << 60

# Fixed value: the public pattern that splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of byte_bpe_50k as ranks; a parameter everywhere else."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def merge_short(word: bytes, rank_of) -> list[int]:
    """Token ids of a word by repeated scans of a contiguous rank array."""
    at = list(range(len(word) + 1))
    ranks = [rank_of(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while ranks:
        low = min(ranks)
        if low == _NONE:
            break
        i = ranks.index(low)
        del at[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank_of(word[at[i] : at[i + 2]], _NONE)
        if i:
            ranks[i - 1] = rank_of(word[at[i - 1] : at[i + 1]], _NONE)
    return [rank_of(word[a:b]) for a, b in zip(at, at[1:])]


def merge_long(word: bytes, rank_of) -> list[int]:
    """The same merges in the same order for a word of any length, from a heap."""
    n = len(word)
    nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2], _NONE)) != _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or (j := nxt[i]) == n or nxt[j] != end:
            continue
        live[j], nxt[i] = False, end
        if end < n:
            prv[end] = i
            if (r := rank_of(word[i : nxt[end]], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, nxt[end]))
        if (p := prv[i]) >= 0 and (r := rank_of(word[p:end], _NONE)) != _NONE:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(rank_of(word[i : nxt[i]]))
        i = nxt[i]
    return out


class Encoder:
    """Texts to token ids; strings that look like special tokens are ordinary text."""

    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, rank_of = self.known, self.ranks.get
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                raw = word.encode("utf-8", "replace")
                whole = rank_of(raw)
                if whole is not None:
                    ids = [whole]
                else:
                    ids = merge_short(raw, rank_of) if len(raw) <= SHORT else merge_long(raw, rank_of)
                if len(raw) <= SHORT:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    return Encoder(vocabulary)


def encode_corpus(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text; an empty list for empty and null texts.

    Narrow: one Arrow-batched pass, no shuffle. Other columns don't matter.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((x for one in ids for x in one), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    key = documents.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", key.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every text; 0 for empty and null texts."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    key = documents.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", key.dataType), T.StructField("n_tokens", T.LongType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
