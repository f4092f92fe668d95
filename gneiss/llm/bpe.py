"""Encoding of texts with a public byte-pair tokenizer.

The vocabulary is read from a file of ranks (base64 token, space, rank), whose path is a parameter. A text is parted by the
tokenizer's pattern; each part's bytes are a doubly linked list of symbols, and a priority queue of merge ranks says which pair
merges next. Entries whose symbols have changed by the time they come up are skipped. The work is n log n in the length of a part,
so one unbroken part of megabytes is no trap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the ranks of byte_bpe_50k lie.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which the public byte-level tokenizer parts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Parts kept with their ids in a worker's memory; beyond, the store starts afresh.
KEPT_PARTS = 200_000


class BytePairEncoder:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.part = regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty or null text an empty list."""
        ids: list[int] = []
        if not text:
            return ids
        kept = self.kept
        for part in self.part.findall(text):
            known = kept.get(part)
            if known is None:
                known = self.merge(part.encode("utf-8", "surrogatepass"))
                if len(part) <= 64:
                    if len(kept) >= KEPT_PARTS:
                        kept.clear()
                    kept[part] = known
            ids += known
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Ids of one part."""
        rank = self.rank
        whole = rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, left, pair = heappop(queue)
            if symbol[left] is None:
                continue
            right = after[left]
            if right >= n or len(symbol[left]) + len(symbol[right]) != len(pair) or symbol[left] + symbol[right] != pair:
                continue  # stale: one of the two has merged since
            symbol[left], symbol[right] = pair, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                joined = pair + symbol[follow]
                if (r := rank.get(joined)) is not None:
                    heappush(queue, (r, left, joined))
            back = before[left]
            if back >= 0:
                joined = symbol[back] + pair
                if (r := rank.get(joined)) is not None:
                    heappush(queue, (r, back, joined))
        return [rank[s] for s in symbol if s is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: their vocabulary strings put together."""
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str = RANKS) -> BytePairEncoder:
    """One encoder for each file and worker process."""
    return BytePairEncoder(path)


def encode_column(text: Column, path: str = RANKS) -> Column:
    """Token ids of a text column: ARRAY<INT>, never null; an empty list for empty and null texts."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoder(path)
        for part in texts:
            yield pd.Series([known.encode(t) for t in part], dtype=object)

    return ids(text)


def count_column(text: Column, path: str = RANKS) -> Column:
    """Number of tokens of a text column: BIGINT, 0 for empty and null texts."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoder(path)
        for part in texts:
            yield pd.Series([len(known.encode(t)) for t in part], dtype="int64")

    return count(text)


def decode_column(ids: Column, path: str = RANKS) -> Column:
    """The texts of lists of ids; null for a null list."""

    @F.pandas_udf("string")
    def texts(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoder(path)
        for part in lists:
            yield pd.Series([None if x is None else known.decode(list(x)) for x in part], dtype=object)

    return texts(ids)
