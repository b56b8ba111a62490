"""Byte-pair encoding of whole corpora with a public vocabulary: ids equal to the reference encoder's, as Arrow batches.

Two tiers. Words of the text (pre-tokens) that are vocabulary entries are resolved by a minimal perfect hash over the vocabulary,
many at once; the others are merged with a heap over linked bytes, in time n log n, so that very long words stay cheap.
The vocabulary file is read on the driver (its size is checked) and its tables are broadcast once.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import received, share

TOKENIZERS = "/opt/tokenizers"
MAX_VOCABULARY = 64 << 20  # bytes of a vocabulary file that may be broadcast
REMEMBERED = 200_000  # words a task remembers
LONGEST_REMEMBERED = 64  # characters
# The pattern that cuts a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PerfectHash:
    """A minimal perfect hash of n byte strings: every key has its own slot of n, a check value tells strangers apart.

    Keys fall into buckets by one hash. Each bucket of several keys, largest first, gets the first displacement that sends its keys to
    free slots; the buckets of one key take the slots that remain, named directly by a negative displacement.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = max(1, len(keys))
        self.buckets = b = max(1, n // 3)
        h = self.hashes(keys)
        home = (h[:, 0] % np.uint64(b)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(b + 1))
        self.seed = np.zeros(b, dtype=np.int64)
        self.value = np.full(n, -1, dtype=np.int64)
        self.check = np.zeros((n, 2), dtype=np.uint64)
        free = np.ones(n, dtype=bool)
        vals = np.asarray(values, dtype=np.int64)
        sizes = np.diff(starts)
        for x in sorted(np.flatnonzero(sizes > 1).tolist(), key=lambda i: -sizes[i]):
            own = order[starts[x] : starts[x + 1]]
            at, step = 1, 256
            while True:
                ds = np.arange(at, at + step, dtype=np.uint64)
                slots = self._slots(h[own, 1][None, :], ds[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    line = np.sort(slots, axis=1)
                    good &= (line[:, 1:] != line[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    break
                at, step = at + step, min(1 << 14, step * 2)
            self.seed[x] = at + k
            free[slots[k]] = False
            self.value[slots[k]] = vals[own]
            self.check[slots[k]] = h[own]
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)[: len(single)]
        own = order[starts[single]]
        self.seed[single] = -rest - 1
        self.value[rest] = vals[own]
        self.check[rest] = h[own]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        """The two halves of a 128-bit hash per key."""
        raw = b"".join([xxhash.xxh3_128_digest(k) for k in keys])
        return np.frombuffer(raw, dtype="<u8").reshape(-1, 2)

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h ^ (d * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = x ^ (x >> np.uint64(32))
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 for a stranger (but for 128-bit collisions, which cannot be among the keys)."""
        if not keys:
            return np.empty(0, dtype=np.int64)
        h = self.hashes(keys)
        seed = self.seed[(h[:, 0] % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seed < 0, -seed - 1, self._slots(h[:, 1], seed.astype(np.uint64)))
        return np.where((self.check[slots] == h).all(axis=1), self.value[slots], -1)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of lowest rank (of equal ranks the leftmost) merges first. A heap over a linked list of parts."""
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= n or part[j] is None or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(both + part[k])) is not None:
                heapq.heappush(heap, (r, i, both + part[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
            heapq.heappush(heap, (r, h, part[h] + both))
    return [ranks[p] for p in part if p is not None]


def _utf8(word: str) -> bytes:
    try:
        return word.encode()
    except UnicodeEncodeError:
        return word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


class Encoder:
    """Encodes texts with a vocabulary of ranks, without special tokens: their strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) < 256 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all single bytes")
        self.ranks = ranks
        self.table = PerfectHash(list(ranks), list(ranks.values()))
        self.pattern = PATTERN
        self._known: dict[str, list[int]] = {}

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Lone surrogates become the replacement character, as the reference encoders do."""
        cut = regex.compile(self.pattern).findall
        known = self._known
        words = [cut(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in known})
        local: dict[str, list[int]] = {}
        raw = [_utf8(w) for w in new]
        for w, b, x in zip(new, raw, self.table.find(raw).tolist(), strict=True):
            local[w] = [x] if x >= 0 else merged(b, self.ranks)
        if len(known) < REMEMBERED:
            known.update((w, ids) for w, ids in local.items() if len(w) <= LONGEST_REMEMBERED)
        out = []
        for ws in words:
            ids: list[int] = []
            for w in ws:
                ids += known.get(w) or local[w]
            out.append(ids)
        return out


_LOADED: dict[tuple[str, float], Encoder] = {}


def load(path: str) -> Encoder:
    """The encoder of a rank file: lines of base64 bytes and a rank. A driver builds it once per file."""
    key = (path, os.path.getmtime(path))
    if key not in _LOADED:
        _LOADED[key] = _load(path)
    return _LOADED[key]


def _load(path: str) -> Encoder:
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that the words of one run fit in memory whatever the batch holds."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    return share(spark, load(os.path.join(folder, f"{name}.tiktoken")))


def ids_of(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The ids of a text as array<int>; null and empty texts have no ids: an empty array."""
    shared = encoder(spark, name, folder)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = received(shared)
        for s in batches:
            yield pd.Series([np.array(x, dtype=np.int32) for run in _slices(s.fillna("").tolist()) for x in own.batch(run)], dtype=object)

    return encode(text)


def sizes_of(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The number of ids of a text; 0 for null and empty texts."""
    shared = encoder(spark, name, folder)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = received(shared)
        for s in batches:
            yield pd.Series([len(x) for run in _slices(s.fillna("").tolist()) for x in own.batch(run)], dtype="int32")

    return count(text)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document; no shuffle, other columns are not read."""
    return docs.select(F.col(doc_id), ids_of(docs.sparkSession, F.col(text), name, folder).alias("ids"))


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {r: b for b, r in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
