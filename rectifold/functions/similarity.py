"""String similarities that have no built-in: Arrow-batched, for small candidate sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """200 times the longest common subsequence over both lengths; two empty texts are alike."""
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 200.0 * _common(a, b) / n if n else 100.0


def sorted_words(c: Column | str) -> Column:
    """A text's words in order, what token_sort_ratio compares."""

    @F.pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(t.split())) if t is not None else None for t in x], dtype="object")

    return f(c)


def _numbered(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """A row of letter numbers per text; the number after the last one fills up."""
    out = np.full((len(texts), max(map(len, texts), default=0)), len(alphabet), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.searchsorted(alphabet, np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32))
    return out


def _bags(numbers: np.ndarray, letters: int) -> np.ndarray:
    """How often each text has each letter; above 64 letters several share a place, which only raises what two texts have in common."""
    out = np.zeros((len(numbers), min(64, letters)), dtype=np.int32)
    rows, at = np.nonzero(numbers < letters)
    np.add.at(out, (rows, numbers[rows, at] % 64), 1)
    return out


def _common_of_pairs(a: np.ndarray, la: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, letters: int) -> np.ndarray:
    """Longest common subsequences of a[i] and b[j], the bit-parallel recurrence of _common over all pairs at once, 64 letters a word."""
    words = max(1, -(-a.shape[1] // 64))
    masks = np.zeros((len(a), letters + 1, words), dtype=np.uint64)
    every = np.arange(len(a))
    for p in range(a.shape[1]):
        masks[every, a[:, p], p // 64] |= np.uint64(1 << (p % 64))
    masks[:, letters] = 0
    full = np.zeros((len(a), words), dtype=np.uint64)
    for w in range(words):
        k = np.clip(la - 64 * w, 0, 64)
        full[:, w] = np.where(k == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    s = [full[i, w] for w in range(words)]
    for p in range(b.shape[1]):
        m = masks[i, b[j, p]]
        carry = None
        for w in range(words):
            u = s[w] & m[:, w]
            t = s[w] + u
            over = t < u
            if carry is not None:
                t = t + carry
                over |= t < carry
            carry = over.astype(np.uint64)
            s[w] = t | (s[w] ^ u)
    return la[i] - sum(np.bitwise_count(s[w] & full[i, w]).astype(np.int64) for w in range(words))


def close_pairs(a: list[str], b: list[str], least: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio) of all a[i], b[j] whose ratio is at least `least`; of one list (same) i < j. Exact.

    A common subsequence is no longer than what both texts have in common as bags of letters, so pairs whose bags cannot reach the
    ratio are left out before the subsequence is computed.
    """
    seen = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a if same else [*a, *b])]
    alphabet = np.unique(np.concatenate(seen)) if seen else np.zeros(0, dtype=np.uint32)
    k = len(alphabet)
    na, nb = _numbered(a, alphabet), _numbered(b, alphabet)
    la, lb = (np.array([len(t) for t in x], dtype=np.int64) for x in (a, b))
    ba, bb = _bags(na, k), _bags(nb, k)
    small = np.int16 if max(na.shape[1], nb.shape[1]) < 2**15 else np.int32
    ba, bb = ba.astype(small), bb.astype(small)
    step = max(1, min(256, 32_000_000 // max(1, 8 * (k + 1) * -(-na.shape[1] // 64)), 4_000_000 // max(1, len(b))))
    found = []
    for lo in range(0, len(a), step):
        hi = min(len(a), lo + step)
        common = np.zeros((hi - lo, len(b)), dtype=small)
        for c in range(ba.shape[1]):
            common += np.minimum.outer(ba[lo:hi, c], bb[:, c])
        keep = 200.0 * common / (la[lo:hi, None] + lb[None, :]) >= least
        if same:
            keep &= np.arange(lo, hi)[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(keep)
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            sim = 200.0 * _common_of_pairs(na[lo:hi], la[lo:hi], nb, p, q, k) / (la[lo + p] + lb[q])
            ok = sim >= least
            found.append((lo + p[ok], q[ok], sim[ok]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def indel_ratio(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return f(a, b)


def token_sort_ratio(a: str, b: str) -> Column:
    """The ratio of the texts with their words in order."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        s = lambda t: " ".join(sorted(t.split())) if t is not None else None
        return pd.Series([ratio(s(p), s(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return f(a, b)
