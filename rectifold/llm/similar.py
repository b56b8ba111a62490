"""String similarity for typed text: longest common subsequence and weighted edit distance, on Python integers and lists."""

from __future__ import annotations

import unicodedata

# Neighbours on a keyboard, row by row.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
# Spellings that sound alike.
SOUNDS = (("ph", "f"), ("ee", "i"), ("oo", "u"), ("aa", "a"), ("c", "k"), ("w", "v"), ("q", "k"), ("y", "i"), ("dh", "d"), ("th", "t"), ("z", "s"))


def memo(limit: int):
    """Remembers up to `limit` results of a function of hashable arguments. A plain closure, so that it travels to workers by value."""

    def wrap(f):
        known: dict = {}

        def inner(*args):
            hit = known.get(args, known)
            if hit is known:
                hit = f(*args)
                if len(known) < limit:
                    known[args] = hit
            return hit

        inner.__doc__ = f.__doc__
        return inner

    return wrap


ASCII_WORDS = {i: " " for i in range(128) if not chr(i).isalnum()}


def plain(s: str) -> str:
    """Case-folded without accents; letters and digits stay, all else becomes one space."""
    if s.isascii():
        return " ".join(s.lower().translate(ASCII_WORDS).split())
    out = []
    for ch in unicodedata.normalize("NFKD", s.casefold()):
        if ch.isalnum():
            out.append(ch)
        elif not unicodedata.combining(ch):
            out.append(" ")
    return " ".join("".join(out).split())


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths: 1 for equal texts, 1 for two empty ones."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


_AT = {ch: (r, i + 0.4 * r) for r, row in enumerate(KEY_ROWS) for i, ch in enumerate(row)}


# Pairs of keys beside each other.
_BESIDE = frozenset(a + b for a, p in _AT.items() for b, q in _AT.items() if abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.1)


def typing_distance(a: str, b: str, most: float = 9.0) -> float:
    """Weighted Damerau-Levenshtein: doubled letters 0.6, swaps of neighbours 0.8, keys beside each other 0.8, all else 1; above `most` any larger value."""
    if abs(len(a) - len(b)) * 0.6 > most:
        return most + 1
    two: list[float] = []
    one = [0.0]
    for j in range(1, len(b) + 1):
        one.append(one[-1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        gone = 0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0
        row = [one[0] + gone]
        for j in range(1, len(b) + 1):
            come = 0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0
            best = min(one[j] + gone, row[j - 1] + come, one[j - 1] + (0.0 if a[i - 1] == b[j - 1] else 0.8 if a[i - 1] + b[j - 1] in _BESIDE else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                best = min(best, two[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def sounded(s: str) -> str:
    """s with each sound written one way, and letters that follow themselves once."""
    for a, b in SOUNDS:
        if a in s:
            s = s.replace(a, b)
    if all(x != y for x, y in zip(s, s[1:], strict=False)):
        return s
    return "".join(ch for i, ch in enumerate(s) if not i or ch != s[i - 1])
