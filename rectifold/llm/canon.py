"""Maps freely typed values to the entries of a reference list, and reports what has no match.

A reference list of up to MAX_ENTRIES entries, counted, is broadcast once with its symmetric-delete index, and every task looks values up by
itself: no shuffle at all, each distinct value of a batch once. A longer list is cut into parts of that size; each distinct value is looked up in every
part and the best of its answers counts, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..operators.hot import attach
from ..session import received, share, written
from .similar import lcs, plain, sounded, typing_distance

MAX_ENTRIES = 10_000  # reference entries that may be broadcast at a time
MEMO = 50_000  # distinct values a task remembers

# Words beside an entry's name that change nothing.
BESIDE = {
    "city": {"city", "near", "dist", "district", "east", "west", "north", "south", "town"},
    "department": {"dept", "department", "team", "hq", "of", "the", "div", "division"},
    "fuel_type": {"only", "engine", "fuel", "car", "type"},
}
JOINERS = {"and", "n", "the", "of"}


def _deletes(s: str, d: int) -> set[str]:
    """s and everything that is left when up to d letters go."""
    level = out = {s}
    for _ in range(min(d, len(s))):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


CHEAPEST = 0.6  # the least an edit costs in typing_distance
DEAREST_PAIR = 0.8  # the least it costs to rid a text of a letter altogether
SCANNED = 1000  # names up to which the letters of all are compared and the index is not asked; the answers are the same
PREFIX = 7  # letters at the beginning that are indexed: two texts within d edits share a form of their beginnings with up to d letters deleted


def _most(n: int) -> float:
    """The largest typing distance at which a text means a name, n being the shorter length of both."""
    return 0.85 if n <= 3 else 1.0 if n <= 5 else 2.0 if n <= 11 else 2.6 if n <= 14 else 3.0


MOST = np.array([_most(n) for n in range(16)])  # by the shorter length, the last for all longer ones


def _bound(n: int) -> int:
    """How many edits fit into the largest distance of a text of n characters, none costing less than CHEAPEST: so many letters may have to go on either side."""
    return int(_most(n) / CHEAPEST + 1e-9)


def _letters(s: str) -> int:
    """The letters of a text as a set of bits."""
    bits = 0
    for ch in s:
        bits |= 1 << (ord(ch) & 63)
    return bits


def _least(a: int, b: int) -> float:
    """What two texts with these letters cost at least: a letter the other text lacks must be dropped or replaced, a replacement removes one of each side."""
    return DEAREST_PAIR * max((a & ~b).bit_count(), (b & ~a).bit_count())


def _apart(a: str, b: str) -> float:
    """What two texts cost at least by the letters outside their longest common subsequence: a replacement or a swap removes two of them, any other edit one."""
    return DEAREST_PAIR / 2 * (len(a) + len(b) - 2 * lcs(a, b))


class Dictionary:
    """Names and aliases of the entries of one field, with the symmetric-delete index over them."""

    def __init__(self, field: str, entries: list[tuple[int, str, str | None]], frequency: dict[int, int] | None = None):
        self.beside, self.freq = BESIDE.get(field, set()), frequency or {}
        self.exact: dict[str, int] = {}
        self.names: list[tuple[str, int, bool]] = []
        self.words: dict[int, list[str]] = {}
        self.deletes: dict[str, list[int]] = {}
        for ref, canonical, aliases in sorted(entries):
            for k, name in enumerate([canonical, *(aliases or "").split("|")]):
                p = plain(name)
                if not p:
                    continue
                if not k:
                    self.words[ref] = p.split()
                for form in {p, p.replace(" ", ""), " ".join(sorted(p.split())), "".join(w for w in p.split() if w not in JOINERS)}:
                    self.exact.setdefault(form, ref)
                joined = p.replace(" ", "")
                self.names.append((joined, ref, bool(k)))
        for i, (joined, _, alias) in enumerate(self.names):
            if alias and len(joined) <= 4:
                continue  # codes of a few letters lie too close together for typing errors
            for form in {joined, sounded(joined)}:
                for x in _deletes(form[:PREFIX], _bound(len(joined))):
                    self.deletes.setdefault(x, []).append(i)
        self.lengths = {len(joined) for joined, _, _ in self.names}
        self.heard = [(sounded(joined), _letters(joined), _letters(sounded(joined))) for joined, _, _ in self.names]
        self.heard_lengths = {len(h) for h, _, _ in self.heard}
        # as written and as they sound
        self.sizes = np.array([[len(x) for x, _, _ in self.names], [len(h) for h, _, _ in self.heard]], dtype=np.int64)
        self.bits = np.array([[x for _, x, _ in self.heard], [x for _, _, x in self.heard]], dtype=np.uint64)
        self.memo: dict[str, int] = {}

    def find(self, value: str) -> int:
        """The id of the entry the value means, 0 for none. Ties: the smaller distance, the more frequent entry, the smaller id."""
        return chosen([self.ranked(value)])

    def ranked(self, value: str) -> tuple[float, float, float, int]:
        """(step, order within it, less the frequency, id) of the best answer; of cut-short values (step 3) the order is the number of entries that fit."""
        hit = self.memo.get(value)
        if hit is None:
            hit = self._ranked(value)
            if len(self.memo) < MEMO:
                self.memo[value] = hit
        return hit

    def _ranked(self, value: str) -> tuple[float, float, float, int]:
        words = plain(value).split()
        if not words:
            return NOTHING
        bare = [w for w in words if w not in self.beside] or words
        both = [words] + ([bare] if bare != words else [])
        forms = [f for ws in both for f in (" ".join(ws), "".join(ws), " ".join(sorted(ws)), "".join(w for w in ws if w not in JOINERS))]
        for i, form in enumerate(forms):
            if form in self.exact:
                return 0, i, 0, self.exact[form]
        near = [got for ws in both for joined in dict.fromkeys(("".join(ws), "".join(sorted(ws)))) if (got := self._near(joined))]
        if near:
            return 1, *min(near)
        if len(words) == 1:
            for i, w in enumerate(sorted(self.beside)):
                for cut in (words[0].removesuffix(w), words[0].removeprefix(w)):
                    if len(w) >= 4 and cut in self.exact and cut != words[0]:
                        return 2, i, 0, self.exact[cut]
        return self._shortened(bare, value.rstrip().endswith("."))

    def near_ids(self, joined: str) -> set[int]:
        """Names that share a form of their beginning, as written or as it sounds, with up to the bound of letters deleted: all that can lie within the largest distance."""
        bound, heard = _bound(len(joined)), sounded(joined)
        span = range(-bound, bound + 1)
        if not any(len(joined) + k in self.lengths or len(heard) + k in self.heard_lengths for k in span):
            return set()  # no name within the bound has such a length
        return {i for f in {joined, heard} for x in _deletes(f[:PREFIX], bound) for i in self.deletes.get(x, ())}

    def _alike(self, joined: str, heard: str, ids: set[int] | None) -> dict[int, float]:
        """Names, of all or of some, whose letters and length leave them within the largest distance, as written or as they sound, with the least they can be apart."""
        at = slice(None) if ids is None else np.fromiter(ids, dtype=np.int64, count=len(ids))
        sizes, bits = self.sizes[:, at], self.bits[:, at]
        own = np.array([[_letters(joined)], [_letters(heard)]], dtype=np.uint64)
        lacking = np.maximum(np.bitwise_count(own & ~bits), np.bitwise_count(bits & ~own))
        as_written, as_heard = np.maximum(DEAREST_PAIR * lacking, CHEAPEST * np.abs(sizes - [[len(joined)], [len(heard)]]))
        least = np.minimum(as_written, as_heard + 0.3)
        close = np.flatnonzero(least <= MOST[np.minimum(sizes[0], min(len(joined), len(MOST) - 1))] + 1e-9)
        return dict(zip((close if ids is None else at[close]).tolist(), least[close].tolist(), strict=True))

    def _meets(self, i: int, joined: str, heard: str) -> bool:
        """Whether name i is among near_ids(joined), without the deletes: two beginnings have one in common if their common subsequence is no shorter than either may become."""
        name, _, alias = self.names[i]
        if alias and len(name) <= 4:
            return False
        bound, own = _bound(len(joined)), _bound(len(name))
        begins, forms = ({x[:PREFIX] for x in both} for both in ((joined, heard), (name, self.heard[i][0])))
        return any(lcs(f, x) >= max(len(f) - bound, len(x) - own) for f in begins for x in forms)

    def _near(self, joined: str, ids: set[int] | None = None) -> tuple | None:
        best = None
        heard = sounded(joined)
        scan = ids is None and len(self.names) <= SCANNED
        if ids is None and not scan:
            ids = self.near_ids(joined)
        alike = self._alike(joined, heard, ids)
        if not alike:
            return None
        own, own_heard = _letters(joined), _letters(heard)
        for least, i in sorted((least, i) for i, least in alike.items()):
            name, ref, _ = self.names[i]
            name_heard, letters, letters_heard = self.heard[i]
            n = min(len(name), len(joined))
            most = _most(n)
            if n <= 4 and joined[0] != name[0]:
                continue
            # a distance beyond the best one so far need not be known
            limit = most if best is None else min(most, best[0] + 0.001)
            if least > limit + 1e-9:
                continue
            as_written = _least(own, letters) <= limit + 1e-9 and _apart(joined, name) <= limit + 1e-9
            as_heard = _least(own_heard, letters_heard) <= limit - 0.3 + 1e-9 and _apart(heard, name_heard) <= limit - 0.3 + 1e-9
            if not (as_written or as_heard) or (scan and not self._meets(i, joined, heard)):
                continue
            d = typing_distance(joined, name, limit) if as_written else most + 1
            if as_heard:
                d = min(d, 0.3 + typing_distance(heard, name_heard, limit - 0.3))
            if d <= limit + 1e-9:
                key = (round(d, 3), -self.freq.get(ref, 0), ref)
                best = key if best is None or key < best else best
        return best

    def _shortened(self, words: list[str], dotted: bool) -> tuple[float, float, float, int]:
        """Entries whose words begin with the given ones (the last cut short): only where exactly one entry fits."""
        if len("".join(words)) < 3 or (len(words) == 1 and len(words[0]) < (3 if dotted else 4)):
            return NOTHING
        fits = []
        for ref, own in self.words.items():
            if len(words) <= len(own) and all(o == w or (len(w) >= 3 and len(words) == len(own) and o.startswith(w)) for o, w in zip(own, words[:-1], strict=False)) and own[len(words) - 1].startswith(words[-1]) and (dotted or len(words) > 1 or len(words[0]) >= 5):
                fits.append(ref)
        return (3, len(fits), 0, min(fits)) if fits else NOTHING


NOTHING = (9, 0, 0, 0)


def chosen(answers: list[tuple[float, float, float, int]]) -> int:
    """The id that the answers of all parts of a list agree on: the best of them, of cut-short values only a single fit."""
    best = min(answers, default=NOTHING)
    if best[0] == 3 and sum(a[1] for a in answers if a[0] == 3) != 1:
        return 0
    return int(best[3])


def dictionary(ref: DataFrame, field: str, used: DataFrame | None = None, column: str | None = None) -> Dictionary:
    """The dictionary of a field; the list's size is checked before it is collected. used[column] gives the entries' frequencies: one aggregation over exact uses."""
    rows = ref.filter(F.col("field_name") == field).select("ref_id", "canonical", "aliases").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list of {field} has more than {MAX_ENTRIES} entries")
    entries = [(r["ref_id"], r["canonical"] or "", r["aliases"]) for r in rows]
    freq: dict[int, int] = {}
    if used is not None:
        by_name = {c: i for i, c, _ in entries}
        exact = used.filter(F.col(column or field).isin(*by_name)).groupBy(F.col(column or field).alias("v")).count() if by_name else None
        freq = {by_name[r["v"]]: r["count"] for r in exact.collect()} if exact is not None else {}  # at most MAX_ENTRIES rows
    return Dictionary(field, entries, freq)


def map_values(df: DataFrame, column: str, book: Dictionary, out: str = "ref_id") -> DataFrame:
    """df with the entry each value means: 0 for none, null for a missing value. Exact uses of a name are resolved too."""
    shared = share(df.sparkSession, book)

    @F.pandas_udf("int")
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = received(shared)
        for s in batches:
            codes, uniques = pd.factorize(s)
            found = [own.find(u) for u in uniques]
            yield pd.Series([found[c] if c >= 0 else None for c in codes], dtype="Int32")

    return df.withColumn(out, F.when(~is_missing(F.col(column)), lookup(F.col(column))))


def map_either(df: DataFrame, first: str, second: str, book: Dictionary, out: str) -> DataFrame:
    """df with the id the first value means or, where it is given but means none, less the id that the second one means; 0 for neither. One pass for both."""
    shared = share(df.sparkSession, book)

    @F.pandas_udf("int")
    def lookup(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = received(shared)
        for a, b in batches:
            codes, uniques = pd.factorize(a)
            found = np.array([*(own.find(u) for u in uniques), 0], dtype=np.int32)[codes]  # the last is for null
            for i in np.flatnonzero((found == 0) & (codes >= 0) & b.notna().to_numpy()):
                found[i] = -own.find(b.iat[i])
            yield pd.Series(found)

    return df.withColumn(out, lookup(F.col(first), F.col(second)))


def _ranking(shared):
    @F.pandas_udf("array<double>")
    def ranked(s: pd.Series) -> pd.Series:
        own = received(shared)
        return s.map(lambda v: [float(x) for x in own.ranked(v)])

    return ranked


def map_by_parts(df: DataFrame, column: str, ref: DataFrame, field: str, out: str = "ref_id") -> DataFrame:
    """`map_values` for a reference list of any length: parts of MAX_ENTRIES entries in order of id, each looked up for every distinct value."""
    spark = df.sparkSession
    entries = ref.filter(F.col("field_name") == field).select("ref_id", "canonical", "aliases")
    used = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_uses"))
    values = written(used.filter(~is_missing(F.col("_v"))))
    uses = entries.join(values, F.col("canonical") == F.col("_v"), "left").groupBy("ref_id").agg(F.min("canonical").alias("canonical"), F.min("aliases").alias("aliases"), F.coalesce(F.max("_uses"), F.lit(0)).alias("_uses"))
    uses, last, found = written(uses), None, None
    while rows := uses.filter(F.col("ref_id") > last if last is not None else F.lit(True)).orderBy("ref_id").limit(MAX_ENTRIES).collect():
        last = rows[-1]["ref_id"]
        part = Dictionary(field, [(r["ref_id"], r["canonical"] or "", r["aliases"]) for r in rows], {r["ref_id"]: r["_uses"] for r in rows})
        part = values.select("_v", _ranking(share(spark, part))("_v").alias("_a"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.withColumn(out, F.when(~is_missing(F.col(column)), F.lit(0)))
    fits = F.sum(F.when(F.col("_a")[0] == 3, F.col("_a")[1]).otherwise(0))
    best = found.groupBy("_v").agg(F.min("_a").alias("_a"), fits.alias("_fits"))
    means = best.select(F.col("_v").alias("_value"), F.when((F.col("_a")[0] == 3) & (F.col("_fits") != 1), 0).otherwise(F.col("_a")[3]).cast("int").alias(out))
    return attach(df.drop(out), written(means), {column: "_value"})


def mapped_values(df: DataFrame, column: str, ref: DataFrame, row_id: str = "row_id", field: str | None = None) -> DataFrame:
    """(field_name, row_id, ref_id) of each value that is neither missing nor an entry's exact name; ref_id 0 reports a value without match."""
    field = field or column
    rows = df.select(F.col(row_id), F.col(column).alias("_v"))
    names = book_canonicals(ref, field)
    if names is None:
        exact = ref.filter(F.col("field_name") == field).select(F.col("canonical").alias("_c")).distinct().withColumn("_known", F.lit(True))
        typed = attach(map_by_parts(rows, "_v", ref, field), exact, {"_v": "_c"}).filter(F.col("ref_id").isNotNull() & F.col("_known").isNull())
    else:
        typed = map_values(rows.filter(~is_missing(F.col("_v")) & ~F.col("_v").isin(*names)), "_v", dictionary(ref, field, df, column))
    return typed.select(F.lit(field).alias("field_name"), F.col(row_id), "ref_id")


def book_canonicals(ref: DataFrame, field: str) -> list[str] | None:
    """The entries' names, None if there are more than MAX_ENTRIES."""
    rows = ref.filter(F.col("field_name") == field).select("canonical").limit(MAX_ENTRIES + 1).collect()
    return [r["canonical"] for r in rows] if len(rows) <= MAX_ENTRIES else None
