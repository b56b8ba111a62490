"""Seeded corruption with its ground truth. Which cells are hit follows a hash of seed, kind, row and column, so partitions do not matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import ROW, as_text, data_columns

TRUTH = "row bigint, column string, original_value string, corrupted_value string, corruption_type string"


def _chance(seed: int, kind: str, column: str) -> Column:
    """A number from 0 to 1 per cell."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.lit(column), F.col(ROW)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _pick(seed: int, kind: str, column: str, options: list) -> Column:
    at = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(kind), F.lit(column), F.col(ROW)), F.lit(len(options)))
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (at + 1).cast("int"))


def _swap(v: Column, seed: int, column: str) -> Column:
    """Two neighbouring letters changed over."""
    at = (F.pmod(F.xxhash64(F.lit(seed + 2), F.lit(column), F.col(ROW)), F.greatest(F.length(v) - 2, F.lit(1))) + 2).cast("int")
    return F.concat(F.substr(v, F.lit(1), at - 1), F.substr(v, at + 1, F.lit(1)), F.substr(v, at, F.lit(1)), F.substr(v, at + 2))


def kinds(v: Column, seed: int, c: str) -> dict[str, Column]:
    """What each kind of corruption makes of a cell, null where it does not apply."""
    num = v.rlike(r"^[-+]?\d+(\.\d+)?$")
    word = v.rlike(r"^\p{L}[\p{L} ]{3,}$")
    day = v.rlike(r"^\d{4}-\d{2}-\d{2}")
    x = F.when(num, v.try_cast("double"))
    year, month, dom = F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2)
    return {
        "missing_value": F.when(v != "", F.lit("")),
        "invalid_range": F.when(num, _pick(seed, "r", c, ["-5", "999999"])),
        "invalid_date": F.when(day, F.concat(F.lit("22/13/"), year)),
        "type_inconsistency": F.when(num, _pick(seed, "t", c, ["Thirty", "N/A"])),
        "whitespace_inconsistency": F.when(word, F.concat(F.lit("  "), v, F.lit(" "))),
        "casing_inconsistency": F.when(word, F.when(v == F.upper(v), F.lower(v)).otherwise(F.upper(v))),
        "spelling_typo": F.when(word, _swap(v, seed, c)),
        "outlier": F.when(num, F.format_string("%.2f", x * 100)),
        "unit_suffix": F.when(num, F.concat(v, F.lit(" kg"))),
        "disguised_missing": F.when(v != "", _pick(seed, "d", c, ["N/A", "unknown", "-", "?"])),
        "mixed_date": F.when(day, F.concat_ws("/", dom, month, year)),
        "near_miss": F.when(word & (F.length(v) >= 6), F.concat(F.substr(v, F.lit(1), F.length(v) - 2), F.substr(v, F.length(v)))),
    }


def inject(df: DataFrame, rates: dict[str, float], seed: int = 42, columns: list[str] | None = None, duplicates: float = 0.0, traps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(corrupted table as text, truth). Of the kinds that would hit a cell the first by name does; repeats get new row ids above the old ones.

    traps adds columns that look defective and are right: codes with leading zeros and yes-no words of a fixed spelling.
    """
    text = as_text(df)
    cols = columns or data_columns(text)
    new: dict[str, Column] = {}
    how: dict[str, Column] = {}
    for c in cols:
        v = F.col(f"`{c}`")
        made = kinds(v, seed, c)
        hits = [(k, (_chance(seed, k, c) < r) & made[k].isNotNull() & (made[k] != v)) for k, r in sorted(rates.items())]
        how[c] = reduce(lambda acc, kh: F.when(kh[1], F.lit(kh[0])).otherwise(acc), reversed(hits), F.lit(None).cast("string"))
        new[c] = reduce(lambda acc, kh, made=made: F.when(kh[1], made[kh[0]]).otherwise(acc), reversed(hits), v)
    both = text.select(ROW, *[F.col(f"`{c}`").alias(c) for c in data_columns(text)], *[how[c].alias(f"_how_{i}") for i, c in enumerate(cols)], *[new[c].alias(f"_new_{i}") for i, c in enumerate(cols)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("original_value"), F.col(f"_new_{i}").alias("corrupted_value"), F.col(f"_how_{i}").alias("corruption_type")) for i, c in enumerate(cols)]))
    truth = both.select(F.col(ROW).alias("row"), cells.alias("_c")).select("row", "_c.*").filter("corruption_type is not null")
    at = {c: i for i, c in enumerate(cols)}
    out = both.select(ROW, *[F.col(f"_new_{at[c]}").alias(c) if c in at else F.col(f"`{c}`") for c in data_columns(text)])
    if traps:
        out = out.withColumn("trap_code", F.lpad(F.pmod(F.col(ROW), F.lit(997)).cast("string"), 5, "0")).withColumn("trap_flag", F.when(F.col(ROW) % 2 == 0, "Yes").otherwise("No"))
    if duplicates > 0:
        top = out.agg(F.max(ROW)).first()[0] or 0
        again = out.filter(_chance(seed, "duplicate", "__all__") < duplicates)
        copies = again.withColumn(ROW, F.col(ROW) + F.lit(top + 1))
        truth = truth.unionByName(copies.select(F.col(ROW).alias("row"), F.lit("__all__").alias("column"), F.lit(None).cast("string").alias("original_value"), F.lit(None).cast("string").alias("corrupted_value"), F.lit("exact_duplicate").alias("corruption_type")))
        out = out.unionByName(copies)
    return out, truth
