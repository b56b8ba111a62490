"""Collapses records that differ in formatting only, and counts the copies of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_and_digits
from ..operators.hot import first_of_groups


def canonical_key(fields: list[str]) -> tuple:
    """Two independent 64-bit hashes of the sorted folded fields: equal whatever column each value stands in."""
    parts = F.array_sort(F.array(*[letters_and_digits(F.col(c).cast("string")) for c in fields]))
    text = F.array_join(parts, "\x1f")
    return F.xxhash64(F.lit(11), text), F.xxhash64(F.lit(77), text)


def membership(df: DataFrame, row_id: str, fields: list[str], hot_rows: int = 100_000) -> DataFrame:
    """(row_id, first_row_id) of every row: the smallest id of its record.

    Null counts as empty; rows whose fields are all empty are one record. Rows of hot keys (exact partial counts) are salted: a
    minimum per salt, a minimum of those, sent back by a broadcast of at most hot.MAX_HOT_KEYS rows, so they meet in no task. All
    other rows take one shuffle. Repeated ids are kept; extra columns are ignored; an empty table gives no rows.
    """
    k1, k2 = canonical_key(fields)
    keyed = df.select(F.col(row_id).alias("_id"), k1.alias("_k1"), k2.alias("_k2"))
    return first_of_groups(keyed, ["_k1", "_k2"], "_id", hot_rows, df.count()).select(F.col("_id").alias(row_id), F.col("first").alias("first_row_id"))


def copies(df: DataFrame, row_id: str, fields: list[str], hot_rows: int = 100_000) -> DataFrame:
    """(first_row_id, copy_row_id) of each row that is not its record's smallest id."""
    m = membership(df, row_id, fields, hot_rows)
    return m.filter(F.col(row_id) != F.col("first_row_id")).select("first_row_id", F.col(row_id).alias("copy_row_id"))


def records(df: DataFrame, row_id: str, fields: list[str], hot_rows: int = 100_000) -> DataFrame:
    """(first_row_id, n_copies): one row per record. The count combines on the map side, so hot records need no salt here."""
    return membership(df, row_id, fields, hot_rows).groupBy("first_row_id").agg(F.count(F.lit(1)).alias("n_copies"))
