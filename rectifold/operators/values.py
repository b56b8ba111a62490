"""The value-count frame and the first cells of each column: what the rules learn from, instead of the rows themselves.

Rules whose verdict depends on a cell's own text need only distinct values with counts. The frame combines on the map side; the first
cells use a group limit per task before the shuffle, so neither gathers a column in one place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ROW = "_row_id"
HEAD = 400


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """df with a stable `_row_id`: a unique integer column if one is named, else the order of arrival, numbered without gathering rows.

    Numbering writes the table once with the numbers of rows within their tasks, so that these stay, and adds the rows of the tasks before: one count per
    task reaches the driver.
    """
    if key:
        return df.withColumn(ROW, F.col(key).cast("bigint"))
    if ROW in df.columns:
        return df
    mixed = written(df.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright(F.col("_at"), 33)
    before, offsets = 0, []
    for r in mixed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        offsets.append((r["task"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_task bigint, _start bigint")
    rows = mixed.join(F.broadcast(starts), task == F.col("_task"))  # a row per task
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(ROW))


def as_text(df: DataFrame) -> DataFrame:
    """Every column but the row id as text, null as the empty string."""
    return df.select(*[F.col(f"`{c}`") if c == ROW else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW and not c.startswith("_h_")]


def long_form(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(_row_id, column, value)."""
    cols = list(columns if columns is not None else data_columns(df))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols]))
    return df.select(ROW, pairs.alias("_p")).select(ROW, "_p.column", "_p.value")


def value_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, value, n, first): exact counts and the first row of every value, kept as a table as several rules read it."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    return written(counts)


def heads(df: DataFrame, columns: Iterable[str] | None = None, k: int = HEAD) -> dict[str, list[str]]:
    """The first k non-empty cells of each column in row order; at most k cells a column reach the driver."""
    w = Window.partitionBy("column").orderBy(ROW)
    rows = long_form(df, columns).filter("value <> ''").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    out: dict[str, list[str]] = {c: [] for c in (columns or data_columns(df))}
    for r in rows.select("column", "value", "_rn").orderBy("column", "_rn").collect():
        out[r["column"]].append(r["value"])
    return out


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """The value of a small dict of texts, else null; at most a few hundred entries."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv]), key)
