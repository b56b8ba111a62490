"""An approved plan on a stream: an extension of the batch engine. Value edits need no state, so a frozen plan runs row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frozen_edits(columns: dict[str, list[Callable[[Column], Column]]]) -> Callable[[DataFrame], DataFrame]:
    """A transform of batch or streaming frames: per column functions of its value that give the new text, or null to leave it; the first wins."""

    def run(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(*[f(F.col(f"`{c}`")) for f in fs], F.col(f"`{c}`")) for c, fs in columns.items()})

    return run


def without_repeats(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first of equal rows within the watermark; state older than the delay is dropped."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Writes every micro-batch through `sink`, exactly once if the sink is idempotent per batch id."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
