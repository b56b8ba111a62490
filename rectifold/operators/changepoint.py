"""Unit changes in the history of a source: exact penalised changepoints on log levels, and the known factors their shifts match.

A history has one row per source and load (exact medians from value counts), so each group that a task handles is as long as
the number of loads, whatever the number of rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .percentiles import exact_percentiles

TOLERANCE = math.log10(1.6)  # how far a level may lie from a factor to match it
LEAST_VALUES = 30  # values a segment needs to contradict a declaration


def segments(levels: list[float], weights: list[float], penalty: float) -> list[int]:
    """Starts of the segments that minimise weighted squared error plus the penalty per segment: optimal partitioning with pruning, exact."""
    n = len(levels)
    w, s, q = [0.0], [0.0], [0.0]
    for x, k in zip(levels, weights, strict=True):
        w.append(w[-1] + k)
        s.append(s[-1] + k * x)
        q.append(q[-1] + k * x * x)

    def cost(a: int, b: int) -> float:
        m = w[b] - w[a]
        return max(0.0, q[b] - q[a] - (s[b] - s[a]) ** 2 / m) if m else 0.0

    best, cut = [-penalty] + [math.inf] * n, [0] * (n + 1)
    live = [0]
    for b in range(1, n + 1):
        for a in live:
            c = best[a] + cost(a, b) + penalty
            if c < best[b] - 1e-12:
                best[b], cut[b] = c, a
        live = [a for a in live if best[a] + cost(a, b) <= best[b]] + [b]
    out, b = [], n
    while b > 0:
        out.append(cut[b])
        b = cut[b]
    return out[::-1]


def history(df: DataFrame, source: str, load: str, value: Column) -> DataFrame:
    """(source, load, level, n): the exact median of log10 of positive values per source and load."""
    x = df.select(F.col(source).alias("source"), F.col(load).alias("load"), F.when(value > 0, F.log10(value)).alias("x")).filter("x is not null and source is not null and load is not null")
    counts = x.groupBy("source", "load", "x").agg(F.count(F.lit(1)).alias("n"))
    mid = exact_percentiles(counts, ["source", "load"], "x", "n", {"level": 0.5})
    return mid.join(counts.groupBy("source", "load").agg(F.sum("n").alias("n")), ["source", "load"])


def without_shared_shifts(hist: DataFrame) -> DataFrame:
    """hist with levels freed of what a load shares: the median, over at least three sources, of the sources' distances from their own median.

    A load whose quantities lie higher in most sources has other quantities, not another unit; a source that changes its unit does so alone. With fewer
    sources in a load nothing is taken off.
    """
    own = hist.groupBy(F.col("source").alias("_s")).agg(F.expr("percentile(level, 0.5)").alias("_own"))
    apart = hist.join(own, F.col("source") == F.col("_s")).withColumn("_d", F.col("level") - F.col("_own"))
    shared = apart.groupBy(F.col("load").alias("_l")).agg(F.when(F.count(F.lit(1)) >= 3, F.expr("percentile(_d, 0.5)")).otherwise(0.0).alias("_shift"))
    return hist.join(shared, F.col("load") == F.col("_l")).select("source", "load", (F.col("level") - F.col("_shift")).alias("level"), "n")


def unit_segments(hist: DataFrame, factors: dict[int, float], common_level: float, penalty: float = 0.05, declared: DataFrame | None = None) -> DataFrame:
    """(source, first_load, last_load, level, unit_id, agrees): segments of each history and the unit whose factor brings the level to the common one.

    unit_id is null where no factor does within TOLERANCE; of several that do the declared one (declared: source, unit_id, one row a source)
    counts, then the nearest, then the smaller id; a segment of fewer than LEAST_VALUES values contradicts no declaration. agrees tells whether the segment has the declared unit, null where none is declared. Loads weigh alike;
    the penalty rises with the noise between neighbouring loads.
    """
    known = sorted(factors.items())
    if declared is None:
        hist = hist.withColumn("declared", F.lit(None).cast("int"))
    else:
        d = declared.select(F.col("source").alias("_s"), F.col("unit_id").cast("int").alias("declared"))
        hist = hist.join(d, F.col("source") == F.col("_s"), "left").drop("_s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("load")
        levels, loads, counts = pdf["level"].tolist(), pdf["load"].tolist(), pdf["n"].tolist()
        said = None if pd.isna(pdf["declared"].iloc[0]) else int(pdf["declared"].iloc[0])
        steps = sorted(abs(b - a) for a, b in zip(levels, levels[1:], strict=False)) or [0.0]
        noise = (steps[len(steps) // 2] / 0.954) ** 2  # the median step of independent noise is 0.954 deviations
        starts = segments(levels, [1.0] * len(levels), max(penalty, 3 * noise * math.log(len(levels) + 1)))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(levels)], strict=True):
            level = sum(levels[a:b]) / (b - a)
            near = sorted((u != said, off, u) for off, u in ((abs(common_level - level - math.log10(f)), u) for u, f in known if f > 0) if off <= TOLERANCE)
            unit = near[0][2] if near else None
            if said is not None and unit != said and sum(counts[a:b]) < LEAST_VALUES:
                unit = said
            rows.append((pdf["source"].iloc[0], loads[a], loads[b - 1], round(level, 6), unit, None if said is None else unit == said))
        out = pd.DataFrame(rows, columns=["source", "first_load", "last_load", "level", "unit_id", "agrees"])
        return out.astype({"unit_id": "Int32", "agrees": "boolean"})

    return hist.groupBy("source").applyInPandas(run, "source string, first_load int, last_load int, level double, unit_id int, agrees boolean")
