"""Exact percentiles of weighted values in groups, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 32


def exact_percentiles(counts: DataFrame, keys: list[str], value: str, n: str, fractions: dict[str, float]) -> DataFrame:
    """One row per group and one column per named fraction, linearly interpolated over values repeated n times.

    counts has distinct values per group. A sketch of each group's values only chooses bucket bounds; exact bucket totals then
    tell which bucket holds a wanted rank, and only those buckets are ordered. Null values are left out; a group of nulls has no row.
    """
    src = counts.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(n).cast("bigint").alias("_n"))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = src.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 2000).alias("_bounds"), F.sum("_n").alias("_total"))
    b = bounds.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_bounds", "_total")
    placed = src.join(b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]).drop(*[f"_b_{k}" for k in keys])
    placed = placed.withColumn("_bucket", F.size(F.filter("_bounds", lambda s: s < F.col("_v")))).drop("_bounds")
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in"), F.max("_total").alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_end", F.sum("_in").over(w)).withColumn("_start", F.col("_end") - F.col("_in"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_total") - 1)).alias("pos")) for name, p in fractions.items()])
    ranks = totals.withColumn("_w", F.explode(wanted)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_w.pos"), F.ceil("_w.pos")))))
    ranks = ranks.filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    ranks = ranks.groupBy(*keys, "_bucket", "_start").agg(F.collect_list(F.struct("_w.name", "_w.pos", "_rank")).alias("_ranks"))
    r = ranks.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_bucket").alias("_b_bucket"), "_start", "_ranks")
    rows = placed.join(r, [*[F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], F.col("_bucket") == F.col("_b_bucket")])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_start") + F.sum("_n").over(inside))
    hits = rows.withColumn("_r", F.explode("_ranks")).filter((F.col("_r._rank") < F.col("_cum")) & (F.col("_r._rank") >= F.col("_cum") - F.col("_n")))
    at = hits.groupBy(*keys, F.col("_r.name").alias("_name"), F.col("_r.pos").alias("_pos")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = at.withColumn("_p", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos")))
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in fractions])
