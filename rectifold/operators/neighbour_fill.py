"""Fills missing cells from the same entity's neighbours in time, then from the same group, and marks what was filled and how.

The cells are read once into a narrow table; means and most frequent values of groups and the filling itself come from it. Rows with a
missing cell meet the values of their group before the others join them, so only those rows move for it. Filling is one
shuffle by (entity, segment). A segment is the whole entity, or one day of it where the entity is hot; then the
observations beside a day come from a second level over one row per hot entity and day. Forward and backward looks are
running windows in either order, so no frame is evaluated again per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hot import attach, hot_keys

DAY = 86_400.0


@dataclass(frozen=True)
class FillColumn:
    """A column to fill. observed: its usable value (double if numeric, else string), null where unusable; missing: what to fill."""

    name: str
    observed: Column
    missing: Column
    numeric: bool


def fill(
    df: DataFrame, entity: list[Column], order: Column, row_id: str, columns: list[FillColumn], group: Column,
    max_gap_days: float = 730.0, hot_rows: int = 100_000,
) -> DataFrame:
    """row_id and, per column, `{c}_filled` (value after filling), `{c}_method` and `{c}_distance` (days), null where not filled.

    Methods: interpolated (numeric, both neighbours within max_gap_days), carried (nearest neighbour within it), group (mean or
    most frequent value of the group), overall (of the table), none (nothing is observed anywhere). Rows of a null entity part go to
    the group; a null order value leaves a row without neighbours. Ties in time go by row_id; the earlier neighbour wins a tie in
    distance, the smaller value a tie in frequency. Repeated rows are filled alike. An empty table stays empty.
    """
    # costly expressions become columns before anything uses them twice
    keys = [f"_k{i}" for i in range(len(entity))]
    base = df.select(
        F.col(row_id).alias("_id"), *[e.alias(k) for e, k in zip(entity, keys, strict=True)], order.cast("double").alias("_t"), group.alias("_g"),
        *[c.observed.alias(f"_r_{c.name}") for c in columns], *[c.missing.alias(f"_m_{c.name}") for c in columns],
    )
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    base = base.select(
        "_id", F.when(known, F.xxhash64(F.lit(17), *keys)).otherwise(F.xxhash64(F.lit(3), "_id")).alias("_e1"), F.when(known, F.xxhash64(F.lit(91), *keys)).otherwise(F.xxhash64(F.lit(5), "_id")).alias("_e2"), "_t", "_g",
        *[F.when(~F.col(f"_m_{c.name}"), F.col(f"_r_{c.name}")).alias(f"_v_{c.name}") for c in columns], *[f"_m_{c.name}" for c in columns],
    )
    base = written(base)
    hot = hot_keys(base.select("_e1", "_e2"), ["_e1", "_e2"], hot_rows).select(F.col("_e1").alias("_h1"), F.col("_e2").alias("_h2"))
    tagged = base.join(F.broadcast(hot), (F.col("_e1") == F.col("_h1")) & (F.col("_e2") == F.col("_h2")), "left")  # at most hot.MAX_HOT_KEYS rows
    tagged = tagged.withColumn("_seg", F.when(F.col("_h1").isNotNull(), F.floor(F.coalesce("_t", F.lit(0.0)) / DAY)).otherwise(F.lit(-1)).cast("bigint"))
    tagged = tagged.withColumn("_hot", F.col("_h1").isNotNull()).drop("_h1", "_h2")
    seen = {f"_o_{c.name}": F.when(F.col(f"_v_{c.name}").isNotNull() & F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col(f"_v_{c.name}").alias("v"))) for c in columns}

    sides, wholes = [], []
    numeric = [c for c in columns if c.numeric]
    if numeric:  # conditional sums, as a filter on a value would compute it again; decimals, as their sum has no order
        sums = [x for c in numeric for x in (F.sum(F.col(f"_v_{c.name}").cast("decimal(18,2)")).alias(f"_s_{c.name}"), F.count(f"_v_{c.name}").alias(f"_c_{c.name}"))]
        stats = base.groupBy("_g").agg(*sums)
        mean = lambda s, n: F.round((s / F.nullif(n, F.lit(0))).cast("double"), 4)
        stats = written(stats)  # a row per group
        sides.append(stats.select(F.col("_g").alias("_gg"), *[mean(F.col(f"_s_{c.name}"), F.col(f"_c_{c.name}")).alias(f"_gv_{c.name}") for c in numeric]))
        wholes.append(stats.agg(*[mean(F.sum(f"_s_{c.name}"), F.sum(f"_c_{c.name}")).alias(f"_av_{c.name}") for c in numeric]))
    for c in columns:
        if not c.numeric:
            freq = written(base.groupBy("_g", F.col(f"_v_{c.name}").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_v").isNotNull()))
            best = F.min_by("_v", F.struct(-F.col("_c"), F.col("_v")))
            sides.append(freq.groupBy(F.col("_g").alias("_gg")).agg(best.alias(f"_gv_{c.name}")))
            wholes.append(freq.groupBy("_v").agg(F.sum("_c").alias("_c")).agg(best.alias(f"_av_{c.name}")))
    per_group = written(reduce(lambda x, y: x.join(y.hint("merge"), "_gg", "full"), sides))
    fills = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"_m_{c.name}"), F.lit(False)) for c in columns])
    own, kinds = [c for c in tagged.columns if c != "_g"], dict(per_group.dtypes)
    filling = attach(tagged.filter(fills), per_group, {"_g": "_gg"}).select(*own, *[F.when(F.col(f"_m_{c.name}"), F.col(f"_gv_{c.name}")).alias(f"_gv_{c.name}") for c in columns])
    others = tagged.filter(~fills).select(*own, *[F.lit(None).cast(kinds[f"_gv_{c.name}"]).alias(f"_gv_{c.name}") for c in columns])
    valued = filling.unionByName(others).withColumns(seen)

    seg = ["_e1", "_e2", "_seg"]
    back = Window.partitionBy(*seg).orderBy(F.col("_t").asc(), F.col("_id").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*seg).orderBy(F.col("_t").desc(), F.col("_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = valued.select("*", *[F.last(f"_o_{c.name}", ignorenulls=True).over(back).alias(f"_p_{c.name}") for c in columns])
    rows = rows.select("*", *[F.last(f"_o_{c.name}", ignorenulls=True).over(ahead).alias(f"_n_{c.name}") for c in columns])

    days = tagged.filter("_hot").withColumns(seen).groupBy(*seg).agg(
        *[F.max_by(f"_o_{c.name}", F.when(F.col(f"_o_{c.name}").isNotNull(), F.struct("_t", "_id"))).alias(f"_l_{c.name}") for c in columns],
        *[F.min_by(f"_o_{c.name}", F.when(F.col(f"_o_{c.name}").isNotNull(), F.struct("_t", "_id"))).alias(f"_f_{c.name}") for c in columns],
    )
    over_days = Window.partitionBy("_e1", "_e2").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    over_days_back = Window.partitionBy("_e1", "_e2").orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*seg, *[F.last(f"_l_{c.name}", ignorenulls=True).over(over_days).alias(f"_dp_{c.name}") for c in columns], *[F.last(f"_f_{c.name}", ignorenulls=True).over(over_days_back).alias(f"_dn_{c.name}") for c in columns])
    rows = rows.join(days, seg, "left")

    for whole in wholes:
        rows = rows.crossJoin(F.broadcast(whole))  # one row

    out = [F.col("_id").alias(row_id)]
    for c in columns:
        p = F.coalesce(F.col(f"_p_{c.name}"), F.col(f"_dp_{c.name}"))
        n = F.coalesce(F.col(f"_n_{c.name}"), F.col(f"_dn_{c.name}"))
        t, miss, value = F.col("_t"), F.col(f"_m_{c.name}"), F.col(f"_v_{c.name}")
        gap_p, gap_n = (t - p["t"]) / DAY, (n["t"] - t) / DAY
        near_p, near_n = F.coalesce(gap_p <= max_gap_days, F.lit(False)), F.coalesce(gap_n <= max_gap_days, F.lit(False))
        prev_wins = near_p & (~near_n | (gap_p <= gap_n))
        by_group, by_all = F.col(f"_gv_{c.name}"), F.col(f"_av_{c.name}")
        method = F.when(near_p & near_n & F.lit(c.numeric), "interpolated").when(near_p | near_n, "carried").when(by_group.isNotNull(), "group").when(by_all.isNotNull(), "overall").otherwise("none")
        between = F.when(n["t"] > p["t"], p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"])).otherwise(p["v"]) if c.numeric else p["v"]
        carried = F.when(prev_wins, p["v"]).otherwise(n["v"])
        filled = F.when(method == "interpolated", between).when(method == "carried", carried).when(method == "group", by_group).when(method == "overall", by_all)
        out += [
            F.when(miss, filled).otherwise(value).alias(f"{c.name}_filled"),
            F.when(miss, method).alias(f"{c.name}_method"),
            F.when(miss & (method.isin("interpolated", "carried")), F.least(F.when(near_p, gap_p), F.when(near_n, gap_n))).alias(f"{c.name}_distance"),
        ]
    return rows.select(*out)


def filled_cells(filled: DataFrame, names: list[str], row_id: str = "row_id") -> DataFrame:
    """(column_name, row_id, method, distance, value) of every marked cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_method").alias("method"), F.col(f"{c}_distance").alias("distance"), F.col(f"{c}_filled").cast("string").alias("value")) for c in names]))
    return filled.select(F.col(row_id), cells.alias("_c")).select("_c.column_name", row_id, "_c.method", "_c.distance", "_c.value").filter(F.col("method").isNotNull())
