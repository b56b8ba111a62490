"""Column profiles from exact column-value counts, and the loads that differ from the rest.

The unpivoted counts combine on the map side: a value that fills a third of all cells is one row per task. Everything after
them works on distinct values or on one row per table, column and load.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_missing, is_plain_number, to_number
from ..session import checkpoint
from .percentiles import exact_percentiles

KEYS = ["table_name", "column_name", "load_no"]

# How far a load's measure may stand from the median over the loads.
NULL_RATE_ABOVE = 0.15
PATTERN_ABOVE = 0.15
DISTINCT_BELOW = 0.5
RANGE_SHARE = 0.10
SHIFT_OF_IQR = 0.5


def value_counts(df: DataFrame, columns: list[str], table: str, load: str | None = "load_no") -> DataFrame:
    """(table_name, column_name, load_no, value, n): exact counts of every value of the columns, as text; null is a value."""
    picked = df.select(F.col(load).alias("load_no") if load else F.lit(None).cast("int").alias("load_no"), *[F.col(c).cast("string").alias(c) for c in columns if c != load])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns if c != load]))
    long = picked.select("load_no", pairs.alias("_p")).select(F.lit(table).alias("table_name"), "_p.column_name", "load_no", "_p.value")
    return long.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(counts: DataFrame) -> DataFrame:
    """One row per table and column: cells, missing, distinct values, plain numbers, pattern violations, range, top share.

    A column without cells has no row. n_pattern counts cells that are neither missing nor plain numbers; min_number and max_number
    are null without plain numbers.
    """
    per = counts.groupBy("table_name", "column_name", "value").agg(F.sum("n").alias("n"))
    v, n = F.col("value"), F.col("n")
    return per.groupBy("table_name", "column_name").agg(
        F.sum(n).alias("n_cells"),
        F.sum(F.when(is_missing(v), n).otherwise(0)).alias("n_missing"),
        F.count(F.when(~is_missing(v), 1)).alias("n_distinct"),
        F.sum(F.when(is_plain_number(v), n).otherwise(0)).alias("n_plain"),
        F.sum(F.when(~is_missing(v) & ~is_plain_number(v), n).otherwise(0)).alias("n_pattern"),
        F.min(to_number(v)).alias("min_number"),
        F.max(to_number(v)).alias("max_number"),
        F.max(F.when(~is_missing(v), n)).alias("n_top"),
    )


def load_measures(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measures per table, column and load; counts of plain numbers as num, n)."""
    v, n = F.col("value"), F.col("n")
    numbers = checkpoint(counts.filter(is_plain_number(v)).groupBy(*KEYS, to_number(v).alias("num")).agg(F.sum(n).alias("n")))
    shares = counts.groupBy(*KEYS).agg(F.sum(n).alias("n_cells"), F.sum(F.when(is_missing(v), n).otherwise(0)).alias("n_missing"), F.sum(F.when(is_plain_number(v), n).otherwise(0)).alias("n_plain"))
    distinct = numbers.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_distinct"))
    q = exact_percentiles(numbers, KEYS, "num", "n", {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})
    m = shares.join(distinct, KEYS, "left").join(q, KEYS, "left")
    filled = F.col("n_cells") - F.col("n_missing")
    m = m.withColumn("null_rate", F.col("n_missing") / F.col("n_cells"))
    m = m.withColumn("pattern_rate", F.when(filled > 0, (filled - F.col("n_plain")) / filled))
    m = m.withColumn("distinct_rate", F.when(F.col("n_plain") > 0, F.col("n_distinct") / F.col("n_plain")))
    return m.withColumn("iqr", F.col("p75") - F.col("p25")), numbers


def deviating_loads(counts: DataFrame) -> DataFrame:
    """(table_name, column_name, load_no, finding): loads whose measure stands too far from the median over the table's loads.

    A measure that a load lacks (no filled cells, no plain numbers) neither counts for the median nor deviates. Rows of a null load
    form a load of their own. An empty table has no findings.
    """
    m, numbers = load_measures(counts)
    m = checkpoint(m)  # one row per column and load: small, and read three times
    mid = ["null_rate", "pattern_rate", "distinct_rate", "p01", "p50", "p99", "iqr"]
    medians = m.groupBy("table_name", "column_name").agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"m_{c}") for c in mid])
    both = m.join(medians, ["table_name", "column_name"])
    bounds = medians.select("table_name", "column_name", F.col("m_p01"), F.col("m_p99"))
    outside = numbers.join(bounds, ["table_name", "column_name"]).filter((F.col("num") < F.col("m_p01")) | (F.col("num") > F.col("m_p99")))
    both = both.join(outside.groupBy(*KEYS).agg(F.sum("n").alias("n_outside")), KEYS, "left")
    eps = 1e-12  # equal shares computed apart may differ in the last bit
    found = {
        "null_rate": F.col("null_rate") - F.col("m_null_rate") >= NULL_RATE_ABOVE - eps,
        "pattern": F.col("pattern_rate") - F.col("m_pattern_rate") >= PATTERN_ABOVE - eps,
        "distinct": F.col("distinct_rate") < DISTINCT_BELOW * F.col("m_distinct_rate") - eps,
        "value_range": F.coalesce(F.col("n_outside"), F.lit(0)) / F.col("n_plain") >= RANGE_SHARE - eps,
        "distribution": F.abs(F.col("p50") - F.col("m_p50")) > SHIFT_OF_IQR * F.col("m_iqr") + eps,
    }
    found["value_range"] = (F.col("n_plain") > 0) & (F.coalesce(F.col("n_outside"), F.lit(0)) >= (RANGE_SHARE - eps) * F.col("n_plain"))
    names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in found.items()]), lambda x: x.isNotNull())
    return both.select(*KEYS, F.explode(names).alias("finding"))


def load_drift(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Each load against the load before: population stability index and chi-square over decile bins of all loads' plain numbers.

    Bin shares are floored at half a row so that empty bins stay finite. The first load of a column has no row.
    """
    numbers = checkpoint(counts.filter(is_plain_number(F.col("value"))).groupBy(*KEYS, to_number(F.col("value")).alias("num")).agg(F.sum("n").alias("n")))
    pair = ["table_name", "column_name"]
    whole = numbers.groupBy(*pair, "num").agg(F.sum("n").alias("n"))
    names = {f"d{i}": i / bins for i in range(1, bins)}
    cuts = exact_percentiles(whole, pair, "num", "n", names).select(*pair, F.array(*names).alias("_cuts"))
    binned = numbers.join(cuts, pair).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col("num"))))
    per = binned.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    loads = per.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("hist"))
    w = Window.partitionBy(*pair).orderBy("load_no")
    loads = loads.withColumn("_t0", F.lag("total").over(w)).withColumn("_h0", F.lag("hist").over(w)).filter(F.col("_t0").isNotNull())

    def parts(i):
        a = F.greatest(F.coalesce(F.try_element_at("_h0", F.lit(i)), F.lit(0)).cast("double"), F.lit(0.5)) / F.col("_t0")
        b = F.greatest(F.coalesce(F.try_element_at("hist", F.lit(i)), F.lit(0)).cast("double"), F.lit(0.5)) / F.col("total")
        return (b - a) * F.log(b / a), F.col("total") * (b - a) * (b - a) / a

    each = [parts(i) for i in range(bins)]
    return loads.select(*KEYS, F.round(reduce(lambda x, y: x + y, [e[0] for e in each]), 6).alias("psi"), F.round(reduce(lambda x, y: x + y, [e[1] for e in each]), 4).alias("chi_square"))
