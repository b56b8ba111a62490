"""The older cleaning path: categories, types, repeats, imputation and outliers, each a lazy transform that keeps `_row_id`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.text import TYPE_NULL_TOKENS, UI_BLANK, collapse, strip
from ..session import written
from . import detect, rules
from .percentiles import exact_percentiles
from .values import ROW, data_columns, long_form


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW]


def category_clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K2: collapse white space; every variant of a folded value becomes the leading one, if that occurs more than once.

    Leading: most frequent, then titled, then with a leading capital, then the smaller. The map has a row per folded value that has variants.
    """
    for c in columns or text_columns(df):
        v = collapse(F.col(f"`{c}`"))
        counts = df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.lower(v).alias("_key"), v.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
        titled = (F.col("_v") == F.initcap("_v")).cast("int")
        capital = F.col("_v").rlike(r"^\p{Lu}").cast("int")
        lead = counts.groupBy("_key").agg(F.count(F.lit(1)).alias("kinds"), F.min_by("_v", F.struct(-F.col("n"), -titled, -capital, F.col("_v"))).alias("_lead"), F.max("n").alias("top")).filter("kinds > 1 and top > 1").select("_key", "_lead")
        df = df.join(lead, F.lower(v) == F.col("_key"), "left").withColumn(c, F.coalesce("_lead", v)).drop("_key", "_lead")
    return df


def type_clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K3: null tokens become null; columns over 80 % boolean words become boolean, over 70 % numbers double; one pass decides, one projection casts."""
    cols = columns or text_columns(df)
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = F.lower(strip(F.col(f"`{c}`")))
        real = F.col(f"`{c}`").isNotNull() & ~v.isin(*TYPE_NULL_TOKENS)
        aggs += [F.count(F.when(real, 1)).alias(f"n{i}"), F.count(F.when(real & v.isin(*detect.TRUE_WORDS, *detect.FALSE_WORDS), 1)).alias(f"b{i}"), F.count(F.when(real & _money(v).isNotNull(), 1)).alias(f"x{i}")]
    row = df.agg(*aggs).first()
    out: dict[str, Column] = {}
    for i, c in enumerate(cols):
        v = F.lower(strip(F.col(f"`{c}`")))
        real = F.when(~v.isin(*TYPE_NULL_TOKENS), F.col(f"`{c}`"))
        n = row[f"n{i}"]
        if n and row[f"b{i}"] / n > 0.80:
            out[c] = F.when(v.isin(*detect.TRUE_WORDS), F.lit(True)).when(v.isin(*detect.FALSE_WORDS), F.lit(False))
        elif n and row[f"x{i}"] / n >= 0.70:
            out[c] = _money(v)
        else:
            out[c] = real
    return df.withColumns(out)


def _money(v: Column) -> Column:
    bare = F.regexp_replace(v, "[$,€£]", "")
    return F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), bare.try_cast("double"))


def drop_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K4: keep the first of equal rows. Row ids stay as they are, so later steps still hit the right rows."""
    gone = rules.duplicate_rows(df, columns or data_columns(df)).select(ROW)
    return df.join(gone, ROW, "left_anti")


def impute(df: DataFrame, numeric: str = "median", categorical: str = "mode", constants: dict[str, object] | None = None, cfg: Config | None = None) -> DataFrame:
    """K5: numeric median, mean, constant or skip; categorical mode, constant or skip. Tokens count as missing; values are rounded to three digits; a column without values gets 'Unknown'."""
    cfg, constants = cfg or Config(), constants or {}
    nums = detect.numeric_columns(df)
    texts = text_columns(df)
    token = lambda c: F.col(f"`{c}`").isNull() | F.lower(strip(F.col(f"`{c}`"))).isin(*cfg.missing_tokens)
    fills: dict[str, object] = {}
    if nums and numeric == "median":
        x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in nums]))
        counts = df.select(x.alias("p")).select("p.*").filter("x is not null and not isnan(x)").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
        fills |= {r["column"]: round(r["m"], 3) for r in exact_percentiles(counts, ["column"], "x", "n", {"m": 0.5}).collect()}
    elif nums and numeric == "mean":
        row = df.agg(*[F.round(F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))), 3).alias(c) for c in nums]).first()
        fills |= {c: row[c] for c in nums}
    elif numeric == "constant":
        fills |= {c: constants.get(c, 0) for c in nums}
    if texts and categorical == "mode":
        counts = long_form(df, texts).filter("value is not null").filter(~F.lower(strip(F.col("value"))).isin(*cfg.missing_tokens)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        top = {r["column"]: r["v"] for r in counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v")).collect()}
        fills |= {c: top.get(c, "Unknown") for c in texts}
    elif categorical == "constant":
        fills |= {c: constants.get(c, "Unknown") for c in texts}
    out = {}
    for c, v in fills.items():
        if v is None:
            continue
        if c in texts:
            out[c] = F.when(token(c), F.lit(v)).otherwise(F.col(f"`{c}`"))
        else:
            d = F.col(f"`{c}`").cast("double")
            out[c] = F.when(d.isNull() | F.isnan(d), F.lit(float(v))).otherwise(d)
    return df.withColumns(out) if out else df


DONOR_BLOCK = 50_000  # rows that a task compares with at a time


def knn_impute(df: DataFrame, columns: list[str], k: int = 5, donors: int | None = None) -> DataFrame:
    """Numeric blanks from the mean of the k nearest rows that have the value (distance over shared columns, scaled up for missing ones).

    All rows are donors: rows with blanks are the queries and meet the donors in blocks of DONOR_BLOCK rows, read one after the other; each block keeps the k
    nearest of every blank and the next block improves on them. With `donors` only so many rows by hash are compared with, for those who want that. Ties in distance go to
    the smaller row id; without any comparable row the mean of the column's values is taken.
    """
    import numpy as np
    import pandas as pd

    from ..session import checkpoint, received, share

    names = [f"`{c}`" for c in columns]
    x = checkpoint(df.select(ROW, *[F.col(n).cast("double").alias(c) for n, c in zip(names, columns, strict=True)]))
    pool = x.orderBy(F.xxhash64(F.lit(5), ROW), ROW).limit(donors) if donors is not None else x
    n = pool.count()
    blocks = max(1, -(-n // DONOR_BLOCK))
    placed = pool.withColumn("_b", F.pmod(F.xxhash64(F.lit(5), ROW), F.lit(blocks))) if blocks > 1 else pool.withColumn("_b", F.lit(0))
    open_rows = x.filter(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in columns))
    means = x.agg(*[F.avg(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    near_type = "array<array<struct<d:double,id:bigint,v:double>>>"
    asked = open_rows.withColumn("_near", F.lit(None).cast(near_type))
    for b in range(blocks):
        block = placed.filter(F.col("_b") == b).drop("_b").toPandas()  # about DONOR_BLOCK rows
        shared = share(df.sparkSession, (block[ROW].to_numpy(), block[columns].to_numpy(dtype=float)))

        def run(it, shared=shared):
            ids, d = received(shared)
            for pdf in it:
                m = pdf[columns].to_numpy(dtype=float)
                out = []
                for i in range(len(m)):
                    both = ~np.isnan(d) & ~np.isnan(m[i])
                    count = both.sum(axis=1)
                    dist = np.where(both, (d - m[i]) ** 2, 0).sum(axis=1) * len(columns) / np.maximum(count, 1)
                    dist[(count == 0) | (ids == pdf[ROW].iloc[i])] = np.inf
                    old = pdf["_near"].iloc[i]
                    mine = []
                    for j in range(len(columns)):
                        best = [(e["d"], e["id"], e["v"]) for e in old[j]] if old is not None else []
                        if np.isnan(m[i, j]):
                            ok = np.flatnonzero(~np.isnan(d[:, j]) & np.isfinite(dist))
                            some = ok[np.lexsort((ids[ok], dist[ok]))[:k]] if len(ok) else ok
                            best = sorted([*best, *((float(dist[z]), int(ids[z]), float(d[z, j])) for z in some)])[:k]
                        mine.append([{"d": a, "id": c, "v": v} for a, c, v in best])
                    out.append(mine)
                yield pdf[[ROW, *columns]].assign(_near=pd.Series(out, index=pdf.index, dtype=object))

        asked = asked.mapInPandas(run, asked.schema)
        asked = checkpoint(asked) if blocks > 1 else asked
    mean = lambda i: F.aggregate(F.col("_near")[i], F.lit(0.0), lambda a, e: a + e["v"]) / F.size(F.col("_near")[i])
    value = lambda i: F.when(F.size(F.col("_near")[i]) > 0, mean(i)).otherwise(F.lit(means[i]))
    got = asked.select(F.col(ROW).alias("_fid"), *[F.round(value(i), 3).alias(f"_f{i}") for i in range(len(columns))])
    fills = df.join(got, F.col(ROW) == F.col("_fid"), "left")
    blank = lambda c: F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
    done = {c: F.when(blank(c), F.col(f"_f{i}")).otherwise(F.col(f"`{c}`").cast("double")).alias(c) for i, c in enumerate(columns)}
    return fills.select(*[done.get(c, F.col(f"`{c}`")) for c in df.columns])


def handle_outliers(df: DataFrame, how: str = "flag_only", columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """K6: flag_only leaves the table, cap draws values to the bounds (rounded to three digits, five values at least), remove drops the rows."""
    cols = columns or detect.numeric_columns(df)
    if how == "flag_only" or not cols:
        return df
    stats = {r["column"]: r for r in detect.outlier_stats(df, cols).collect() if r["n"] >= 5}
    bounds = {c: (round(s["q1"] - factor * (s["q3"] - s["q1"]), 3), round(s["q3"] + factor * (s["q3"] - s["q1"]), 3)) for c, s in stats.items()}
    d = {c: F.col(f"`{c}`").cast("double") for c in bounds}
    if how == "cap":
        return df.withColumns({c: F.when(d[c].isNotNull(), F.least(F.greatest(d[c], F.lit(lo)), F.lit(hi))) for c, (lo, hi) in bounds.items()})
    keep = reduce(lambda a, b: a & b, [F.coalesce(d[c].between(lo, hi), F.lit(True)) for c, (lo, hi) in bounds.items()], F.lit(True))
    return df.filter(keep)


def fix_typos(df: DataFrame, cfg: Config) -> DataFrame:
    """Cells whose typo issue is to be corrected automatically."""
    found = detect.typos(df, cfg).filter("suggested_action = 'auto_correct'").select(F.col("row").alias("_r"), "column", "suggested_value")
    wide = found.groupBy("_r").agg(F.map_from_entries(F.collect_list(F.struct("column", "suggested_value"))).alias("_m"))  # at most a cell per column
    j = df.join(wide, F.col(ROW) == F.col("_r"), "left")
    return j.withColumns({c: F.coalesce(F.try_element_at("_m", F.lit(c)), F.col(f"`{c}`")) for c in text_columns(df)}).drop("_r", "_m")


def validate_correction(column: str, value: str, cfg: Config | None = None) -> tuple[bool, str]:
    """K7: (accepted, value or reason): dates become year-month-day, numbers stay within the rule of the column's name."""
    import datetime as dt

    from .assist import domain_rules

    cfg = cfg or Config()
    v = value.strip()
    if any(w in column.lower() for w in detect.DATE_WORDS):
        for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y"):
            try:
                return True, dt.datetime.strptime(v, f).date().isoformat()
            except ValueError:
                continue
        return False, "no existing date"
    bounds = domain_rules([column], cfg.domain_rules).get(column)
    if bounds:
        try:
            x = float(v)
        except ValueError:
            return False, "no number"
        lo, hi = bounds
        if (lo is not None and x < lo) or (hi is not None and x > hi):
            return False, f"outside {lo} to {hi}"
    return True, v


class Decisions:
    """Corrections that people accepted, by cell; the last one counts."""

    def __init__(self):
        self.cells: dict[tuple[int, str], str] = {}

    def decide(self, row: int, column: str, value: str, cfg: Config | None = None) -> tuple[bool, str]:
        ok, v = validate_correction(column, value, cfg)
        if ok:
            self.cells[row, column] = v
        return ok, v

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(r, c, v, i) for i, ((r, c), v) in enumerate(self.cells.items())], "row bigint, column string, value string, seq int")


def clean_pipeline(df: DataFrame, cfg: Config | None = None, corrections: DataFrame | None = None, numeric: str = "median", categorical: str = "mode", outliers: str = "flag_only") -> tuple[DataFrame, DataFrame]:
    """K1: (clean table, audit): human corrections, typos, categories, types, repeats, imputation, outliers. The audit compares cells of both ends by row id."""
    from .engine import override

    cfg = cfg or Config()
    out = df
    if corrections is not None:
        text = out.select(ROW, *[F.col(f"`{c}`").cast("string").alias(c) for c in data_columns(out)])
        kinds = {f.name: f.dataType for f in out.schema.fields}
        fixed, _ = override(text, corrections)
        out = fixed.select(ROW, *[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in data_columns(out)])
    # every step decides from the whole table, so each result is written once instead of being worked out again by all later steps
    out = written(category_clean(written(fix_typos(written(out), cfg))))
    out = written(drop_duplicates(written(type_clean(out))))
    out = written(handle_outliers(impute(out, numeric, categorical, cfg=cfg), outliers))
    cols = data_columns(df)
    side = lambda d, s: d.select(ROW, *[F.col(f"`{c}`").cast("string").alias(f"{s}{i}") for i, c in enumerate(cols)])
    j = side(df, "a").join(side(out, "b"), ROW, "left").withColumn("_kept", F.lit(True))
    gone = df.select(ROW).join(out.select(ROW), ROW, "left_anti")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("original_value"), F.col(f"b{i}").alias("new_value")) for i, c in enumerate(cols)]))
    changed = j.join(gone, ROW, "left_anti").select(ROW, cells.alias("_c")).select(ROW, "_c.*").filter(~F.col("original_value").eqNullSafe(F.col("new_value")))
    audit = changed.select(F.col(ROW).alias("row"), "column", "original_value", "new_value", F.lit("cell_changed").alias("action"))
    dropped = gone.select(F.col(ROW).alias("row"), F.lit("__all__").alias("column"), F.lit(None).cast("string").alias("original_value"), F.lit(None).cast("string").alias("new_value"), F.lit("row_removed").alias("action"))
    return out, audit.unionByName(dropped)


def fill_blanks(df: DataFrame, column: str, how: str, value: str | None = None) -> DataFrame:
    """Blanks of a column by mode, median, mean (two digits), the value before or after in row order, or a given text.

    ffill and bfill need row order over the whole table: blocks of rows get running windows, and one row per block carries the value across
    blocks, so no task holds the table.
    """
    c = F.col(f"`{column}`")
    blank = c.isNull() | F.lower(strip(c.cast("string"))).isin(*UI_BLANK)
    if how in ("ffill", "bfill"):
        sign = 1 if how == "ffill" else -1
        size = 1 << 16
        d = df.withColumn("_blk", F.floor(F.col(ROW) / size)).withColumn("_v", F.when(~blank, c))
        within = Window.partitionBy("_blk").orderBy(F.col(ROW) * sign).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_near", F.last("_v", True).over(within))
        ends = d.groupBy("_blk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(ROW) * sign)).alias("_e"))
        across = Window.orderBy(F.col("_blk") * sign).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of 65,536
        ends = ends.select("_blk", F.last("_e", True).over(across).alias("_far"))
        return d.join(ends, "_blk").withColumn(column, F.coalesce("_near", "_far", c)).drop("_blk", "_v", "_near", "_far")
    if how == "custom":
        fill: object = value
    elif how == "mode":
        r = df.filter(~blank).groupBy(c.cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()
        fill = r["v"] if r else None
    else:
        x = strip(c.cast("string")).try_cast("double")
        nums = df.filter(~blank).select(F.lit(0).alias("k"), x.alias("x")).filter("x is not null")
        if how == "median":
            r = exact_percentiles(nums.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")), ["k"], "x", "n", {"m": 0.5}).first()
        else:
            r = nums.agg(F.avg("x").alias("m")).first()
        fill = None if r is None or r["m"] is None else str(round(r["m"], 2))
    return df if fill is None else df.withColumn(column, F.when(blank, F.lit(fill)).otherwise(c.cast("string")))
