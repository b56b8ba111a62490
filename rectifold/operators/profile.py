"""Profiles of a table: shapes, tokens, parse rates, cardinality, dependencies, logical types and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import QUALITY_SENTINELS, R1_TOKENS, shape, strip
from . import rules
from .percentiles import exact_percentiles
from .values import ROW, data_columns, long_form

# Name parts and patterns of the logical types.
DATE_HINTS = ("date", "time", "dob", "birth", "created", "joined", "timestamp")
SCHEMA_EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"


def first_cells(df: DataFrame, k: int) -> DataFrame:
    """The first k non-empty cells of each column, by a group limit before the shuffle."""
    w = Window.partitionBy("column").orderBy(ROW)
    return long_form(df).filter("value <> ''").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)


def shapes(df: DataFrame, cells: int | None = None, top: int = 5) -> DataFrame:
    """(column, shape, n, share, rank) over all non-empty cells of each column, or over its first `cells`. Counts combine on the map side."""
    filled = first_cells(df, cells) if cells else long_form(df).filter("value <> ''")
    counts = filled.groupBy("column", shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    return counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "shape"))).withColumn("dominant", F.col("rank") <= top).withColumn("minority", F.col("share") < 0.05)


def missing_tokens(counts: DataFrame) -> DataFrame:
    """(column, token, n): missing tokens as written, and whitespace_only."""
    v = F.col("value")
    bare = strip(v)
    token = F.when((v != "") & (bare == ""), "whitespace_only").when(F.lower(bare).isin(*R1_TOKENS), bare)
    return counts.withColumn("token", token).filter("token is not null").groupBy("column", "token").agg(F.sum("n").alias("n"))


def column_stats(counts: DataFrame) -> DataFrame:
    """(column, n_cells, n_blank, n_unique, unique_ratio, numeric_parse_rate); the blank counts as a value."""
    v, n = F.col("value"), F.col("n")
    ok = rules.numeric_rate(v)
    g = counts.groupBy("column").agg(F.sum(n).alias("n_cells"), F.sum(F.when(v == "", n).otherwise(0)).alias("n_blank"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.when((v != "") & ok, n).otherwise(0)).alias("_ok"))
    filled = F.col("n_cells") - F.col("n_blank")
    return g.select("column", "n_cells", "n_blank", "n_unique", (F.col("n_unique") / F.col("n_cells")).alias("unique_ratio"), F.when(filled > 0, F.col("_ok") / filled).otherwise(0.0).alias("numeric_parse_rate"))


def samples(counts: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct values of each column in row order."""
    w = Window.partitionBy("column").orderBy("first")
    return counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).select("column", F.col("_rn").alias("position"), "value")


def candidate_dependencies(t: rules.Learned, min_confidence: float = 0.95) -> list[rules.Dependency]:
    """Approximate dependencies over all rows, without sampling."""
    return rules.dependencies(t, min_confidence, repair=False)


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties go to the smaller value, so rank 1 is the mode."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.filter("value is not null and value <> ''").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "rank", "value", "n")


def numeric_profile(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """P10: per numeric column count, min, max, mean, median, sample deviation (0 for one value), quartiles, range between, zeros and negatives."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ROW]
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]))
    cells = df.select(x.alias("_p")).select("_p.column", "_p.x").filter("x is not null and not isnan(x)")
    counts = cells.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    q = exact_percentiles(counts, ["column"], "x", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    g = cells.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.count(F.when(F.col("x") == 0, 1)).alias("zeros"), F.count(F.when(F.col("x") < 0, 1)).alias("negatives"))
    j = g.join(q, "column")
    r = lambda c: F.round(c, digits)
    return j.select("column", "n", r("min").alias("min"), r("max").alias("max"), r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"), r("q1").alias("q1"), r("q3").alias("q3"), r(F.col("q3") - F.col("q1")).alias("iqr"), "zeros", "negatives")


def datetime_profile(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("timestamp").alias("x")) for c in cols]))
    return df.select(each.alias("_p")).groupBy("_p.column").agg(F.count("_p.x").alias("n"), F.min("_p.x").alias("min"), F.max("_p.x").alias("max"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """P10: one row: rows, columns, missing cells (null or sentinel), duplicate rows."""
    cols = data_columns(df)
    n_missing = sum((F.col(f"`{c}`").isNull() | F.lower(strip(F.col(f"`{c}`").cast("string"))).isin(*QUALITY_SENTINELS)).cast("bigint") for c in cols)
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"), F.coalesce(F.sum(n_missing), F.lit(0)).alias("missing_cells"))
    d = df.select(*rules.row_keys(df, cols)).distinct().agg(F.count(F.lit(1)).alias("_d"))
    return a.crossJoin(d).select("n_rows", "n_columns", "missing_cells", (F.col("n_rows") - F.col("_d")).alias("duplicate_rows"))


def logical_types(df: DataFrame) -> list[dict]:
    """The logical type of every column from one aggregation of shares; decided in the fixed order of the cascade."""
    from .detect import is_date

    cols = [c for c in df.columns if c != ROW]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in cols if isinstance(kinds[c], T.StringType)]
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(text):
        v = strip(F.col(f"`{c}`"))
        ok = F.col(f"`{c}`").isNotNull() & (v != "")
        low = F.lower(v)
        share = lambda cond, name, ok=ok, i=i: F.count(F.when(ok & cond, 1)).alias(f"{name}{i}")
        aggs += [
            F.count(F.when(ok, 1)).alias(f"n{i}"), F.count_distinct(F.when(ok, v)).alias(f"u{i}"), F.avg(F.when(ok, F.length(v))).alias(f"len{i}"),
            share(low.isin("true", "false", "yes", "no", "t", "f", "y", "n", "1", "0"), "bool"), share(v.rlike(SCHEMA_EMAIL), "mail"), share(v.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), "date"),
            share(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), "num"), share(is_date(v), "parsed"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for c in cols:
        t = kinds[c]
        if isinstance(t, T.NumericType | T.BooleanType):
            logical = "numeric"
        elif isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
            logical = "datetime"
        elif not isinstance(t, T.StringType):
            logical = "unknown"
        else:
            i = text.index(c)
            n, u = row[f"n{i}"], row[f"u{i}"]
            r = lambda k, i=i, n=n: row[f"{k}{i}"] / n
            low = c.lower()
            if not n:
                logical = "unknown"
            elif r("bool") >= 0.9 and u <= 4:
                logical = "boolean"
            elif r("mail") >= 0.7:
                logical = "email"
            elif (r("date") >= 0.5 or any(h in low for h in DATE_HINTS)) and r("parsed") >= 0.5:
                logical = "datetime"
            elif r("num") >= 0.8:
                logical = "numeric"
            elif re.search(r"id|uuid|code", low) and u / n > 0.9:
                logical = "identifier"
            elif u / n < 0.25 or u <= 50:
                logical = "categorical"
            elif (row[f"len{i}"] or 0) > 50:
                logical = "text"
            else:
                logical = "categorical"
        out.append({"column": c, "logical_type": logical})
    return out


def profile_table(df: DataFrame, key: str | None = None) -> dict[str, DataFrame | list]:
    """The rule-side profile of a table as frames, each a row per column or per column and item."""
    t = rules.learn(df, key)
    return {"stats": column_stats(t.counts), "shapes": shapes(t.frame), "missing_tokens": missing_tokens(t.counts), "samples": samples(t.counts), "dependencies": candidate_dependencies(t)}
