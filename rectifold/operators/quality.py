"""Quality score, confidences, and metrics of detections and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import QUALITY_SENTINELS, strip
from . import rules
from .values import ROW, data_columns

# Which dimension an issue lowers; kinds not named lower consistency.
DIMENSIONS = {"missing_value": "completeness", "exact_duplicate": "uniqueness", "near_duplicate": "uniqueness", "invalid_range": "validity", "invalid_date": "validity", "type_inconsistency": "validity", "cross_column_contradiction": "validity", "outlier": "anomaly"}


def resolution_rate(initial: Column, repaired: Column) -> Column:
    """G1: repaired of initial defects in percent, at most 100; 100 without defects."""
    return F.round(F.when(initial > 0, F.least(F.lit(100.0), 100.0 * repaired / initial)).otherwise(100.0), 2)


def quality_score(df: DataFrame, issues: DataFrame | None = None, cfg: Config | None = None) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency and anomaly in percent, their weighted score and a grade."""
    cfg = cfg or Config()
    cols = data_columns(df)
    gone = sum((F.col(f"`{c}`").isNull() | F.lower(strip(F.col(f"`{c}`").cast("string"))).isin(*QUALITY_SENTINELS)).cast("bigint") for c in cols)
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(gone), F.lit(0)).alias("missing"))
    distinct = df.select(*rules.row_keys(df, cols)).distinct().agg(F.count(F.lit(1)).alias("distinct"))
    kinds = ("validity", "consistency", "anomaly")
    if issues is not None:
        dim = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv]), F.col("issue_type")), F.lit("consistency"))
        n = issues.withColumn("_d", dim).agg(*[F.count(F.when(F.col("_d") == k, 1)).alias(f"n_{k}") for k in kinds])
    else:
        n = base.select(*[F.lit(0).alias(f"n_{k}") for k in kinds])
    cells = F.greatest(F.col("rows") * len(cols), F.lit(1))
    j = base.crossJoin(distinct).crossJoin(n)
    dims = {"completeness": 100.0 * (1 - F.col("missing") / cells), "uniqueness": F.when(F.col("rows") > 0, 100.0 * F.col("distinct") / F.col("rows")).otherwise(100.0)}
    dims |= {k: 100.0 / (1 + 5 * F.col(f"n_{k}") / cells) for k in kinds}
    score = sum(cfg.weights[k] * d for k, d in dims.items())
    out = j.select(*[F.round(d, 2).alias(k) for k, d in dims.items()], F.round(score, 2).alias("score"))
    s = F.col("score")
    return out.withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").otherwise("D"))


def category_confidence(similarity: Column, frequency: Column, context: Column) -> Column:
    """Half similarity, three tenths frequency, two tenths context."""
    return F.round(0.50 * similarity + 0.30 * frequency + 0.20 * context, 3)


def outlier_confidence(z: Column, iqr: Column, forest: Column) -> Column:
    """Weighted signals; two of at least 0.8 raise it by 0.05, three by 0.1, up to 0.99."""
    strong = sum((x >= 0.8).cast("int") for x in (z, iqr, forest))
    return F.round(F.least(F.lit(0.99), 0.35 * z + 0.35 * iqr + 0.30 * forest + F.when(strong >= 3, 0.1).when(strong == 2, 0.05).otherwise(0.0)), 3)


def detection_metrics(truth: DataFrame, issues: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) per corruption type and overall; truth (row, column, corruption_type), issues (row, column, issue_type). A cell counts once."""
    t = truth.select("row", "column", F.col("corruption_type").alias("type")).distinct()
    i = issues.filter("row is not null").select("row", "column").distinct()
    hit = t.join(i.withColumn("_hit", F.lit(1)), ["row", "column"], "left")
    per = hit.groupBy("type").agg(F.count("_hit").alias("tp"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("fn")).withColumn("fp", F.lit(0).cast("bigint"))
    fp = i.join(t.select("row", "column").distinct(), ["row", "column"], "left_anti").agg(F.count(F.lit(1)).alias("fp"))
    cells = hit.groupBy("row", "column").agg(F.max("_hit").alias("_hit")).agg(F.count("_hit").alias("tp"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("fn"))
    whole = cells.crossJoin(fp).select(F.lit("overall").alias("type"), "tp", "fn", "fp")
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = per.select("type", "tp", "fn", "fp").unionByName(whole).withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4))
    return out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)).select("type", "tp", "fp", "fn", "precision", "recall", "f1")


def correction_metrics(truth: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row: corruptions, those corrected, changed wrongly and unresolved, and the accuracy in percent.

    truth (row, column, original_value, corrupted_value); corrected (_row_id and text columns). Equal in any case, or numbers less than 0.01 apart, is right.
    """
    cols = data_columns(corrected)
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("now")) for c in cols]))
    cells = corrected.select(F.col(ROW).alias("row"), x.alias("_p")).select("row", "_p.column", "_p.now")
    j = truth.join(cells, ["row", "column"], "left")
    norm = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    num = lambda c: F.when(strip(c).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), strip(c).try_cast("double"))
    right = (norm(F.col("now")) == norm(F.col("original_value"))) | F.coalesce(F.abs(num(F.col("now")) - num(F.col("original_value"))) < 1e-2, F.lit(False))
    same = norm(F.col("now")) == norm(F.col("corrupted_value"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = j.agg(F.count(F.lit(1)).alias("corruptions"), n(right, "corrected"), n(~right & ~same, "wrong"), n(~right & same, "unresolved"))
    return out.withColumn("accuracy", F.round(F.when(F.col("corruptions") > 0, 100.0 * F.col("corrected") / F.col("corruptions")).otherwise(0.0), 2))
