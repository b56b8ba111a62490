"""Downstream utility: how well models trained on dirty, cleaned and true data do on the same clean test rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import ROW, data_columns

# Names that targets usually have, in order of preference.
TARGETS = "churn target label class diagnosis income survived price rating type room_type poutcome deposit y default g3 status category".split()
TOP_CATEGORIES = 20


def _num(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def _plain(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


def infer_target(df: DataFrame) -> str | None:
    """A known name, else the last column of 2 to 10 values over at least 20 rows, else the last numeric column of more than five values."""
    cols = data_columns(df)
    low = {c.lower(): c for c in cols}
    for name in TARGETS:
        if name in low:
            return low[name]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(cols)], *[F.avg(_plain(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if 2 <= row[f"u{i}"] <= 10 and row["n"] >= 20]
    nums = [c for i, c in enumerate(cols) if row[f"u{i}"] > 5 and (row[f"s{i}"] or 0) >= 0.75]
    return few[-1] if few else nums[-1] if nums else None


class Encoding:
    """Numeric columns by median, others as lower-case one-hot of the 20 most frequent values and Other, learned from one table and used for all."""

    def __init__(self, df: DataFrame, columns: list[str]):
        row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(_plain(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"s{i}"), F.percentile_approx(_num(F.col(f"`{c}`")), 0.5, 10_000).alias(f"m{i}"))]).first()
        self.medians = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns) if (row[f"s{i}"] or 0) >= 0.75}
        self.levels: dict[str, list[str]] = {}
        for c in columns:
            if c not in self.medians:
                v = F.lower(F.trim(F.col(f"`{c}`").cast("string")))
                self.levels[c] = [r["v"] for r in df.groupBy(v.alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(TOP_CATEGORIES).collect()]

    def features(self) -> list[Column]:
        out = [F.coalesce(_num(F.col(f"`{c}`")), F.lit(float(m))) for c, m in self.medians.items()]
        for c, levels in self.levels.items():
            v = F.coalesce(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), F.lit(""))
            out += [(v == x).cast("double") for x in levels[1:]] + [(~v.isin(*levels)).cast("double") if levels else F.lit(0.0)]
        return out


def utility(tables: dict[str, DataFrame], clean: str, target: str | None = None, rows: int | None = None, trees: int = 40, depth: int = 12, seed: int = 42) -> DataFrame:
    """(model, metric, value) per table: accuracy, f1, precision and recall, or r2, mae and rmse, on test rows of the clean table.

    All rows are used, or the first `rows` of each table. Rows are split 70 to 30 by a hash of their id among ids all tables have; features are
    encoded as the clean table has them, so columns line up.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    base = tables[clean]
    spark = base.sparkSession
    target = target or infer_target(base)
    if target is None:
        return spark.createDataFrame([], "model string, metric string, value double")
    heads = {k: d.orderBy(ROW).limit(rows) for k, d in tables.items()} if rows else dict(tables)
    ids = reduce(lambda a, b: a.join(b, ROW, "left_semi"), [d.select(ROW) for d in heads.values()])
    cols = [c for c in data_columns(base) if c != target and all(c in d.columns for d in tables.values())]
    enc = Encoding(heads[clean], cols)
    y = F.col(f"`{target}`")
    st = heads[clean].agg(F.count_distinct(y).alias("u"), F.avg(_plain(y).isNotNull().cast("double")).alias("s")).first()
    regression = (st["s"] or 0) >= 0.75 and st["u"] > 10
    test = F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(10)) >= 7
    feats = enc.features()

    def prepare(d: DataFrame) -> DataFrame:
        label = _num(y) if regression else F.lower(F.trim(y.cast("string")))
        out = d.join(ids, ROW, "left_semi").select(ROW, label.alias("_y"), *[f.alias(f"f{i}") for i, f in enumerate(feats)]).filter("_y is not null")
        return VectorAssembler(inputCols=[f"f{i}" for i in range(len(feats))], outputCol="features", handleInvalid="keep").transform(out).select(ROW, "_y", "features")

    truth = prepare(heads[clean])
    index = None if regression else StringIndexer(inputCol="_y", outputCol="label", handleInvalid="skip").fit(truth)
    labelled = lambda d: d.withColumn("label", F.col("_y")) if regression else index.transform(d)
    exam = labelled(truth.filter(test))
    out = []
    for name, d in heads.items():
        train = labelled(prepare(d).filter(~test))
        if regression:
            pred = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(train).transform(exam)
            out += [(name, m, float(RegressionEvaluator(metricName=m).evaluate(pred))) for m in ("r2", "mae", "rmse")]
        else:
            pred = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train).transform(exam)
            names = {"accuracy": "accuracy", "f1": "f1", "weightedPrecision": "precision", "weightedRecall": "recall"}
            out += [(name, n, float(MulticlassClassificationEvaluator(metricName=m).evaluate(pred))) for m, n in names.items()]
    return spark.createDataFrame(out, "model string, metric string, value double")


def suite(name: str, dirty: DataFrame, truth: DataFrame | None = None, target: str | None = None) -> dict:
    """One run: detect and score, propose, approve all but flags, apply, detect and score again, and the models if there is a truth. Small results only."""
    from . import detect, engine, quality

    before = detect.detect_all(dirty)
    p = engine.propose(dirty)
    a = engine.apply(p, engine.approve(p.proposals, ("AUTO", "REVIEW")))
    after = detect.detect_all(a.clean)
    out = {
        "name": name, "issues_before": before.count(), "issues_after": after.count(), "score_before": quality.quality_score(dirty, before).first()["score"], "score_after": quality.quality_score(a.clean, after).first()["score"],
        "diff": engine.diff_summary(p.table.frame, a.diff).first().asDict(), "issues": [r.asDict() for r in engine.before_after(before, after).collect()],
    }
    if truth is not None:
        out["cells"] = engine.cell_metrics(dirty, truth, a.clean).first().asDict()
        out["utility"] = [r.asDict() for r in utility({"dirty": dirty, "ours": a.clean, "truth": truth}, "truth", target).collect()]
    return out


def comparison_table(results: list[dict], published: dict[str, dict[str, float]] | None = None) -> str:
    """A Markdown table of precision, recall, f1 and harm per run; values at least as good as published ones are bold."""
    lines = ["| dataset | precision | recall | f1 | harm |", "|---|---|---|---|---|"]
    for r in results:
        cells = []
        for m in ("precision", "recall", "f1", "harm"):
            v = r["cells"][m]
            best = (published or {}).get(r["name"], {}).get(m)
            good = best is not None and (v <= best if m == "harm" else v >= best)
            cells.append(f"**{v:.2f}**" if good else f"{v:.2f}")
        lines.append(f"| {re.sub(r'[|]', '/', r['name'])} | " + " | ".join(cells) + " |")
    return "\n".join(lines)
