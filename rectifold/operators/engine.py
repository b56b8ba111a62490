"""Proposals over a table, their approval, application with a cell-level diff, and comparisons of tables.

Application is one projection: per column the approved edits in rank order, first one wins, each only where the cell still has
the text it was proposed for. Rows are dropped by their keys after the edits. The diff is one exploded pass over the same frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import assist, rules
from .rules import Learned, Proposal
from .values import ROW, data_columns, long_form

DIFF = ("rule_id", "rule_kind", "tier", "row", "column", "old_value", "new_value")
Ask = Callable[[str, list[str]], dict[str, str]]


@dataclass
class Proposed:
    """Proposals with the table they were learned from."""

    table: Learned
    proposals: list[Proposal]

    def header(self, spark) -> DataFrame:
        """One row per proposal."""
        rows = [(p.seq, p.id, p.kind, p.tier, ",".join(p.columns), p.description, p.evidence, int(p.n_cells)) for p in self.proposals]
        return spark.createDataFrame(rows, "seq int, id string, kind string, tier string, columns string, description string, evidence string, n_cells bigint")

    def changes(self) -> DataFrame:
        """(proposal_id, seq, _row_id, column, old_value, new_value) of every proposed cell, overlapping ones too."""
        items = [F.struct(F.lit(p.id).alias("proposal_id"), F.lit(p.seq).alias("seq"), F.lit(e.column).alias("column"), F.col(f"`{e.column}`").alias("old_value"), e.new.alias("new_value")) for p in self.proposals for e in p.edits]
        if not items:
            return self.table.frame.sparkSession.createDataFrame([], "proposal_id string, seq int, _row_id bigint, column string, old_value string, new_value string")
        return self.table.frame.select(ROW, F.explode(F.array(*items)).alias("_c")).select("_c.proposal_id", "_c.seq", ROW, "_c.column", "_c.old_value", "_c.new_value").filter("new_value is not null")

    def samples(self, k: int = 5) -> DataFrame:
        """The first k changes of each proposal."""
        w = Window.partitionBy("seq").orderBy(ROW, "column")
        return self.changes().withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def propose(df: DataFrame, key: str | None = None, imputation: bool = False, semantic: Ask | None = None, columns: list[str] | None = None) -> Proposed:
    """All rules in their fixed order. Each learns from the raw table; cells that earlier rules propose are taken, approved or not."""
    t = rules.learn(df if columns is None else df.select(*([ROW] if ROW in df.columns else []), *([key] if key and key not in columns else []), *columns), key)
    out: list[Proposal] = []
    for rule in (rules.r1_missing, rules.r2_numeric, rules.r3_whitespace_case, rules.r4_dates, rules.r5_compound_split, rules.r6_dependency_repair, rules.r7_category_variants):
        got = rule(t)
        t.hit(got)
        out += got
    if semantic:
        got = assist.vocabulary_proposals(t, semantic)
        t.hit(got)
        out += got
    if imputation:
        got = rules.impute_safe(t)
        t.hit(got)
        out += got
    out += rules.r8_exact_duplicates(t) + rules.validators(t) + rules.iqr_outliers(t)[0]
    return Proposed(t, rules.numbered(out))


def approve(proposals: list[Proposal], tiers: tuple[str, ...] = ("AUTO",), also: set[tuple[str, int]] | None = None, without: set[tuple[str, int]] | None = None) -> list[Proposal]:
    """Proposals of the tiers, and those named by (id, seq), without the deselected; FLAG proposals change nothing and stay out."""
    also, without = also or set(), without or set()
    return [p for p in proposals if p.tier != "FLAG" and (p.tier in tiers or (p.id, p.seq) in also) and (p.id, p.seq) not in without]


@dataclass
class Applied:
    clean: DataFrame
    diff: DataFrame


def apply(proposed: Proposed, approved: list[Proposal], overrides: DataFrame | None = None) -> Applied:
    """The cleaned table and the diff. overrides (row, column, value[, seq]) come last, unconditionally; of several for a cell the last counts.

    Rows are dropped only if an approved proposal drops rows; repeats are found again after the edits.
    """
    t = proposed.table
    todo = sorted((p for p in approved if p.tier != "FLAG"), key=lambda p: (p.rank, p.seq))
    finals, marks = {}, {}
    for c in t.columns:
        raw = F.col(f"`{c}`")
        edits = [(p, e) for p in todo for e in p.edits if e.column == c]
        # the first approved edit claims the cell; one that was proposed for the stripped text leaves padded cells alone
        value, mark = raw, F.lit(None).cast("int")
        for p, e in reversed(edits):
            fits = (raw == strip(raw)) if e.stripped else F.lit(True)
            value = F.when(e.new.isNotNull(), F.when(fits, e.new).otherwise(raw)).otherwise(value)
            mark = F.when(e.new.isNotNull(), F.when(fits & (e.new != raw), F.lit(p.seq)).otherwise(F.lit(None).cast("int"))).otherwise(mark)
        finals[c], marks[c] = value, mark
    edited = t.frame.select(ROW, *[F.struct(F.col(f"`{c}`").alias("old"), finals[c].alias("new"), marks[c].alias("seq")).alias(c) for c in t.columns])
    by_seq = {p.seq: p for p in todo}
    name = lambda attr: F.try_element_at(F.create_map(*[F.lit(x) for s, p in by_seq.items() for x in (s, getattr(p, attr))]), F.col("_c.seq")) if by_seq else F.lit(None).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.old").alias("old"), F.col(f"`{c}`.new").alias("new"), F.col(f"`{c}`.seq").alias("seq")) for c in t.columns]))
    diff = edited.select(ROW, cells.alias("_c")).filter("_c.seq is not null")
    diff = diff.select(name("id").alias("rule_id"), name("kind").alias("rule_kind"), name("tier").alias("tier"), F.col(ROW).cast("string").alias("row"), F.col("_c.column").alias("column"), F.col("_c.old").alias("old_value"), F.col("_c.new").alias("new_value"))
    clean = edited.select(ROW, *[F.col(f"`{c}`.new").alias(c) for c in t.columns])
    drop = next((p for p in todo if p.drops_rows), None)
    if drop:
        gone = rules.duplicate_rows(clean, t.columns)
        diff = diff.unionByName(gone.select(F.lit(drop.id).alias("rule_id"), F.lit(drop.kind).alias("rule_kind"), F.lit(drop.tier).alias("tier"), F.col(ROW).cast("string").alias("row"), F.lit("__ROW__").alias("column"), F.lit("DUPLICATE_ROW").alias("old_value"), F.lit("DROPPED").alias("new_value")))
        clean = clean.join(gone.select(ROW), ROW, "left_anti")
    if overrides is not None:
        clean, manual = override(clean, overrides)
        diff = diff.unionByName(manual)
    return Applied(clean, diff)


def override(df: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with manual edits (row, column, value, optional seq for their order), and the diff of those that change something."""
    cols = data_columns(df)
    order = F.col("seq") if "seq" in overrides.columns else F.lit(0)
    last = overrides.groupBy(F.col("row").cast("bigint").alias("_r"), "column").agg(F.max_by(F.coalesce("value", F.lit("")), order).alias("value"))
    wide = last.groupBy("_r").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_m"))  # at most a value per column
    both = df.join(wide, F.col(ROW) == F.col("_r"), "left")
    new = {c: F.coalesce(F.try_element_at("_m", F.lit(c)), F.col(f"`{c}`")) for c in cols}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("old"), new[c].alias("new")) for c in cols]))
    diff = both.filter("_r is not null").select(ROW, cells.alias("_c")).filter("_c.old <> _c.new")
    diff = diff.select(F.lit("MANUAL_EDIT").alias("rule_id"), F.lit("MANUAL_EDIT").alias("rule_kind"), F.lit("MANUAL").alias("tier"), F.col(ROW).cast("string").alias("row"), F.col("_c.column").alias("column"), F.col("_c.old").alias("old_value"), F.col("_c.new").alias("new_value"))
    return both.select(ROW, *[new[c].alias(c) for c in cols]), diff


def diff_summary(original: DataFrame, diff: DataFrame) -> DataFrame:
    """One row: cells, modified cells, dropped rows, untouched share in percent, harm risk (a constant 0.0, not a measure)."""
    cols = data_columns(original)
    n = original.agg((F.count(F.lit(1)) * len(cols)).alias("total_cells"))
    d = diff.agg(F.count(F.when(F.col("column") != "__ROW__", 1)).alias("modified_cells"), F.count(F.when(F.col("column") == "__ROW__", 1)).alias("dropped_rows"))
    return n.crossJoin(d).select("total_cells", "modified_cells", "dropped_rows", F.round(F.when(F.col("total_cells") > 0, 100.0 * (F.col("total_cells") - F.col("modified_cells")) / F.col("total_cells")).otherwise(100.0), 2).alias("untouched_percentage"), F.lit(0.0).alias("harm_risk"))


def changes_by_kind(diff: DataFrame) -> DataFrame:
    return diff.groupBy("rule_kind").agg(F.count(F.lit(1)).alias("n"))


def diff_table(diff: DataFrame, limit: int = 500) -> DataFrame:
    """The first rows of the diff for display."""
    return diff.select(F.col("row").alias("Row"), F.col("column").alias("Column"), F.col("old_value").alias("Before"), F.col("new_value").alias("After"), F.col("rule_kind").alias("Rule"), F.col("tier").alias("Tier")).orderBy(F.col("Row").try_cast("bigint"), "Column").limit(limit)


def side_by_side(original: DataFrame, clean: DataFrame, diff: DataFrame, rows: int = 15) -> DataFrame:
    """Before and after of the first modified rows that are still there, a row per cell of a changed column."""
    first = diff.filter("column <> '__ROW__'").select(F.col("row").try_cast("bigint").alias(ROW)).distinct().orderBy(ROW).limit(rows)
    cells = diff.filter("column <> '__ROW__'").select(F.col("row").try_cast("bigint").alias(ROW), "column")
    a = long_form(original.join(first, ROW, "left_semi")).withColumnRenamed("value", "before")
    b = long_form(clean.join(first, ROW, "left_semi")).withColumnRenamed("value", "after")
    return a.join(b, [ROW, "column"]).join(cells, [ROW, "column"], "left_semi").orderBy(ROW, "column")


def tally(diff: DataFrame) -> DataFrame:
    """Columns by kind of change."""
    return diff.groupBy("column", "rule_kind").agg(F.count(F.lit(1)).alias("n"))


def same_exact(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def same_number(a: Column, b: Column) -> Column:
    """Equal texts, or numbers less than 1e-6 apart."""
    num = lambda c: F.when(F.trim(c).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), F.trim(c).try_cast("double"))
    return same_exact(a, b) | F.coalesce(F.abs(num(a) - num(b)) < 1e-6, F.lit(False))


def same_boolean(a: Column, b: Column) -> Column:
    """Equal texts or numbers, or two words for the same truth value."""
    truth = lambda c: F.when(F.lower(F.trim(c)).isin("yes", "true", "t", "1", "y"), F.lit(True)).when(F.lower(F.trim(c)).isin("no", "false", "f", "0", "n"), F.lit(False))
    return same_number(a, b) | F.coalesce(truth(a) == truth(b), F.lit(False))


def cell_metrics(dirty: DataFrame, truth: DataFrame, output: DataFrame, tolerant: bool = False, skip: tuple[str, ...] = (), booleans: bool = False) -> DataFrame:
    """tolerant compares numbers by value, booleans also truth words. One row: errors, changed, fixed, damaged, wrong and missed cells, precision, recall, f1 and harm in percent, over rows all three have."""
    cols = [c for c in data_columns(dirty) if c in truth.columns and c in output.columns and c not in skip]
    same = same_boolean if booleans else same_number if tolerant else same_exact
    side = lambda df, s: df.select(ROW, *[F.col(f"`{c}`").cast("string").alias(f"{s}_{i}") for i, c in enumerate(cols)])
    j = side(dirty, "d").join(side(truth, "t"), ROW).join(side(output, "o"), ROW)
    trio = F.explode(F.array(*[F.struct(F.col(f"d_{i}").alias("d"), F.col(f"t_{i}").alias("t"), F.col(f"o_{i}").alias("o")) for i in range(len(cols))]))
    cells = j.select(trio.alias("c")).select((~same(F.col("c.d"), F.col("c.t"))).alias("error"), (~same(F.col("c.d"), F.col("c.o"))).alias("changed"), same(F.col("c.o"), F.col("c.t")).alias("right"))
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    e, ch, r = F.col("error"), F.col("changed"), F.col("right")
    m = cells.agg(F.count(F.lit(1)).alias("cells"), n(e, "errors"), n(ch, "changed"), n(e & ch & r, "fixed"), n(~e & ch & ~r, "damaged"), n(e & ch & ~r, "wrong"), n(e & ~ch, "missed"), n(r, "right"))
    pct = lambda a, b, empty: F.when(b > 0, 100.0 * a / b).otherwise(F.lit(empty))
    precision, recall = pct(F.col("fixed"), F.col("changed"), 0.0), pct(F.col("fixed"), F.col("errors"), 0.0)
    m = m.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    clean_cells = F.col("cells") - F.col("errors")
    m = m.withColumn("f1", F.round(f1, 4)).withColumn("harm", F.round(pct(F.col("damaged"), clean_cells, 0.0), 4)).withColumn("agreement", F.round(pct(F.col("right"), F.col("cells"), 100.0), 4))
    return m.withColumn("precision", F.round("precision", 4)).withColumn("recall", F.round("recall", 4)).drop("right")


def oracle_filter(dirty: DataFrame, truth: DataFrame, output: DataFrame) -> DataFrame:
    """output with every change of a cell that was right taken back."""
    cols = [c for c in data_columns(dirty) if c in truth.columns and c in output.columns]
    a = dirty.select(ROW, *[F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(cols)])
    b = truth.select(ROW, *[F.col(f"`{c}`").alias(f"t_{i}") for i, c in enumerate(cols)])
    j = output.join(a, ROW).join(b, ROW)
    return j.select(ROW, *[F.when(same_exact(F.col(f"d_{i}"), F.col(f"t_{i}")), F.col(f"d_{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(cols)])


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(issue_type, before, after, resolved, rate): a full outer join of issue counts."""
    a = before.groupBy("issue_type").agg(F.count(F.lit(1)).alias("before"))
    b = after.groupBy("issue_type").agg(F.count(F.lit(1)).alias("after"))
    j = a.join(b, "issue_type", "full_outer").select("issue_type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    resolved = F.greatest(F.col("before") - F.col("after"), F.lit(0))
    return j.select("*", resolved.alias("resolved"), F.round(F.when(F.col("before") > 0, 100.0 * resolved / F.col("before")).otherwise(100.0), 2).alias("rate"))


def fidelity(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation of numeric columns before and after."""
    def one(df: DataFrame, when: str) -> DataFrame:
        x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("x")) for c in columns]))
        return df.select(x.alias("p")).groupBy("p.column").agg(F.round(F.avg("p.x"), 4).alias(f"mean_{when}"), F.round(F.stddev_samp("p.x"), 4).alias(f"std_{when}"))

    return one(before, "before").join(one(after, "after"), "column")


def explain(p: Proposal) -> str:
    """A preview line of a proposal."""
    return f"[{p.tier}] {p.id}: {p.description}. {p.evidence}".strip()


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
