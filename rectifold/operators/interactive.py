"""Batch forms of the interactive operators: row scopes, formulas, text edits, rules in words. Formulas are parsed, never evaluated as code."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UI_BLANK, strip, title
from .values import ROW, data_columns


def blank(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c.cast("string"))).isin(*UI_BLANK)


def number(c: Column) -> Column:
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


class FormulaError(ValueError):
    """A formula that names an unknown column or uses what is not allowed."""


FUNCTIONS = {
    "round": lambda x, n=None: F.bround(x, 0 if n is None else n), "abs": F.abs, "min": F.least, "max": F.greatest, "sqrt": F.sqrt, "log": F.log, "exp": F.exp, "floor": F.floor, "ceil": F.ceil, "where": lambda c, a, b: F.when(c, a).otherwise(b), "isnan": lambda x: x.isNull(),
}


def aliases(columns: list[str]) -> dict[str, str]:
    """Names a formula may use for a column: itself, with underscores for spaces, and without spaces; `_str` at the end asks for text."""
    out: dict[str, str] = {}
    for c in columns:
        for a in (c, c.replace(" ", "_"), c.replace(" ", ""), re.sub(r"\W", "_", c)):
            out.setdefault(a, c)
    return out


def compile_formula(text: str, columns: list[str], numeric: set[str]) -> Column:
    """A Column of an expression with + - * / // % **, comparisons, and, or, not, and a few functions; `numeric` columns are read as numbers.

    + joins texts. // and % follow the sign of the divisor. Division by zero gives null.
    """
    known = aliases(columns)
    for c in sorted(columns, key=len, reverse=True):
        if not c.isidentifier():
            text = text.replace(f"`{c}`", re.sub(r"\W", "_", c))
            text = re.sub(rf"(?<![\w'\"]){re.escape(c)}(?![\w'\"])", re.sub(r"\W", "_", c), text)
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"no formula: {e.msg}") from e

    def is_text(n: ast.AST) -> bool:
        if isinstance(n, ast.Constant):
            return isinstance(n.value, str)
        if isinstance(n, ast.Name):
            return n.id.endswith("_str") and n.id[:-4] in known or (n.id in known and known[n.id] not in numeric)
        if isinstance(n, ast.BinOp):
            return isinstance(n.op, ast.Add) and (is_text(n.left) or is_text(n.right))
        return False

    def walk(n: ast.AST, as_text: bool = False) -> Column:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, bool) or n.value is None or not isinstance(n.value, int | float | str):
                raise FormulaError("only numbers and texts are constants")
            return F.lit(str(n.value)) if as_text else F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id.endswith("_str") and n.id[:-4] in known:
                return F.coalesce(F.col(f"`{known[n.id[:-4]]}`").cast("string"), F.lit(""))
            if n.id not in known:
                raise FormulaError(f"unknown column {n.id}")
            c = F.col(f"`{known[n.id]}`")
            return number(c) if known[n.id] in numeric and not as_text else F.coalesce(c.cast("string"), F.lit(""))
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, ast.Add) and is_text(n):
                return F.concat(walk(n.left, True), walk(n.right, True))
            a, b = walk(n.left), walk(n.right)
            safe = F.nullif(b.cast("double"), F.lit(0.0))
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / safe, ast.FloorDiv: lambda: F.floor(a / safe), ast.Mod: lambda: a - b * F.floor(a / safe), ast.Pow: lambda: F.pow(a, b)}
            if type(n.op) not in ops:
                raise FormulaError("this operator is not allowed")
            return ops[type(n.op)]()
        if isinstance(n, ast.UnaryOp):
            x = walk(n.operand)
            if isinstance(n.op, ast.USub):
                return -x
            if isinstance(n.op, ast.Not):
                return ~x
            return x
        if isinstance(n, ast.BoolOp):
            parts = [walk(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.Compare):
            cmp = {ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y, ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}
            left, out = walk(n.left), F.lit(True)
            for op, right in zip(n.ops, n.comparators, strict=True):
                if type(op) not in cmp:
                    raise FormulaError("this comparison is not allowed")
                r = walk(right)
                out, left = out & cmp[type(op)](left, r), r
            return out
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == "np" else None
            if name not in FUNCTIONS or n.keywords:
                raise FormulaError("this function is not allowed")
            if name == "round":
                digits = n.args[1].value if len(n.args) > 1 and isinstance(n.args[1], ast.Constant) else None
                return FUNCTIONS["round"](walk(n.args[0]), digits)
            return FUNCTIONS[name](*[walk(a) for a in n.args])
        raise FormulaError("this expression is not allowed")

    return walk(tree)


def numeric_in_scope(df: DataFrame, columns: list[str], scope: Column | None = None) -> set[str]:
    """Columns of which at least half the filled cells in scope are numbers."""
    s = F.lit(True) if scope is None else scope
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(F.when(s & ~blank(F.col(f"`{c}`")), 1)).alias(f"n{i}"), F.count(F.when(s & number(F.col(f"`{c}`")).isNotNull(), 1)).alias(f"x{i}"))]).first()
    return {c for i, c in enumerate(columns) if row[f"n{i}"] and row[f"x{i}"] >= 0.5 * row[f"n{i}"]}


def scope(df: DataFrame, how: str = "all", column: str | None = None, first: int | None = None, last: int | None = None, rows: str | None = None, condition: str | None = None) -> Column:
    """B1: rows by all, range (both ends in), list (separated by ; or ,), blank target, or a condition; an undecided condition is no."""
    if how == "all":
        return F.lit(True)
    if how == "range":
        return F.col(ROW).between(first, last)
    if how == "list":
        return F.col(ROW).isin([int(x) for x in re.split(r"[;,]", rows or "") if x.strip().lstrip("-").isdigit()])
    if how == "blank":
        return blank(F.col(f"`{column}`"))
    if how == "condition":
        cols = data_columns(df)
        return F.coalesce(compile_formula(condition or "", cols, numeric_in_scope(df, cols)), F.lit(False))
    raise ValueError(f"unknown scope {how}")


def formatted(c: Column) -> Column:
    """Numbers as text: no decimals where integral, null as empty."""
    d = c.cast("string").try_cast("double")
    whole = F.coalesce((d == F.floor(d)) & (F.abs(d) < 1e15), F.lit(False))
    return F.when(c.isNull(), F.lit("")).when(whole & c.cast("string").rlike(r"^[-+]?\d+(\.0*)?([eE][-+]?\d+)?$"), d.cast("bigint").cast("string")).otherwise(c.cast("string"))


def apply_formula(df: DataFrame, target: str, formula: str, where: Column | None = None) -> DataFrame:
    """The target column in scope gets the formula as text; a new target starts empty."""
    cols = data_columns(df)
    w = F.lit(True) if where is None else where
    value = formatted(compile_formula(formula, cols, numeric_in_scope(df, cols, where)))
    old = F.col(f"`{target}`").cast("string") if target in cols else F.lit("")
    return df.withColumn(target, F.when(w, value).otherwise(old))


def append_text(df: DataFrame, column: str, text: str, where: Column | None = None, before: bool = False, separator: str = "") -> DataFrame:
    """Text after or before filled cells in scope."""
    c = F.col(f"`{column}`").cast("string")
    w = ~blank(c) if where is None else where & ~blank(c)
    new = F.concat(F.lit(text), F.lit(separator), c) if before else F.concat(c, F.lit(separator), F.lit(text))
    return df.withColumn(column, F.when(w, new).otherwise(c))


def find_replace(df: DataFrame, find: str, replace: str, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Whole cells, or all occurrences within them; an empty search changes nothing."""
    if not find:
        return df
    out = {}
    for c in columns or data_columns(df):
        v = F.col(f"`{c}`").cast("string")
        out[c] = F.when(v == find, F.lit(replace)).otherwise(v) if exact else F.replace(v, F.lit(find), F.lit(replace))
    return df.withColumns(out)


def odd_text(df: DataFrame, column: str, rows: int = 500) -> DataFrame:
    """Among the first 500 rows the cells with a digit inside a word, or a year of the nineteenth century."""
    v = F.col(f"`{column}`").cast("string")
    first = df.orderBy(ROW).limit(rows)
    return first.filter(v.rlike(r"\p{L}[0-9@$]|[0-9@$]\p{L}") | v.rlike(r"(?<!\d)18\d{2}(?!\d)")).select(ROW, v.alias("value"))


def century(c: Column) -> Column:
    """Years 18xx as 19xx."""
    return F.regexp_replace(c, r"(?<!\d)18(\d{2})(?!\d)", "19$1")


# Digits and signs and the letters they look like.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "8": "b", "@": "a", "$": "s"}


def leet(c: Column) -> Column:
    """Digits and signs inside words as the letters they look like, then title case."""
    return title(F.translate(c, "".join(LEET), "".join(LEET.values())))


def rule_violations(df: DataFrame, rule: str, column: str | None = None) -> DataFrame:
    """Rows that break a rule in words: 'must be positive' or '> 0' finds negative numbers (zero passes), 'not null' or 'not empty' finds blanks.

    Without a column the one whose name the rule mentions is meant; a rule that says neither finds nothing.
    """
    low = rule.lower()
    cols = data_columns(df)
    c = column or next((x for x in sorted(cols, key=len, reverse=True) if x.lower() in low or x.lower().replace("_", " ") in low), None)
    if c is None:
        return df.limit(0)
    v = F.col(f"`{c}`")
    if "positive" in low or re.search(r">=?\s*0|greater than (or equal to )?(0|zero)|not be negative|non-?negative", low):
        return df.filter(number(v) < 0)
    if re.search(r"not\s+(be\s+)?(null|empty|blank|missing)", low):
        return df.filter(blank(v))
    return df.limit(0)


def grid_edits(original: DataFrame, edited: DataFrame) -> DataFrame:
    """Overrides (row, column, value) of the cells that an edited grid changed."""
    cols = [c for c in data_columns(original) if c in edited.columns]
    a = original.select(ROW, *[F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(cols)])
    b = edited.select(ROW, *[F.col(f"`{c}`").cast("string").alias(f"b{i}") for i, c in enumerate(cols)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("old"), F.col(f"b{i}").alias("value")) for i, c in enumerate(cols)]))
    return a.join(b, ROW).select(F.col(ROW).alias("row"), cells.alias("_c")).filter(~F.coalesce("_c.old", F.lit("")).eqNullSafe(F.coalesce("_c.value", F.lit("")))).select("row", "_c.column", F.coalesce("_c.value", F.lit("")).alias("value"))
