"""Issue detectors over typed or text tables, one flat issue row each, and their unified, de-duplicated list.

Detectors that judge values work on the value counts and join the verdict back; a verdict table is one row per distinct bad value, so
adaptive execution broadcasts it when it is small. Nothing is capped by default; a cap that is asked for is applied with a group limit.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.similarity import close_pairs, indel_ratio, sorted_words, token_sort_ratio
from ..functions.text import TYPE_NULL_TOKENS, collapse, strip, title
from ..session import written
from . import rules
from .percentiles import exact_percentiles
from .values import ROW, data_columns, long_form

ISSUE = ("row", "column", "original_value", "issue_type", "method", "detection_confidence", "correction_confidence", "suggested_action", "suggested_value", "reason", "human")
# Which kind of issue wins a cell.
PRECEDENCE = {
    "invalid_range": 10, "invalid_date": 10, "missing_value": 9, "type_inconsistency": 8, "cross_column_contradiction": 8, "exact_duplicate": 7, "spelling_typo": 6, "casing_inconsistency": 5,
    "whitespace_inconsistency": 4, "near_duplicate": 3, "outlier": 2, "constant_column": 2, "high_cardinality": 2, "class_imbalance": 2, "rare_category": 2, "highly_correlated": 2, "data_leakage": 2, "multivariate_anomaly": 2,
}
# Number words.
WORD_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "1", "y"), ("no", "false", "f", "0", "n")
DATE_WORDS = ("date", "dob", "birth", "joined", "timestamp", "created_at", "updated_at", "time")
# Name parts of columns that hold codes.
CODE_WORDS = ("state", "country", "code", "abbr", "currency", "iso", "zip")
# The formats a date may have; other notations count as invalid.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")


def issue(df: DataFrame, kind: str, column: Column | str, value: Column | None, det: Column | float, corr: Column | float, action: Column | str, suggestion: Column | None = None, reason: str = "", human: Column | bool = False, method: str = "", row: Column | None = None) -> DataFrame:
    lit = lambda x, t: x.cast(t) if isinstance(x, Column) else F.lit(x).cast(t)
    return df.select(
        (F.col(ROW) if row is None else row).cast("bigint").alias("row"), lit(column, "string").alias("column"), (F.lit(None) if value is None else value).cast("string").alias("original_value"), F.lit(kind).alias("issue_type"), F.lit(method or kind).alias("method"),
        lit(det, "double").alias("detection_confidence"), lit(corr, "double").alias("correction_confidence"), lit(action, "string").alias("suggested_action"), (F.lit(None) if suggestion is None else suggestion).cast("string").alias("suggested_value"), F.lit(reason).alias("reason"), lit(human, "boolean").alias("human"),
    )


def _text_cells(df: DataFrame) -> DataFrame:
    cols = data_columns(df)
    return long_form(df.select(ROW, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]), cols)


def _judged(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """Cells of df whose (column, value) has a verdict row."""
    return _text_cells(df).join(verdict, ["column", "value"])


def _counts(df: DataFrame) -> DataFrame:
    return _text_cells(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))


def missing(df: DataFrame, cfg: Config, cap: int | None = None) -> DataFrame:
    """Null, blank or a configured token; with a cap only the first so many of a column."""
    cells = _text_cells(df).filter(F.col("value").isNull() | F.lower(strip(F.col("value"))).isin(*cfg.missing_tokens))
    if cap:
        cells = cells.withColumn("_rn", F.row_number().over(Window.partitionBy("column").orderBy(ROW))).filter(F.col("_rn") <= cap)
    return issue(cells, "missing_value", F.col("column"), F.col("value"), 1.0, 0.0, "impute")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one in all columns; nulls count as equal."""
    d = rules.duplicate_rows(df, data_columns(df))
    return issue(d, "exact_duplicate", "__all__", F.col("first"), 1.0, 1.0, "remove_duplicate", F.col("first"))


def near_duplicates(df: DataFrame, cfg: Config, first: int = 1000, band: int = 49) -> DataFrame:
    """T3 as single-node tools bound it, kept for comparison with them: of the first 1,000 rows without exact repeats each with the next 49.

    `near_duplicates_all` searches all rows and is what `detect_all` and the queries use. A band join on positions: bucket of 50 and the next one, so no row meets more than two buckets.
    """
    cols = data_columns(df)
    dup = rules.duplicate_rows(df, cols).select(ROW)
    rows = df.join(dup, ROW, "left_anti").orderBy(ROW).limit(first)
    sig = F.lower(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in cols]))
    rows = rows.select(ROW, sig.alias("sig")).filter(F.length("sig") >= 5)
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(ROW)))  # at most `first` rows
    width = band + 1
    a = rows.select(F.col(ROW).alias("ra"), F.col("sig").alias("sa"), F.col("pos").alias("pa"), F.explode(F.array(F.floor(F.col("pos") / width), F.floor(F.col("pos") / width) + 1)).alias("b"))
    b = rows.select(F.col(ROW).alias("rb"), F.col("sig").alias("sb"), F.col("pos").alias("pb"), F.floor(F.col("pos") / width).alias("b"))
    pairs = a.join(b, "b").filter((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= band))
    pairs = pairs.withColumn("sim", token_sort_ratio("sa", "sb")).filter((F.col("sim") >= cfg.near_duplicate_similarity) & (F.col("sim") < 100.0))
    return issue(pairs, "near_duplicate", "__all__", F.col("ra"), F.round(F.col("sim") / 100, 3), 0.80, "flag_for_review", F.col("ra"), human=True, row=F.col("rb"))


def near_duplicates_all(df: DataFrame, cfg: Config) -> DataFrame:
    """All pairs of rows without exact repeats, by token-sort ratio from the threshold to below 100.

    Rows of equal sorted words are one key. Keys are laid in blocks by length; each pair of blocks whose lengths can reach the threshold
    is one group, in which letters in common rule out pairs before they are compared. The output grows with the number of near pairs.
    """
    cols = data_columns(df)
    least = cfg.near_duplicate_similarity
    dup = rules.duplicate_rows(df, cols).select(ROW)
    sig = F.lower(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in cols]))
    rows = df.join(dup, ROW, "left_anti").select(ROW, sig.alias("sig")).filter(F.length("sig") >= 5)
    rows = rows.select(ROW, sorted_words("sig").alias("key"))
    rows = written(rows.withColumn("kid", F.min(ROW).over(Window.partitionBy("key"))))
    keys = rows.filter(F.col(ROW) == F.col("kid")).select("kid", "key", F.length("key").alias("len"))
    sizes = sorted((r["len"], r["count"]) for r in keys.groupBy("len").count().collect())  # a row per length
    blocks, where = _length_blocks(sizes)
    reach = [(i, j) for i, (lo, hi) in enumerate(blocks) for j, (low, _) in enumerate(blocks) if i <= j and low * least <= hi * (200.0 - least)]
    if not reach:
        return _union(df, [])
    spark = df.sparkSession
    sides = [(i, n, False) for n, (i, _) in enumerate(reach)] + [(j, n, True) for n, (i, j) in enumerate(reach) if i != j]
    at = spark.createDataFrame(where, "len int, first int, pieces int")
    placed = keys.join(F.broadcast(at), "len").select("kid", "key", (F.col("first") + F.pmod(F.xxhash64("kid"), F.col("pieces"))).cast("int").alias("block"))
    groups = placed.join(F.broadcast(spark.createDataFrame(sides, "block int, pair int, right boolean")), "block").select("pair", "right", "kid", "key")
    groups = groups.repartition(min(len(reach), 256), "pair")  # a number of its own, as adaptive execution would join the few bytes into one task

    def near(pdf):
        import pandas as pd

        right = pdf["right"].to_numpy(dtype=bool)
        same = reach[int(pdf["pair"].iloc[0])]
        same = same[0] == same[1]
        a, b = pdf[~right], pdf[~right] if same else pdf[right]
        i, j, sim = close_pairs(list(a["key"]), list(b["key"]), least, same)
        return pd.DataFrame({"a": a["kid"].to_numpy()[i], "b": b["kid"].to_numpy()[j], "sim": sim})

    found = groups.groupBy("pair").applyInPandas(near, "a bigint, b bigint, sim double").filter("sim < 100")
    pairs = found.join(rows.select(F.col("kid").alias("a"), F.col(ROW).alias("x")), "a").join(rows.select(F.col("kid").alias("b"), F.col(ROW).alias("y")), "b")
    pairs = pairs.select(F.least("x", "y").alias("ra"), F.greatest("x", "y").alias("rb"), "sim")
    return issue(pairs, "near_duplicate", "__all__", F.col("ra"), F.round(F.col("sim") / 100, 3), 0.80, "flag_for_review", F.col("ra"), human=True, row=F.col("rb"))


def _length_blocks(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Blocks (shortest, longest) of texts, and per length its (length, first block, number of blocks), from sorted (length, n)."""
    most = min(8000, max(500, sum(n for _, n in sizes) // 32))
    blocks: list[tuple[int, int]] = []
    where, held = [], 0
    for length, n in sizes:
        limit = max(1, min(most, 4_000_000 // max(1, length)))
        if held and held + n <= limit:
            blocks[-1] = (blocks[-1][0], length)
            where.append((length, len(blocks) - 1, 1))
            held += n
            continue
        pieces = -(-n // limit)
        where.append((length, len(blocks), pieces))
        blocks += [(length, length)] * pieces
        held = n if pieces == 1 else 0
    return blocks, where


def _number(c: Column) -> Column:
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def ranges(df: DataFrame, cfg: Config) -> DataFrame:
    """T4: numbers outside the bounds of the rule whose word the column's name holds, the longest word first."""
    from .assist import domain_rules

    parts = []
    for c, (lo, hi) in domain_rules(data_columns(df), cfg.domain_rules).items():
        x = _number(F.col(f"`{c}`"))
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (x < lo)
        if hi is not None:
            bad = bad | (x > hi)
        parts.append(issue(df.filter(bad), "invalid_range", c, F.col(f"`{c}`"), 1.0, 0.0, "flag_for_human_review", human=True))
    return _union(df, parts)


def _union(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else issue(df.limit(0), "none", "", None, 0.0, 0.0, "")


def is_date(c: Column) -> Column:
    """Whether a text is an existing date in one of the known formats."""
    return reduce(lambda a, b: a | b, [F.try_to_timestamp(c, F.lit(f)).isNotNull() for f in DATE_FORMATS])


def dates(df: DataFrame) -> DataFrame:
    """T5: in columns named like dates, or whose first ten cells look like dates thrice, the values that are no existing date."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW and not f.name.startswith("_h_")]
    if not cols:
        return _union(df, [])
    from .values import as_text, heads

    first = heads(as_text(df.select(ROW, *[F.col(f"`{c}`") for c in cols])), cols, 10)
    live = [c for c in cols if any(w in c.lower() for w in DATE_WORDS) or sum(bool(re.match(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", v.strip())) for v in first[c]) >= 3]
    if not live:
        return _union(df, [])
    v = strip(F.col("value"))
    seen = _counts(df.select(ROW, *[F.col(f"`{c}`") for c in live])).filter((v != "") & ~F.lower(v).isin("nan", "none", "null", "nat"))
    p = [F.regexp_extract(v, r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})$", i).try_cast("int") for i in (1, 2, 3)]
    shaped = v.rlike(r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})$")
    zero = (p[0] == 0) | (p[1] == 0) | (p[2] == 0)
    both = (F.least(p[0], p[1]) > 12) & (p[0] < 1000) | ((p[0] >= 1000) & (F.least(p[1], p[2]) > 12))
    bad = F.coalesce(shaped & (zero | both), F.lit(False)) | ~is_date(v)
    return issue(_judged(df.select(ROW, *[F.col(f"`{c}`") for c in live]), seen.filter(bad).select("column", "value")), "invalid_date", F.col("column"), F.col("value"), 1.0, 0.0, "flag_for_human_review", human=True)


def types(df: DataFrame) -> DataFrame:
    """Per distinct value of text columns: null tokens, booleans (column over 80 %), numbers with currency signs (70 %), number words, else ambiguous."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW]
    if not cols:
        return _union(df, [])
    counts = _counts(df.select(ROW, *[F.col(f"`{c}`") for c in cols])).filter("value is not null")
    v = strip(F.col("value"))
    low = F.lower(v)
    bare = F.regexp_replace(v, "[$,€£]", "")
    number = F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), bare.try_cast("double"))
    null_token = low.isin(*TYPE_NULL_TOKENS)
    boolean = low.isin(*TRUE_WORDS, *FALSE_WORDS)
    n = F.col("n")
    share = counts.groupBy("column").agg(F.sum(F.when(~null_token, n).otherwise(0)).alias("real"), F.sum(F.when(~null_token & boolean, n).otherwise(0)).alias("bools"), F.sum(F.when(~null_token & number.isNotNull(), n).otherwise(0)).alias("nums"))
    rows = [r for r in share.collect() if r["real"]]
    bools = [r["column"] for r in rows if r["bools"] / r["real"] > 0.80]
    nums = [r["column"] for r in rows if r["column"] not in bools and r["nums"] / r["real"] >= 0.70]
    if not bools and not nums:
        return _union(df, [])
    in_bool, in_num = F.col("column").isin(*bools) if bools else F.lit(False), F.col("column").isin(*nums) if nums else F.lit(False)
    words = F.create_map(*[F.lit(str(x)) for kv in WORD_NUMBERS.items() for x in kv])
    word = F.try_element_at(words, F.regexp_replace(low, "-", " "))
    plain = v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$")
    kind = F.when(null_token & (v != ""), "null").when(in_bool & boolean & ~low.isin("true", "false"), "boolean").when(in_num & number.isNotNull() & ~plain, "numeric").when(in_num & word.isNotNull(), "word").when((in_num & number.isNull() & ~null_token) | (in_bool & ~boolean & ~null_token), "ambiguous")
    suggestion = F.when(kind == "boolean", F.when(low.isin(*TRUE_WORDS), "true").otherwise("false")).when(kind == "numeric", number.cast("string")).when(kind == "word", word)
    verdict = counts.filter(in_bool | in_num).select("column", "value", kind.alias("kind"), suggestion.alias("sug")).filter("kind is not null")
    k = F.col("kind")
    det = F.when(k.isin("null", "boolean"), 0.99).when(k == "word", 0.95).otherwise(1.0)
    corr = F.when(k.isin("null", "boolean", "numeric"), 0.99).when(k == "word", 0.85).otherwise(0.0)
    action = F.when(k == "null", "convert_to_null").when(k == "boolean", "convert_to_boolean").when(k == "numeric", "convert_type").when(k == "word", "convert_word_to_number").otherwise("flag_for_human_review")
    return issue(_judged(df, verdict), "type_inconsistency", F.col("column"), F.col("value"), det, corr, action, F.col("sug"), human=k.isin("word", "ambiguous"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ROW]


def _numeric_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]))
    return df.select(ROW, x.alias("_p")).select(ROW, "_p.column", "_p.x").filter("x is not null and not isnan(x)")


def outlier_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, q1, q3, median, mean, std, n) exactly, quartiles by rank selection over value counts."""
    cells = _numeric_cells(df, cols)
    q = exact_percentiles(cells.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n")), ["column"], "x", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.join(cells.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n")), "column")


def outliers(df: DataFrame, cfg: Config, forest: DataFrame | None = None) -> DataFrame:
    """Interquartile range and z-score on numeric columns, optionally an isolation-forest signal (row, column); flagged with two signals, or far out."""
    cols = numeric_columns(df)
    if not cols:
        return _union(df, [])
    cells = _numeric_cells(df, cols).join(outlier_stats(df, cols).filter("n >= 5"), "column")
    iqr = F.col("q3") - F.col("q1")
    dist = F.greatest(F.col("q1") - F.col("x"), F.col("x") - F.col("q3"))
    by_iqr = F.coalesce((iqr > 0) & (dist > cfg.iqr_factor * iqr), F.lit(False))
    z = F.abs(F.col("x") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    by_z = F.coalesce(z > cfg.z_threshold, F.lit(False))
    signal = F.lit(0)
    if forest is not None:
        cells = cells.join(forest.select(ROW, "column", F.lit(1).alias("_forest")), [ROW, "column"], "left")
        signal = F.coalesce("_forest", F.lit(0))
    count = by_iqr.cast("int") + by_z.cast("int") + signal
    far = F.coalesce(z > 4, F.lit(False)) | (by_iqr & (F.abs(F.col("x") - F.col("mean")) > 3 * iqr))
    strength = lambda s: F.greatest(F.least(s, F.lit(0.99)), F.lit(0.5))
    parts = F.array_compact(F.array(F.when(by_iqr, strength(0.5 + 0.1 * dist / iqr)), F.when(by_z, strength(z / 6))))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(parts), F.lit(1))
    hit = cells.filter((count >= 2) | far)
    return issue(hit, "outlier", F.col("column"), F.col("x"), F.round(strength(mean), 3), 0.30, "flag_only", F.col("median"), human=True)


def forms(df: DataFrame) -> DataFrame:
    """(column, key, canonical, count): per case-folded value the spelling that stands for it: the most frequent, titled when all lower case."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, key string, canonical string, n bigint, kinds bigint")
    counts = _counts(df.select(ROW, *[F.col(f"`{c}`") for c in cols])).filter(strip(F.col("value")) != "")
    n = F.col("n")
    share = counts.groupBy("column").agg(F.sum(F.when(_number(F.col("value")).isNotNull(), n).otherwise(0)).alias("nums"), F.sum(n).alias("all"))
    text = share.filter(F.col("nums") < 0.70 * F.col("all")).select("column")
    variants = counts.join(text, "column").groupBy("column", F.lower(collapse(F.col("value"))).alias("key"), collapse(F.col("value")).alias("v")).agg(F.sum(n).alias("n"))
    lead = variants.groupBy("column", "key").agg(F.max(F.struct("n", "v")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    v = F.col("top.v")
    return lead.select("column", "key", F.when(v == F.lower(v), title(v)).otherwise(v).alias("canonical"), F.col("top.n").alias("n"), "kinds")


def inconsistencies(df: DataFrame) -> DataFrame:
    """White space and letter case that differ from the canonical spelling of the same folded text."""
    cells = _text_cells(df).filter(strip(F.col("value")) != "").withColumn("key", F.lower(collapse(F.col("value"))))
    j = cells.join(forms(df), ["column", "key"])
    v = F.col("value")
    spaces = j.filter(v != collapse(v))
    case = j.filter((v == collapse(v)) & (v != F.col("canonical")))
    a = issue(spaces, "whitespace_inconsistency", F.col("column"), v, 1.0, 1.0, "normalize_whitespace", F.col("canonical"))
    return a.unionByName(issue(case, "casing_inconsistency", F.col("column"), v, 1.0, 0.98, "normalize_casing", F.col("canonical")))


def typos(df: DataFrame, cfg: Config, max_categories: int = 100) -> DataFrame:
    """Rare categories that look like a more frequent one, in text columns of at most 100 categories that are no codes.

    The vocabulary pairs of one column number at most 100 x 100 by the gate, and come from a join on the column.
    """
    f = forms(df)
    live = f.groupBy("column").agg(F.count(F.lit(1)).alias("u")).filter((F.col("u") > 1) & (F.col("u") <= max_categories)).select("column")
    code = reduce(lambda a, w: a | F.lower("column").contains(w), CODE_WORDS, F.lit(False))
    f = f.join(live, "column").filter(~code)
    rare, lead = f.select("column", F.col("key").alias("rk"), F.col("n").alias("rn")), f.select("column", F.col("key").alias("dk"), F.col("n").alias("dn"), "canonical")
    p = rare.join(lead, "column").filter((F.col("rk") != F.col("dk")) & (F.col("dn") >= 2) & (F.col("dn") > F.col("rn")) & (F.abs(F.length("rk") - F.length("dk")) <= 3))
    p = p.withColumn("sim", indel_ratio("rk", "dk"))
    short = (F.least(F.length("rk"), F.length("dk")) <= 5) & (F.levenshtein("rk", "dk") <= 1) & (F.substring("rk", 1, 1) == F.substring("dk", 1, 1)) & (F.col("sim") >= 75)
    p = p.filter((F.col("sim") >= cfg.category_similarity) | short)
    w = Window.partitionBy("column", "rk")
    p = p.withColumn("_rivals", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("sim"), F.desc("dn"), "dk"))).filter("_rn = 1")
    ratio = F.least(F.col("dn") / F.greatest(F.col("rn") * 3, F.lit(1)), F.lit(1.0))
    score = F.least(0.5 * F.col("sim") / 100 + 0.35 * ratio + 0.15, F.lit(0.99))
    score = F.round(F.when(F.col("_rivals") > 1, F.least(score, F.lit(0.90))).otherwise(F.greatest(score, F.lit(0.96))), 3)
    verdict = p.select("column", F.col("rk").alias("key"), score.alias("score"), F.col("canonical").alias("sug"))
    cells = _text_cells(df).filter("value is not null").withColumn("key", F.lower(collapse(F.col("value"))))
    s = F.col("score")
    return issue(cells.join(verdict, ["column", "key"]), "spelling_typo", F.col("column"), F.col("value"), s, s, F.when(s >= 0.95, "auto_correct").otherwise("flag_for_review"), F.col("sug"), human=s < 0.95)


def column_shapes(df: DataFrame, rare_cap: int | None = None) -> DataFrame:
    """Constant and nearly unique columns, dominating classes, rare categories; with a cap only the first so many rows of each category."""
    counts = _counts(df).filter("value is not null")
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.max("n").alias("top"))
    none = F.lit(None).cast("bigint")
    constant = issue(per.filter("u = 1"), "constant_column", F.col("column"), None, 1.0, 0.0, "report_only", row=none)
    high = issue(per.filter("n > 50 and u > 0.9 * n"), "high_cardinality", F.col("column"), None, 1.0, 0.0, "report_only", row=none)
    imbalance = issue(per.filter("u > 1 and top > 0.95 * n"), "class_imbalance", F.col("column"), None, 1.0, 0.0, "report_only", row=none)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rare = counts.join(per.filter("n > 100 and u between 2 and 50").select("column", F.col("n").alias("all")), "column").filter((F.col("n") < 0.01 * F.col("all")) & F.col("column").isin(*text or [""])).select("column", "value")
    cells = _judged(df, rare)
    if rare_cap:
        cells = cells.withColumn("_rn", F.row_number().over(Window.partitionBy("column", "value").orderBy(ROW))).filter(F.col("_rn") <= rare_cap)
    return reduce(DataFrame.unionByName, [constant, high, imbalance, issue(cells, "rare_category", F.col("column"), F.col("value"), 0.9, 0.0, "report_only")])


def correlations(df: DataFrame, target: str | None = None, least: float = 0.98) -> DataFrame:
    """Pairs of numeric columns with an absolute correlation above 0.98; with the target it is leakage. All pairs in one aggregation."""
    cols = numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return _union(df, [])
    row = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    hit = row.select(each.alias("p")).select("p.*").filter(F.abs("r") > least)
    leak = (F.col("a") == target) | (F.col("b") == target) if target else F.lit(False)
    out = issue(hit, "highly_correlated", F.when(F.col("a") == F.lit(target), F.col("b")).otherwise(F.col("a")) if target else F.col("a"), F.col("b"), 1.0, 0.0, "report_only", row=F.lit(None))
    if target is None:
        return out
    leaks = issue(hit.filter(leak), "data_leakage", F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")), F.lit(target), 1.0, 0.0, "report_only", row=F.lit(None))
    return issue(hit.filter(~leak), "highly_correlated", F.col("a"), F.col("b"), 1.0, 0.0, "report_only", row=F.lit(None)).unionByName(leaks)


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, contamination: float = 0.01, seed: int = 7, fit_rows: int = 10_000) -> DataFrame:
    """(row, score) of the rows that isolate fastest, the top share of all. Trees grow on a hash-chosen sample of about fit_rows; all rows are scored in batches."""
    import numpy as np
    import pandas as pd

    from ..session import received, share

    x = df.select(ROW, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    n = x.count()
    few = x.filter(F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(1, n)))).orderBy(ROW)
    data = few.drop(ROW).limit(2 * fit_rows).toPandas().to_numpy() if n else np.zeros((0, len(columns)))
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, min(sample, len(data))))))

    def grow(rows: np.ndarray, depth: int):
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            return len(rows)
        k = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, k].min(), rows[:, k].max()))
        left = rows[:, k] < cut
        return k, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    forest = [grow(data[rng.choice(len(data), min(sample, len(data)), replace=False)], 0) for _ in range(trees)] if len(data) else []
    shared = share(df.sparkSession, (forest, min(sample, max(2, len(data)))))

    def score(it):
        grown, size = received(shared)
        norm = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else 1.0 if m == 2 else 0.0

        def path(tree, rows, at, depth, out):
            if not isinstance(tree, tuple):
                out[at] += depth + norm(tree)
                return
            k, cut, a, b = tree
            left = rows[at, k] < cut
            if left.any():
                path(a, rows, at[left], depth + 1, out)
            if (~left).any():
                path(b, rows, at[~left], depth + 1, out)

        for pdf in it:
            rows = pdf.drop(columns=[ROW]).to_numpy(dtype=float)
            total = np.zeros(len(rows))
            for tree in grown:
                path(tree, rows, np.arange(len(rows)), 0, total)
            yield pd.DataFrame({ROW: pdf[ROW], "score": 2.0 ** (-total / max(1, len(grown)) / max(1e-9, norm(size)))})

    scored = x.mapInPandas(score, f"{ROW} bigint, score double")
    k = int(contamination * n)
    return scored.orderBy(F.desc("score"), ROW).limit(k)


def contradictions(df: DataFrame) -> DataFrame:
    """Younger than 16 and married."""
    cols = data_columns(df)
    age = next((c for c in cols if re.search(r"(?:^|[_\W])age(?:$|[_\W])", c.lower())), None)
    marital = next((c for c in cols if "marital" in c.lower()), None)
    if not age or not marital:
        return _union(df, [])
    hit = df.filter((_number(F.col(f"`{age}`")) < 16) & F.lower(F.col(f"`{marital}`")).contains("marri"))
    return issue(hit, "cross_column_contradiction", marital, F.col(f"`{marital}`"), 0.95, 0.5, "flag_for_human_review", human=True)


def unify(issues: DataFrame, cfg: Config) -> DataFrame:
    """Per cell the issue of highest precedence (of equal ones the first by type); issues of whole rows all stay; routing decided."""
    prec = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("issue_type")), F.lit(1))
    whole = F.col("column") == "__all__"
    w = Window.partitionBy("row", "column").orderBy(F.desc("_p"), "issue_type", "original_value")
    kept = issues.withColumn("_p", prec)
    one = kept.filter(~whole).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").unionByName(kept.filter(whole)).drop("_p")
    c = F.col("correction_confidence")
    route = F.when((c >= cfg.auto_threshold) & ~F.col("human"), "AUTO_CORRECT").when(((c >= cfg.suggest_threshold) & (c < cfg.auto_threshold)) | (F.col("human") & (c >= cfg.suggest_threshold)), "SUGGEST_REVIEW").otherwise("HUMAN_REVIEW_REQUIRED")
    return one.withColumn("routing_decision", route).withColumn("issue_id", F.concat_ws("_", "issue_type", F.coalesce(F.col("row").cast("string"), F.lit("col")), "column"))


def detect_all(df: DataFrame, cfg: Config | None = None, target: str | None = None, errors: list[str] | None = None) -> DataFrame:
    """All detectors, united. A detector that fails to plan is left out and named in errors."""
    cfg = cfg or Config()
    parts = []
    for name, f in {
        "exact_duplicates": lambda: exact_duplicates(df), "near_duplicates": lambda: near_duplicates_all(df, cfg), "missing": lambda: missing(df, cfg), "ranges": lambda: ranges(df, cfg), "dates": lambda: dates(df), "types": lambda: types(df),
        "inconsistencies": lambda: inconsistencies(df), "typos": lambda: typos(df, cfg), "outliers": lambda: outliers(df, cfg), "column_shapes": lambda: column_shapes(df), "correlations": lambda: correlations(df, target), "contradictions": lambda: contradictions(df),
    }.items():
        try:
            parts.append(f())
        except Exception as e:  # noqa: BLE001
            if errors is None:
                raise
            errors.append(f"{name}: {e}")
    return unify(reduce(DataFrame.unionByName, parts), cfg)
