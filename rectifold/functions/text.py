"""Text expressions on the JVM side that keep the semantics of the string methods the rules rely on."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 21 tokens that stand for a missing cell in the rule engine.
R1_TOKENS = (
    "na", "n/a", "null", "none", "nan", "?", "--", "-", "undefined", "#n/a", "nil",
    "n.a.", "n/d", "#na", "n/k", "unknown", "error", "missing", "blank", "<na>", "<null>",
)

# The sentinels of the quality score (the rule tokens and the empty string).
QUALITY_SENTINELS = ("", *R1_TOKENS)
# The configured missing tokens after normalising.
CONFIG_MISSING = ("", "nan", "none", "null", "n/a", "na", "?", "-")
# The tokens the type checks read as null.
TYPE_NULL_TOKENS = ("n/a", "na", "null", "none", "?", "-", "undefined", "missing", "")
# What the safe imputer reads as missing.
IMPUTER_MISSING = ("", "nan", "null", "none", "n/a", "na", "?")
# What the interactive fill reads as blank.
UI_BLANK = ("", "nan", "null", "none")

PLAIN_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without any Unicode white space at either end (trim() knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Stripped, with every inner run of white space as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def fold(c: Column) -> Column:
    """Full case folding: equal for texts that differ in letter case only.

    The concat keeps the optimizer from reading lower(upper(x)) as lower(x), which leaves letters such as the sharp s apart from their capitals.
    """
    return F.lower(F.concat(F.upper(c), F.lit("")))


def letters_and_digits(c: Column) -> Column:
    """What is left without white space, punctuation and marks, case-folded; null counts as empty."""
    return fold(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


# The code points with the Unicode property White_Space, as a character class.
SPACES = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: A missing cell that is not null. One anchored pattern, as this runs for every cell of every table.
MISSING = rf"(?i)\A{SPACES}*+(?:{'|'.join(re.escape(t) for t in sorted(R1_TOKENS, key=len, reverse=True))})?{SPACES}*+\z"


def is_missing(c: Column) -> Column:
    """Null, nothing but white space, or one of the rule tokens in any case; never null itself."""
    return F.coalesce(c.rlike(MISSING), F.lit(True))


def is_plain_number(c: Column) -> Column:
    return F.coalesce(c.rlike(PLAIN_NUMBER), F.lit(False))


def to_number(c: Column) -> Column:
    """Double of a plain number, null otherwise; the guard keeps '12f' and 'nan' out."""
    return F.when(is_plain_number(c), c.try_cast("double"))


def shape(c: Column) -> Column:
    """Digits as #, letters as a, all else kept."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"\p{Nd}", "#")


def title(c: Column) -> Column:
    """Title case after any non-letter, which initcap does not do."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")
