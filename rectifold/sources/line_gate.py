"""Loads delimited lines of a fixed schema and sets the broken ones apart with the reason.

One anchored pattern per schema decides for a whole line; only lines that fail it meet the structure patterns
(quoting, column count) and the field-prefix patterns, which find the first broken field. All of it is one narrow
projection on the JVM: no shuffle, no Python. Groups repeat possessively, so very long lines cannot overflow the matcher.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineField:
    """A field of a line. plain: the pattern of a valid value; free: any text that meets `must` and lacks `never`."""

    name: str
    plain: str = ""
    must: str = ""
    never: str = ""
    free: bool = False


# The calendar, written as a pattern. Leap years are those divisible by 4, of the centuries those by 400.
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
DATE = rf"(?:[0-9]{{4}}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|{_LEAP}-02-29)"
DECIMAL = r"[0-9]+(?:\.[0-9]+)?"
AGE = r"0*(?:[0-9]|[1-9][0-9]|1[01][0-9]|120)"

CUSTOMER_CHURN = (
    LineField("customer_id", r"CUST_[0-9]+"),
    LineField("name", free=True),
    LineField("age", rf"(?:{AGE})?"),
    LineField("city", free=True),
    LineField("join_date", rf"(?:{DATE})?"),
    LineField("salary", rf"(?:{DECIMAL})?"),
    LineField("department", free=True),
    LineField("churn", r"[01]"),
)
CAR_DATA = (
    LineField("car_name", free=True, must=r"\p{L}", never=r"[\u0000-\u0009\u000B\u000C\u000E-\u001F\u007F-\u009F�]"),
    LineField("year", r"[0-9]{4}"),
    LineField("selling_price", DECIMAL),
    LineField("present_price", rf"(?:{DECIMAL})?"),
    LineField("kms_driven", rf"(?:{DECIMAL})?"),
    LineField("fuel_type", free=True),
    LineField("seller_type", free=True),
    LineField("transmission", free=True),
    LineField("owner", r"[0-9]+"),
)

_SP = r"[ \t]*+"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_ANY = rf'(?:{_SP}{_QUOTED}{_SP}|[^",]*+)'
#: A line of any number of well-quoted fields.
WELL_QUOTED = rf"\A{_ANY}(?:,{_ANY})*+\z"


def _field(f: LineField) -> str:
    if f.free:
        return _ANY  # must and never are checked on the value itself
    return rf'(?:{_SP}"{_SP}{f.plain}{_SP}"{_SP}|{_SP}{f.plain}{_SP})'


def whole_line(schema: tuple[LineField, ...]) -> str:
    """The anchored pattern of a valid line, without the content checks of free fields."""
    return r"\A" + ",".join(_field(f) for f in schema) + r"\z"


def prefix_patterns(schema: tuple[LineField, ...]) -> list[str]:
    """Pattern k holds for lines whose first k+1 fields are valid."""
    return [r"\A" + ",".join(_field(f) for f in schema[: k + 1]) + (r"(?:,|\z)" if k + 1 < len(schema) else r"\z") for k in range(len(schema))]


def _fields(line: Column, n: int) -> list[Column]:
    """The n fields as delivered, without quotes around them and spaces beside them."""
    out = []
    for k in range(n):
        skip = rf"(?:{_ANY},){{{k}}}" if k else ""
        raw = F.regexp_extract(line, rf"\A{skip}({_ANY})(?:,|\z)", 1)
        bare = F.regexp_replace(raw, r"\A[ \t]++|[ \t]++\z", "")
        inner = F.regexp_replace(F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))), '""', '"')
        out.append(F.when(bare.startswith('"'), F.regexp_replace(inner, r"\A[ \t]++|[ \t]++\z", "")).otherwise(bare))
    return out


def _verdict(text: Column, schema: tuple[LineField, ...]) -> tuple[Column, Column, list[Column]]:
    """(reason, first bad field, values) of a line's text under a schema; both null for a line that loads."""
    n = len(schema)
    count = rf"\A{_ANY}(?:,{_ANY}){{{n - 1}}}\z"
    values = _fields(text, n)
    checks = [(k, f) for k, f in enumerate(schema) if f.must or f.never]

    def content(k: int, f: LineField) -> Column:
        ok = F.lit(True)
        if f.must:
            ok = ok & values[k].rlike(f.must)
        if f.never:
            ok = ok & ~values[k].rlike(f.never)
        return ok

    valid = text.rlike(whole_line(schema))
    for k, f in checks:
        valid = valid & content(k, f)
    bad = F.lit(None).cast("string")
    for k in reversed(range(n)):
        ok = text.rlike(prefix_patterns(schema)[k])
        for j, f in checks:
            if j == k:
                ok = ok & content(k, f)
        bad = F.when(~ok, F.lit(schema[k].name)).otherwise(bad)
    # a line of sound structure fails by its first broken field, which the prefix patterns find
    reason = F.when(valid, F.lit(None).cast("string")).when(~text.rlike(WELL_QUOTED), F.lit("broken_quoting")).when(~text.rlike(count), F.lit("wrong_column_count")).when(bad.isNotNull(), F.lit("invalid_value"))
    return reason, bad, values


def _text(line: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\r\z", "")


def gate(lines: DataFrame, schema: tuple[LineField, ...], line: str = "raw_line") -> DataFrame:
    """lines with `reason`, `bad_field` and, for lines that load, the struct `record`; columns of these names are replaced.

    reason is null for a line that loads, else the first that applies of broken_quoting, wrong_column_count and
    invalid_value; bad_field names the first field that no prefix pattern carries past (null when the count is wrong).
    A null line has one field, as an empty line has. A final carriage return is no part of the line; control characters
    but line breaks, and the replacement character, make a field with `never` invalid. Empty values load as null. Repeated lines are
    judged alike; an empty table stays empty; other columns stay.
    """
    reason, bad, values = _verdict(_text(line), schema)
    out = lines.withColumn("reason", reason)
    out = out.withColumn("bad_field", F.when(F.col("reason").isin("broken_quoting", "invalid_value"), bad))
    record = F.struct(*[F.when(values[k] == "", F.lit(None)).otherwise(values[k]).alias(f.name) for k, f in enumerate(schema)])
    return out.withColumn("record", F.when(F.col("reason").isNull(), record))


def set_apart(lines: DataFrame, schemas: dict[str, tuple[LineField, ...]], table: str = "feed_table", line: str = "raw_line") -> DataFrame:
    """Lines of any table that do not load, with reason and bad_field, in one pass. Lines of a table without schema have reason unknown_table."""
    reason, bad = F.lit("unknown_table"), F.lit(None).cast("string")
    for name, schema in schemas.items():
        r, b, _ = _verdict(_text(line), schema)
        reason = F.when(F.col(table) == name, r).otherwise(reason)
        bad = F.when(F.col(table) == name, b).otherwise(bad)
    apart = lines.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return apart.withColumn("bad_field", F.when(F.col("reason").isin("broken_quoting", "invalid_value"), bad))


def split_lines(lines: DataFrame, schemas: dict[str, tuple[LineField, ...]], table: str = "feed_table", line: str = "raw_line") -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: loaded rows}, lines set apart). Loaded rows keep the lines' other columns where no field has their name."""
    loaded = {}
    for name, schema in schemas.items():
        own = gate(lines.filter(F.col(table) == name), schema, line).filter(F.col("reason").isNull())
        keep = [c for c in lines.columns if c != line and c.lower() not in {f.name for f in schema} | {"reason", "bad_field", "record"}]
        loaded[name] = own.select(*[F.col(f"`{c}`") for c in keep], "record.*")
    return loaded, set_apart(lines, schemas, table, line)
