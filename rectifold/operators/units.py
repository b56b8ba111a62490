"""Quantities in different units: what a value, a remark or its feed says about the unit, and conversion to the common one.

The unit is a triple (currency or measure, scale, period). Each part comes from the first of value, remark and feed that
says it; the triple names the unit. What a feed means comes from the segments of its history, where these point to a unit, else from
its declaration. All is narrow projection; feeds and segments are attached by a broadcast after a check of their size, else by a salted join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot import BROADCAST_ROWS, attach

MAX_LITERALS = 300  # feeds whose units become a literal of the plan; more are attached as a table
MAX_UNITS = 10_000  # rows the table of units may have to be read into a plan

# How a value says its parts, as patterns over its lower-case text.
SAYS_USD = r"(?:us\s*\$|\$|\busd\b|us dollars?|dollars?)"
SAYS_LAKH = r"(?:(?<![a-z])(?:lakhs?|lacs?|lpa|l)(?![a-z]))"
SAYS_CRORE = r"(?:(?<![a-z])(?:crores?|cr)(?![a-z]))"
SAYS_THOUSAND = r"(?:(?<![a-z])(?:thousands?|k)(?![a-z])|'000)"
SAYS_SINGLE = r"(?:(?<![a-z])rupees?(?![a-z]))"
SAYS_MONTH = r"(?:(?<![a-z])(?:pm|p\.m\.?|monthly|per month|a month|mth)(?![a-z])|/\s*(?:month|mo|mth)\b)"
SAYS_YEAR = r"(?:(?<![a-z])(?:lpa|pa|p\.a\.?|per annum|per year|a year|yearly|annually|annual)(?![a-z])|/\s*(?:yr|year|annum)\b)"
SAYS_MILE = r"(?:(?<![a-z])(?:miles?|mi)(?![a-z]))"
SAYS_KM = r"(?:(?<![a-z])(?:kms?|kilomet(?:re|er)s?)(?![a-z]))"

# The words that make a clause of a remark one about distance or about price.
ABOUT_DISTANCE = r"(?:\b(?:odometer|odo|distance|reading|dial|mileage|kms? driven)\b)"
ABOUT_PRICE = r"(?:\b(?:price|asking|amount|figure|quoted|cost)\b)"
LINKS = r"(?:\b(?:in|is|as|shows?|marked|noted|given|quoted|of|written|full|plain)\b)"


def _first(*pairs: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for cond, what in reversed(pairs):
        out = F.when(cond, F.lit(what)).otherwise(out)
    return out


def says_money(text: Column) -> dict[str, Column]:
    """currency (usd or null), scale (one, thousand, lakh, crore or null) and period (month, year or null) that text says."""
    t = F.lower(text)
    usd = t.rlike(SAYS_USD)
    scale = _first((t.rlike(SAYS_CRORE), "crore"), (t.rlike(SAYS_LAKH), "lakh"), (t.rlike(SAYS_THOUSAND), "thousand"), (t.rlike(SAYS_SINGLE), "one"))
    return {"currency": _first((usd, "usd")), "scale": scale, "period": _first((t.rlike(SAYS_MONTH), "month"), (t.rlike(SAYS_YEAR), "year"))}


def says_distance(text: Column) -> dict[str, Column]:
    """measure (mile, km or null) and scale (thousand or null) that text says."""
    t = F.lower(text)
    return {"measure": _first((t.rlike(SAYS_MILE), "mile"), (t.rlike(SAYS_KM), "km")), "scale": _first((t.rlike(SAYS_THOUSAND), "thousand"))}


def _clauses(remarks: Column) -> Column:
    return F.split(F.lower(F.coalesce(remarks, F.lit(""))), r"[;,]\s*|\.\s+|\.$")


def remark_distance(remarks: Column) -> Column:
    """mile, km or thousand_km where a clause is about the distance reading and names its unit, else null."""

    def unit(x: Column) -> Column:
        said = F.regexp_extract(x, rf"(?:{LINKS}|')\s*(?:the\s+)?(miles?|mi|thousands?(?: of)? (?:kms?|kilomet(?:re|er)s?)|'000 (?:kms?|kilomet(?:re|er)s?)|kms?|kilomet(?:re|er)s?)\b", 1)
        return F.when(x.rlike(ABOUT_DISTANCE), _first((said.rlike("^mi"), "mile"), (said.rlike("^(?:thousand|'000)"), "thousand_km"), (said.rlike("^k"), "km")))

    return F.try_element_at(F.filter(F.transform(_clauses(remarks), unit), lambda u: u.isNotNull()), F.lit(1))


def remark_price(remarks: Column) -> Column:
    """usd, thousand, one, lakh or crore where a clause is about the price and names its unit, else null."""

    def unit(x: Column) -> Column:
        said = F.regexp_extract(x, rf"{LINKS}\s*((?:us\s*\$|usd|us dollars?|dollars?)|(?:thousands?(?: of)?|'000|lakhs?(?: of)?|crores?(?: of)?|full|plain|single)?\s*(?:rupees?|inr|rs)|lakhs?|crores?)(?![a-z])", 1)
        kind = _first((said.rlike(r"^(?:us|dollar)"), "usd"), (said.rlike(r"^(?:thousand|'000)"), "thousand"), (said.rlike("^lakh"), "lakh"), (said.rlike("^crore"), "crore"), (said.rlike("rupee|inr|rs"), "one"))
        return F.when(x.rlike(ABOUT_PRICE), kind)

    return F.try_element_at(F.filter(F.transform(_clauses(remarks), unit), lambda u: u.isNotNull()), F.lit(1))


# The parts each unit name stands for.
UNIT_PARTS = {
    "inr_per_year": ("inr", "one", "year"), "inr_per_month": ("inr", "one", "month"), "thousand_inr_per_year": ("inr", "thousand", "year"),
    "lakh_inr_per_year": ("inr", "lakh", "year"), "usd_per_year": ("usd", "one", "year"),
    "kilometre": ("km", "one", None), "mile": ("mile", "one", None), "thousand_kilometre": ("km", "thousand", None),
    "lakh_inr": ("inr", "lakh", None), "inr": ("inr", "one", None), "thousand_inr": ("inr", "thousand", None), "crore_inr": ("inr", "crore", None), "usd": ("usd", "one", None),
}


def _small(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"{what} has more than {MAX_UNITS} rows; it is meant to be a small fixed table")
    return rows


def _unit_ids(units: DataFrame, field: str) -> tuple[dict[tuple, int], dict[int, tuple], dict[int, float]]:
    rows = [r for r in _small(units, "the unit table") if r["field_name"] == field]
    parts = {r["unit_id"]: UNIT_PARTS[r["unit_name"]] for r in rows if r["unit_name"] in UNIT_PARTS}
    return {p: i for i, p in parts.items()}, parts, {r["unit_id"]: r["factor"] for r in rows}


def factors_of(units: DataFrame, field: str) -> dict[int, float]:
    """Factor by unit id of one field."""
    return _unit_ids(units, field)[2]


def _case(key: Column, mapping: dict, kind: str) -> Column:
    """A literal lookup of a bounded dict."""
    if not mapping:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x) for k, v in mapping.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind) if pairs else F.lit(None).cast(kind)


def with_unit(df: DataFrame, field: str, units: DataFrame, feeds: DataFrame, feed: str = "feed", remarks: str | None = None, out: str = "unit_id", history: DataFrame | None = None, load: str = "load_no") -> DataFrame:
    """df with the unit id of each value of `field` that holds a digit, null for other values.

    What a feed means in a load comes from the segment of its history (feed, first_load, last_load, unit_id) that changepoint.unit_segments found there;
    a load without one, or whose segment points to no unit, has the declared unit of its feed (of several the smallest id). A feed that neither knows says
    nothing; then the common unit (the one of factor 1) is assumed. A part that the named triple has no unit for gives way: a period first, then a
    currency's scale. Rows and other columns stay.
    """
    by_parts, parts, factors = _unit_ids(units, field)
    common = min((i for i, f in factors.items() if f == 1.0), default=None)
    c = F.col(field)
    base = parts.get(common, (None, None, None))
    distance = "km" in {p[0] for p in parts.values()}
    kept = df.columns
    # each part is a column of its own, so that no pattern runs twice for a row; bare numbers say nothing
    says = F.when(c.rlike(r"[^0-9.+-]"), F.lower(c))
    df = df.withColumn("__unit_says", says)
    said = says_distance(F.col("__unit_says")) if distance else says_money(F.col("__unit_says"))
    df = df.withColumns({f"__unit_v_{k}": v for k, v in said.items()})
    nothing = F.lit(None).cast("string")
    remark = nothing if remarks is None else F.when(F.col(remarks).isNotNull(), remark_distance(F.col(remarks)) if distance else remark_price(F.col(remarks)))
    df = df.withColumn("__unit_remark", remark)
    declared = feeds.filter((F.col("field_name") == field) & F.col("feed").isNotNull()).groupBy(F.col("feed").alias("__unit_feed")).agg(F.min("unit_id").cast("int").alias("__unit_declared"))
    few = declared.limit(MAX_LITERALS + 1).collect()
    if len(few) <= MAX_LITERALS:
        meant = _case(F.col(feed), {r[0]: r[1] for r in few}, "int")
    else:
        df, meant = attach(df, declared, {feed: "__unit_feed"}), F.col("__unit_declared")
    if history is not None:
        spans = history.filter(F.col("unit_id").isin(*parts) if parts else F.lit(False)).select(F.col("feed").alias("__unit_of"), F.col("first_load").alias("__unit_a"), F.col("last_load").alias("__unit_b"), F.col("unit_id").cast("int").alias("__unit_span"))
        within = lambda f, x: (f == F.col("__unit_of")) & x.between(F.col("__unit_a"), F.col("__unit_b"))
        if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            df = df.join(F.broadcast(spans), within(F.col(feed), F.col(load)), "left").drop("__unit_of", "__unit_a", "__unit_b")  # segments of a feed do not overlap
        else:  # one row per feed and load
            loads = df.select(F.col(feed).alias("__unit_feed"), F.col(load).alias("__unit_load")).distinct()
            each = loads.join(spans, within(F.col("__unit_feed"), F.col("__unit_load"))).groupBy("__unit_feed", "__unit_load").agg(F.min("__unit_span").alias("__unit_span"))
            df = attach(df, each, {feed: "__unit_feed", load: "__unit_load"})
        meant = F.coalesce("__unit_span", meant)
    df = df.withColumn("__unit_meant", meant)
    df = df.withColumns({f"__unit_f_{i}": _case(F.col("__unit_meant"), {u: p[i] for u, p in parts.items()}, "string") for i in range(3)})
    rem = F.col("__unit_remark")
    if distance:
        r_measure = _first((rem == "mile", "mile"), (rem.isNotNull(), "km"))
        r_scale = _first((rem == "thousand_km", "thousand"), (rem.isNotNull(), "one"))
        measure = F.coalesce("__unit_v_measure", r_measure, "__unit_f_0", F.lit(base[0]))
        # a measure said in the value without a scale means single units of it
        scale = F.coalesce("__unit_v_scale", F.when(F.col("__unit_v_measure").isNotNull(), F.lit("one")), r_scale, "__unit_f_1", F.lit(base[1]))
        df = df.withColumn("__unit_key", F.concat_ws("|", measure, F.when(measure == "mile", F.lit("one")).otherwise(scale)))
    else:
        r_cur = _first((rem == "usd", "usd"), (rem.isNotNull(), "inr"))
        v_cur = F.coalesce("__unit_v_currency", F.when(F.col("__unit_v_scale").isNotNull() | F.col("__unit_says").rlike(r"₹|\brs\b|inr"), F.lit("inr")))
        currency = F.coalesce(v_cur, r_cur, "__unit_f_0", F.lit(base[0]))
        scale = F.coalesce("__unit_v_scale", F.when(rem != "usd", rem), "__unit_f_1", F.lit(base[1]))
        df = df.withColumns({"__unit_currency": currency, "__unit_scale": scale})
        period = F.coalesce("__unit_v_period", "__unit_f_2", F.lit(base[2])) if base[2] else None
        usd = F.lit("usd|one|year" if base[2] else "usd|one")
        inr = F.concat_ws("|", F.lit("inr"), "__unit_scale", *([F.when(F.col("__unit_scale") == "one", period).otherwise(F.lit("year"))] if base[2] else []))
        df = df.withColumn("__unit_key", F.when(F.col("__unit_currency") == "usd", usd).otherwise(inr))
    ids = {"|".join(x for x in p if x): i for p, i in by_parts.items()}
    unit = F.when(c.rlike(r"[0-9]"), F.coalesce(_case(F.col("__unit_key"), ids, "int"), F.lit(common).cast("int")))
    return df.select(*[F.col(f"`{k}`") for k in kept if k != out], unit.alias(out))


def number_in(c: Column) -> Column:
    """The first number of a value, thousands separators removed; null if there is none."""
    digits = F.regexp_replace(F.regexp_extract(c, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    return digits.try_cast("double")


def convert(df: DataFrame, field: str, units: DataFrame, unit: str = "unit_id", out: str | None = None) -> DataFrame:
    """df with the value of `field` in its common unit; null where the value has no number or no unit."""
    _, _, factors = _unit_ids(units, field)
    return df.withColumn(out or f"{field}_common", number_in(F.col(field)) * _case(F.col(unit), factors, "double"))


def foreign_units(df: DataFrame, fields: dict[str, str | None], units: DataFrame, feeds: DataFrame, table: str, row_id: str = "row_id", feed: str = "feed", histories: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table_name, column_name, row_id, unit_id) of every value that is not in its field's common unit. fields: field -> remarks column."""
    parts = []
    for field, remarks in fields.items():
        common = [i for i, f in _unit_ids(units, field)[2].items() if f == 1.0]
        own = with_unit(df, field, units, feeds, feed, remarks, "_unit", (histories or {}).get(field))
        parts.append(own.filter(F.col("_unit").isNotNull() & ~F.col("_unit").isin(*common)).select(F.lit(table).alias("table_name"), F.lit(field).alias("column_name"), F.col(row_id).alias("row_id"), F.col("_unit").alias("unit_id")))
    return reduce(DataFrame.unionByName, parts)
