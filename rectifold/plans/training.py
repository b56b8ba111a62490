"""Queries of the general training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import R1_TOKENS, fold, is_missing, letters_and_digits, strip
from ..operators import changepoint, load_profile, neighbour_fill, units
from ..session import checkpoint, table
from ..sources import line_gate


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = {"customer_churn": line_gate.CUSTOMER_CHURN, "car_data": line_gate.CAR_DATA}
    return line_gate.set_apart(table(spark, sf_dir, "raw_lines"), schemas).select("line_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, _ = line_gate.split_lines(table(spark, sf_dir, "raw_lines"), {"customer_churn": line_gate.CUSTOMER_CHURN})
    return loaded["customer_churn"].select("line_id", "customer_id", F.col("age").try_cast("int").alias("age"), F.col("join_date").try_cast("date").cast("string").alias("join_date"), "churn")


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken field of each line of sound structure that does not load."""
    schemas = {"customer_churn": line_gate.CUSTOMER_CHURN, "car_data": line_gate.CAR_DATA}
    return line_gate.set_apart(table(spark, sf_dir, "raw_lines"), schemas).filter("reason = 'invalid_value'").select("line_id", "bad_field")


def p2_loaded_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the car lines that load."""
    loaded, _ = line_gate.split_lines(table(spark, sf_dir, "raw_lines"), {"car_data": line_gate.CAR_DATA})
    return loaded["car_data"].select("line_id", *[f.name for f in line_gate.CAR_DATA])


PROFILED = {"clean_benchmark_dataset": ["credit_score", "tenure_months"], "car_data": ["kms_driven"]}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (load_profile.value_counts(table(spark, sf_dir, t), cols, t) for t, cols in PROFILED.items())
    return load_profile.deviating_loads(a.unionByName(b))


WHOLE_TABLES = {
    "customer_churn": ["customer_id", "name", "age", "city", "join_date", "salary", "department", "churn", "feed"],
    "car_data": ["car_name", "year", "selling_price", "present_price", "kms_driven", "fuel_type", "seller_type", "transmission", "owner", "remarks", "feed"],
    "clean_benchmark_dataset": ["customer_id", "age", "salary", "credit_score", "tenure_months", "department", "city", "join_date", "churn"],
}


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cols in WHOLE_TABLES.items():
        one = load_profile.column_profile(load_profile.value_counts(table(spark, sf_dir, t), cols, t, None))
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "column_name", "n_cells", "n_missing", "n_distinct", "n_plain", "n_pattern", "n_top")


RANGED = {
    "customer_churn": ["row_id", "age", "salary", "churn", "recorded_at", "loaded_at"],
    "car_data": ["row_id", "year", "selling_price", "present_price", "kms_driven", "owner", "loaded_at"],
    "clean_benchmark_dataset": ["row_id", "age", "salary", "credit_score", "tenure_months", "churn", "loaded_at"],
}


def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the plain numbers of each column that has any; of times the seconds since 1970."""
    out = []
    for t, cols in RANGED.items():
        rows = table(spark, sf_dir, t)
        seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("string")
        rows = rows.select(*[seconds(c).alias(c) if c.endswith("_at") else F.col(c).cast("string").alias(c) for c in cols])
        out.append(load_profile.column_profile(load_profile.value_counts(rows, cols, t, None)))
    return reduce(DataFrame.unionByName, out).filter("n_plain > 0").select("table_name", "column_name", "min_number", "max_number")


def p3_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (load_profile.value_counts(table(spark, sf_dir, t), cols, t) for t, cols in PROFILED.items())
    return load_profile.load_drift(a.unionByName(b))


def filled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_churn with salary (rupees a year), age and department filled and marked."""
    rows = table(spark, sf_dir, "customer_churn")
    unit_t, feed_t = table(spark, sf_dir, "unit_factors"), table(spark, sf_dir, "feed_units")
    rows = units.convert(units.with_unit(rows, "salary", unit_t, feed_t), "salary", unit_t, out="_salary")
    rows = rows.withColumn("_age", units.number_in(F.col("age")))
    age = F.col("_age")
    cols = [
        neighbour_fill.FillColumn("salary", F.when(F.col("_salary") > 0, F.col("_salary")), is_missing(F.col("salary")), True),
        neighbour_fill.FillColumn("age", F.when(age.between(0, 120), age), is_missing(F.col("age")), True),
        neighbour_fill.FillColumn("department", strip(F.col("department")), is_missing(F.col("department")), False),
    ]
    # the house account stands for many people, so the entity is the account and the name
    entity = [F.nullif(letters_and_digits(F.col(c)), F.lit("")) for c in ("customer_id", "name")]
    return neighbour_fill.fill(rows, entity, F.coalesce("recorded_at", "loaded_at").cast("timestamp"), "row_id", cols, F.coalesce(fold(strip(F.col("city"))), F.lit("")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fill.filled_cells(filled_customers(spark, sf_dir), ["salary", "age", "department"]).select("column_name", "row_id")


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fill.filled_cells(filled_customers(spark, sf_dir), ["salary", "age", "department"])


def unit_history(spark: SparkSession, sf_dir: str, t: str, field: str) -> DataFrame | None:
    """(feed, first_load, last_load, level, unit_id, agrees): segments of the feeds' bare numbers, with the unit their level points to; None without any number.

    The common level is the median one of the feeds that are declared to use the common unit.
    """
    unit_t, feed_t = table(spark, sf_dir, "unit_factors"), table(spark, sf_dir, "feed_units")
    bare = F.when(F.col(field).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.col(field).try_cast("double"))
    hist = checkpoint(changepoint.without_shared_shifts(changepoint.history(table(spark, sf_dir, t), "feed", "load_no", bare)))  # a row per feed and load
    factors = {u: f for u, f in units.factors_of(unit_t, field).items() if f}
    declared = feed_t.filter((F.col("field_name") == field) & F.col("feed").isNotNull()).groupBy(F.col("feed").alias("source")).agg(F.min("unit_id").alias("unit_id"))
    plain = declared.filter(F.col("unit_id").isin(*[u for u, f in factors.items() if f == 1.0]))
    level = hist.join(plain, "source", "left_semi").agg(F.expr("percentile(level, 0.5)")).first()[0]
    if level is None:
        return None
    return checkpoint(changepoint.unit_segments(hist, factors, level, declared=declared).withColumnRenamed("source", "feed"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit_t, feed_t = table(spark, sf_dir, "unit_factors"), table(spark, sf_dir, "feed_units")
    out = []
    for t, fields in (("customer_churn", {"salary": None}), ("car_data", {"kms_driven": "remarks", "selling_price": "remarks"})):
        histories = {f: unit_history(spark, sf_dir, t, f) for f in fields}
        out.append(units.foreign_units(table(spark, sf_dir, t), fields, unit_t, feed_t, t, histories=histories))
    return out[0].unionByName(out[1])


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(f, unit_history(spark, sf_dir, t, f)) for t, f in (("customer_churn", "salary"), ("car_data", "kms_driven"), ("car_data", "selling_price"))]
    frames = [h.select(F.lit(f).alias("field_name"), "feed", "first_load", "last_load", "level", "unit_id", "agrees") for f, h in parts if h is not None]
    return reduce(DataFrame.unionByName, frames)


def p7_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three fields in its common unit, with the unit it was recorded in."""
    unit_t, feed_t = table(spark, sf_dir, "unit_factors"), table(spark, sf_dir, "feed_units")
    out = []
    for t, field, remarks in (("customer_churn", "salary", None), ("car_data", "kms_driven", "remarks"), ("car_data", "selling_price", "remarks")):
        rows = units.with_unit(table(spark, sf_dir, t), field, unit_t, feed_t, remarks=remarks, history=unit_history(spark, sf_dir, t, field))
        rows = units.convert(rows, field, unit_t, out="value")
        out.append(rows.filter(F.col("unit_id").isNotNull()).select(F.lit(t).alias("table_name"), F.lit(field).alias("column_name"), "row_id", "unit_id", F.round("value", 4).alias("value")))
    return reduce(DataFrame.unionByName, out)


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_fields, p2_loaded, p2_loaded_cars, p3_found, p3_profile, p3_ranges, p3_drift, p6_found, p6_filled, p7_found, p7_segments, p7_converted)}


# ---- SQL --------------------------------------------------------------------------------------------------------------------
WHITE = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def missing_sql(c: str) -> str:
    tokens = ", ".join("'" + t + "'" for t in ("", *R1_TOKENS))
    return f"({c} IS NULL OR lower(regexp_replace(regexp_replace({c}, '^{WHITE}+', ''), '{WHITE}+$', '')) IN ({tokens}))"


_SP, _ANY = "[ \\t]*", """(?:[ \\t]*"(?:[^"]|"")*"[ \\t]*|[^",]*)"""


def _plain_pattern(f: line_gate.LineField) -> str:
    return _ANY if f.free else f'(?:{_SP}"{_SP}{f.plain}{_SP}"{_SP}|{_SP}{f.plain}{_SP})'


def p2_sql() -> str:
    text = "regexp_replace(coalesce(raw_line, ''), '\\r$', '')"
    whole = {t: "^" + ",".join(_plain_pattern(f) for f in s) + "$" for t, s in (("customer_churn", line_gate.CUSTOMER_CHURN), ("car_data", line_gate.CAR_DATA))}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    full = lambda x: f"regexp_full_match(line, {quote(x.removeprefix('^').removesuffix('$'))}, 's')"
    fields = lambda n: f"{_ANY}(?:,{_ANY}){{{n - 1}}}"
    car = f"regexp_extract(line, {quote('^(' + _ANY + ')')}, 1)"
    bad_name = f"(NOT regexp_matches({car}, '\\p{{L}}') OR regexp_matches({car}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]'))"
    reason = f"""CASE WHEN NOT {full(_ANY + '(?:,' + _ANY + ')*')} THEN 'broken_quoting' WHEN feed_table = 'customer_churn' AND NOT {full(fields(8))} OR feed_table = 'car_data' AND NOT {full(fields(9))} THEN 'wrong_column_count'
 WHEN feed_table = 'customer_churn' AND NOT {full(whole['customer_churn'])} OR feed_table = 'car_data' AND (NOT {full(whole['car_data'])} OR {bad_name}) THEN 'invalid_value' END"""
    return f"SELECT line_id, reason FROM (SELECT line_id, {reason} AS reason FROM (SELECT line_id, feed_table, {text} AS line FROM raw_lines)) WHERE reason IS NOT NULL"


def p2_loaded_sql() -> str:
    """Values of the lines that load, read off field by field with an unanchored pattern."""
    text = "regexp_replace(coalesce(raw_line, ''), '\\\\r$', '')"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    bare = lambda k: f"trim(trim(trim(regexp_extract({text}, {quote('^' + (f'(?:{_ANY},){{{k}}}' if k else '') + '(' + _ANY + ')')}, 1), ' \t'), '\"'), ' \t')"
    return f"SELECT line_id, {bare(0)} AS customer_id, CAST(nullif({bare(2)}, '') AS INT) AS age, nullif({bare(4)}, '') AS join_date, {bare(7)} AS churn FROM raw_lines WHERE feed_table = 'customer_churn' AND line_id NOT IN (SELECT line_id FROM ({p2_sql()}))"


def p2_fields_sql() -> str:
    """The first field of a line of sound structure that its own pattern does not take, field by field."""
    text = "regexp_replace(coalesce(raw_line, ''), '\\r$', '')"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    at = lambda k: f"regexp_extract(line, {quote('^' + (f'(?:{_ANY},){{{k}}}' if k else '') + '(' + _ANY + ')')}, 1)"
    name_bad = f"(NOT regexp_matches({at(0)}, '\\p{{L}}') OR regexp_matches({at(0)}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]'))"
    cases = []
    for t, schema in (("customer_churn", line_gate.CUSTOMER_CHURN), ("car_data", line_gate.CAR_DATA)):
        tests = [(f"NOT regexp_full_match({at(k)}, {quote(_plain_pattern(f))}, 's')" if not f.free else name_bad if f.must else "false", f.name) for k, f in enumerate(schema)]
        cases.append(f"WHEN feed_table = '{t}' THEN CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in tests) + " END")
    return f"SELECT line_id, CASE {' '.join(cases)} END AS bad_field FROM (SELECT line_id, feed_table, {text} AS line FROM raw_lines) WHERE line_id IN (SELECT line_id FROM ({p2_sql()}) WHERE reason = 'invalid_value')"


def p2_loaded_cars_sql() -> str:
    text = "regexp_replace(coalesce(raw_line, ''), '\\r$', '')"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    raw = lambda k: f"trim(regexp_extract({text}, {quote('^' + (f'(?:{_ANY},){{{k}}}' if k else '') + '(' + _ANY + ')')}, 1), ' \t')"
    bare = lambda k: f"nullif(CASE WHEN {raw(k)} LIKE '\"%' THEN trim(replace(substr({raw(k)}, 2, length({raw(k)}) - 2), '\"\"', '\"'), ' \t') ELSE {raw(k)} END, '')"
    fields = ", ".join(f"{bare(k)} AS {f.name}" for k, f in enumerate(line_gate.CAR_DATA))
    return f"SELECT line_id, {fields} FROM raw_lines WHERE feed_table = 'car_data' AND line_id NOT IN (SELECT line_id FROM ({p2_sql()}))"


def ranges_sql() -> str:
    num = "'^[+-]?[0-9]+(\\.[0-9]+)?$'"
    text = lambda c: f"CAST(CAST(floor(epoch({c})) AS BIGINT) AS VARCHAR)" if c.endswith("_at") else f"CAST({c} AS VARCHAR)"
    cells = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {text(c)} AS v FROM {t}" for t, cols in RANGED.items() for c in cols)
    return f"SELECT table_name, column_name, min(CAST(v AS DOUBLE)) AS min_number, max(CAST(v AS DOUBLE)) AS max_number FROM ({cells}) WHERE regexp_matches(v, {num}) GROUP BY ALL"


def drift_sql(bins: int = 10) -> str:
    """Shares of each load in the decile bins of all loads against those of the load before."""
    num = "'^[+-]?[0-9]+(\\.[0-9]+)?$'"
    parts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_no, CAST({c} AS DOUBLE) AS x FROM {t} WHERE regexp_matches({c}, {num})" for t, cols in PROFILED.items() for c in cols)
    cuts = ", ".join(f"quantile_cont(x, {i / bins}) AS d{i}" for i in range(1, bins))
    above = " + ".join(f"(d{i} < x)::INT" for i in range(1, bins))
    return f"""WITH v AS ({parts}), c AS (SELECT table_name, column_name, {cuts} FROM v GROUP BY ALL), b AS (SELECT table_name, column_name, load_no, {above} AS bin, count(*) AS n FROM v JOIN c USING (table_name, column_name) GROUP BY ALL),
 g AS (SELECT table_name, column_name, load_no, sum(n) AS total FROM b GROUP BY ALL), t AS (SELECT *, lag(load_no) OVER (PARTITION BY table_name, column_name ORDER BY load_no) AS prev FROM g), bins AS (SELECT unnest(range({bins})) AS bin),
 s AS (SELECT t.table_name, t.column_name, t.load_no, t.prev, bins.bin, t.total, greatest(coalesce(b.n, 0), 0.5) / t.total AS share FROM t CROSS JOIN bins LEFT JOIN b ON b.table_name = t.table_name AND b.column_name = t.column_name AND b.load_no = t.load_no AND b.bin = bins.bin)
 SELECT y.table_name, y.column_name, y.load_no, round(sum((y.share - z.share) * ln(y.share / z.share)), 6) AS psi, round(sum(y.total * (y.share - z.share) * (y.share - z.share) / z.share), 4) AS chi_square
 FROM s y JOIN s z ON y.table_name = z.table_name AND y.column_name = z.column_name AND y.prev = z.load_no AND y.bin = z.bin GROUP BY y.table_name, y.column_name, y.load_no"""


def p3_sql() -> str:
    num = "'^[+-]?[0-9]+(\\.[0-9]+)?$'"
    parts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_no, {missing_sql(c)} AS gone, coalesce(regexp_matches({c}, {num}), false) AS plain, CASE WHEN regexp_matches({c}, {num}) THEN CAST({c} AS DOUBLE) END AS x FROM {t}" for t, cols in PROFILED.items() for c in cols)
    return f"""WITH v AS ({parts}), m AS (SELECT table_name, column_name, load_no, avg(gone::INT) AS nr, count(*) FILTER (NOT gone AND NOT plain) / nullif(CAST(count(*) FILTER (NOT gone) AS DOUBLE), 0) AS pr, count(DISTINCT x) / nullif(CAST(count(x) AS DOUBLE), 0) AS dr,
 quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.99) AS p99 FROM v GROUP BY ALL),
 md AS (SELECT table_name, column_name, median(nr) AS mnr, median(pr) AS mpr, median(dr) AS mdr, median(p01) AS m01, median(p50) AS m50, median(p99) AS m99, median(p75 - p25) AS miqr FROM m GROUP BY ALL),
 o AS (SELECT table_name, column_name, load_no, avg((x < m01 OR x > m99)::INT) AS outside FROM v JOIN md USING (table_name, column_name) WHERE x IS NOT NULL GROUP BY ALL), j AS (SELECT * FROM m JOIN md USING (table_name, column_name) LEFT JOIN o USING (table_name, column_name, load_no))
 SELECT table_name, column_name, load_no, 'null_rate' AS finding FROM j WHERE nr - mnr >= 0.15 - 1e-12 UNION ALL SELECT table_name, column_name, load_no, 'pattern' FROM j WHERE pr - mpr >= 0.15 - 1e-12 UNION ALL SELECT table_name, column_name, load_no, 'distinct' FROM j WHERE dr < 0.5 * mdr - 1e-12
 UNION ALL SELECT table_name, column_name, load_no, 'value_range' FROM j WHERE outside >= 0.10 - 1e-12 UNION ALL SELECT table_name, column_name, load_no, 'distribution' FROM j WHERE abs(p50 - m50) > 0.5 * miqr + 1e-12"""


def profile_sql() -> str:
    num = "'^[+-]?[0-9]+(\\.[0-9]+)?$'"
    cells = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in WHOLE_TABLES.items() for c in cols)
    return f"""WITH c AS (SELECT table_name, column_name, v, count(*) AS n FROM ({cells}) GROUP BY ALL), d AS (SELECT *, {missing_sql('v')} AS gone, coalesce(regexp_matches(v, {num}), false) AS plain FROM c)
 SELECT table_name, column_name, CAST(sum(n) AS BIGINT) AS n_cells, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_missing, count(*) FILTER (NOT gone) AS n_distinct, CAST(coalesce(sum(n) FILTER (plain), 0) AS BIGINT) AS n_plain, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT plain), 0) AS BIGINT) AS n_pattern, CAST(max(n) FILTER (NOT gone) AS BIGINT) AS n_top FROM d GROUP BY ALL"""


def p6_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, row_id FROM customer_churn WHERE {missing_sql(c)}" for c in ("salary", "age", "department"))


def p7_sql() -> str:
    """An independent reading of the unit rules: every stated part by pattern, the rest from the remark and the feed."""
    has = lambda c, p: f"regexp_matches(lower({c}), '{p}')"
    v = "salary"
    usd, lakh, thousand, rupees = has(v, "[$]|usd"), has(v, "lakh|lac|[0-9 ]l$|[0-9 ]l |lpa"), has(v, "thousand|[0-9 ]k$|[0-9 ]k "), has(v, "rupees")
    month, year = has(v, "month|[0-9 ]pm$"), has(v, "annum|year|/yr|p[.]a[.]|[0-9lk$ ]pa$|lpa")
    salary = f"""SELECT 'customer_churn' AS table_name, 'salary' AS column_name, row_id, CASE WHEN {usd} THEN 5 WHEN {lakh} THEN 4 WHEN {thousand} THEN 3 WHEN {rupees} THEN CASE WHEN {month} THEN 2 WHEN {year} THEN 1 WHEN u = 2 THEN 2 ELSE 1 END
 WHEN u IN (3, 4) THEN u WHEN {month} THEN 2 WHEN {year} THEN 1 ELSE u END AS unit_id FROM customer_churn LEFT JOIN (SELECT feed, unit_id AS u FROM feed_units WHERE field_name = 'salary') USING (feed) WHERE regexp_matches(salary, '[0-9]')"""
    k = "kms_driven"
    r_mile = has("remarks", "(odometer in|noted in|odo shows|reading is|marked in) (miles|mi)\\b")
    r_thousand = has("remarks", "(odometer noted as thousand km|thousands of km|in ''000 km)")
    kms = f"""SELECT 'car_data', 'kms_driven', row_id, CASE WHEN {has(k, 'mi')} THEN 12 WHEN {has(k, '(k|thousand) *k')} THEN 13 WHEN {has(k, 'k')} THEN 11 WHEN {r_mile} THEN 12 WHEN {r_thousand} THEN 13 ELSE u END
 FROM car_data LEFT JOIN (SELECT feed, unit_id AS u FROM feed_units WHERE field_name = 'kms_driven') USING (feed) WHERE regexp_matches(kms_driven, '[0-9]')"""
    p = "selling_price"
    r = {"usd": "us[$]|in usd|us dollars", "thousand": "thousands of rupees|thousand inr|''000 rupees", "one": "full rupees|plain rupees|in rupees, not lakh"}
    price = f"""SELECT 'car_data', 'selling_price', row_id, CASE WHEN {has(p, '[$]|usd')} THEN 25 WHEN {has(p, 'cr')} THEN 24 WHEN {has(p, 'l(a|$)|[0-9 ]l$')} THEN 21 WHEN {has(p, 'thousand|[0-9 ]k')} THEN 23 WHEN {has(p, 'rupees')} THEN 22
 WHEN {has('remarks', r['usd'])} THEN 25 WHEN {has('remarks', r['thousand'])} THEN 23 WHEN {has('remarks', r['one'])} THEN 22 WHEN u = 25 AND {has(p, '₹')} THEN 22 ELSE u END
 FROM car_data LEFT JOIN (SELECT feed, unit_id AS u FROM feed_units WHERE field_name = 'selling_price') USING (feed) WHERE regexp_matches(selling_price, '[0-9]')"""
    return f"SELECT table_name, column_name, row_id, CAST(unit_id AS INT) AS unit_id FROM ({salary} UNION ALL {kms} UNION ALL {price}) WHERE unit_id NOT IN (1, 11, 21)"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": p2_sql(), "p2_fields": p2_fields_sql(), "p2_loaded": p2_loaded_sql(), "p2_loaded_cars": p2_loaded_cars_sql(), "p3_found": p3_sql(), "p3_ranges": ranges_sql(), "p3_drift": drift_sql(), "p3_profile": profile_sql(), "p6_found": p6_sql(), "p7_found": p7_sql()}
