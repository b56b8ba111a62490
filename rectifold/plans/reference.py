"""Queries of the engine's own operators over whole tables, each with the SQL an independent engine answers it with.

Dirty views are plain SQL that both engines run: `{table}` stands for a table. The column id of a view is the row id.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clean, corrupt, detect, engine, interactive, mlutility, profile, quality, rules
from ..operators.values import ROW, as_text, value_counts
from ..session import table

CFG = Config()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    df = spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
    return df.withColumnRenamed("id", ROW).withColumn(ROW, F.col(ROW).cast("bigint")) if "id" in df.columns else df


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(name: str, sql: str | None = None):
    """Registers a query; sql may refer to dirty views, which are written into it."""

    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = duck(sql)
        return f

    return wrap


def edits(spark: SparkSession, sf_dir: str, sql: str, *rule_list) -> DataFrame:
    """The proposed changes of some rules on a view, in their order."""
    t = rules.learn(view(spark, sf_dir, sql))
    out = []
    for r in rule_list:
        got = r(t)
        t.hit(got)
        out += got
    p = engine.Proposed(t, rules.numbered(out))
    return p.changes().select("proposal_id", F.col(ROW).alias("id"), "column", "old_value", "new_value")


def header(spark: SparkSession, sf_dir: str, sql: str, rule) -> DataFrame:
    t = rules.learn(view(spark, sf_dir, sql))
    return engine.Proposed(t, rules.numbered(rule(t))).header(spark).select("id", "tier", F.col("n_cells"))


# ---- missing tokens ---------------------------------------------------------------------------------------------------------
R1 = "SELECT c_custkey AS id, CASE WHEN c_custkey % 37 = 0 THEN 'N/A' WHEN c_custkey % 53 = 0 THEN '   ' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN ' Unknown' ELSE c_name END AS name FROM {customer}"
R1_CELLS = f"""SELECT id, 'segment' AS col, segment AS v FROM ({R1}) UNION ALL SELECT id, 'name', name FROM ({R1})"""
R1_ID = "CASE WHEN trim(v) = '' THEN 'R1_missing_trim_' || col ELSE 'R1_missing_' || col || '_' || regexp_replace(trim(v), '[^A-Za-z0-9_]', '_', 'g') END"


@query("r1_missing_tiers", f"""SELECT {R1_ID} AS id, CASE WHEN trim(v) = '' OR count(*) <= 0.05 * (SELECT count(*) FROM {{customer}}) THEN 'AUTO' ELSE 'REVIEW' END AS tier, count(*) AS n_cells
 FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) IN ('n/a', 'unknown') GROUP BY col, v""")  # fmt: skip
def _(s, d):
    return header(s, d, R1, rules.r1_missing)


@query("r1_apply_diff", f"SELECT {R1_ID} AS rule_id, CAST(id AS VARCHAR) AS row, col AS column, v AS old_value, '' AS new_value FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) = 'n/a'")
def _(s, d):
    t = rules.learn(view(s, d, R1))
    p = engine.Proposed(t, rules.numbered(rules.r1_missing(t)))
    t.hit(p.proposals)
    return engine.apply(p, engine.approve(p.proposals)).diff.select("rule_id", "row", "column", "old_value", "new_value")


@query("missing_tokens", f"SELECT col AS column, CASE WHEN trim(v) = '' THEN 'whitespace_only' ELSE trim(v) END AS token, count(*) AS n FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) IN ('n/a', 'unknown') GROUP BY 1, 2")
def _(s, d):
    return profile.missing_tokens(value_counts(as_text(view(s, d, R1))))


# ---- numbers and units ------------------------------------------------------------------------------------------------------
R2U = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_size || ' cm' WHEN 1 THEN '$' || p_size WHEN 2 THEN p_size || ' cm boxed' ELSE CAST(p_size AS STRING) END AS size FROM {part}"


@query("r2_units", f"SELECT CASE WHEN size LIKE '%boxed' THEN 'R2_numeric_descriptor_size' ELSE 'R2_numeric_canonical_size' END AS proposal_id, id, 'size' AS column, size AS old_value, regexp_extract(size, '[0-9]+') AS new_value FROM ({R2U}) WHERE NOT regexp_matches(size, '^[0-9]+$')")
def _(s, d):
    return edits(s, d, R2U, rules.r2_numeric)


R2P = "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN p_size || '%' ELSE CAST(p_size AS STRING) END AS rate FROM {part}"


@query("r2_percent_scale", f"SELECT 'R2_numeric_scale_rate' AS proposal_id, id, 'rate' AS column, rate AS old_value, replace(rate, '%', '') AS new_value FROM ({R2P}) WHERE rate LIKE '%\\%' ESCAPE '\\'")
def _(s, d):
    return edits(s, d, R2P, rules.r2_numeric)


R2D = "SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 0 THEN p_size || ' mins' WHEN p_partkey % 50 = 1 THEN CAST(p_size AS STRING) ELSE p_size || ' min' END AS duration FROM {part}"


@query("r2_dominant", f"SELECT 'R2_numeric_canonical_duration' AS proposal_id, id, 'duration' AS column, duration AS old_value, regexp_extract(duration, '[0-9]+') || ' min' AS new_value FROM ({R2D}) WHERE duration LIKE '%mins'")
def _(s, d):
    return edits(s, d, R2D, rules.r2_numeric)


# ---- white space and case ---------------------------------------------------------------------------------------------------
R3 = "SELECT c_custkey AS id, CASE WHEN c_custkey % 41 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 43 = 0 THEN ' ' || c_mktsegment || ' ' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 29 = 0 THEN 'big  deal' ELSE 'big deal' END AS deal FROM {customer}"


@query("r3_whitespace", f"SELECT 'R3_whitespace_segment' AS proposal_id, id, 'segment' AS column, segment AS old_value, trim(segment) AS new_value FROM ({R3}) WHERE segment <> trim(segment)")
def _(s, d):
    return edits(s, d, R3, rules.r3_whitespace_case).filter("proposal_id = 'R3_whitespace_segment'")


@query("r3_case", f"""SELECT 'R3_case_segment' AS proposal_id, id, 'segment' AS column, segment AS old_value, upper(segment) AS new_value FROM ({R3}) WHERE segment = lower(segment)
 UNION ALL SELECT 'R3_case_deal', id, 'deal', deal, 'big deal' FROM ({R3}) WHERE deal <> 'big deal'""")  # fmt: skip
def _(s, d):
    return edits(s, d, R3, rules.r3_whitespace_case).filter("proposal_id like 'R3_case%'")


R3C = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status FROM {orders}"


@query("r3_codes", f"SELECT 'R3_case_status' AS proposal_id, id, 'status' AS column, status AS old_value, upper(status) AS new_value FROM ({R3C}) WHERE status <> upper(status)")
def _(s, d):
    return edits(s, d, R3C, rules.r3_whitespace_case)


# ---- dates ------------------------------------------------------------------------------------------------------------------
DMY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)"
ISO = "CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
R4 = f"SELECT o_orderkey AS id, {DMY} AS ordered FROM {{orders}}"


@query("r4_dates_dayfirst", f"SELECT 'R4_dates_canonical_ordered' AS proposal_id, o_orderkey AS id, 'ordered' AS column, {DMY} AS old_value, {ISO} AS new_value FROM {{orders}}")
def _(s, d):
    return edits(s, d, R4, rules.r4_dates)


R4A = f"SELECT o_orderkey AS id, {DMY} AS ordered FROM {{orders}} WHERE day(o_orderdate) <= 12"


@query("r4_dates_ambiguous", "SELECT 'R4_dates_ambiguous_ordered' AS id, 'FLAG' AS tier, CAST(0 AS BIGINT) AS n_cells")
def _(s, d):
    return header(s, d, R4A, rules.r4_dates)


# ---- splits, dependencies, variants, repeats --------------------------------------------------------------------------------
R5 = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment FROM {customer}"


@query("r5_split", """SELECT 'R5_compound_split_name_segment' AS proposal_id, c_custkey AS id, 'name' AS column, c_name || ' ' || c_mktsegment AS old_value, c_name AS new_value FROM {customer} WHERE c_custkey % 4 = 0
 UNION ALL SELECT 'R5_compound_split_name_segment', c_custkey, 'segment', '', c_mktsegment FROM {customer} WHERE c_custkey % 4 = 0""")  # fmt: skip
def _(s, d):
    return edits(s, d, R5, rules.r5_compound_split)


FD = "SELECT c_custkey AS id, n_name AS nation, CASE WHEN c_custkey % 97 = 0 THEN 'WRONG' WHEN c_custkey % 89 = 0 THEN '' ELSE r_name END AS region FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
FD_GROUPS = f"SELECT nation, region, count(*) AS n FROM ({FD}) WHERE region <> '' GROUP BY 1, 2"
FD_BEST = f"SELECT nation, sum(n) AS total, max(n) AS top, arg_max(region, n) AS best FROM ({FD_GROUPS}) GROUP BY 1"


@query("fd_discovery", f"SELECT 'nation' AS a, 'region' AS b, CAST(sum(top) AS BIGINT) AS majority, CAST(sum(total) AS BIGINT) AS total, round(CAST(sum(top) AS DOUBLE) / sum(total), 6) AS confidence FROM ({FD_BEST}) WHERE total >= 2")
def _(s, d):
    t = rules.learn(view(s, d, FD))
    rows = [(x.a, x.b, int(x.majority), int(x.total), round(x.confidence, 6)) for x in rules.dependencies(t)]
    return s.createDataFrame(rows, "a string, b string, majority bigint, total bigint, confidence double")


@query("r6_repair", f"SELECT 'R6_dependency_nation_region' AS proposal_id, id, 'region' AS column, region AS old_value, best AS new_value FROM ({FD}) JOIN ({FD_BEST}) USING (nation) WHERE total >= 2 AND top >= 2 AND top * 3 >= total * 2 AND region <> best")
def _(s, d):
    return edits(s, d, FD, rules.r6_dependency_repair)


R7 = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 211 < 5 THEN 'AUTOMOBLE' WHEN c_custkey % 301 = 0 THEN 'MACHINRY ' ELSE c_mktsegment END AS segment FROM {customer}"
R7_FREQ = f"SELECT trim(segment) AS v, count(*) AS n, (SELECT count(*) FROM ({R7})) AS total FROM ({R7}) GROUP BY 1"


@query("r7_variants", f"""WITH f AS ({R7_FREQ}), p AS (SELECT a.v, b.v AS target, row_number() OVER (PARTITION BY a.v ORDER BY b.n DESC, levenshtein(lower(a.v), lower(b.v))) AS rn
 FROM f a JOIN f b ON a.v <> b.v AND (a.n <= 0.02 * a.total OR (a.total < 100 AND a.n <= 2)) AND NOT (b.n <= 0.02 * b.total OR (b.total < 100 AND b.n <= 2)) AND b.n >= 3 AND b.n >= 10 * a.n AND levenshtein(lower(a.v), lower(b.v)) BETWEEN 1 AND 2)
 SELECT 'R7_category_segment_' || v AS proposal_id, id, 'segment' AS column, segment AS old_value, target AS new_value FROM ({R7}) JOIN p ON trim(segment) = v AND rn = 1""")  # fmt: skip
def _(s, d):
    return edits(s, d, R7, rules.r7_category_variants)


R8 = "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_orderpriority, o_orderkey AS k FROM {orders} UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM {orders} WHERE o_orderkey % 100 = 0"


@query("r8_duplicates", f"SELECT id, first FROM (SELECT id, min(id) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority, k) AS first FROM ({R8})) WHERE id <> first")
def _(s, d):
    df = view(s, d, R8)
    return rules.duplicate_rows(df, [c for c in df.columns if c != ROW]).select(F.col(ROW).alias("id"), "first")


SENT = "SELECT doc_id AS id, text FROM {documents}"


@query("exact_dup_documents", "SELECT doc_id AS row, first AS suggested_value FROM (SELECT doc_id, CAST(min(doc_id) OVER (PARTITION BY text) AS VARCHAR) AS first FROM documents) WHERE CAST(doc_id AS VARCHAR) <> first")
def _(s, d):
    return detect.exact_duplicates(view(s, d, SENT)).select("row", "suggested_value")


@query("near_dup_band")
def _(s, d):
    return detect.near_duplicates_all(view(s, d, "SELECT p_partkey AS id, p_name, p_brand, p_type FROM {part}"), CFG)


# ---- profiles ---------------------------------------------------------------------------------------------------------------
NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("profile_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS n, round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(avg({c}), 3) AS mean, round(median({c}), 3) AS median, round(stddev_samp({c}), 3) AS std, round(quantile_cont({c}, 0.25), 3) AS q1, round(quantile_cont({c}, 0.75), 3) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 3) AS iqr, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM {{lineitem}}"
    for c in NUMS))
def _(s, d):
    return profile.numeric_profile(table(s, d, "lineitem"), list(NUMS))


PART = "SELECT p_partkey AS id, p_brand, p_type, p_name FROM {part}"
PCOLS = ("p_brand", "p_type", "p_name")


@query("profile_shapes", " UNION ALL ".join(
    f"SELECT '{c}' AS column, shape, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM (SELECT regexp_replace(regexp_replace({c}, '[A-Za-z]', 'a', 'g'), '[0-9]', '#', 'g') AS shape, count(*) AS n FROM (SELECT * FROM part WHERE {c} <> '' ORDER BY p_partkey LIMIT 5000) GROUP BY 1)"
    for c in PCOLS))
def _(s, d):
    return profile.shapes(as_text(view(s, d, PART))).select("column", "shape", "n", F.round("share", 6).alias("share"))


@query("profile_topk", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank, {c} AS value, count(*) AS n FROM part GROUP BY {c}) WHERE rank <= 5" for c in PCOLS))
def _(s, d):
    return profile.top_values(value_counts(as_text(view(s, d, PART))))


@query("cardinality", " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n_cells, count(DISTINCT {c}) AS n_unique, round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*), 6) AS unique_ratio, CAST({1 if c == 'p_size' else 0} AS DOUBLE) AS numeric_parse_rate FROM part" for c in ("p_brand", "p_type", "p_size")))
def _(s, d):
    c = profile.column_stats(value_counts(as_text(view(s, d, "SELECT p_partkey AS id, p_brand, p_type, p_size FROM {part}"))))
    return c.select("column", "n_cells", "n_unique", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("numeric_parse_rate", 6).alias("numeric_parse_rate"))


@query("profile_samples", "SELECT 'p_brand' AS column, CAST(row_number() OVER (ORDER BY first) AS INT) AS position, p_brand AS value FROM (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1) QUALIFY position <= 5")
def _(s, d):
    return profile.samples(value_counts(as_text(view(s, d, "SELECT p_partkey AS id, p_brand FROM {part}"))))


@query("dataset_summary", f"SELECT (SELECT count(*) FROM ({R1})) AS n_rows, 2 AS n_columns, (SELECT count(*) FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) IN ('n/a', 'unknown')) AS missing_cells, (SELECT count(*) FROM ({R1})) - (SELECT count(*) FROM (SELECT DISTINCT segment, name FROM ({R1}))) AS duplicate_rows")
def _(s, d):
    return profile.dataset_summary(view(s, d, R1))


@query("schema_types", "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'categorical')) AS t(\"column\", logical_type)")
def _(s, d):
    return s.createDataFrame([(x["column"], x["logical_type"]) for x in profile.logical_types(table(s, d, "orders"))], "column string, logical_type string")


@query("datetime_profile", "SELECT 'l_shipdate' AS column, count(l_shipdate) AS n, CAST(min(l_shipdate) AS VARCHAR) AS min, CAST(max(l_shipdate) AS VARCHAR) AS max FROM lineitem")
def _(s, d):
    return profile.datetime_profile(table(s, d, "lineitem").select("l_shipdate")).select("column", "n", F.date_format("min", "yyyy-MM-dd HH:mm:ss").alias("min"), F.date_format("max", "yyyy-MM-dd HH:mm:ss").alias("max"))


# ---- format checks and outliers ---------------------------------------------------------------------------------------------
CHECKED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 'user at mail' ELSE 'user' || c_custkey || '@mail.com' END AS contact,
 CASE WHEN c_custkey % 17 = 0 THEN 'www' ELSE 'https://shop.example.com/' || c_custkey END AS page, CASE WHEN c_custkey % 19 = 0 THEN 'none given' ELSE '+49 30 ' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS phone,
 CASE WHEN c_custkey % 11 = 0 THEN 'ZIP?' ELSE lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') END AS zip, CASE WHEN c_custkey % 23 = 0 THEN 'maybe' WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS active,
 CASE WHEN c_custkey % 31 = 0 THEN 'Z9' WHEN c_custkey % 3 = 0 THEN 'CA' ELSE 'TX' END AS state FROM {customer}"""  # fmt: skip


@query("validators", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'FLAG_validator_{v}_{c}' AS id, count(*) || ' cells of ''{c}'' are no valid {v}' AS description FROM customer WHERE c_custkey % {m} = 0"
    for v, c, m in (("email", "contact", 13), ("url", "page", 17), ("phone", "phone", 19), ("postal_code", "zip", 11), ("boolean", "active", 23), ("iso_code", "state", 31))) + ")")
def _(s, d):
    t = rules.learn(view(s, d, CHECKED))
    return engine.Proposed(t, rules.numbered(rules.validators(t))).header(s).select("id", "description")


PRICE = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS STRING) AS price FROM {lineitem}"
IQR = "SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(*) AS numbers FROM (SELECT CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS DOUBLE) AS x FROM {lineitem})"


@query("iqr_outliers", f"SELECT 'price' AS column, round(q1, 4) AS q1, round(q3, 4) AS q3, numbers, (SELECT count(*) FROM {{lineitem}} WHERE CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS DOUBLE) NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS mild, (SELECT count(*) FROM {{lineitem}} WHERE CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS DOUBLE) NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)) AS extreme FROM ({IQR})")
def _(s, d):
    df = table(s, d, "lineitem").select(F.monotonically_increasing_id().alias(ROW), F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("price"))
    return rules.iqr_outliers(rules.learn(df))[1].select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "numbers", "mild", "extreme")


# ---- detectors --------------------------------------------------------------------------------------------------------------
EV = "SELECT event_id AS id, CASE WHEN event_id % 31 = 0 THEN 'N/A' WHEN event_id % 47 = 0 THEN '' ELSE event_type END AS kind, CAST(event_id % 140 AS INT) - 5 AS age, CASE WHEN event_id % 3 = 0 THEN 'Married' ELSE 'single' END AS marital_status FROM {events}"


@query("detect_missing", f"SELECT id AS row, 'kind' AS column, kind AS original_value FROM ({EV}) WHERE kind IN ('N/A', '') QUALIFY row_number() OVER (ORDER BY id) <= 5000")
def _(s, d):
    return detect.missing(view(s, d, EV), CFG).select("row", "column", "original_value")


@query("detect_range", f"SELECT id AS row, 'age' AS column, CAST(age AS VARCHAR) AS original_value FROM ({EV}) WHERE age < 0 OR age > 120")
def _(s, d):
    return detect.ranges(view(s, d, EV), CFG).select("row", "column", "original_value")


@query("detect_contradiction", f"SELECT id AS row, marital_status AS original_value FROM ({EV}) WHERE age < 16 AND marital_status = 'Married'")
def _(s, d):
    return detect.contradictions(view(s, d, EV)).select("row", "original_value")


DATED = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 61 = 0 THEN '22/13/2020' WHEN o_orderkey % 67 = 0 THEN '2025-02-30' ELSE {ISO} END AS order_date FROM {{orders}}"


@query("detect_date", f"SELECT id AS row, order_date AS original_value FROM ({DATED}) WHERE order_date IN ('22/13/2020', '2025-02-30')")
def _(s, d):
    return detect.dates(view(s, d, DATED)).select("row", "original_value")


TYPED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 'Thirty' WHEN p_partkey % 41 = 0 THEN '$' || p_size WHEN p_partkey % 43 = 0 THEN 'N/A' WHEN p_partkey % 47 = 0 THEN 'abc' ELSE CAST(p_size AS STRING) END AS size FROM {part}"


@query("detect_type", f"SELECT id AS row, size AS original_value, CASE WHEN size = 'N/A' THEN 'convert_to_null' WHEN size = 'Thirty' THEN 'convert_word_to_number' WHEN size = 'abc' THEN 'flag_for_human_review' ELSE 'convert_type' END AS suggested_action, CASE WHEN size = 'Thirty' THEN '30' WHEN size LIKE '$%' THEN CAST(CAST(substr(size, 2) AS DOUBLE) AS VARCHAR) END AS suggested_value FROM ({TYPED}) WHERE NOT regexp_matches(size, '^[0-9]+$')")
def _(s, d):
    return detect.types(view(s, d, TYPED)).select("row", "original_value", "suggested_action", "suggested_value")


@query("detect_category", f"SELECT id AS row, 'casing_inconsistency' AS issue_type, segment AS original_value, upper(segment) AS suggested_value FROM ({R3}) WHERE segment = lower(segment) UNION ALL SELECT id, 'whitespace_inconsistency', segment, trim(segment) FROM ({R3}) WHERE segment <> trim(segment)")
def _(s, d):
    return detect.inconsistencies(view(s, d, R3).select(ROW, "segment")).select("row", "issue_type", "original_value", "suggested_value")


@query("detect_typo", f"SELECT id AS row, segment AS original_value, CASE WHEN segment LIKE 'AUTO%' THEN 'AUTOMOBILE' ELSE 'MACHINERY' END AS suggested_value FROM ({R7}) WHERE trim(segment) IN ('AUTOMOBLE', 'MACHINRY')")
def _(s, d):
    return detect.typos(view(s, d, R7), CFG).select("row", "original_value", "suggested_value")


SHAPED = "SELECT o_orderkey AS id, 'x' AS same, CAST(o_orderkey AS STRING) AS unique_text, CASE WHEN o_orderkey % 500 = 0 THEN 'rare' WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS cls, CASE WHEN o_orderkey % 30 = 0 THEN 'minor' ELSE 'major' END AS skewed FROM {orders}"


@query("detect_columns", f"""WITH v AS ({SHAPED}) SELECT 'constant_column' AS issue_type, 'same' AS column, CAST(NULL AS BIGINT) AS row UNION ALL SELECT 'high_cardinality', 'unique_text', NULL UNION ALL SELECT 'class_imbalance', 'skewed', NULL WHERE (SELECT avg(CASE WHEN skewed = 'major' THEN 1.0 ELSE 0 END) FROM v) > 0.95
 UNION ALL SELECT 'rare_category', 'cls', id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM v WHERE cls = 'rare') WHERE rn <= 25 AND (SELECT count(*) FILTER (cls = 'rare') < 0.01 * count(*) FROM v)""")  # fmt: skip
def _(s, d):
    return detect.column_shapes(view(s, d, SHAPED)).select("issue_type", "column", "row")


@query("detect_correlation", "SELECT 'l_quantity' AS column, 'twice' AS original_value, 'highly_correlated' AS issue_type")
def _(s, d):
    df = view(s, d, "SELECT l_orderkey AS id, l_quantity, l_quantity * 2 + l_tax AS twice, l_discount FROM {lineitem}")
    return detect.correlations(df).select("column", "original_value", "issue_type")


OUT = "SELECT event_id AS id, CASE WHEN event_id % 997 = 0 THEN value + 5000 ELSE value END AS amount FROM {events}"
OUT_STATS = f"SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3, avg(amount) AS m, stddev_samp(amount) AS sd FROM ({OUT})"


@query("zscore_iqr_outliers", f"SELECT id AS row FROM ({OUT}), ({OUT_STATS}) WHERE (amount NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AND (abs(amount - m) > 3 * sd OR abs(amount - m) > 3 * (q3 - q1))) OR abs(amount - m) > 4 * sd")
def _(s, d):
    return detect.outliers(view(s, d, OUT), CFG).select("row")


@query("issues_unified", f"""SELECT row, "column", issue_type, routing_decision FROM (SELECT id AS row, 'age' AS column, 'invalid_range' AS issue_type, 'HUMAN_REVIEW_REQUIRED' AS routing_decision FROM ({EV}) WHERE age < 0 OR age > 120
 UNION ALL SELECT id, 'kind', 'missing_value', 'HUMAN_REVIEW_REQUIRED' FROM ({EV}) WHERE kind IN ('N/A', '') QUALIFY row_number() OVER (ORDER BY id) <= 5000
 UNION ALL SELECT id, 'marital_status', 'cross_column_contradiction', 'HUMAN_REVIEW_REQUIRED' FROM ({EV}) WHERE age < 16 AND marital_status = 'Married')""")  # fmt: skip
def _(s, d):
    v = view(s, d, EV)
    issues = engine.union_all([detect.missing(v, CFG), detect.ranges(v, CFG), detect.contradictions(v)])
    return detect.unify(issues, CFG).select("row", "column", "issue_type", "routing_decision")


@query("forest_outliers")
def _(s, d):
    return detect.isolation_forest(view(s, d, OUT), ["amount"])


# ---- cleaning ---------------------------------------------------------------------------------------------------------------
GAPS = "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS kind FROM {events}"


@query("impute_median", f"SELECT id, round(coalesce(value, (SELECT round(median(value), 3) FROM ({GAPS}))), 6) AS value, coalesce(kind, (SELECT kind FROM ({GAPS}) WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM ({GAPS})")
def _(s, d):
    return clean.impute(view(s, d, GAPS)).select(F.col(ROW).alias("id"), F.round("value", 6).alias("value"), "kind")


@query("impute_mean", f"SELECT id, round(coalesce(value, (SELECT round(avg(value), 3) FROM ({GAPS}))), 6) AS value FROM ({GAPS})")
def _(s, d):
    return clean.impute(view(s, d, GAPS).drop("kind"), numeric="mean").select(F.col(ROW).alias("id"), F.round("value", 6).alias("value"))


@query("impute_constant", f"SELECT id, coalesce(value, -1.0) AS value, coalesce(kind, 'none given') AS kind FROM ({GAPS})")
def _(s, d):
    return clean.impute(view(s, d, GAPS), "constant", "constant", {"value": -1, "kind": "none given"}).select(F.col(ROW).alias("id"), "value", "kind")


@query("fill_forward", f"SELECT id, coalesce(kind, last_value(kind IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS kind FROM ({GAPS})")
def _(s, d):
    return clean.fill_blanks(view(s, d, GAPS).drop("value"), "kind", "ffill").select(F.col(ROW).alias("id"), "kind")


@query("fill_backward", f"SELECT id, coalesce(kind, first_value(kind IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kind FROM ({GAPS})")
def _(s, d):
    return clean.fill_blanks(view(s, d, GAPS).drop("value"), "kind", "bfill").select(F.col(ROW).alias("id"), "kind")


CAP = f"SELECT round(quantile_cont(amount, 0.25) - 1.5 * (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)), 3) AS lo, round(quantile_cont(amount, 0.75) + 1.5 * (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)), 3) AS hi FROM ({OUT})"


@query("cap_outliers", f"SELECT id, round(least(greatest(amount, lo), hi), 4) AS amount FROM ({OUT}), ({CAP})")
def _(s, d):
    return clean.handle_outliers(view(s, d, OUT), "cap").select(F.col(ROW).alias("id"), F.round("amount", 4).alias("amount"))


@query("remove_outliers", f"SELECT id FROM ({OUT}), ({CAP}) WHERE amount BETWEEN lo AND hi")
def _(s, d):
    return clean.handle_outliers(view(s, d, OUT), "remove").select(F.col(ROW).alias("id"))


@query("type_clean", f"SELECT id, try_cast(replace(size, '$', '') AS DOUBLE) AS size FROM ({TYPED})")
def _(s, d):
    return clean.type_clean(view(s, d, TYPED)).select(F.col(ROW).alias("id"), "size")


@query("category_clean", f"SELECT id, upper(trim(segment)) AS segment FROM ({R3})")
def _(s, d):
    return clean.category_clean(view(s, d, R3).select(ROW, "segment")).select(F.col(ROW).alias("id"), "segment")


@query("dedupe", f"SELECT min(id) AS id FROM ({R8}) GROUP BY o_custkey, o_orderstatus, o_orderpriority, k")
def _(s, d):
    return clean.drop_duplicates(view(s, d, R8)).select(F.col(ROW).alias("id"))


# ---- scores and comparisons -------------------------------------------------------------------------------------------------
TRUTH = "SELECT c_custkey AS id, c_mktsegment AS segment, c_name AS name FROM {customer}"
DIRTY = "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, c_name AS name FROM {customer}"
FIXED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'WRONG' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 50 = 3 THEN 'hurt' ELSE c_name END AS name FROM {customer}"
TRIO = f"SELECT d.segment AS d, t.segment AS t, o.segment AS o FROM ({DIRTY}) d JOIN ({TRUTH}) t USING (id) JOIN ({FIXED}) o USING (id) UNION ALL SELECT d.name, t.name, o.name FROM ({DIRTY}) d JOIN ({TRUTH}) t USING (id) JOIN ({FIXED}) o USING (id)"


@query("cell_metrics", f"""SELECT *, round(CASE WHEN changed > 0 THEN 100.0 * fixed / changed ELSE 0 END, 4) AS precision, round(CASE WHEN errors > 0 THEN 100.0 * fixed / errors ELSE 0 END, 4) AS recall, round(200.0 * fixed / (changed + errors), 4) AS f1, round(100.0 * damaged / (cells - errors), 4) AS harm FROM (
 SELECT count(*) AS cells, count(*) FILTER (d <> t) AS errors, count(*) FILTER (d <> o) AS changed, count(*) FILTER (d <> t AND d <> o AND o = t) AS fixed, count(*) FILTER (d = t AND d <> o) AS damaged, count(*) FILTER (d <> t AND d <> o AND o <> t) AS wrong, count(*) FILTER (d <> t AND d = o) AS missed FROM ({TRIO}))""")  # fmt: skip
def _(s, d):
    return engine.cell_metrics(*(view(s, d, v) for v in (DIRTY, TRUTH, FIXED))).drop("agreement")


@query("oracle_filter", f"SELECT id, CASE WHEN d.segment = t.segment THEN d.segment ELSE o.segment END AS segment, CASE WHEN d.name = t.name THEN d.name ELSE o.name END AS name FROM ({DIRTY}) d JOIN ({TRUTH}) t USING (id) JOIN ({FIXED}) o USING (id)")
def _(s, d):
    return engine.oracle_filter(*(view(s, d, v) for v in (DIRTY, TRUTH, FIXED))).withColumnRenamed(ROW, "id")


@query("quality_score", f"""WITH v AS ({R1}), x AS (SELECT count(*) AS n, (SELECT count(*) FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) IN ('n/a', 'unknown')) AS m, (SELECT count(*) FROM (SELECT DISTINCT segment, name FROM v)) AS u FROM v)
 SELECT round(100.0 * (1 - CAST(m AS DOUBLE) / (2 * n)), 2) AS completeness, round(100.0 * u / n, 2) AS uniqueness, 100.0 AS validity, 100.0 AS consistency, 100.0 AS anomaly, round(0.25 * 100.0 * (1 - CAST(m AS DOUBLE) / (2 * n)) + 0.20 * 100.0 * u / n + 55.0, 2) AS score FROM x""")  # fmt: skip
def _(s, d):
    return quality.quality_score(view(s, d, R1)).drop("grade")


@query("before_after", f"""WITH b AS (SELECT 'missing_value' AS issue_type, count(*) AS before FROM ({EV}) WHERE kind IN ('N/A', '') UNION ALL SELECT 'invalid_range', count(*) FROM ({EV}) WHERE age < 0 OR age > 120), a AS (SELECT 'invalid_range' AS issue_type, count(*) AS after FROM ({EV}) WHERE age < 0 OR age > 120)
 SELECT issue_type, least(before, 5000) AS before, coalesce(after, 0) AS after, greatest(least(before, 5000) - coalesce(after, 0), 0) AS resolved, round(100.0 * greatest(least(before, 5000) - coalesce(after, 0), 0) / least(before, 5000), 2) AS rate FROM b LEFT JOIN a USING (issue_type) WHERE issue_type = 'missing_value'
 UNION ALL SELECT issue_type, before, coalesce(after, 0), greatest(before - coalesce(after, 0), 0), round(100.0 * greatest(before - coalesce(after, 0), 0) / before, 2) FROM b LEFT JOIN a USING (issue_type) WHERE issue_type <> 'missing_value'""")  # fmt: skip
def _(s, d):
    v = view(s, d, EV)
    return engine.before_after(detect.missing(v, CFG).unionByName(detect.ranges(v, CFG)), detect.ranges(v, CFG))


@query("diff_summary", f"SELECT 2 * (SELECT count(*) FROM ({R1})) AS total_cells, count(*) AS modified_cells, CAST(0 AS BIGINT) AS dropped_rows, round(100.0 - 100.0 * count(*) / (2 * (SELECT count(*) FROM ({R1}))), 2) AS untouched_percentage, 0.0 AS harm_risk FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) = 'n/a'")
def _(s, d):
    t = rules.learn(view(s, d, R1))
    p = engine.Proposed(t, rules.numbered(rules.r1_missing(t)))
    t.hit(p.proposals)
    return engine.diff_summary(as_text(view(s, d, R1)), engine.apply(p, engine.approve(p.proposals)).diff)


@query("fidelity", f"SELECT 'value' AS column, round(avg(value), 4) AS mean_before, round(stddev_samp(value), 4) AS std_before, round(avg(coalesce(value, 0.0)), 4) AS mean_after, round(stddev_samp(coalesce(value, 0.0)), 4) AS std_after FROM ({GAPS})")
def _(s, d):
    v = view(s, d, GAPS)
    return engine.fidelity(v, v.withColumn("value", F.coalesce("value", F.lit(0.0))), ["value"])


@query("resolution_rate", "SELECT * FROM (VALUES (0, 0, 100.0), (10, 4, 40.0), (10, 12, 100.0)) AS t(initial, repaired, rate)")
def _(s, d):
    df = s.createDataFrame([(0, 0), (10, 4), (10, 12)], "initial int, repaired int")
    return df.withColumn("rate", quality.resolution_rate(F.col("initial"), F.col("repaired")))


PLANTED = "SELECT event_id AS row, CASE WHEN event_id % 2 = 0 THEN 'value' ELSE 'kind' END AS column, CASE WHEN event_id % 3 = 0 THEN 'typo' ELSE 'range' END AS corruption_type FROM {events} WHERE event_id % 7 = 0"
FOUND = "SELECT event_id AS row, CASE WHEN event_id % 2 = 0 THEN 'value' ELSE 'kind' END AS column, 'x' AS issue_type FROM {events} WHERE event_id % 14 < 3"


@query("detection_metrics", f"""WITH t AS ({PLANTED}), i AS ({FOUND}), h AS (SELECT t.*, i.issue_type IS NOT NULL AS hit FROM t LEFT JOIN i ON t.row = i.row AND t.column = i.column),
 c AS (SELECT corruption_type AS type, count(*) FILTER (hit) AS tp, CAST(0 AS BIGINT) AS fp, count(*) FILTER (NOT hit) AS fn FROM h GROUP BY 1 UNION ALL SELECT 'overall', count(*) FILTER (hit), (SELECT count(*) FROM i ANTI JOIN t ON t.row = i.row AND t.column = i.column), count(*) FILTER (NOT hit) FROM h)
 SELECT type, tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 4) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""")  # fmt: skip
def _(s, d):
    return quality.detection_metrics(view(s, d, PLANTED), view(s, d, FOUND))


@query("correction_metrics", f"""SELECT count(*) AS corruptions, count(*) FILTER (o = t) AS corrected, count(*) FILTER (o <> t AND lower(o) <> lower(d)) AS wrong, count(*) FILTER (o <> t AND lower(o) = lower(d)) AS unresolved, round(100.0 * count(*) FILTER (o = t) / count(*), 2) AS accuracy
 FROM (SELECT d.segment AS d, t.segment AS t, o.segment AS o FROM ({DIRTY}) d JOIN ({TRUTH}) t USING (id) JOIN ({FIXED}) o USING (id)) WHERE d <> t""")  # fmt: skip
def _(s, d):
    a, b, c = (view(s, d, v) for v in (DIRTY, TRUTH, FIXED))
    truth = a.select(F.col(ROW), F.col("segment").alias("corrupted_value")).join(b.select(ROW, F.col("segment").alias("original_value")), ROW).filter("corrupted_value <> original_value")
    return quality.correction_metrics(truth.select(F.col(ROW).alias("row"), F.lit("segment").alias("column"), "original_value", "corrupted_value"), c)


@query("inject_and_recover")
def _(s, d):
    base = view(s, d, TRUTH)
    dirty, truth = corrupt.inject(base, {"missing_value": 0.02, "casing_inconsistency": 0.02, "spelling_typo": 0.01}, columns=["segment"])
    return quality.detection_metrics(truth, detect.detect_all(dirty.select(ROW, "segment"), CFG).filter("column <> '__all__'"))


# ---- interactive operators --------------------------------------------------------------------------------------------------
ITEMS = "SELECT p_partkey AS id, p_size AS Quantity, CAST(p_retailprice AS DECIMAL(12, 2)) AS Unit_Price, p_brand AS Brand, p_type AS Kind FROM {part}"


@query("formula_arith", f"SELECT id, round(CAST(Quantity AS DOUBLE) * CAST(Unit_Price AS DOUBLE), 4) AS total, CAST(floor(CAST(Quantity AS DOUBLE) / 7) AS BIGINT) AS weeks, CAST(Quantity % 7 AS BIGINT) AS days FROM ({ITEMS})")
def _(s, d):
    df = as_text(view(s, d, ITEMS))
    cols = [c for c in df.columns if c != ROW]
    nums = interactive.numeric_in_scope(df, cols)
    f = lambda x: interactive.compile_formula(x, cols, nums)
    return df.select(F.col(ROW).alias("id"), F.round(f("Quantity * Unit_Price"), 4).alias("total"), f("Quantity // 7").cast("bigint").alias("weeks"), f("Quantity % 7").cast("bigint").alias("days"))


@query("formula_concat", f"SELECT id, Brand || ' - ' || Kind AS label FROM ({ITEMS})")
def _(s, d):
    return interactive.apply_formula(as_text(view(s, d, ITEMS)), "label", "Brand + ' - ' + Kind").select(F.col(ROW).alias("id"), "label")


@query("formula_scope", f"SELECT id, CASE WHEN Quantity > 25 THEN CAST(Quantity * 2 AS VARCHAR) ELSE CAST(Quantity AS VARCHAR) END AS Quantity FROM ({ITEMS})")
def _(s, d):
    df = as_text(view(s, d, ITEMS))
    return interactive.apply_formula(df, "Quantity", "Quantity * 2", interactive.scope(df, "condition", condition="Quantity > 25")).select(F.col(ROW).alias("id"), "Quantity")


@query("find_replace", f"SELECT id, replace(Brand, 'Brand', 'B') AS Brand FROM ({ITEMS})")
def _(s, d):
    return interactive.find_replace(as_text(view(s, d, ITEMS)), "Brand", "B", ["Brand"]).select(F.col(ROW).alias("id"), "Brand")


@query("append_unit", f"SELECT id, Quantity || ' pcs' AS Quantity FROM ({ITEMS})")
def _(s, d):
    return interactive.append_text(as_text(view(s, d, ITEMS)), "Quantity", "pcs", separator=" ").select(F.col(ROW).alias("id"), "Quantity")


@query("nl_rule_violation", f"SELECT id FROM ({EV}) WHERE age < 0")
def _(s, d):
    return interactive.rule_violations(view(s, d, EV), "age must be positive").select(F.col(ROW).alias("id"))


@query("change_tally", f"SELECT col AS column, 'R1_missing_tokens' AS rule_kind, count(*) AS n FROM ({R1_CELLS}) WHERE trim(v) = '' OR lower(trim(v)) = 'n/a' GROUP BY 1")
def _(s, d):
    t = rules.learn(view(s, d, R1))
    p = engine.Proposed(t, rules.numbered(rules.r1_missing(t)))
    t.hit(p.proposals)
    return engine.tally(engine.apply(p, engine.approve(p.proposals)).diff)


# ---- whole runs -------------------------------------------------------------------------------------------------------------
LINES = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity, CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS STRING) AS price, l_discount, l_tax,
 CASE WHEN l_partkey % 101 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS returnflag, CASE WHEN l_partkey % 37 = 0 THEN 'N/A' ELSE l_linestatus END AS linestatus, l_partkey, l_suppkey FROM {lineitem}"""  # fmt: skip


@query("pipeline_lineitem")
def _(s, d):
    li = table(s, d, "lineitem")
    df = li.select(
        F.monotonically_increasing_id().alias(ROW), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").cast("decimal(14,2)").alias("l_extendedprice"), "l_discount", "l_tax",
        F.when(F.col("l_partkey") % 101 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("l_returnflag"), F.when(F.col("l_partkey") % 37 == 0, "N/A").otherwise(F.col("l_linestatus")).alias("l_linestatus"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate"),
    )
    p = engine.propose(df)
    return engine.changes_by_kind(engine.apply(p, engine.approve(p.proposals)).diff)


@query("ml_utility")
def _(s, d):
    base = view(s, d, "SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, o_totalprice, o_custkey % 7 AS bucket FROM {orders}")
    dirty, _ = corrupt.inject(base, {"missing_value": 0.1, "outlier": 0.05}, columns=["o_totalprice", "bucket"])
    return mlutility.utility({"dirty": dirty, "truth": base}, "truth", "o_orderstatus")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
