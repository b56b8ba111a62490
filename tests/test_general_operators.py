"""Unit reading, histories, load profiles, exact percentiles and filling, on small frames with defined edge cases."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rectifold.functions.text import is_missing, letters_and_digits, shape, title
from rectifold.operators import changepoint, hot, load_profile, neighbour_fill, percentiles, units

UNITS = [(1, "salary", "inr_per_year", 1.0), (2, "salary", "inr_per_month", 12.0), (3, "salary", "thousand_inr_per_year", 1000.0), (4, "salary", "lakh_inr_per_year", 1e5), (5, "salary", "usd_per_year", 82.5),
         (11, "kms_driven", "kilometre", 1.0), (12, "kms_driven", "mile", 1.609344), (13, "kms_driven", "thousand_kilometre", 1000.0),
         (21, "selling_price", "lakh_inr", 1.0), (22, "selling_price", "inr", 1e-5), (23, "selling_price", "thousand_inr", 0.01), (24, "selling_price", "crore_inr", 100.0), (25, "selling_price", "usd", 0.000825)]
FEEDS = [("year", "salary", 1), ("month", "salary", 2), ("lakh", "salary", 4), ("km", "kms_driven", 11), ("mi", "kms_driven", 12), ("lakh", "selling_price", 21), ("usd", "selling_price", 25), ("inr", "selling_price", 22)]


def read(spark, field, rows, remarks=None):
    u = spark.createDataFrame(UNITS, "unit_id int, field_name string, unit_name string, factor double")
    f = spark.createDataFrame(FEEDS, "feed string, field_name string, unit_id int")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id int, {field} string, feed string, remarks string")
    return [r["unit_id"] for r in units.with_unit(df, field, u, f, remarks=remarks).orderBy("row_id").collect()]


def test_salary_units(spark):
    rows = [("5000", "year", None), ("5000", "month", None), ("INR 60000 p.a.", "month", None), ("6.5", "lakh", None), ("₹86,675 pm", "year", None), ("1281 k per annum", "lakh", None), ("7.12 lakhs pa", "month", None), ("9.5LPA", "year", None),
            ("US$ 900", "lakh", None), ("3,55,200 rupees p.a.", "lakh", None), ("69333 rupees/month", "lakh", None), ("N/A", "year", None), (None, "year", None), ("", "year", None), ("7", None, None), ("7", "unlisted", None)]
    assert read(spark, "salary", rows) == [1, 2, 1, 4, 2, 3, 4, 4, 5, 1, 2, None, None, None, 1, 1]


def test_distances_and_prices_read_value_then_remark_then_feed(spark):
    rows = [("100", "km", None), ("100", "mi", None), ("100 km", "mi", None), ("16.9k km", "mi", None), ("26410mi", "km", None), ("5", "km", "odometer in miles"), ("5", "mi", "distance in '000 km; new tyres"), ("5", "km", "never driven more than 50 miles a day"), ("5", "mi", "reading is miles not km"), ("as read", "mi", None), ("-9", "mi", None)]
    assert read(spark, "kms_driven", rows, "remarks") == [11, 12, 11, 13, 12, 12, 13, 11, 12, None, 12]
    rows = [("3.5", "lakh", None), ("3.5", "usd", None), ("₹443", "lakh", None), ("1,641,000 rupees", "lakh", None), ("0.03 Cr.", "inr", None), ("7k", "lakh", None), ("5", "lakh", "amount is in rupees, not lakh"), ("5", "inr", "lakhs of memories"), ("5", "lakh", "price quoted in thousands of rupees"), ("5", "lakh", "quoted in US$. new tyres"), ("5", "lakh", "price last revised a thousand days ago"), ("4 lakh", "inr", "price in USD")]
    assert read(spark, "selling_price", rows, "remarks") == [21, 25, 21, 22, 24, 23, 22, 22, 23, 25, 21, 21]


def test_conversion_and_table_size_check(spark, monkeypatch):
    u = spark.createDataFrame(UNITS, "unit_id int, field_name string, unit_name string, factor double")
    df = spark.createDataFrame([("1,000 pm", 2), ("none", 1), (None, None)], "salary string, unit_id int")
    assert [r["salary_common"] for r in units.convert(df, "salary", u).collect()] == [12000.0, None, None]
    monkeypatch.setattr(units, "MAX_UNITS", 3)
    with pytest.raises(ValueError):
        units.convert(df, "salary", u)


def brute_segments(x, penalty):
    n, best = len(x), [0.0] + [math.inf] * len(x)
    for b in range(1, n + 1):
        for a in range(b):
            best[b] = min(best[b], best[a] + sum((v - np.mean(x[a:b])) ** 2 for v in x[a:b]) + penalty)
    return best[n]


def test_changepoints_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 0.1, rng.integers(2, 6)) for m in rng.integers(0, 4, 4)]).tolist()
        starts = changepoint.segments(x, [1.0] * len(x), 0.3)
        cost = sum(sum((v - np.mean(x[a:b])) ** 2 for v in x[a:b]) + 0.3 for a, b in zip(starts, [*starts[1:], len(x)], strict=True))
        assert abs(cost - brute_segments(x, 0.3)) < 1e-9


def test_a_feed_that_changes_its_unit_is_segmented(spark):
    rows = [("a", load, 700_000.0 * (1.02 ** (i % 5)) / (12 if load > 4 else 1)) for load in range(1, 9) for i in range(20)]
    hist = changepoint.history(spark.createDataFrame(rows + [("a", 3, None), (None, 3, 5.0), ("a", 3, -1.0)], "feed string, load_no int, v double"), "feed", "load_no", F.col("v"))
    got = [(r["first_load"], r["last_load"], r["unit_id"]) for r in changepoint.unit_segments(hist, {1: 1.0, 2: 12.0, 4: 1e5}, math.log10(710_000)).orderBy("first_load").collect()]
    assert got == [(1, 4, 1), (5, 8, 2)]


def test_segments_decide_what_a_feed_means(spark):
    """A feed that changes its unit is reversed by its segments; without them the declaration would stand for all its loads."""
    rows = [(f"{100 * f + 10 * load + i}", feed, load, str(round(700_000 * (1.02 ** (i % 5)) * (1.6 if load == 3 else 1.0) / (1e5 if feed == "b" and load > 4 else 1), 4))) for f, feed in enumerate("abcd") for load in range(1, 9) for i in range(10)]
    rows += [("n1", "b", None, "5"), ("n2", None, 7, "5"), ("n3", "new", 7, "5")]
    df = spark.createDataFrame(rows, "row_id string, feed string, load_no int, salary string").withColumn("unit_id", F.lit("clash"))
    u = spark.createDataFrame(UNITS, "unit_id int, field_name string, unit_name string, factor double")
    declared = spark.createDataFrame([(f, "salary", 1) for f in "abcd"], "feed string, field_name string, unit_id int")
    hist = changepoint.without_shared_shifts(changepoint.history(df, "feed", "load_no", F.col("salary").cast("double")))
    found = changepoint.unit_segments(hist, {x[0]: x[3] for x in UNITS[:5]}, math.log10(710_000), declared=declared.select(F.col("feed").alias("source"), "unit_id")).withColumnRenamed("source", "feed")
    assert sorted((r["feed"], r["first_load"], r["unit_id"], r["agrees"]) for r in found.collect() if r["feed"] in "abcd") == [("a", 1, 1, True), ("b", 1, 1, True), ("b", 5, 4, False), ("c", 1, 1, True), ("d", 1, 1, True)]
    without = {r["row_id"]: r["unit_id"] for r in units.with_unit(df, "salary", u, declared).collect()}
    got = {r["row_id"]: r["unit_id"] for r in units.with_unit(df, "salary", u, declared, history=found).collect()}
    changed = {k for k in got if got[k] != without[k]}
    assert changed == {r[0] for r in rows if r[1] == "b" and (r[2] or 0) > 4} | {"n3"} and {got[k] for k in changed} == {4} and set(without.values()) == {1}
    assert units.with_unit(df.limit(0), "salary", u, declared, history=found).count() == 0


def test_attaching_alike_for_small_and_large_sides(spark, monkeypatch):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("z", 2)], "k string, x int")
    side = spark.createDataFrame([("a", 7, "p"), ("b", 8, "q")], "_k string, y int, t string")
    small = sorted(map(str, hot.attach(df, side, {"k": "_k"}).collect()))
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 1)
    assert sorted(map(str, hot.attach(df, side, {"k": "_k"}).collect())) == small and len(small) == 52 and hot.attach(df, side.limit(0), {"k": "_k"}).filter("y is null").count() == 52


def test_exact_percentiles_match_interpolation(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.integers(0, 50, n).tolist() if k != "c" else rng.normal(0, 1, n).tolist() for k, n in (("a", 1), ("b", 999), ("c", 5000))}
    rows = [(k, float(v), 1) for k, vs in data.items() for v in vs] + [("d", None, 3), (None, 4.0, 2)]
    counts = spark.createDataFrame(rows, "k string, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {r["k"]: r for r in percentiles.exact_percentiles(counts, ["k"], "v", "n", {"p1": 0.01, "q1": 0.25, "m": 0.5, "p99": 0.99}).collect()}
    for k, vs in data.items():
        for name, p in (("p1", 1), ("q1", 25), ("m", 50), ("p99", 99)):
            assert abs(got[k][name] - np.percentile(vs, p)) < 1e-9
    assert "d" not in got and got[None]["m"] == 4.0


def test_deviating_loads(spark):
    rows = []
    for load in range(1, 8):
        for i in range(100):
            v = str(500 + i)
            if load == 2 and i % 3 == 1:
                v = "n/a"
            if load == 3 and i % 3 == 1:
                v = "text"
            if load == 4:
                v = str(500 + i % 20)
            if load == 5 and i % 8 == 5:
                v = "9999"
            if load == 6:
                v = str(900 + i)
            rows.append((load, v))
    df = spark.createDataFrame(rows, "load_no int, x string")
    got = {(r["load_no"], r["finding"]) for r in load_profile.deviating_loads(load_profile.value_counts(df, ["x"], "t")).collect()}
    assert {(2, "null_rate"), (3, "pattern"), (4, "distinct"), (5, "value_range"), (6, "distribution"), (6, "value_range")} <= got
    assert not any(load in (1, 7) for load, _ in got)
    assert load_profile.deviating_loads(load_profile.value_counts(df.limit(0), ["x"], "t")).count() == 0


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, "5"), (1, " ", "+7.5"), (2, "N/A", "x" * 100_000), (2, "a", "5")], "load_no int, value string, n string")
    got = {r["column_name"]: r for r in load_profile.column_profile(load_profile.value_counts(df, ["value", "n"], "t")).collect()}
    assert (got["value"]["n_missing"], got["value"]["n_distinct"], got["value"]["n_plain"]) == (3, 1, 0)
    assert (got["n"]["n_plain"], got["n"]["n_pattern"], got["n"]["max_number"], got["n"]["n_top"]) == (3, 1, 7.5, 2)


def test_drift_is_zero_for_equal_loads(spark):
    df = spark.createDataFrame([(load, str(i)) for load in (1, 2) for i in range(50)] + [(3, str(i + 40)) for i in range(50)], "load_no int, x string")
    got = {r["load_no"]: r["psi"] for r in load_profile.load_drift(load_profile.value_counts(df, ["x"], "t")).collect()}
    assert got[2] == 0.0 and got[3] > 0.5


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


ROWS = [(1, "a", 100.0, "x", at(0)), (2, "a", None, None, at(5)), (3, "a", 200.0, "y", at(10)), (4, "a", None, None, at(12)), (5, None, None, None, at(1)), (6, "b", None, "y", at(2)), (7, "b", None, None, None), (8, "c", 300.0, "y", at(3)), (9, "a", None, "x", at(5000))]


def filled(spark, rows, hot_rows):
    df = spark.createDataFrame(rows, "row_id int, who string, pay double, team string, seen timestamp").withColumn("_t", F.lit("clash"))
    cols = [neighbour_fill.FillColumn("pay", F.col("pay"), F.col("pay").isNull(), True), neighbour_fill.FillColumn("team", F.col("team"), is_missing(F.col("team")), False)]
    return {r["row_id"]: r for r in neighbour_fill.fill(df, [F.col("who")], F.col("seen"), "row_id", cols, F.lit("g"), 730.0, hot_rows).collect()}


@pytest.mark.parametrize("hot_rows", [1, 100_000])
def test_filling_alike_for_hot_and_other_entities(spark, hot_rows):
    got = filled(spark, ROWS, hot_rows)
    assert (got[2]["pay_filled"], got[2]["pay_method"], got[2]["pay_distance"]) == (150.0, "interpolated", 5.0)
    assert (got[2]["team_filled"], got[2]["team_method"]) == ("x", "carried")
    assert (got[4]["pay_filled"], got[4]["pay_method"], got[4]["pay_distance"]) == (200.0, "carried", 2.0)
    assert (got[5]["pay_method"], got[5]["pay_filled"]) == ("group", 200.0) and got[7]["team_method"] == "group"
    assert got[9]["pay_method"] == "group"  # the last value is older than the limit
    assert got[1]["pay_method"] is None and got[1]["pay_filled"] == 100.0 and len(got) == len(ROWS)


def test_filling_without_any_observation_and_empty(spark):
    got = filled(spark, [(1, "a", None, None, at(0))], 10)
    assert got[1]["pay_method"] == "none" and got[1]["pay_filled"] is None
    assert filled(spark, [], 10) == {}


def test_text_expressions(spark):
    df = spark.createDataFrame([("Straße-1 ", " N/A\t"), (None, "x"), ("STRASSE 1", "\xa0"), ("", None)], "a string, b string")
    got = df.select(letters_and_digits(F.col("a")).alias("k"), is_missing(F.col("b")).alias("m"), shape(F.lit("12.0 oz.")).alias("s"), title(F.lit("york-city o'neil")).alias("t")).collect()
    assert [r["k"] for r in got] == ["strasse1", "", "strasse1", ""] and [r["m"] for r in got] == [True, False, True, True]
    assert got[0]["s"] == "##.# aa." and got[0]["t"] == "york-city o'neil".title()
    assert statistics.median([1, 2]) == 1.5
