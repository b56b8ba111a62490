"""The rules on small in-line frames with known proposals, tiers and values, and invariants of application."""

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from rectifold.operators import engine, profile, rules
from rectifold.operators.values import ROW, as_text, value_counts, with_row_id


def frame(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} bigint, " + ", ".join(f"`{c}` string" for c in columns))


def run(spark, columns, rows, *rule_list):
    t = rules.learn(frame(spark, columns, rows))
    out = []
    for r in rule_list:
        got = r(t)
        t.hit(got)
        out += got
    return engine.Proposed(t, rules.numbered(out))


def cells(p):
    return {(r[ROW], r["column"]): r["new_value"] for r in p.changes().collect()}


def tiers(p):
    return {x.id: x.tier for x in p.proposals}


def test_missing_tokens_tiers(spark):
    vals = ["NA"] * 2 + ["n/a"] * 10 + ["   "] + ["ok"] * 87
    p = run(spark, ["c"], [(v,) for v in vals], rules.r1_missing)
    assert tiers(p) == {"R1_missing_trim_c": "AUTO", "R1_missing_c_NA": "AUTO", "R1_missing_c_n_a": "REVIEW"}
    assert len(cells(p)) == 13 and set(cells(p).values()) == {""}
    assert tiers(run(spark, ["c"], [("NA",), ("NA",), ("NaN",)], rules.r1_missing))["R1_missing_c_NA"] == "REVIEW"


def test_units_of_one_column(spark):
    vals = ["12.0 oz", "12.0 oz.", "16.0 ounce", "12.0 OZ.", "8 fl oz", "12.0 oz. Alumi-Tek", "16.0 oz. Silo Can", "12"]
    p = run(spark, ["ounces"], [(v,) for v in vals], rules.r2_numeric)
    assert tiers(p) == {"R2_numeric_canonical_ounces": "AUTO", "R2_numeric_descriptor_ounces": "REVIEW"}
    got = cells(p)
    assert got[0, "ounces"] == "12.0" and got[5, "ounces"] == "12.0" and (7, "ounces") not in got


def test_percent_and_street_and_dominant_unit(spark):
    p = run(spark, ["rate"], [(v,) for v in ["0.05", "0.06", "0.07", "0.04", "0.09%", "0.08%"]], rules.r2_numeric)
    assert tiers(p) == {"R2_numeric_scale_rate": "REVIEW"} and cells(p)[4, "rate"] == "0.09"
    assert not run(spark, ["a"], [(f"{i} Main Street",) for i in range(8)], rules.r2_numeric).proposals
    p = run(spark, ["d"], [(f"{i} min",) for i in range(95)] + [("100 min.",), ("90",), ("120 mins",)], rules.r2_numeric)
    assert cells(p) == {(95, "d"): "100 min", (97, "d"): "120 min"}
    # four digits without commas are no number of this rule
    assert not run(spark, ["y"], [(f"${i}",) for i in range(2000, 2010)], rules.r2_numeric).proposals


def test_case_and_spaces(spark):
    rows = [("Female", "MI")] * 3 + [("female", "IN"), (" Male ", "OR"), ("Male", "mi")]
    got = cells(run(spark, ["gender", "state"], rows, rules.r3_whitespace_case))
    assert got[3, "gender"] == "Female" and got[4, "gender"] == "Male" and got[5, "state"] == "MI"
    got = cells(run(spark, ["t"], [("a  big   deal",), ("a big deal",), ("lonely  pair",)], rules.r3_whitespace_case))
    assert got == {(0, "t"): "a big deal"}


@pytest.mark.parametrize("vals,kind", [(["25/01/2021", "26/01/2021", "05/03/2021", "07/04/2021", "08/05/2021", "09/06/2021"], "AUTO"), (["05/01/2021", "06/01/2021", "05/03/2021", "07/04/2021", "08/05/2021"], "FLAG"), (["2021-01-05"] * 6, None), (["2021/01/05"] * 6, None)])
def test_dates(spark, vals, kind):
    p = run(spark, ["d"], [(v,) for v in vals], rules.r4_dates)
    assert [x.tier for x in p.proposals] == ([kind] if kind else [])
    if kind == "AUTO":
        assert cells(p)[0, "d"] == "2021-01-25" and cells(p)[2, "d"] == "2021-03-05"


def test_compound_split_fills_blanks_only(spark):
    rows = [("San Diego CA", "")] * 3 + [("Austin TX", "TX")] * 3 + [("Albany NY", "NY")] * 4 + [("Boston", "CA")] * 3 + [("Reno CA", "TX")]
    got = cells(run(spark, ["city", "state"], rows, rules.r5_compound_split))
    assert got[0, "city"] == "San Diego" and got[0, "state"] == "CA" and got[3, "city"] == "Austin" and (13, "city") not in got


def test_dependency_repair_and_fill(spark):
    rows = [("94101", "SF")] * 18 + [("94101", "SFO"), ("94101", "")] + [("10001", "NY")] * 10
    p = run(spark, ["zip", "city"], rows, rules.r6_dependency_repair)
    assert cells(p)[18, "city"] == "SF" and cells(p)[19, "city"] == "SF"
    half = [("1", "a"), ("1", "b")] * 10
    assert not run(spark, ["k", "v"], half, rules.r6_dependency_repair).proposals


def test_category_variants(spark):
    p = run(spark, ["c"], [("Hospital",)] * 50 + [("Hospitl",)] + [("Clinic",)] * 20, rules.r7_category_variants)
    assert tiers(p) == {"R7_category_c_Hospitl": "REVIEW"} and cells(p) == {(50, "c"): "Hospital"}
    assert not run(spark, ["c"], [("male",)] * 98 + [("female",)] * 2, rules.r7_category_variants).proposals
    assert rules.near_miss("Wal Mart", "Walmart") == 1 and rules.near_miss("North Side", "South Side") is None


def test_repeats_and_reapplied_repeats(spark):
    p = run(spark, ["id", "v"], [("1", "a"), ("2", "b"), ("3", "c"), ("2", "b"), ("4", "d")], rules.r8_exact_duplicates)
    out = engine.apply(p, engine.approve(p.proposals, ("REVIEW",)))
    assert sorted(r[ROW] for r in out.clean.collect()) == [0, 1, 2, 4] and out.diff.first()["new_value"] == "DROPPED"


def test_validators_and_outliers(spark):
    rows = [(f"a{i}@b.com", str(50 + i % 5)) for i in range(20)] + [("no mail", "5000")]
    p = run(spark, ["m", "x"], rows, rules.validators, lambda t: rules.iqr_outliers(t)[0])
    assert tiers(p) == {"FLAG_validator_email_m": "FLAG", "FLAG_outliers_iqr_x": "FLAG"}
    assert not run(spark, ["ok"], [("yes",), ("no",)] * 10, rules.validators).proposals


def test_padded_cells_are_proposed_but_left(spark):
    p = run(spark, ["c"], [("Hospital",)] * 60 + [("Hospitl ",)] + [("Clinic",)] * 20, rules.r7_category_variants)
    assert len(cells(p)) == 1
    assert engine.apply(p, engine.approve(p.proposals, ("REVIEW",))).diff.count() == 0


def test_whole_engine_overrides_and_summary(spark):
    rows = [(f"u{i}", "NA" if i % 25 == 0 else "Kestrapur" if i % 2 else "Marivelle", str(20 + i % 40)) for i in range(100)]
    df = frame(spark, ["name", "city", "age"], rows)
    p = engine.propose(df)
    over = spark.createDataFrame([(1, "age", "30", 0), (1, "age", "31", 1), (2, "city", "Marivelle", 2)], "row int, column string, value string, seq int")
    out = engine.apply(p, engine.approve(p.proposals), over)
    got = {r[ROW]: r for r in out.clean.collect()}
    assert got[0]["city"] == "" and got[1]["age"] == "31" and len(got) == 100
    manual = out.diff.filter("rule_id = 'MANUAL_EDIT'").collect()
    assert [(r["row"], r["new_value"]) for r in manual] == [("1", "31")]
    s = engine.diff_summary(as_text(df), out.diff).first()
    assert s["total_cells"] == 300 and s["modified_cells"] == 5
    assert engine.side_by_side(as_text(df), out.clean, out.diff).count() == 5


def test_empty_and_tiny_tables(spark):
    for rows in ([], [("",)], [("x",)]):
        p = engine.propose(frame(spark, ["a"], rows))
        assert engine.apply(p, engine.approve(p.proposals)).clean.count() == len(rows)


def test_partitions_and_order_do_not_matter(spark):
    rows = [("Female" if i % 9 else "female", f"{i % 7} oz", "N/A" if i % 33 == 0 else "v") for i in range(120)]
    df = frame(spark, ["g", "u", "m"], rows)
    a = {(r["proposal_id"], r[ROW], r["new_value"]) for r in engine.propose(df.repartition(1)).changes().collect()}
    b = {(r["proposal_id"], r[ROW], r["new_value"]) for r in engine.propose(df.orderBy(F.desc(ROW)).repartition(7)).changes().collect()}
    assert a == b and a


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["NA", " x ", "X", "x", "12 oz", "", "25/01/2021"]), st.sampled_from(["a", "A ", "", "null", "b"])), min_size=5, max_size=25))
def test_untouched_cells_stay_byte_identical_and_cells_change_once(spark, rows):
    p = engine.propose(frame(spark, ["p", "q"], rows))
    out = engine.apply(p, engine.approve(p.proposals, ("AUTO", "REVIEW")))
    touched = [(int(r["row"]), r["column"]) for r in out.diff.filter("column <> '__ROW__'").collect()]
    assert len(touched) == len(set(touched))
    for r in out.clean.collect():
        for i, c in enumerate(("p", "q")):
            if (r[ROW], c) not in touched:
                assert r[c] == rows[r[ROW]][i]


def test_profile_numbers(spark):
    df = frame(spark, ["n"], [("10",), ("20",), ("30",), ("40",), ("N/A",)])
    vc = value_counts(as_text(df))
    assert profile.column_stats(vc).first()["numeric_parse_rate"] == 0.8
    assert profile.missing_tokens(vc).first()["token"] == "N/A"
    assert with_row_id(spark.createDataFrame([("a",), ("b",)], "x string")).orderBy(ROW).collect()[1][ROW] == 1


def test_safe_imputation_by_neighbours_and_by_median(spark):
    rows = [(str(i), str(2 * i), "yes") for i in range(10)] + [("", "9", "yes"), ("4", "n/a", ""), ("x", "8", "yes")]
    df = frame(spark, ["a", "b", "c"], rows)
    t = rules.learn(df)
    p = engine.Proposed(t, rules.numbered(rules.impute_safe(t)))
    assert {x.id: x.evidence for x in p.proposals if x.id.startswith("IMPUTE_num")} == {"IMPUTE_numeric_a": "method: nearest neighbours", "IMPUTE_numeric_b": "method: nearest neighbours"}
    got = cells(p)
    assert got[11, "b"] == "8" and got[11, "c"] == "yes" and 4 <= int(got[10, "a"]) <= 5
    t = rules.learn(df)
    p = engine.Proposed(t, rules.numbered(rules.impute_safe(t, knn_rows=5)))
    assert p.proposals[0].evidence == "method: median" and cells(p)[10, "a"] == "4"


def test_truth_words_count_as_equal(spark):
    mk = lambda v: frame(spark, ["v"], [(v,)])
    assert engine.cell_metrics(mk("yes"), mk("True"), mk("yes"), booleans=True).first()["errors"] == 0
    assert engine.cell_metrics(mk("yes"), mk("no"), mk("yes"), booleans=True).first()["errors"] == 1
