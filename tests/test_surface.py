"""Detectors, cleaning, scores, interactive operators, sources, export and streams on small frames."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rectifold.config import Config, load_config
from rectifold.functions.similarity import ratio
from rectifold.operators import assist, clean, corrupt, detect, engine, export, interactive, mlutility, quality, rules
from rectifold.operators.values import ROW
from rectifold.sources import delimited
from rectifold.streaming import frozen

CFG = Config()


def typed(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} bigint, {schema}")


def test_detectors(spark):
    df = typed(spark, "Age double, Percentage double, City string", [(25.0, 50.0, "Mumbai"), (-5.0, -10.0, "Mumbai"), (140.0, 105.0, "mumbai"), (30.0, 90.0, " Mumbai"), (31.0, 1.0, "Mumabi"), (32.0, 1.0, None), (33.0, 1.0, "unknown")])
    kinds = {(r["issue_type"], r["row"]) for r in detect.detect_all(df, CFG).collect()}
    assert {("invalid_range", 1), ("invalid_range", 2), ("casing_inconsistency", 2), ("whitespace_inconsistency", 3), ("spelling_typo", 4), ("missing_value", 5)} <= kinds
    d = typed(spark, "Join_Date string", [("2024-01-15",), ("22/13/2020",), ("2025-02-30",), ("2023-08-19",)])
    assert sorted(r["row"] for r in detect.dates(d).collect()) == [1, 2]
    dup = typed(spark, "a string, b string", [("1", None), ("2", "x"), ("1", None), ("2", "y")])
    assert [(r["row"], r["suggested_value"]) for r in detect.exact_duplicates(dup).collect()] == [(2, "0")]
    out = typed(spark, "salary double", [(50000.0 + 100 * i,) for i in range(30)] + [(1500000.0,)])
    assert [r["row"] for r in detect.outliers(out, CFG).collect()] == [30]
    assert detect.detect_all(df.limit(0), CFG).filter("row is not null").count() == 0


def test_near_duplicates_match_brute_force(spark):
    names = [f"alpha beta gamma {i % 13} delta" for i in range(120)] + [f"gamma alpha beta {i} delta x" for i in range(40)]
    df = typed(spark, "t string, u string", [(n, str(i)) for i, n in enumerate(names)])
    sig = [" | ".join((n, str(i))).lower() for i, n in enumerate(names)]
    srt = [" ".join(sorted(s.split())) for s in sig]
    want = {(a, b) for a in range(len(sig)) for b in range(a + 1, min(len(sig), a + 50)) if 90 <= ratio(srt[a], srt[b]) < 100}
    got = {(int(r["suggested_value"]), r["row"]) for r in detect.near_duplicates(df, CFG).collect()}
    assert got == want and want


def test_cleaning_pipeline(spark):
    df = typed(spark, "Name string, Age string, City string", [("A", "25", "Mumbai"), ("B", "Thirty", "mumbai"), ("C", "40", "Mumbai"), ("A", "25", "Mumbai")])
    corrections = spark.createDataFrame([(1, "Age", "30")], "row int, column string, value string")
    out, audit = clean.clean_pipeline(df, CFG, corrections)
    got = {r[ROW]: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2] and got[1]["Age"] == 30.0 and got[1]["City"] == "Mumbai"
    assert audit.filter("action = 'row_removed'").count() == 1


def test_knn_and_fill_and_validation(spark):
    df = typed(spark, "a double, b double", [(1.0, 10.0), (1.1, 11.0), (5.0, 50.0), (1.05, None)])
    got = {r[ROW]: r["b"] for r in clean.knn_impute(df, ["a", "b"], 2).collect()}
    assert got[3] == 10.5 and got[0] == 10.0
    t = typed(spark, "v string", [(None,), ("2",), ("",), ("4",), ("nan",)])
    f = lambda how: [r["v"] for r in clean.fill_blanks(t, "v", how).orderBy(ROW).collect()]
    assert f("ffill") == [None, "2", "2", "4", "4"] and f("bfill") == ["2", "2", "4", "4", "nan"] and f("mean")[0] == "3.0"
    assert clean.validate_correction("Join_Date", "25/12/2020") == (True, "2020-12-25") and not clean.validate_correction("Age", "140")[0]


def test_metrics_by_hand(spark):
    mk = lambda rows: typed(spark, "v string", [(x,) for x in rows])
    m = engine.cell_metrics(mk(["x", "y", "z", "1", "2"]), mk(["a", "b", "c", "1", "2"]), mk(["a", "q", "z", "1", "9"])).first()
    assert (m["errors"], m["changed"], m["fixed"], m["damaged"], m["harm"]) == (3, 3, 1, 1, 50.0)
    assert engine.cell_metrics(mk(["1.0"]), mk(["1"]), mk(["1.0"]), tolerant=True).first()["errors"] == 0
    q = quality.quality_score(mk(["a", "b", "", "a"])).first()
    assert q["completeness"] == 75.0 and q["uniqueness"] == 75.0


def test_corruption_is_reproducible_and_recorded(spark):
    df = typed(spark, "city string, n string", [("Kestrapur", str(i)) for i in range(200)])
    rates = {"missing_value": 0.1, "spelling_typo": 0.1, "outlier": 0.1}
    a, truth = corrupt.inject(df, rates, 7, duplicates=0.05, traps=True)
    b, _ = corrupt.inject(df.repartition(5), rates, 7, duplicates=0.05, traps=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    cells = {(r["row"], r["column"]): r["corrupted_value"] for r in truth.filter("column <> '__all__'").collect()}
    for r in a.filter(f"{ROW} < 200").collect():
        for c in ("city", "n"):
            assert (r[c] != {"city": "Kestrapur", "n": str(r[ROW])}[c]) == ((r[ROW], c) in cells)


def test_formulas(spark):
    df = typed(spark, "Quantity string, `Unit Price` string, first string, Price string", [("2", "10", "Ann", "10.34"), ("5", "20", "Bo", "20.67"), ("x", "3", "", "")])
    total = [r["t"] for r in interactive.apply_formula(df, "t", "Quantity * Unit_Price").orderBy(ROW).collect()]
    assert total == ["20", "100", ""]
    assert [r["t"] for r in interactive.apply_formula(df, "t", "first + ' ' + Quantity_str").orderBy(ROW).collect()] == ["Ann 2", "Bo 5", " x"]
    assert [r["p"] for r in interactive.apply_formula(df, "p", "np.round(Price * 1.08, 2)").orderBy(ROW).collect()][:2] == ["11.17", "22.32"]
    for bad in ("__import__('os')", "Quantity.__class__", "nope + 1", "(lambda: 1)()", "[x for x in 'a']", "Quantity +"):
        with pytest.raises(interactive.FormulaError):
            interactive.compile_formula(bad, ["Quantity"], {"Quantity"})
    n = typed(spark, "a int, b int", [(-7, 3), (7, -3), (7, 0)])
    f = interactive.compile_formula("a // b", ["a", "b"], {"a", "b"})
    assert [r[0] for r in n.select(f).collect()] == [-3, -3, None]


def test_scopes_and_words(spark):
    df = typed(spark, "Total string", [("100",), ("-15",), ("50",), ("",)])
    pick = lambda **k: [r[ROW] for r in df.filter(interactive.scope(df, **k)).collect()]
    assert pick(how="range", first=1, last=2) == [1, 2] and pick(how="list", rows="0;3") == [0, 3] and pick(how="blank", column="Total") == [3] and pick(how="condition", condition="Total > 0") == [0, 2]
    assert [r[ROW] for r in interactive.rule_violations(df, "Total must be positive").collect()] == [1]
    assert [r[ROW] for r in interactive.rule_violations(df, "Total is not empty").collect()] == [3]
    assert interactive.rule_violations(df, "whatever").count() == 0
    t = spark.range(1).select(interactive.century(F.lit("12/05/1894")), interactive.leet(F.lit("r0b3rt")))
    assert tuple(t.first()) == ("12/05/1994", "Robert")


def test_loading(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id, code,val\n00145,NA,12.0\n00146, null,"a ""b""\nc"\n00147,,\n')
    rows = [tuple(r) for r in delimited.load_table(spark, str(p)).collect()]
    assert rows == [("00145", "NA", "12.0"), ("00146", "null", 'a "b"\nc'), ("00147", "", "")]
    assert delimited.sniff('"a";"b"\n1;2\n') == (";", 0) and delimited.sniff("39, State-gov, 77516\n50, Private, 83311\n") == (",", None) and delimited.sniff("a,b\nc,d\n") == (",", 0)
    assert [tuple(r) for r in delimited.load_table(spark, b"a|b\nx|1\n").collect()] == [("x", "1")]
    with pytest.raises(ValueError):
        delimited.load_dataset(spark, "x.parquet")
    delimited.save_table(spark.createDataFrame([("a", "")], "x string, y string"), str(tmp_path / "o"), one_file=True)
    assert delimited.load_table(spark, str(tmp_path / "o")).first()["y"] == ""


def test_exported_script_equals_engine(spark, tmp_path):
    rows = [("1", "94101", "SF", "x"), ("2", "94101", "sf", "N/A"), ("3", "94101", "SF", "x"), ("4", "94101", "SF ", "x"), ("5", "10001", "NY", "y"), ("5", "10001", "NY", "y")] + [(str(i), "94101", "SF", "x") for i in range(6, 12)]
    src = tmp_path / "in.csv"
    src.write_text("\n".join(",".join(r) for r in [("id", "zip", "city", "m"), *rows]) + "\n")
    df = delimited.load_table(spark, str(src))
    p = engine.propose(df)
    ok = engine.approve(p.proposals, ("AUTO", "REVIEW"))
    a = engine.apply(p, ok)
    script = tmp_path / "s.py"
    script.write_text(export.script(p, ok, a))
    subprocess.run([sys.executable, str(script), str(src), str(tmp_path / "out")], check=True, capture_output=True, timeout=300)
    got = [tuple(r) for r in delimited.load_table(spark, str(tmp_path / "out")).collect()]
    want = [tuple(r)[1:] for r in a.clean.orderBy(ROW).collect()]
    assert sorted(got) == sorted(want)


def test_reports_config_and_assistants(spark, tmp_path):
    actions = spark.createDataFrame([(1, "a", "x", "y", "cell_changed"), (2, "__all__", None, None, "row_removed")], "row int, column string, original_value string, new_value string, action string")
    assert delimited.audit_report(actions, str(tmp_path / "log"))["actions_by_type"] == {"cell_changed": 1, "row_removed": 1}
    assert "<b>" not in delimited.html_report("<b>", {"score": 1.0}, {"score": 2.0}, actions) and "+1.00" in delimited.html_report("t", {"score": 1.0}, {"score": 2.0}, actions)
    (tmp_path / "c.yaml").write_text("routing:\n  auto_threshold: 0.9\ndomain_rules:\n  height:\n    min: 0\n    max: 3\n")
    cfg = load_config(str(tmp_path / "c.yaml"))
    assert cfg.auto_threshold == 0.9 and cfg.domain_rules["height"] == (0, 3) and load_config("none.yaml").suggest_threshold == 0.70

    class Fake(assist.Offline):
        def available(self):
            return True

        def ask_json(self, prompt):
            return {"HR": "Human Resources", "same": True, "confidence": 1.0, "new": "x"}

    assert not assist.same_entity("a", "b") and assist.same_entity("a", "b", Fake())
    t = rules.learn(typed(spark, "d string", [("HR",)] * 6 + [("Sales",)] * 3 + [("IT",)] * 3 + [("Ops",)] * 3))
    got = assist.vocabulary_proposals(t, assist.ask_vocabulary(Fake()))
    assert [(p.id, p.n_cells) for p in got] == [("R9_semantic_vocab_d", 6)]
    assert assist.enrich([{"issue_type": "t", "correction_confidence": 0.9}], Fake())[0]["correction_confidence"] == 0.94
    assert "worsened" in assist.explain_shift("rmse", 1.0, 2.0) and json.loads(json.dumps(assist.domain_rules(["Customer_Age"])))
    filled = assist.impute_rows(spark.createDataFrame([("a", None), ("b", "y")], "k string, v string"), "v", lambda row: row["k"] + "!").collect()
    assert [r["v"] for r in filled] == ["a!", "y"]


def test_utility_models_and_target(spark):
    df = typed(spark, "x double, c string, label string", [(float(i % 10), "abc"[i % 3], "hi" if i % 10 > 4 else "lo") for i in range(200)])
    assert mlutility.infer_target(df) == "label"
    got = {(r["model"], r["metric"]): r["value"] for r in mlutility.utility({"truth": df, "dirty": df.withColumn("x", F.lit(1.0))}, "truth", trees=5, depth=4).collect()}
    assert got["truth", "accuracy"] > 0.95 > got["dirty", "accuracy"]


def test_frozen_plan_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("N/A",), ("x",)], "v string").write.parquet(str(tmp_path / "in"))
    run = frozen.frozen_edits({"v": [lambda c: F.when(F.lower(c) == "n/a", F.lit(""))]})
    got = []
    q = frozen.start(run(spark.readStream.schema("v string").parquet(str(tmp_path / "in"))), lambda df, _: got.extend(r["v"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == ["", "x"]
