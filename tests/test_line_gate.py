"""Lines against an independent parser, and the defined edge cases."""

import datetime
import re

import pytest

from rectifold.sources import line_gate as g

SCHEMAS = {"customer_churn": g.CUSTOMER_CHURN, "car_data": g.CAR_DATA}
GOOD = "CUST_1,Ann,41,Kestrapur,2020-02-29,100.5,Sales,1"


def fields(s):
    s = (s or "").removesuffix("\r")
    out, i = [], 0
    while True:
        j = i
        while j < len(s) and s[j] in " \t":
            j += 1
        if j < len(s) and s[j] == '"':
            k, buf = j + 1, ""
            while True:
                m = s.find('"', k)
                if m < 0:
                    return None
                buf += s[k:m]
                if s[m : m + 2] == '""':
                    buf, k = buf + '"', m + 2
                    continue
                k = m + 1
                break
            while k < len(s) and s[k] in " \t":
                k += 1
            if k < len(s) and s[k] != ",":
                return None
            out.append(buf.strip(" \t"))
            i = k
        else:
            m = s.find(",", i)
            m = len(s) if m < 0 else m
            if '"' in s[i:m]:
                return None
            out.append(s[i:m].strip(" \t"))
            i = m
        if i >= len(s):
            return out
        i += 1


def valid(f):
    number = lambda x: x == "" or re.fullmatch(r"[0-9]+(\.[0-9]+)?", x)
    try:
        day = f[4] == "" or bool(re.fullmatch(r"\d{4}-\d\d-\d\d", f[4]) and datetime.date.fromisoformat(f[4]))
    except ValueError:
        day = False
    return bool(re.fullmatch(r"CUST_[0-9]+", f[0]) and (f[2] == "" or (f[2].isdigit() and int(f[2]) <= 120)) and day and number(f[5]) and f[7] in ("0", "1"))


LINES = [
    GOOD, GOOD + "\r", "", None, ",,,,,,,", '"CUST_2", "B ""x"", y" ,,"Mar,ivelle","","" ,,0', '"CUST_3,Ann,41,a,2020-01-01,1,Sales,1', 'CUST_4,"Ann"-,41,a,2020-01-01,1,Sales,1', 'CUST_5,An"n,41,a,2020-01-01,1,Sales,1',
    "CUST_6,Ann,121,a,2020-01-01,1,Sales,1", "CUST_7,Ann,120,a,2021-02-29,1,Sales,1", "CUST_8,Ann,31.5,a,2020-01-01,1,Sales,1", "CUST_9,Ann,3,a,2020-01-01,-1,Sales,1", "cust_9,Ann,3,a,2020-01-01,1,Sales,1",
    "CUST_10|Ann|3", "CUST_11,Ann,3,a,2020-01-01,1,Sales,1,extra", "  CUST_12 ,Ann, 3 ,a, 2020-12-31 , 7 ,Sales, 1 ", 'CUST_13,"two\nlines",3,a,2000-02-29,1,Sales,1', "CUST_14,Ann,3,a,1900-02-29,1,Sales,1", "CUST_15,Ann,3,a,2020-01-01,1,Sales,2",
]


def test_reasons_match_an_independent_parser(spark):
    df = spark.createDataFrame([(i, "customer_churn", x, "clash") for i, x in enumerate(LINES)], "line_id int, feed_table string, raw_line string, reason string")
    got = {r["line_id"]: (r["reason"], r["bad_field"]) for r in g.set_apart(df, SCHEMAS).collect()}
    for i, x in enumerate(LINES):
        p = fields(x)
        want = "broken_quoting" if p is None else "wrong_column_count" if len(p) != 8 else None if valid(p) else "invalid_value"
        assert got.get(i, (None,))[0] == want, x
    assert got[9][1] == "age" and got[12][1] == "salary" and got[15 - 1][0] == "wrong_column_count" and got[14][1] is None


def test_loaded_rows_have_values_without_quotes(spark):
    df = spark.createDataFrame([(5, "customer_churn", LINES[5])], "line_id int, feed_table string, raw_line string")
    loaded, apart = g.split_lines(df, SCHEMAS)
    r = loaded["customer_churn"].first()
    assert (r["customer_id"], r["name"], r["city"], r["age"]) == ("CUST_2", 'B "x", y', "Mar,ivelle", None)
    assert apart.count() == 0 and loaded["car_data"].count() == 0


def test_car_names_need_a_letter_and_no_control_characters(spark):
    rest = ",2015,3.5,4.1,100,Petrol,Dealer,Manual,0"
    names = {"ok 14": None, "1234": "invalid_value", "b\x07ad": "invalid_value", "b�d": "invalid_value", '"two\nlines"': None, "": "invalid_value", '"sedan 14"" alloy"': None}
    df = spark.createDataFrame([(i, "car_data", n + rest) for i, n in enumerate(names)], "line_id int, feed_table string, raw_line string")
    got = {r["line_id"]: r["reason"] for r in g.set_apart(df, SCHEMAS).collect()}
    assert [got.get(i) for i in range(len(names))] == list(names.values())


def test_unknown_tables_empty_tables_and_very_long_lines(spark):
    schema = "line_id int, feed_table string, raw_line string"
    assert g.set_apart(spark.createDataFrame([], schema), SCHEMAS).count() == 0
    long_quotes = 'CUST_1,"' + '""' * 200_000 + '",3,a,2020-01-01,1,Sales,1'
    rows = [(1, "other", "x"), (2, None, "x"), (3, "customer_churn", long_quotes), (4, "customer_churn", "x" * 300_000)]
    got = {r["line_id"]: r["reason"] for r in g.set_apart(spark.createDataFrame(rows, schema), SCHEMAS).collect()}
    assert got == {1: "unknown_table", 2: "unknown_table", 4: "wrong_column_count"}


@pytest.mark.parametrize("day,ok", [("2024-02-29", True), ("2100-02-29", False), ("2000-02-29", True), ("2023-04-31", False), ("2023-12-31", True), ("2023-00-10", False)])
def test_calendar_pattern(day, ok):
    assert bool(re.fullmatch(g.DATE, day)) == ok
