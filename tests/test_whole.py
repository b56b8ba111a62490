"""Operators do the whole job: cases beyond the places where they used to stop."""

import random

import pytest
from pyspark.sql import functions as F

from rectifold.config import Config
from rectifold.functions.similarity import close_pairs, ratio
from rectifold.operators import detect, mlutility, profile
from rectifold.operators.values import ROW

CFG = Config()


def typed(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} bigint, {schema}")


def test_close_pairs_equal_the_ratio():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé 漢") for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 130)))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts if t]
    for least in (50.0, 80.0, 90.0):
        want = {(i, j): ratio(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (a or b) and ratio(a, b) >= least}
        got = {(int(i), int(j)): s for i, j, s in zip(*close_pairs(texts, texts, least, True), strict=True) if texts[i] or texts[j]}
        assert got == want and want


def test_near_duplicates_of_all_rows(spark):
    rng = random.Random(1)
    names = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rng.choice((3, 4)))) for _ in range(1020)]
    names[1010] = names[3][:-1] + "z"  # far beyond 49 positions and the first 1,000 rows
    names[1019] = " ".join(reversed((names[900][:-1] + "z").split()))
    df = typed(spark, "t string", [(n,) for n in names])
    srt = [" ".join(sorted(n.split())) for n in names]
    want = {(a, b) for a in range(len(srt)) for b in range(a + 1, len(srt)) if abs(len(srt[a]) - len(srt[b])) < 8 and 90 <= ratio(srt[a], srt[b]) < 100}
    got = [(int(r["suggested_value"]), r["row"]) for r in detect.near_duplicates_all(df, CFG).collect()]
    assert {(3, 1010), (900, 1019)} <= want and sorted(got) == sorted(want)


def test_every_missing_cell_and_rare_row_is_reported(spark):
    df = spark.range(60_000).select(F.col("id").alias(ROW), F.when(F.col("id") % 10 == 0, "N/A").otherwise("x").alias("kind"), F.when(F.col("id") % 500 == 0, "rare").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cls"))
    assert detect.missing(df, CFG).count() == 6000
    assert detect.missing(df, CFG, 5000).count() == 5000
    assert detect.column_shapes(df).filter("issue_type = 'rare_category'").count() == 120
    assert detect.column_shapes(df, 25).filter("issue_type = 'rare_category'").count() == 25


def test_shapes_of_all_cells(spark):
    df = spark.range(6000).select(F.col("id").alias(ROW), F.when(F.col("id") < 5500, "ab1").otherwise("1-a").alias("v"))
    got = {r["shape"]: (r["n"], r["share"]) for r in profile.shapes(df).collect()}
    assert got == {"aa#": (5500, 5500 / 6000), "#-a": (500, 500 / 6000)}


def test_models_use_all_rows(spark):
    i = F.col("id")
    noise = i < 25_000  # rows beyond can be learned
    y = F.when(F.when(noise, F.pmod(F.xxhash64("id"), F.lit(2))).otherwise(i % 2) == 0, "a").otherwise("b")
    df = spark.range(50_000).select(i.alias(ROW), F.when(noise, -(i % 100).cast("double")).otherwise((i % 2 + 1).cast("double")).alias("x"), y.alias("y"))
    got = {r["metric"]: r["value"] for r in mlutility.utility({"truth": df}, "truth", "y", trees=3, depth=3).collect()}
    assert got["accuracy"] > 0.7
