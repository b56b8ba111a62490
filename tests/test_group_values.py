"""Values of many groups reach the rows without a broadcast that grows with the groups."""

from pyspark.sql import functions as F

from rectifold.operators import hot, neighbour_fill
from rectifold.session import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_side_is_not_broadcast(spark, monkeypatch):
    """Its files are below Spark's threshold; repeated under 64 salts it is far above."""
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 100)
    side = written(spark.range(2000).select(F.col("id").cast("string").alias("_k"), (F.col("id") * 2).alias("y")))
    df = spark.range(6000).select((F.col("id") % 3000).cast("string").alias("k"), "id")
    got = hot.attach(df, side, {"k": "_k"})
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)
    assert got.filter("y = 2 * (id % 3000)").count() == 4000 and got.filter("y is null").count() == 2000


def test_filling_alike_for_few_and_many_groups(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(900).select(
        i.alias("row_id"), F.concat(F.lit("w"), (i % 41).cast("string")).alias("who"), F.when(i % 5 > 0, (i % 7).cast("double")).alias("pay"),
        F.when(i % 4 > 0, F.concat(F.lit("t"), (i % 3).cast("string"))).alias("team"), F.when(i % 11 > 0, F.timestamp_seconds(i * 1_000_000)).alias("seen"), F.when(i % 13 > 0, (i % 90).cast("string")).alias("city"),
    )
    cols = [neighbour_fill.FillColumn("pay", F.col("pay"), F.when(F.col("row_id") != 3, F.col("pay").isNull()), True), neighbour_fill.FillColumn("team", F.col("team"), F.col("team").isNull(), False)]
    fill = lambda: neighbour_fill.fill(df, [F.col("who")], F.col("seen"), "row_id", cols, F.col("city"), hot_rows=22)
    few = sorted(map(str, fill().collect()))
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 10)
    many = fill()
    salted = [x for x in plan(many).split("\n") if "Join" in x and "__salt" in x]
    assert sorted(map(str, many.collect())) == few and len(few) == 900 and len({x.split("method='")[1][:5] for x in few if "method='" in x}) >= 3
    assert len(salted) == 1 and "SortMergeJoin" in salted[0]  # one join for all columns
