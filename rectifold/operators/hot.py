"""Hot keys: found exactly from partial counts, bounded in number, so that they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT_KEYS = 4096
SALTS = 64
BROADCAST_ROWS = 20_000  # rows a side may have to be broadcast
BROADCAST_CHARS = 8_000_000  # and the text they may hold


def hot_keys(df: DataFrame, keys: list[str], min_rows: int, total: int | None = None) -> DataFrame:
    """Keys with at least max(min_rows, rows / MAX_HOT_KEYS) rows, and their exact number `n_rows`.

    There are at most MAX_HOT_KEYS of them at any size of df, which bounds a broadcast of the result. The count combines
    on the map side, so a key that holds a third of all rows costs one row per task.
    """
    total = df.count() if total is None else total
    least = max(min_rows, -(-total // MAX_HOT_KEYS))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)


def first_of_groups(keyed: DataFrame, keys: list[str], row_id: str, min_rows: int = 100_000, total: int | None = None) -> DataFrame:
    """(row_id, first): the smallest row id among the rows of equal keys, for every row.

    Rows of hot keys are salted: a minimum per salt, a minimum of those, sent back by a broadcast of at most MAX_HOT_KEYS rows, so they
    meet in no task. All other rows take one shuffle and a window.
    """
    keyed = keyed.select(F.col(row_id).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    own, other = [f"_k{i}" for i in range(len(keys))], [f"_h{i}" for i in range(len(keys))]
    hot = hot_keys(keyed.select(*own), own, min_rows, total).select(*[F.col(k).alias(h) for k, h in zip(own, other, strict=True)])
    same = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(own, other, strict=True)]
    cold = keyed.join(F.broadcast(hot), same, "left_anti").select("_id", F.min("_id").over(Window.partitionBy(*own)).alias("_first"))
    heavy = keyed.join(F.broadcast(hot), same, "left_semi")
    salted = heavy.groupBy(*own, F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")).agg(F.min("_id").alias("_m"))
    firsts = salted.groupBy(*[F.col(k).alias(h) for k, h in zip(own, other, strict=True)]).agg(F.min("_m").alias("_first"))
    heavy = heavy.join(F.broadcast(firsts), same).select("_id", "_first")
    return cold.unionByName(heavy).select(F.col("_id").alias(row_id), F.col("_first").alias("first"))


def attach(df: DataFrame, side: DataFrame, keys: dict[str, str], null_safe: bool = False) -> DataFrame:
    """df with the columns of `side`, which has one row per key; keys: column of df -> column of side. Rows without a match keep nulls.

    A side within BROADCAST_ROWS and BROADCAST_CHARS, both counted, is broadcast. A larger one is repeated under SALTS salts and the rows of df are salted by
    all their key-free content, so a key that holds a third of all rows is spread over as many tasks. The hint keeps Spark from broadcasting
    the repeated side, whose size it estimates from the side's files, before it is repeated.
    """
    same = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in keys.items()]
    texts = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("bigint") for c, t in side.dtypes if t == "string"]
    size = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("bigint"))), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS:
        return df.join(F.broadcast(side), same, "left").drop(*keys.values())
    free = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in free]), F.lit(SALTS)).cast("int") if free else F.lit(0))
    spread = side.withColumn("__side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1 if free else 0))))
    return salted.join(spread.hint("merge"), [F.col("__salt") == F.col("__side"), *same], "left").drop("__salt", "__side", *keys.values())
