"""Fills containers of fixed capacity with items of varying length by sum-of-squares online packing.

Items are dealt by hash into groups of bounded size (the number of groups follows from the number of items). In a group every
item goes to the fill level that makes the sum of squared counts of partly filled containers smallest, tracked in an array
over levels. What each group leaves partly filled is packed again as whole pieces, in fewer groups, so leftovers do not add up with the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

GROUP_ITEMS = 50_000  # items that one task packs at a time
WELL_FILLED = 0.97  # containers below this share are packed again as pieces


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers of items of sizes 1..capacity, in order.

    N(h) counts open containers of level h. Moving an item of size s from level h to h+s changes the sum of squares by
    2 (N(h+s) - N(h)) + 2 for an open container, 2 N(s) + 1 for a new one, 1 - 2 N(h) where it fills up. Ties take the fullest level.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        top = capacity - s
        best, at = 2 * count[s] + 1 if s < capacity else 0, 0
        levels = np.flatnonzero(count[1 : top + 1]) + 1
        if len(levels):
            cost = 2 * (count[levels + s] - count[levels]) + 2
            if levels[-1] == top:
                cost[-1] = 1 - 2 * count[top]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                at = int(levels[k])
        if at:
            c = open_at[at].pop()
            count[at] -= 1
        else:
            c = used
            used += 1
        out[i] = c
        if at + s < capacity:
            open_at[at + s].append(c)
            count[at + s] += 1
    return out


ITEM = ["_i0", "_i1", "_i2"]  # what names an item exactly: document, part and 0, or round, group and container of a piece


def _grouped(items: DataFrame, capacity: int, salt: int, group_items: int) -> DataFrame:
    """items (ITEM, _size) with the container `_c` of their group `_g`."""
    n = items.count()
    groups = max(1, -(-n // group_items))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_mix", *ITEM], kind="stable").reset_index(drop=True)
        out = pdf[[*ITEM, "_size"]].copy()
        out["_g"], out["_c"] = key[0], pack(pdf["_size"].to_numpy(), capacity)
        return out

    mixed = items.select(*ITEM, "_size", F.xxhash64(F.lit(salt), *ITEM).alias("_mix"))
    mixed = mixed.withColumn("_g", F.pmod("_mix", F.lit(groups)))
    return mixed.groupBy("_g").applyInPandas(run, "_i0 bigint, _i1 bigint, _i2 bigint, _size int, _g bigint, _c bigint")


def fill_containers(docs: DataFrame, doc_id: str, size: str, capacity: int, rounds: int = 2, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, doc_id, part, start, length): every token of every item in one container, at most `capacity` a container.

    An item larger than the capacity is cut into full parts and a rest; no other is split. Items of size 0 or null need no container
    and have container_id null and one row. doc_id must be unique. The order of packing goes by a hash of doc_id, so the result depends
    neither on partitions nor on row order; pieces and containers meet by their exact names, never by a hash alone.
    """
    pieces = docs.select(F.col(doc_id).cast("bigint").alias("_doc"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("_n"))
    n_parts = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    pieces = checkpoint(pieces.withColumn("start", F.col("part") * capacity).withColumn("length", F.least(F.lit(capacity), F.col("_n") - F.col("start"))))
    big = lambda x: x.cast("bigint")
    left = pieces.filter((F.col("length") > 0) & (F.col("length") < capacity)).select(F.col("_doc").alias("_i0"), big(F.col("part")).alias("_i1"), big(F.lit(0)).alias("_i2"), F.col("length").alias("_size"))
    packed = checkpoint(_grouped(left, capacity, 0, group_items))
    home = packed.select(F.col("_i0").alias("_doc"), F.col("_i1").cast("int").alias("part"), big(F.lit(0)).alias("_k"), "_g", "_c")
    bins = packed.groupBy(big(F.lit(0)).alias("_i0"), F.col("_g").alias("_i1"), F.col("_c").alias("_i2")).agg(F.sum("_size").cast("int").alias("_size"))
    for k in range(1, rounds + 1):
        slack = checkpoint(bins.filter(F.col("_size") < WELL_FILLED * capacity))
        if slack.limit(2).count() < 2:
            break
        again = checkpoint(_grouped(slack, capacity, k, group_items))
        moved = again.select(F.col("_i0").alias("_k"), F.col("_i1").alias("_g"), F.col("_i2").alias("_c"), F.col("_g").alias("_ng"), F.col("_c").alias("_nc"))
        home = home.join(moved, ["_k", "_g", "_c"], "left").select("_doc", "part", F.when(F.col("_nc").isNotNull(), k).otherwise(F.col("_k")).cast("bigint").alias("_k"), F.coalesce("_ng", "_g").alias("_g"), F.coalesce("_nc", "_c").alias("_c"))
        bins = again.groupBy(big(F.lit(k)).alias("_i0"), F.col("_g").alias("_i1"), F.col("_c").alias("_i2")).agg(F.sum("_size").cast("int").alias("_size"))
    named = home.select("_doc", "part", F.concat_ws(":", F.lit("c"), "_k", "_g", "_c").alias("_in"))
    whole = F.when(F.col("length") == capacity, F.concat_ws(":", F.lit("w"), "_doc", "part"))
    return pieces.join(named, ["_doc", "part"], "left").select(F.coalesce("_in", whole).alias("container_id"), F.col("_doc").alias(doc_id), "part", "start", "length")


def filling(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the share of unused space."""
    used = packed.filter(F.col("container_id").isNotNull())
    bins = used.groupBy("container_id").agg(F.sum("length").alias("n"))
    total = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))

