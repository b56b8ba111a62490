"""Keys of names: only what every form needs is kept with it, the rest is made for pairs that share a suffix."""

import random

from pyspark.sql import functions as F

from rectifold.llm import names


def test_ends_are_left_to_pairs_and_no_pair_is_lost(spark):
    rng = random.Random(3)
    first, last = ["Jim", "James", "Jon", "Marianela", "Velomir", "Ann", "J", "Ravi Kumar"], ["Kingston", "Kinyston", "Vatedigan", "Vatedigam", "Lee", "Plastics Ltd", "Smith-Otero"]
    texts = sorted({f"{rng.choice(first)} {rng.choice(last)}{rng.choice(['', '', ' Roe', 's'])}" for _ in range(60)}) + ["Kingston", "J"]
    rows = [(i, t, i, i, 7, len(texts)) for i, t in enumerate(texts)]
    forms = spark.createDataFrame(rows, "_form bigint, _name string, _lo bigint, _hi bigint, _block bigint, _n bigint")
    packed = names.packs(forms, 64)
    assert set(packed.schema["_fs"].dataType.elementType.names) == {*names.SIDE, "_single", "_bits", "_sa", "_w"}
    pairs = lambda tile: {tuple(r) for r in names.candidate_pairs(names.packs(forms, tile), tile).select("a_form", "b_form", "a_name", "b_name").collect()}
    local = pairs(64)
    assert local == pairs(4) and 100 < len(local) < len(texts) * (len(texts) - 1) / 2
    assert all(a < b and texts[a] == x and texts[b] == y for a, b, x, y in local)
    keys = names.with_keys(forms, "_name").select("_form", F.explode("_sa").alias("k"))
    sharing = {tuple(r) for r in keys.alias("x").join(keys.alias("y"), F.expr("x.k = y.k and x._form < y._form")).select("x._form", "y._form").distinct().collect()}
    assert {p[:2] for p in local} <= sharing
