"""What p4_found no longer computes for every value and pair, held against the long way."""

import random
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rectifold import session
from rectifold.llm import canon, names
from rectifold.llm.similar import sounded, typing_distance


def typed(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t) + 1)
        t[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("aeiourstkz"), t[i - 1] if i else ""])
    return "".join(t)


def test_short_lists_need_no_deletes(monkeypatch):
    rng = random.Random(5)
    known = ["kestrapur", "marivelle", "dhalgarh", "ondrashem", "ub", "lo", "portofvelomir", "saintanneonthehill", "ambrolee", "anbrolee"]
    book = canon.Dictionary("city", [(i + 1, n, "kst|kestranagar" if not i else None) for i, n in enumerate(known)], {2: 9})
    values = [typed(rng, rng.choice(known), rng.randint(1, 5)) or "x" for _ in range(800)]
    inside = [book.near_ids(v) for v in values]
    for v, ids in zip(values, inside, strict=True):
        assert {i for i in range(len(book.names)) if book._meets(i, v, sounded(v))} >= ids
        for i, (name, _, _) in enumerate(book.names):
            assert canon._apart(v, name) <= typing_distance(v, name, 99.0) + 1e-9
            # beyond near_ids, which is empty where no name has a length in reach, lies nothing within the largest distance
            assert i in ids or not book._meets(i, v, sounded(v)) or min(typing_distance(v, name, 99.0), 0.3 + typing_distance(sounded(v), sounded(name), 99.0)) > canon._most(min(len(v), len(name)))
    made = []
    monkeypatch.setattr(canon, "_deletes", lambda s, d, f=canon._deletes: made.append(s) or f(s, d))
    got = [book._near(v) for v in values]
    assert not made and 200 < sum(g is not None for g in got)
    assert got == [min((k for i in ids if (k := book._near(v, [i]))), default=None) for v, ids in zip(values, inside, strict=True)]


def test_keys_of_pairs_are_those_of_the_index(spark):
    rng = random.Random(6)
    parts = ["Jim", "James", "Jon", "Ann", "Ng", "Lee", "Kingston", "Kinyston", "Kingsto", "Vatedigan", "Vatedigam", "Roe", "Aarav", "Smith-Otero", "Śliwa", "Liz", "Elizabeth", "Maximiliane"]
    texts = sorted({" ".join(rng.choices(parts, k=rng.choice([1, 2, 2, 2, 3, 4, 7, 9]))) for _ in range(150)})
    rows = [(i, t, i, i, 7, len(texts)) for i, t in enumerate(texts)]
    forms = spark.createDataFrame(rows, "_form bigint, _name string, _lo bigint, _hi bigint, _block bigint, _n bigint")
    keyed = names.with_keys(forms, "_name").select("_form", F.array_join("_w", " "), F.array_distinct("_sa"), "_single", names.index_keys(F.col("_w")))
    got = [(t, set(sa), single, set(keys)) for _, t, sa, single, keys in keyed.orderBy("_form").collect()]
    pairs = [(x, y) for i, x in enumerate(got) for y in got[i + 1 :]]
    told = [names.share_a_key(x[0], y[0]) for x, y in pairs]
    assert told == [bool(x[3] & y[3]) or ((x[2] or y[2]) and bool(x[1] & y[1])) for x, y in pairs]
    assert 300 < sum(told) < len(told) - 300


def test_no_dictionaries_for_values_that_hardly_repeat(spark):
    df = spark.range(300).select("id", F.lit("x").alias("same"), F.array(F.struct(F.xxhash64("id").alias("h"), F.lit(1).alias("n"))).alias("l"))
    out = session.written(df, ["id", "l.list.element.h"])
    assert sorted(out.collect()) == sorted(df.collect())
    coded = {}
    for part in Path(session.WRITTEN[-1].removeprefix("file:")).glob("*.parquet"):
        group = pq.ParquetFile(part).metadata.row_group(0)
        coded |= {c.path_in_schema: any("DICTIONARY" in e for e in c.encodings) for c in map(group.column, range(group.num_columns))}
    assert coded == {"id": False, "same": True, "l.list.element.h": False, "l.list.element.n": True}
