"""Short ways of the linking of names give the same answers as the long ones."""

import random

from pyspark.sql import functions as F

from rectifold.llm import canon, names


def test_names_are_ruled_out_by_letters_without_loss(monkeypatch):
    """With few names their letters are compared before any deletes are made, and a worse distance than the best one is not computed."""
    rng = random.Random(4)
    known = ["Kestrapur", "Marivelle", "Dhalgarh", "Ondrashem", "Ambrolee", "Rastibad North", "Ub", "Lo", "Port of Velomir", "Saint Anne on the Hill"]
    entries = [(i + 1, n, "Kst|Kestra Nagar" if not i else None) for i, n in enumerate(known)]
    typed = ["", "none of them", "Kest.", "Rastibad", "Kst", "Kts", "Quyzwq Fjxczk"]
    for _ in range(600):
        t = list(rng.choice(known))
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("aeiourstkz"), "  "])
        typed.append("".join(t))
    made = []
    monkeypatch.setattr(canon, "_deletes", lambda s, d, f=canon._deletes: made.append(s) or f(s, d))
    book = canon.Dictionary("city", entries, {1: 5})
    made.clear()
    assert book.find("Quyzwq Fjxczk") == 0 and not made  # its letters are enough
    got = [book.ranked(t) for t in typed]
    monkeypatch.setattr(canon, "SCANNED", 0)
    book = canon.Dictionary("city", entries, {1: 5})
    assert [book.ranked(t) for t in typed] == got and 200 < sum(a[0] == 1 for a in got)
    every = range(len(book.names))
    for t in typed:
        joined = canon.plain(t).replace(" ", "")
        if joined:
            each = [k for i in every if (k := book._near(joined, [i])) and i in book.near_ids(joined)]
            assert book._near(joined) == min(each, default=None), t


def test_days_alike_by_either_way(spark):
    rows = ["2020-01-05", "2020/1/5", " 2020-01-05", "5.1.2020", "05-01-20", "2020-01-05\n", "N/A", None, "Soon", "2020-13-45"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string").orderBy("i").select(names.day(F.col("d"))).collect()]
    assert got == ["2020-01-05", "2020-1-5", "2020-01-05", "2020-1-5", "2020-01-05", "2020-01-05", None, None, "soon", "2020-13-45"]
