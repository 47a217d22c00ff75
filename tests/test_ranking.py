"""Places in groups of any size, against plain sorting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillroster.operators.ranking import ranked


def test_places_and_totals(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.randint(0, 5000), i) for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g string, x int, id int").repartition(5), "g", [F.col("x"), F.col("id")]).collect()
    assert len(got) == len(rows)
    for group in {g for g, *_ in rows}:
        want = [i for _, _, i in sorted((r for r in rows if r[0] == group), key=lambda r: r[1:])]
        mine = sorted((r for r in got if r.g == group), key=lambda r: r._pos)
        assert [r.id for r in mine] == want and [r._pos for r in mine] == list(range(len(want))) and {r._total for r in mine} == {len(want)}


def test_one_group_ties_and_no_rows(spark):
    tied = spark.createDataFrame([(1,)] * 500 + [(2,)] * 3, "x int").repartition(4)
    got = ranked(tied, None, [F.col("x")]).collect()
    assert sorted(r._pos for r in got) == list(range(503)) and {r._pos for r in got if r.x == 2} == {500, 501, 502} and {r._total for r in got} == {503}
    assert ranked(tied.where("x = 9"), None, [F.col("x")]).count() == 0
