"""Pages of every event's roster."""

from pyspark.sql import functions as F

from quillroster.operators import views
from quillroster.plans import queries  # noqa: F401 - registers its queries
from quillroster.plans.registry import QUERIES


def test_every_event_has_its_pages(spark):
    e = spark.createDataFrame([(t, p, p != 3) for t, most in ((1, 25), (2, 4), (1001, 10)) for p in range(most)] + [(2, 1, True)], "tournament_id long, player_id long, active boolean")
    people = spark.createDataFrame([(p, f"n{50 - p}") for p in range(25)], "id long, full_name string")
    got = views.pages(views.rosters(e, people), ["tournament_id"], [F.asc("full_name"), F.asc("player_id")]).collect()
    want = set()
    for t, most in ((1, 25), (2, 4), (1001, 10)):
        own = [p for p in sorted(range(most), reverse=True) if p != 3]
        want |= {(t, p, k + 1, k // 10, k >= 10, len(own) > (k // 10 + 1) * 10) for k, p in enumerate(own)}
    assert {(r.tournament_id, r.player_id, r.place, r.page, r.has_previous, r.has_next) for r in got} == want and len(got) == len(want)


def test_query_reads_every_event(spark):
    folder = "/root/testdata/sf0.001"
    active = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag <> 'R'")
    assert QUERIES["c8_roster_pages"](spark, folder).select("tournament_id").distinct().count() == active.select("l_orderkey").distinct().count()
