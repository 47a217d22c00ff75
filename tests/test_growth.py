"""What must not grow with copies, hot keys or equal beginnings: counted, not timed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.operators import resolve
from quillroster.operators.patterns import name_index, unique_match


def test_equal_names_share_their_pieces(spark):
    one = spark.createDataFrame([(1, "Anna Bolt")], "id long, full_name string")
    many = spark.range(1, 201).selectExpr("id", "'Anna Bolt' AS full_name").coalesce(1)
    index = name_index(many, "full_name")
    assert index.count() == name_index(one, "full_name").count()
    # A small file is read by one task; what is made of it is not.
    assert index.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = spark.createDataFrame([("%bolt",), ("%",), ("_________",), ("%x%bolt",)], "probe string")
    assert unique_match(probes, many, ("full_name",)).count() == 0
    assert {r.probe: r.player_id for r in unique_match(probes, one, ("full_name",)).collect()} == {"%bolt": 1, "%": 1, "_________": 1}


def test_nearest_people_are_all_that_candidates_need(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ab ") for _ in range(n)).strip() or "a"
    words = [letters(rng.randint(1, 12)) for _ in range(60)] + ["common beginning " + letters(rng.randint(3, 12)) for _ in range(60)] + ["a longer common beginning " + letters(9) for _ in range(30)]
    people = spark.createDataFrame([(i, w.upper(), w) for i, w in enumerate(words + words[:20] + ["aab"] * 40)], "player_id long, full_name string, _norm string")
    asked = {w[:k] + rng.choice("abx") + w[k + rng.randint(0, 2) :] for w in words for k in [rng.randint(0, len(w))]} | {"AAB", ""}
    probes = spark.createDataFrame([(w, w.lower()) for w in sorted(asked)], "name string, norm string")
    every = resolve.within_distance(probes, people, "norm", "_norm", X.name_distance_limit(F.col("norm")))
    want = sorted(resolve.best_candidates(every).collect())
    assert sorted(resolve.best_candidates(resolve.nearest(probes, people)).collect()) == want and len(want) > 300


def test_names_that_begin_alike_meet_few(spark):
    people = spark.range(3000).selectExpr("format_string('supplier#%09d', id * 37) AS _person")
    asked = spark.range(100).selectExpr("format_string('supplier#%09dx', id * 37) AS _probe", "2 AS _pk")
    assert resolve._close(asked, people).distinct().count() < 20_000  # of 300,000


def test_pairs_of_one_large_group_are_made_in_many_tasks(spark):
    people = spark.range(5000).selectExpr("id", "'same' AS telegram_id").unionByName(spark.createDataFrame([(-1, "other"), (-2, "other"), (-3, None)], "id long, telegram_id string")).coalesce(1)
    pairs = resolve.identity_conflicts(people)
    made = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 5000 * 4999 + 2 and max(r["count"] for r in made) < 5000 * 4999
    assert pairs.where("id < 0").count() == 2


def test_notices_stage_their_payers(spark, tmp_path):
    from quillroster.operators import outbox

    spark.sql("SELECT 1L AS id, 7L AS player_id, 'a' AS payment_id, CAST(NULL AS BIGINT) AS paid_by_entry_id UNION ALL SELECT 2, 8, NULL, 1 UNION ALL SELECT 3, 9, 'b', NULL").write.parquet(f"{tmp_path}/e")
    people = spark.createDataFrame([(7, "x"), (8, None)], "id long, telegram_id string")
    found = outbox.notices(spark.read.parquet(f"{tmp_path}/e"), people, spark.createDataFrame([("a",), ("a",)], "payment_id string"), F.current_timestamp())
    assert sorted((r.payment_id, r.entry_id, r.kind, r.status) for r in found.collect()) == [("a", 1, "payer", "waiting"), ("a", 2, "partner", "no_chat")]
    # The payers are staged, so that the plan reads the entries themselves once more, for the partners.
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("paid_by_entry_id") == 1


def test_an_import_makes_its_tables_when_they_are_asked_for(spark, monkeypatch):
    from quillroster.operators import reconcile
    from quillroster.plans import flows

    labels, real = [], reconcile.staged
    monkeypatch.setattr(reconcile, "staged", lambda df, label: labels.append(label) or real(df, label))
    done = flows._imported(spark, "/root/testdata/sf0.001")
    new = done.counters.first()["entries_new"]
    assert new > 0 and "changes" in labels and not {"entries", "pending", "pending_entries", "archived"} & set(labels)
    assert done.tables["entries"].where("first_seen_in_source IS NOT NULL").count() == new and set(done.tables) >= {"tournaments", "players", "pending_entries"}
    assert labels.count("entries") == 1  # once, however often they are read
