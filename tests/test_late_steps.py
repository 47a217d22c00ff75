"""Sessions as a stream: any split of shuffled steps into micro-batches gives what the fold gives; ties; one very large roster."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillroster.operators import views
from quillroster.streaming import sessions

SCHEMA = "telegram_id string, seq long, step string, support boolean"


def streamed(spark, folder, batches: list[list[tuple]], delay: str | None) -> dict:
    (folder / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    seen: dict = {}

    def keep(batch, number):
        seen.update({r.telegram_id: (r.state, r.support_mode) if r.open else None for r in batch.collect()})

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for number, rows in enumerate(batches):
        (folder / "in" / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("telegram_id", "seq", "step", "support"), r, strict=True))) for r in rows))
        query = sessions.session_stream(source, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return {k: v for k, v in seen.items() if v and k != "last"}


def fold(spark, steps: list[tuple]) -> dict:
    return {r.telegram_id: (r.state, r.support_mode) for r in sessions.fold_sessions(spark.createDataFrame(steps, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_steps_over_micro_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = [*sessions.STEPS, *sessions.ENDS[:1], "support", "support", "ask_name", "other"]
    steps = [(f"p{rng.randrange(25)}", rng.randrange(40), kind := rng.choice(kinds), rng.choice([True, False, None]) if kind == "support" else None) for _ in range(220)]
    want = fold(spark, steps)
    assert len(want) > 8
    batches: list[list] = [[] for _ in range(3)]
    for s in steps:
        rng.choice(batches).append(s)
    # The watermark is an hour behind, all steps lie within a minute; the last ones push it past them.
    assert streamed(spark, tmp_path, [*batches, [("last", 100_000, "ask_name", None)], [("last", 200_000, "ask_name", None), ("p1", 5, "ask_name", None)]], "1 hour") == want


def test_ties_in_one_micro_batch(spark, tmp_path):
    steps = [("a", 1, "support", None), ("a", 1, "support", True), ("b", 1, "ask_name", None), ("b", 2, "linked", None), ("b", 2, "support", True), ("c", 3, "pick_date", None), ("c", 3, "support", False), ("d", 4, "support", True), ("d", 5, "support", None), (None, 1, "ask_name", None), ("e", None, "ask_name", None), ("f", -1, "ask_name", None)]
    assert streamed(spark, tmp_path, [steps], None) == fold(spark, steps) == {"a": (None, True), "c": ("bind_pick_date", False), "d": (None, False)}


def test_pages_of_one_large_roster(spark):
    rows = spark.range(5000).select((F.when(F.col("id") % 50 == 0, F.col("id") % 7)).alias("event"), F.md5(F.col("id").cast("string")).alias("name"))
    got = views.pages(rows, ["event"], [F.col("name")]).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.event, []).append(r)
    assert len(by[None]) == 4900 and sum(map(len, by.values())) == 5000
    for own in by.values():
        own.sort(key=lambda r: r.place)
        assert [r.name for r in own] == sorted(r.name for r in own) and [r.place for r in own] == list(range(1, len(own) + 1))
        last = (len(own) - 1) // views.PAGE
        assert all(r.page == (r.place - 1) // views.PAGE and r.has_previous == (r.page > 0) and r.has_next == (r.page < last) for r in own)
    two = views.pages(rows.withColumn("half", F.length("name") % 2), ["event", "half"], [F.col("name")])
    assert two.columns[:3] == ["event", "name", "half"] and two.count() == 5000
