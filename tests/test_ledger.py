"""Payments over bucketed tables, their streams, versions of documents, and the passes over the queue."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillroster.operators import queue
from quillroster.sources import readers, schemas, sinks
from quillroster.sources.staging import shared_folder
from quillroster.streaming.payments import Ledger, apply_stream, once


def now():
    return F.lit("2026-01-10 12:00:00").cast("timestamp")


def table(spark, name, columns, rows):
    return schemas.conform(spark.createDataFrame(rows, columns), name)


@pytest.fixture
def ledger(spark, tmp_path):
    rows = [(1, 1, "p", "pair", 2, "pending"), (2, 2, None, "self", None, "pending"), (3, 3, "q", "self", None, "pending"), (4, 9, None, "self", None, "pending")] + [(k, 1, f"other{k}", "self", None, "pending") for k in range(10, 200)]
    made = Ledger(spark, str(tmp_path / "state"), buckets=16)
    people = table(spark, "players", "id long, full_name string, telegram_id string", [(1, "Ann", "11"), (2, "Ben", None), (3, "Cid", "33")])
    made.create(table(spark, "entries", "id long, player_id long, payment_id string, payment_scope string, paid_for_entry_id long, payment_status string", rows), people)
    return made


def event(spark, *payments):
    return spark.createDataFrame([("payment.succeeded", p, "10.00") for p in payments], "event string, payment_id string, amount_text string")


def files(ledger, name):
    top = f"{ledger.root}/{name}"
    return {d: sorted(f for f in os.listdir(f"{top}/{d}") if f.endswith(".parquet")) for d in os.listdir(top) if d.startswith("bucket=")}


def test_a_payment_rewrites_its_own_bucket_and_counts_once(spark, ledger):
    before = files(ledger, "entries")
    assert len(before) == 16
    paid, told = ledger.apply(event(spark, "q", "q"), now())
    after = files(ledger, "entries")
    assert [f"bucket={b}" for b in paid] == [d for d in before if before[d] != after[d]] and len(paid) == len(told) == 1
    got = {r.id: r for r in ledger.entries().collect()}
    assert len(got) == 194 and {i for i, r in got.items() if r.payment_status == "paid"} == {3} and got[3].paid_at == datetime(2026, 1, 10, 12)
    assert ledger.apply(event(spark, "q"), now()) == ([], []) and files(ledger, "entries") == after
    paid, told = ledger.apply(event(spark, "p", "q", "nobody"), now())
    assert len(paid) in (1, 2) and {r.id for r in ledger.entries().where("payment_status = 'paid'").collect()} == {1, 2, 3}
    assert {(r.payment_id, r.entry_id, r.kind, r.status) for r in ledger.outbox().collect()} == {("p", 1, "payer", "waiting"), ("p", 2, "partner", "no_chat"), ("q", 3, "payer", "waiting")}
    assert ledger.apply(event(spark, "p").limit(0), now()) == ([], [])


def test_the_stream_and_events_that_come_again(spark, ledger, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    body = lambda p: json.dumps({"event": "payment.succeeded", "object": {"id": p, "amount": {"value": "10.00"}}}) + "\n"

    def put(name: str, at: int, *payments: str) -> None:
        (tmp_path / "in" / name).write_text("".join(map(body, payments)))
        os.utime(tmp_path / "in" / name, (at, at))

    day, start = 86_400, 1_700_000_000
    seen: list[list] = []
    source = lambda: readers.payment_events(spark, str(tmp_path / "in"), stream=True)

    def watch() -> None:
        query = once(source()).writeStream.foreachBatch(lambda b, n: seen.append([r.payment_id for r in b.collect()])).option("checkpointLocation", str(tmp_path / "watch")).trigger(availableNow=True).start()
        query.awaitTermination()
        apply_stream(source(), ledger, str(tmp_path / "cp"), now()).awaitTermination()

    put("1.json", start, "p", "p", "q")
    watch()
    put("2.json", start + 3600, "p")  # within the day: it never reaches the fold
    watch()
    put("3.json", start + 5 * day, "other10")
    watch()
    put("4.json", start + 5 * day + 60, "p")  # long after: it reaches the fold and changes nothing
    before = files(ledger, "entries")
    watch()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(x for batch in seen for x in batch) == ["other10", "p", "p", "q"]
    assert files(ledger, "entries") == before
    assert {r.id for r in ledger.entries().where("payment_status = 'paid'").collect()} == {1, 2, 3, 10} and ledger.outbox().count() == 4


def test_versions_of_a_document(spark, tmp_path):
    path, schema = str(tmp_path / "doc"), "title string, participants array<string>"
    first = spark.createDataFrame([("Cup", ["Ann"]), ("Open", [])], schema)
    sinks.add_version(first, path, 1)
    again = sinks.at_version(spark, path, schema).withColumn("participants", F.when(F.col("title") == "Cup", F.array_append("participants", F.lit("Bo"))).otherwise(F.col("participants")))
    sinks.add_version(again, path, 2)
    assert {r.title: r.participants for r in sinks.at_version(spark, path, schema).collect()} == {"Cup": ["Ann", "Bo"], "Open": []}
    sinks.add_version(sinks.at_version(spark, path, schema, 1), path, 3)  # back to the first
    assert {r.title: r.participants for r in sinks.at_version(spark, path, schema).collect()} == {"Cup": ["Ann"], "Open": []}
    assert sinks.at_version(spark, path, schema, 2).count() == 2


@pytest.mark.parametrize("size, most", [(7, 50), (5, 50), (4, 3), (100, 50)])
def test_passes_equal_the_loop(spark, size, most):
    rows = [(i, 1 + i % 3, 7, None if i % 5 == 0 else datetime(2026, 1, 1, i % 3), i % 4 != 0) for i in range(25)]
    entries = table(spark, "entries", "id long, player_id long, tournament_id long, created_at timestamp, active boolean", rows)
    people = table(spark, "players", "id long, full_name string, telegram_id string", [(1, "Ann", "11"), (2, "Ben", None), (3, "Cid", "33")])
    events = table(spark, "tournaments", "id long, title string", [(7, "Cup")])
    want, state = [], entries
    for number in range(1, most + 1):
        batch = queue.work_batch(state, people, events, now(), size).collect()
        want.append((number, len(batch), sum(r.outcome == "send" for r in batch)))
        if not batch:
            break
        done = spark.createDataFrame([(r.entry_id, r.payment_url, r.outcome) for r in batch], "entry_id long, payment_url string, outcome string")
        state = spark.createDataFrame(queue.apply_batch(state, done, now()).collect(), state.schema)
    drained = queue.drain(entries, people, events, now(), size, most)
    assert sorted(map(tuple, queue.pass_totals(drained, most).collect())) == want
    after = {r.id: (r.payment_url, r.telegram_notified) for r in queue.apply_batch(entries, drained, now()).collect()}
    assert after == {r.id: (r.payment_url, r.telegram_notified) for r in state.collect()}
    assert queue.pass_totals(queue.drain(entries.limit(0), people, events, now()), 50).collect() == [(1, 0, 0)]


def test_runs_of_logs_read_in_blocks(spark, tmp_path):
    lines = ["ERROR: before any run", "RUN START: PID=1, Time=2026-01-01 10:00:00 +0300 MSK", "RUN TYPE: AUTOMATIC (timer)", "Entries DELETED: 0", "RUN START: PID=2, Time=2026-01-01 11:00:00 +0300 MSK", "RUN TYPE: MANUAL", "ERROR: no file", "ERROR: again", "RUN START: PID=3, Time=2026-01-01 12:00:00 +0300 MSK", "noise", "RUN START: PID=4, Time=2026-01-01 13:00:00 +0300 MSK"]
    want = {(1, "AUTOMATIC", 0, None, "finished"), (2, "MANUAL", 2, "no file", "failed"), (3, None, 0, None, "broken"), (4, None, 0, None, "running")}
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    told = lambda runs: {(r.pid, r.kind, r.errors, r.first_error, r.state) for r in runs.collect()}
    assert told(readers.runs_from_log(readers.log_lines(spark, str(tmp_path / "log")))) == want
    for size in (1, 2, 3, 5):
        dealt = [("f", n // size, n, line) for n, line in enumerate(lines)] + [("g", 0, 0, "RUN TYPE: MANUAL")]
        assert told(readers.runs_from_log(spark.createDataFrame(dealt, "file string, block long, at long, value string"))) == want
    assert readers.runs_from_log(readers.log_lines(spark, str(tmp_path / "log")).limit(0)).count() == 0
    ages = spark.createDataFrame([(datetime(2026, 1, 1), datetime(2026, 1, 2, 5)), (datetime(2026, 1, 3), datetime(2026, 1, 2)), (None, datetime(2026, 1, 2))], "e timestamp, s timestamp")
    assert [tuple(r.a) for r in ages.select(readers.error_age(F.col("e"), F.col("s")).alias("a")).collect()] == [("old", 1, 29), ("current", None, None), ("none", None, None)]


def test_what_is_told_or_empty_is_not_staged_again(spark, ledger):
    top = f"{shared_folder(spark).removeprefix('file:')}/quillroster"

    def staged_by(batch):
        before = set(os.listdir(top)) if os.path.isdir(top) else set()
        changed = ledger.apply(batch, now())
        return changed, {d.rsplit("-", 1)[0]: spark.read.parquet(f"file:{top}/{d}").count() for d in set(os.listdir(top)) - before}

    changed, rows = staged_by(event(spark, "p", "q", "other10"))
    # The buckets are written without a copy beside them, and so is the first outbox.
    assert all(changed) and not {"buckets", "notices", "new_notices"} & set(rows) and ledger.outbox().count() == 4
    changed, rows = staged_by(event(spark, "p", "q", "other11"))
    assert rows["new_notices"] == 1 and "notices" not in rows and len(changed[1]) == 1 and ledger.outbox().count() == 5
    # The batches by which a stream's watermark goes on have no events: nothing is looked up for them.
    assert staged_by(event(spark, "p").limit(0)) == (([], []), {"payments": 0})
