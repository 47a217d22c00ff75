import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillroster.operators import mutate, payments, pending, queue, reconcile, resolve, views
from quillroster.sources import readers, schemas


def now():
    return F.lit("2026-01-10 12:00:00").cast("timestamp")


def frame(spark, table, *rows):
    names = sorted({k for r in rows for k in r}) or ["id"]
    fields = [f for f in schemas.schema(table) if f.name in names]
    from pyspark.sql import types as T

    return schemas.conform(spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType(fields)), table)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_segments_lose_no_pair(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 18))) for _ in range(120)})
    probes = spark.createDataFrame([(w,) for w in words], "probe string")
    people = spark.createDataFrame([(w,) for w in words], "person string")
    from quillroster.functions import text as X

    got = {(r.probe, r.person, r.dist) for r in resolve.within_distance(probes, people, "probe", "person", X.name_distance_limit(F.col("probe"))).collect()}
    limit = lambda w: 2 if len(w) <= 8 else 3 if len(w) <= 14 else 4 if len(w) <= 22 else 5
    want = {(a, b, d) for a in words for b in words if (d := edit_distance(a, b)) <= limit(a)}
    assert got == want


def test_resolution_cascade(spark):
    people = spark.createDataFrame([(1, "Ivan Petrov", "ivan petrov"), (2, "Anna Smirnova", "anna smirnova")], "id long, full_name string, normalized_name string")
    aliases = spark.createDataFrame([("vanya", 1)], "normalized_alias string, player_id long")
    names = spark.createDataFrame([("Vanya",), ("Ivan Petrov",), ("ivan petrov",), ("Anna Smirnov",), ("Quite Other",), ("",), (None,)], "name string")
    got = {r.name: r for r in resolve.resolve_names(names, aliases, people).collect()}
    assert {k: (v.outcome, v.player_id) for k, v in got.items()} == {"Vanya": ("alias", 1), "Ivan Petrov": ("exact", 1), "ivan petrov": ("ambiguous", None), "Anna Smirnov": ("ambiguous", None), "Quite Other": ("new", None)}
    assert got["Anna Smirnov"].candidates[0].player_id == 2 and got["Anna Smirnov"].candidates[0].dist == 1


def test_new_ids_have_no_gaps(spark):
    prior = spark.createDataFrame([(7,)], "id long")
    got = mutate.with_new_ids(spark.range(1000).select(F.col("id").alias("k")), prior, ["k"]).collect()
    assert sorted(r.id for r in got) == list(range(8, 1008))


def snapshot_docs(spark, *values):
    return spark.createDataFrame([(v, f"f{i}", datetime(2026, 1, 1)) for i, v in enumerate(values)], "value string, file string, modified_at timestamp")


SNAPSHOT = """{"last_updated": "2026-01-09 10:00:00", "tournaments": {
 "a": {"start_datetime": "2026-01-11T19:00:00+03:00", "tournament_type": "TEAM", "participants": ["Ivan Petrov", "New One", "", "Ivan Petrow"], "tournament": {"title": "Cup", "location": "Hall", "price": "6 000 R"}},
 "b": {"start_datetime": "2026-01-10 07:00", "participants": ["Past"], "tournament": {"title": "Old", "location": "Hall", "price": ""}}}}"""


def test_snapshot_forms(spark):
    as_list = '{"tournaments": [{"start_datetime": "junk", "tournament": {"title": "T"}}]}'
    docs = snapshot_docs(spark, SNAPSHOT, as_list, '{"tournaments": []}', "{}", '{"tournaments": 5}')
    rows = {(r.file, r.title): r for r in readers.snapshot_rows(docs).collect()}
    assert rows["f0", "Cup"].participants == ["Ivan Petrov", "New One", "Ivan Petrow"] and rows["f0", "Cup"].price_rub == 6000 and rows["f0", "Cup"].tournament_type == "team"
    assert rows["f1", "T"].starts_at is None and len(rows) == 3
    assert {r.file: r.problem for r in readers.snapshot_problem(docs).collect()} == {"f2": "empty", "f3": "missing", "f4": "not events"}


def state(spark):
    return {
        "tournaments": frame(spark, "tournaments", {"id": 5, "location": "Hall", "starts_at": datetime(2026, 1, 11, 16), "title": "Cup", "active": True, "first_seen_in_source": datetime(2026, 1, 1), "archived_at": datetime(2026, 1, 2)}, {"id": 6, "location": "Hall", "starts_at": datetime(2026, 2, 1)}, {"id": 7, "location": "Hall", "starts_at": datetime(2025, 2, 1)}),
        "players": frame(spark, "players", {"id": 1, "full_name": "Ivan Petrov", "normalized_name": "ivan petrov"}, {"id": 2, "full_name": "Paid Leaver", "normalized_name": "paid leaver"}, {"id": 3, "full_name": "Unpaid Leaver", "normalized_name": "unpaid leaver"}),
        "entries": frame(spark, "entries", {"id": 10, "tournament_id": 5, "player_id": 2, "payment_status": "paid"}, {"id": 11, "tournament_id": 5, "player_id": 3, "payment_status": "pending"}),
        "player_aliases": frame(spark, "player_aliases"),
        "pending_entries": frame(spark, "pending_entries"),
    }


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_three_imports_in_a_row(spark):
    docs = snapshot_docs(spark, SNAPSHOT)
    tables = state(spark)
    done = reconcile.import_snapshot(tables, docs, 1, now())
    assert done.counters.first().asDict() == {"entries_new": 2, "entries_existing": 0, "entries_inactivated": 1, "entries_deleted": 1, "players_upsert": 2, "tournaments_upsert": 1, "tournaments_skipped_past": 1, "tournaments_archived": 2, "tournaments_deleted": 0}
    entries = {(r.tournament_id, r.player_id): r for r in done.tables["entries"].collect()}
    assert entries[5, 2].active is False and (5, 3) not in entries and entries[5, 1].payment_status == "pending"
    events_now = {r.id: r for r in done.tables["tournaments"].collect()}
    assert events_now[5].archived_at is None and events_now[5].first_seen_in_source == datetime(2026, 1, 1) and events_now[6].archived_at and events_now[7].archived_at
    waiting = done.tables["pending_entries"].collect()
    assert [(w.raw_player_name, w.status, w.candidates[0].player_id) for w in waiting] == [("Ivan Petrow", "pending", 1)]
    again = reconcile.import_snapshot(done.tables, docs, 2, now())
    assert {(r.player_id, r.action) for r in again.changes.collect()} == {(1, "existing"), (4, "existing"), (2, "inactivated")}
    third = reconcile.import_snapshot(again.tables, docs, 3, now())
    for name in ("tournaments", "players", "entries"):
        assert again.tables[name].exceptAll(third.tables[name]).count() == third.tables[name].exceptAll(again.tables[name]).count() == 0
    assert [(w.raw_player_name, w.sync_run_id, w.status) for w in third.tables["pending_entries"].collect()] == [("Ivan Petrow", 3, "pending")]
    assert max(joins(t) for t in third.tables.values()) == 0
    row = reconcile.run_row(1, done.counters, now(), now(), "x.json", now(), "late").first()
    assert (row.entries_new, row.source, row.json_mtime, row.error) == (2, "import", datetime(2026, 1, 10, 12), "late")


def test_bad_snapshots_change_nothing(spark):
    for value, problem in (('{"tournaments": {}}', "empty"), ("{}", "missing"), ('{"tournaments": 5}', "not events"), ("{broken", "missing")):
        with pytest.raises(ValueError, match=problem):
            reconcile.import_snapshot(state(spark), snapshot_docs(spark, value), 1, now())
    with pytest.raises(ValueError, match="no snapshot"):
        reconcile.import_snapshot(state(spark), snapshot_docs(spark, "{}").limit(0), 1, now())
    with pytest.raises(ValueError, match="no events"):
        reconcile.reconcile(state(spark), readers.snapshot_rows(snapshot_docs(spark, "{}")), 1, now())


def test_leavers_by_name_and_failed_events(spark):
    tables = state(spark)
    tables["player_aliases"] = frame(spark, "player_aliases", {"id": 1, "normalized_alias": "ivan petrow", "player_id": 3})
    docs = snapshot_docs(spark, SNAPSHOT)
    ways = {by_name: {(r.player_id, r.action) for r in reconcile.import_snapshot(tables, docs, 1, now(), by_name).changes.collect()} for by_name in (False, True)}
    assert (3, "existing") in ways[False] and (3, "deleted") in ways[True] and (2, "inactivated") in ways[True]
    events = readers.snapshot_rows(docs)
    failed = reconcile.reconcile(tables, events, 1, now(), failed=events.where("title = 'Cup'"))
    assert failed.changes.count() == 0 and failed.tables["entries"].count() == 2
    twice = readers.snapshot_rows(snapshot_docs(spark, SNAPSHOT, SNAPSHOT))
    assert {(r.location, r.records) for r in reconcile.duplicate_events(twice).collect()} == {("Hall", 2)}


def test_import_status(spark):
    runs = frame(spark, "sync_runs", {"id": 1, "started_at": datetime(2026, 1, 10, 9), "finished_at": datetime(2026, 1, 10, 9, 5)}, {"id": 2, "started_at": datetime(2026, 1, 10, 11), "error": "x"})
    lines = spark.createDataFrame([("RUN TYPE: MANUAL",), ("RUN TYPE: AUTOMATIC (launchd)",), ("RUN TYPE: MANUAL",), ("other",)], "value string")
    row = reconcile.import_status(runs, lines, now()).first()
    assert (row.id, row.error, row.age_hours, row.recent, row.automatic_runs, row.manual_runs) == (2, "x", 1, True, 1, 2)
    none = reconcile.import_status(runs.limit(0), lines.limit(0), now()).first()
    assert (none.id, none.recent, none.manual_runs) == (None, False, 0)


def test_payments_count_once(spark):
    entries = frame(spark, "entries", {"id": 1, "payment_id": "p", "payment_scope": "pair", "paid_for_entry_id": 2, "payment_status": "pending"}, {"id": 2, "payment_id": None, "payment_status": "pending"}, {"id": 3, "payment_id": "q", "payment_status": "paid"})
    events = spark.createDataFrame([("payment.succeeded", "p", "3500.00"), ("payment.succeeded", "p", "bad"), ("payment.canceled", "q", "1"), ("payment.succeeded", "nobody", "1")], "event string, payment_id string, amount_text string")
    after, changes = payments.apply_payments(entries, events, now())
    rows = {r.id: r for r in after.collect()}
    assert changes.count() == 2 and rows[1].payment_status == rows[2].payment_status == "paid"
    assert rows[2].paid_by_entry_id == 1 and float(rows[2].paid_amount_rub) == 3500 and rows[1].paid_by_entry_id is None
    twice, more = payments.apply_payments(after, events, now())
    assert more.count() == 0 and twice.exceptAll(after).count() == 0
    assert {r.id for r in payments.notify_set(after, events).collect()} == {1, 2, 3}


def test_queue(spark):
    entries = frame(spark, "entries", *[{"id": i, "tournament_id": 1, "player_id": i, "payment_status": "pending", "active": a, "telegram_notified": n, "created_at": datetime(2026, 1, 1)} for i, a, n in ((1, True, False), (2, None, None), (3, False, False), (4, True, True))])
    people = frame(spark, "players", *[{"id": i, "full_name": f"P{i}", "telegram_id": None if i == 2 else str(i)} for i in (1, 2, 3, 4)])
    events = frame(spark, "tournaments", {"id": 1, "starts_at": None, "tournament_type": "team"})
    batch = queue.work_batch(entries, people, events, now(), 3)
    assert [(r.entry_id, r.outcome) for r in batch.collect()] == [(1, "send"), (2, "no_telegram_id"), (3, "inactive")]
    after = {r.id: r for r in queue.apply_batch(entries, batch, now()).collect()}
    assert after[1].telegram_notified and after[1].payment_url.endswith("/p/e/1?pay=half") and after[4].payment_url is None
    assert queue.batch_totals(batch).first().asDict() == {"processed": 3, "notified": 1}
    with pytest.raises(ValueError):
        queue.work_batch(entries, people, events, now(), 501)


def test_quarantine_transitions_and_merge(spark):
    rows = frame(spark, "pending_entries", {"id": 1, "tournament_id": 1, "normalized_name": "a", "status": "pending", "sync_run_id": 1}, {"id": 2, "tournament_id": 1, "normalized_name": "b", "status": "rejected", "sync_run_id": None}, {"id": 3, "tournament_id": 2, "normalized_name": "c", "status": "pending", "sync_run_id": None})
    decided = spark.createDataFrame([(1, "resolved", 9), (2, "approved", 9)], "id long, status string, resolved_player_id long")
    after = {r.id: r for r in pending.transition(rows, decided, now()).collect()}
    assert (after[1].status, after[1].resolved_player_id, after[2].status) == ("resolved", 9, "rejected")
    assert {r.id: r.status for r in mutate.expire(rows, F.lit(2)).collect()} == {1: "expired", 2: "rejected", 3: "pending"}
    people = frame(spark, "players", {"id": 1, "full_name": "A", "normalized_name": "n"}, {"id": 2, "full_name": "a", "normalized_name": "n"}, {"id": 3, "full_name": "x", "normalized_name": "x"})
    entries = frame(spark, "entries", {"id": 1, "tournament_id": 1, "player_id": 1}, {"id": 2, "tournament_id": 1, "player_id": 2}, {"id": 3, "tournament_id": 2, "player_id": 2, "paid_for_entry_id": 2})
    aliases = frame(spark, "player_aliases", {"id": 1, "normalized_alias": "z", "player_id": 2})
    merged = pending.merge_people(people, entries, aliases, rows, spark.createDataFrame([(1,)], "player_id long"), now())
    assert {r.id for r in merged["players"].collect()} == {1, 3} and merged["player_aliases"].count() == 0
    assert {(r.id, r.player_id, r.paid_for_entry_id) for r in merged["entries"].collect()} == {(1, 1, None), (3, 1, None)}
    learned = spark.createDataFrame([("Z", "z", 3, "t"), ("Y", "y", 1, "t")], "alias_name string, normalized_alias string, player_id long, created_by_telegram_id string")
    assert {(r.normalized_alias, r.player_id) for r in pending.add_aliases(aliases, learned, now()).collect()} == {("z", 3), ("y", 1)}


def test_constraints(spark):
    bad = frame(spark, "entries", {"id": 1, "payment_scope": "other"}, {"id": 2, "payment_scope": "pair"})
    assert [(r.id, r.violation) for r in schemas.violations(bad, "entries").collect()] == [(1, "payment_scope")]


def test_sessions(spark):
    from quillroster.streaming.sessions import fold_sessions

    steps = [("a", 1, "ask_name", None), ("a", 2, "name_unknown", None), ("b", 1, "pick_date", None), ("c", 1, "ask_name", None), ("c", 2, "linked", None), ("d", 1, "support", True), ("d", 2, "pick_date", None)]
    got = {r.telegram_id: (r.state, r.support_mode) for r in fold_sessions(spark.createDataFrame(steps, "telegram_id string, seq long, step string, support boolean")).collect()}
    assert got == {"a": ("needs_manual_link", False), "d": ("bind_pick_date", True)}


def test_event_match_and_logs(spark, tmp_path):
    events = spark.createDataFrame([(0, "Hall", "Cup", datetime(2026, 1, 1, 10, 0, 0, 5)), (1, "Cup", "X", datetime(2026, 1, 1, 10))], "position int, location string, title string, starts_at timestamp")
    asked = spark.createDataFrame([(1, "Cup", datetime(2026, 1, 1, 10)), (2, "Nope", datetime(2026, 1, 1, 10))], "ask_id int, place_name string, starts_at timestamp")
    assert [tuple(r) for r in views.match_events(asked, events).collect()] == [(1, 0)]
    (tmp_path / "log").write_text("noise\nRUN START: PID=12, Time=2026-01-01 10:00:00 +0300 MSK\nRUN START: PID=13, Time=2026-01-02 10:00:00 +0300 MSK\n")
    assert [tuple(r) for r in readers.latest_runs(spark.read.text(str(tmp_path / "log")), 1).collect()] == [(13, "2026-01-02 10:00:00")]
    (tmp_path / "p.csv").write_text("id,full_name\n1,Ann Ö\n")
    assert [tuple(r) for r in readers.people(spark, str(tmp_path / "p.csv")).collect()] == [(1, "Ann Ö")]
