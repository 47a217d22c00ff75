import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillroster.operators import decisions, outbox, patterns, payments, resolve, views
from quillroster.sources import readers, schemas
from quillroster.streaming import sessions


def now():
    return F.lit("2026-01-10 12:00:00").cast("timestamp")


def table(spark, name, columns, *rows):
    return schemas.conform(spark.createDataFrame(list(rows), columns), name)


@pytest.fixture
def entries(spark):
    return table(spark, "entries", "id long, player_id long, payment_id string, payment_scope string, paid_for_entry_id long, paid_by_entry_id long", (1, 1, "p", "pair", 2, None), (2, 2, None, "self", None, 1), (3, 3, "q", "self", None, None), (4, 4, None, "self", None, None))


@pytest.fixture
def people(spark):
    return table(spark, "players", "id long, full_name string, telegram_id string", (1, "Ann", "11"), (2, "Ben", None), (3, "Cid", "33"))


def test_notices_are_made_and_sent_once(spark, entries, people):
    asked = spark.createDataFrame([("p",), ("q",), ("p",), (None,), ("nobody",)], "payment_id string")
    found = outbox.notices(entries, people, asked, now())
    assert {(r.payment_id, r.entry_id, r.kind, r.status) for r in found.collect()} == {("p", 1, "payer", "waiting"), ("p", 2, "partner", "no_chat"), ("q", 3, "payer", "waiting")}
    box = outbox.enqueue(spark.createDataFrame([], outbox.OUTBOX), found)
    assert outbox.enqueue(box, found).count() == 3
    sent = outbox.mark_sent(box, spark.createDataFrame([("p", 1), ("p", 2)], "payment_id string, entry_id long"), now())
    assert {(r.entry_id, r.status, r.sent_at is not None) for r in sent.collect()} == {(1, "sent", True), (2, "no_chat", False), (3, "waiting", False)}
    assert outbox.notices(entries, people, asked.limit(0), now()).count() == 0


def test_the_first_event_of_a_payment_counts(spark, entries):
    rows = [("payment.succeeded", "p", "10.00", 2), ("payment.succeeded", "p", "99.00", 3), ("payment.canceled", "p", "1.00", 1), ("payment.succeeded", "q", None, 1), ("payment.succeeded", "q", "5", 2)]
    events = spark.createDataFrame(rows, "event string, payment_id string, amount_text string, arrived_at int")
    assert {(r.id, r.amount and float(r.amount)) for r in payments.payment_changes(entries, events).collect()} == {(1, 10.0), (2, 10.0), (3, None)}
    assert {r.id: float(r.amount) for r in payments.payment_changes(entries, events.drop("arrived_at")).collect()} == {1: 99.0, 2: 99.0, 3: 5.0}


def test_sessions_as_a_stream_are_those_of_the_fold(spark, tmp_path):
    steps = [("a", 1, "ask_name", None), ("a", 2, "name_unknown", None), ("b", 1, "pick_date", None), ("c", 1, "ask_name", None), ("c", 5, "linked", None), ("d", 1, "support", True), ("d", 6, "pick_date", None), ("c", 7, "ask_name", None), ("a", 8, "cancel", None), ("d", 9, "support", False)]
    (tmp_path / "in").mkdir()
    schema = "telegram_id string, seq long, step string, support boolean"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = {}

    def keep(batch, number):
        seen.update({r.telegram_id: (r.state, r.support_mode) if r.open else None for r in batch.collect()})

    for part in range(2):
        rows = [s for s in steps if (s[1] > 4) == bool(part)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("telegram_id", "seq", "step", "support"), r, strict=True))) for r in rows))
        query = sessions.session_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = {r.telegram_id: (r.state, r.support_mode) for r in sessions.fold_sessions(spark.createDataFrame(steps, schema)).collect()}
    assert {k: v for k, v in seen.items() if v} == whole == {"c": ("awaiting_lunda_name", False), "d": ("bind_pick_date", False)}
    assert seen["a"] is None and "b" not in seen


def test_matches_by_stem_and_by_wildcard(spark):
    people = spark.createDataFrame([(1, "Ann Ox", None), (2, "ann bee", "Zed"), (3, "Bo", "bo"), (4, None, "Élan")], "id long, full_name string, lunda_name string")
    probes = spark.createDataFrame([(p,) for p in ("ANN%", "ann o%", "%ed", "bo", "é%", "B_", "", "nobody", "%n%")], "probe string")
    assert {(r.probe, r.player_id) for r in patterns.unique_match(probes, people).collect()} == {("ann o%", 1), ("%ed", 2), ("bo", 3), ("é%", 4), ("B_", 3)}
    assert "NestedLoop" not in patterns.unique_match(probes.where("probe LIKE 'a%'"), people).where("probe = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    groups = resolve.conflict_groups(spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, None), (5, None)], "id long, telegram_id string"))
    assert [tuple(r) for r in groups.collect()] == [("t", 2, 1)]


def test_a_page_of_a_long_list(spark):
    rows = spark.range(100).withColumnRenamed("id", "n")
    got = views.page(rows, [F.desc("n")], 2).collect()
    assert [r.n for r in got] == list(range(79, 69, -1)) and {(r.has_previous, r.has_next) for r in got} == {(True, True)}
    assert {r.has_next for r in views.page(rows, [F.asc("n")], 9).collect()} == {False} and views.page(rows, [F.asc("n")], 10).count() == 0


def test_decisions_about_names(spark):
    tables = {
        "players": table(spark, "players", "id long, full_name string, normalized_name string", (1, "Ivan Petrov", "ivan petrov"), (2, "Ivan Petrow", "ivan petrow"), (3, "Ann", "ann")),
        "entries": table(spark, "entries", "id long, tournament_id long, player_id long, active boolean", (10, 7, 2, True), (11, 8, 2, True), (12, 8, 1, False)),
        "player_aliases": spark.createDataFrame([], schemas.schema("player_aliases")),
        "pending_entries": table(spark, "pending_entries", "id long, tournament_id long, raw_player_name string, normalized_name string, status string", (1, 9, "Ivan Petrow", "ivan petrow", "pending"), (2, 9, "Ann", "ann", "pending"), (3, 9, "New One", "new one", "pending"), (4, 9, "x", "x", "pending"), (5, 9, "y", "y", "pending"), (6, 9, "z", "z", "expired")),
    }
    asked = spark.createDataFrame([(1, "resolved", 1, "adm"), (2, "approved", 3, "adm"), (3, "new_person", None, "adm"), (4, "snoozed", None, "adm"), (5, "rejected", None, "adm"), (6, "approved", 3, "adm"), (77, "approved", 3, "adm")], "id long, decision string, player_id long, by string")
    after = decisions.decide(tables, asked, now())
    assert {(r.id, r.full_name) for r in after["players"].collect()} == {(1, "Ivan Petrov"), (3, "Ann"), (4, "New One")}
    assert {(r.tournament_id, r.player_id) for r in after["entries"].where("active").collect()} == {(7, 1), (9, 1), (9, 3), (9, 4)}
    assert {r.id for r in after["entries"].collect()} == {10, 12, 13, 14, 15}
    assert [(r.normalized_alias, r.player_id, r.created_by_telegram_id) for r in after["player_aliases"].collect()] == [("ivan petrow", 1, "adm")]
    rows = {r.id: r for r in after["pending_entries"].collect()}
    assert {k: r.status for k, r in rows.items()} == {1: "resolved", 2: "approved", 3: "approved", 4: "snoozed", 5: "rejected", 6: "expired"}
    assert rows[1].resolved_player_id == 1 and rows[4].notified_at and rows[2].resolved_at is None
    again = decisions.decide(after, asked, now())
    for name in tables:
        assert again[name].count() == after[name].count()


def test_chat_and_payment_sources(spark, tmp_path):
    (tmp_path / "chat.json").write_text('{"message": {"text": "hi", "from": {"id": 5}}}\n{"callback_query": {"data": "x:1", "from": {"id": 6}}}\n')
    assert sorted(tuple(r) for r in readers.chat_updates(spark, str(tmp_path / "chat.json")).collect()) == [("5", "hi", None), ("6", None, "x:1")]
    assert schemas.has_column(spark.range(1), "id") and not schemas.has_column(spark.range(1), "x")
