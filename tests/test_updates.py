"""A folder of chat updates in, sessions out."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from quillroster.sources import readers
from quillroster.streaming import sessions, updates


def test_updates_become_sessions(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ann Ox", None, None), (2, "Bo Lee", "Bo", ""), (3, "bo lee", None, None), (4, "Cid", None, "77")], "id long, full_name string, lunda_name string, telegram_id string")
    events = spark.createDataFrame([(1, datetime(2026, 1, 12, 10), None), (2, datetime(2026, 1, 13, 10), datetime(2026, 1, 9)), (3, datetime(2026, 1, 1), None)], "id long, starts_at timestamp, archived_at timestamp")
    now = F.lit("2026-01-10 12:00:00").cast("timestamp")
    text = lambda who, t: {"message": {"text": t, "from": {"id": who}}}
    press = lambda who, d: {"callback_query": {"data": d, "from": {"id": who}}}
    first = [
        text(1, "Помощь"), text(1, "hello there"),  # passed on: the mode ends, the session stays
        text(2, "Помощь"), press(2, "bind_date:2026-01-12"), press(2, "bind_pick_tournament:1"), press(2, "bind_pick_player:1:2:0"),
        text(3, "Помощь"), press(3, "bind_date:2026-01-13"),  # nothing on that date
        text(4, "Помощь"), press(4, "bind_back:menu"), text(4, "ann ox"),  # opened and ended in one batch
        press(5, "bind_date:2026-01-12"), text(5, "/start"), press(5, "pay:3"),  # no session to change
        text(6, "Помощь"), press(6, "bind_back:date"),
    ]
    second = [press(2, "bind_confirm:2"), text(6, "Мои турниры"), text(6, "bad \\"), text(3, "Помощь"), press(3, "bind_date:2026-01-12")]
    (tmp_path / "in").mkdir()
    seen: dict = {}

    def keep(batch, number):
        seen.update({r.telegram_id: (r.state, r.support_mode) if r.open else None for r in batch.collect()})

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    number = 0
    for part in (first, second):
        rows = [json.dumps({"update_id": number + k} | u) for k, u in enumerate(part)]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(rows))
        number += len(part)
        source = readers.chat_events(spark, str(tmp_path / "in"), stream=True)
        updates.steps_stream(source, people, events, str(tmp_path / "steps"), str(tmp_path / "cp1"), now).awaitTermination()
        steps = updates.read_steps(spark, str(tmp_path / "steps"), stream=True)
        sessions.session_stream(steps).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen == {"1": (None, False), "2": None, "3": ("bind_pick_tournament", True), "6": ("bind_pick_date", False)}
    kinds = {(r.telegram_id, r.seq): r.step for r in updates.read_steps(spark, str(tmp_path / "steps")).collect()}
    assert kinds["4", 10] == "named" and kinds["1", 1] == "unnamed" and kinds["6", 18] == "unnamed" and ("3", 7) not in kinds and ("5", 12) not in kinds


def test_an_answer_to_the_question_for_a_name():
    folded = sessions._folded
    asked = folded(None, [("ask_name", None)])
    assert asked == ("awaiting_lunda_name", False) and folded(asked, [("named", None)]) is None
    assert folded(asked, [("unnamed", None)]) == ("needs_manual_link", False) and folded(("bind_confirm", False), [("unnamed", None)]) == ("bind_confirm", False)
    assert folded(("awaiting_lunda_name", True), [("named", None)]) == ("awaiting_lunda_name", False) and folded(None, [("named", None)]) is None
