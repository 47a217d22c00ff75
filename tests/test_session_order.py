"""Steps that repeat a seq are folded in a total order."""

from collections import defaultdict

from quillroster.plans import queries  # noqa: F401 - registers its queries
from quillroster.plans.registry import QUERIES
from quillroster.streaming.sessions import fold_sessions

STEPS = "telegram_id string, seq long, at long, step string, support boolean"


def test_repeated_seq_is_ordered_by_ties(spark):
    steps = [("a", 0, 0, "ask_name", None), ("a", 5, 1, "pick_date", None), ("a", 5, 2, "confirm", None)]
    steps += [("b", 0, 0, "ask_name", None), ("b", 5, 2, "confirm", None), ("b", 5, 3, "linked", None)]
    steps += [("c", 5, 1, "linked", None), ("c", 5, 2, "ask_name", None)]
    got = {r.telegram_id: r.state for r in fold_sessions(spark.createDataFrame(steps, STEPS), ("at",)).collect()}
    assert got == {"a": "bind_confirm", "c": "awaiting_lunda_name"}


def test_query_folds_all_rows(spark):
    folder = "/root/testdata/sf0.001"
    want = defaultdict(tuple)
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        own = (r.l_orderkey * 10 + r.l_linenumber, r.l_shipdate, "bind_pick_date" if r.l_linestatus == "F" else "bind_confirm")
        want[r.l_suppkey] = max(want[r.l_suppkey], own)
    assert {r.telegram_id: r.last for r in QUERIES["st1_session_fold_all"](spark, folder).collect()} == {k: v[2] for k, v in want.items()}
