"""Chat sessions: a state for each person, folded from their steps, in a batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step, the state it leads to, and whether it makes a session where there is none.
STEPS = {"ask_name": ("awaiting_lunda_name", True), "name_unknown": ("needs_manual_link", False), "pick_date": ("bind_pick_date", False), "pick_tournament": ("bind_pick_tournament", False), "pick_player": ("bind_pick_player", False), "confirm": ("bind_confirm", False)}
ENDS = ("linked", "bound", "cancel")
#: A typed text answers the question of this state; whether the name was found says what follows.
ASKED, FOUND, NOT_FOUND, MANUAL = "awaiting_lunda_name", "named", "unnamed", "needs_manual_link"


def _table(value: int) -> Column:
    return F.create_map(*[F.lit(x) for step, made in STEPS.items() for x in (step, made[value])])


def fold_sessions(steps: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """steps (telegram_id, seq, step, support) -> open sessions: telegram_id, state, support_mode.

    After a person's last ending step a session exists from the first step that makes one (asking for
    the name, or switching support mode); steps before that have no session to change. The last state
    and the last support flag after that hold. Steps of one seq are ordered by the columns `ties`; of
    those that agree there too, an ending step is the last, else the greatest state. Only aggregates by
    person are used, so that a person with very many steps is pre-aggregated.
    """
    steps = steps.withColumn("_order", F.struct("seq", *ties))
    last_end = steps.groupBy("telegram_id").agg(F.max(F.when(F.col("step").isin(*ENDS), F.col("_order"))).alias("_end"))
    after = steps.join(last_end, "telegram_id").where((F.col("seq") > -1) & (F.col("_end").isNull() | (F.col("_order") > F.col("_end"))))
    makes = F.coalesce(_table(1)[F.col("step")], F.lit(False)) | (F.col("step") == "support")
    opened = after.where(makes).groupBy("telegram_id").agg(F.min("_order").alias("_open"))
    live = after.join(opened, "telegram_id").where(F.col("_order") >= F.col("_open"))
    state = F.max(F.when(_table(0)[F.col("step")].isNotNull(), F.struct("_order", _table(0)[F.col("step")].alias("state"))))
    support = F.max(F.when(F.col("step") == "support", F.struct("_order", "support")))
    return live.groupBy("telegram_id").agg(state.alias("_s"), support.alias("_m")).select("telegram_id", F.col("_s.state").alias("state"), F.coalesce("_m.support", F.lit(False)).alias("support_mode"))


SESSION = "telegram_id string, state string, support_mode boolean, open boolean"
#: What is kept for a person: the session, if open, and the steps that wait for the watermark.
KEPT = "state string, support_mode boolean, open boolean, seqs array<bigint>, steps array<string>, flags array<int>"


def _folded(session: tuple[str | None, bool] | None, steps: list[tuple[str, bool | None]]) -> tuple[str | None, bool] | None:
    """A session (state, support mode) after the steps of one seq, as fold_sessions has it: an ending step is the last, else the greatest state and flag hold. None where there is none.

    Typed texts, of which the fold knows nothing, hang on the session: see FOUND.
    """
    if any(step in ENDS for step, _ in steps):
        return None
    if session is None:
        if not any(step == "support" or STEPS.get(step, ("", False))[1] for step, _ in steps):
            return None
        session = (None, False)
    states = [STEPS[step][0] for step, _ in steps if step in STEPS]
    flags = [bool(flag) for step, flag in steps if step == "support"]
    state, mode = (max(states) if states else session[0], max(flags) if flags else session[1])
    typed = [step for step, _ in steps if step in (FOUND, NOT_FOUND)]
    if typed and session[1]:
        return (state, False)  # a text in support mode is passed on, and ends the mode
    if typed and session[0] == ASKED:
        return None if FOUND in typed else (MANUAL, mode)
    return (state, mode)


def session_stream(steps: DataFrame, delay: str | None = None) -> DataFrame:
    """A stream of steps (telegram_id, seq, step, support) -> a row for each person whose session a micro-batch changes; open is false where it has ended.

    Each person's session is kept as state between micro-batches. With delay, seq is the second, from
    1970 on, at which the step was taken: steps are held back as state until the watermark, which is that
    much behind the latest step, has passed them, and count in the order of their seq, however they are dealt over
    micro-batches; a step that comes behind the watermark is too late and left out. Without it, steps
    of one micro-batch count in order of seq, and those of a later one come after them. Steps of one
    seq are taken as by fold_sessions. Steps without a person or a seq, or with a negative one, are left out.
    """
    steps = steps.where("telegram_id IS NOT NULL AND seq >= 0")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, mode, is_open, *waiting = tuple(kept.get) if kept.exists else (None, False, False, [], [], [])
        before = session = (state, mode) if is_open else None
        held = list(zip(*waiting, strict=True))
        now = kept.getCurrentWatermarkMs() if delay else 0
        if not kept.hasTimedOut:
            new = [(int(q), s, -1 if pd.isna(m) else int(m)) for part in parts for q, s, m in zip(part["seq"], part["step"], part["support"], strict=True)]
            held += [r for r in new if not delay or r[0] * 1000 >= now]
        due = [r for r in held if not delay or r[0] * 1000 < now]
        for seq in sorted({r[0] for r in due}):
            session = _folded(session, [(s, None if m < 0 else bool(m)) for q, s, m in due if q == seq])
        held = [r for r in held if delay and r[0] * 1000 >= now]
        if session or held:
            state, mode = session or (None, False)
            kept.update((state, mode, session is not None, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))
            if held:
                # A timer fires once the watermark is past it, and must be set ahead of the watermark.
                kept.setTimeoutTimestamp(max(min(r[0] for r in held) * 1000, now + 1))
        elif kept.exists:
            kept.remove()
        if session != before or (session and due):
            yield pd.DataFrame({"telegram_id": [key[0]], "state": [session[0] if session else None], "support_mode": [session[1] if session else False], "open": [session is not None]})

    if delay is None:
        return steps.groupBy("telegram_id").applyInPandasWithState(fold, SESSION, KEPT, "update", GroupStateTimeout.NoTimeout)
    timed = steps.withColumn("at", F.timestamp_seconds("seq")).withWatermark("at", delay)
    return timed.groupBy("telegram_id").applyInPandasWithState(fold, SESSION, KEPT, "update", GroupStateTimeout.EventTimeTimeout)
