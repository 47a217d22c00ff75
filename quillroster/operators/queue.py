"""The queue of entries that need a payment link and a notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.functions import timeops as D
from quillroster.operators.mutate import update_keyed
from quillroster.operators.ranking import ranked
from quillroster.operators.views import entry_details

BATCH_RANGE = (1, 500)


def open_entries(entries: DataFrame, players: DataFrame, tournaments: DataFrame, as_of: Column) -> DataFrame:
    """Pending entries without a link and not paid by hand, of events that are undated or began at most some hours ago."""
    due = entries.where((F.col("payment_status") == "pending") & F.col("payment_url").isNull() & (F.coalesce("manual_paid", F.lit(False)) == F.lit(False)))
    ahead = tournaments.where(F.col("starts_at").isNull() | (F.col("starts_at") > as_of - D.hours(D.QUEUE_GRACE_HOURS)))
    return entry_details(due, players.select("id", "full_name", "telegram_id"), ahead.select("id", "title", "starts_at", "tournament_type"))


def outcome(active: Column, chat_id: Column, notified: Column, bot_ready: bool = True) -> Column:
    """inactive, no_telegram_id, already_notified, bot_not_configured or send: the first that holds."""
    return F.when(F.coalesce(~active, F.lit(False)), "inactive").when(chat_id.isNull() | (chat_id == ""), "no_telegram_id").when(F.coalesce(notified, F.lit(False)), "already_notified").when(F.lit(not bot_ready), "bot_not_configured").otherwise("send")


def work_batch(entries: DataFrame, players: DataFrame, tournaments: DataFrame, as_of: Column, limit: int | None = 50, base: str = "https://pay.invalid", bot_ready: bool = True) -> DataFrame:
    """Open entries, the oldest first (ties by id), with link and outcome; limit None takes all in one pass."""
    rows = open_entries(entries, players, tournaments, as_of)
    if limit is not None:
        if not BATCH_RANGE[0] <= limit <= BATCH_RANGE[1]:
            raise ValueError(f"limit must be from {BATCH_RANGE[0]} to {BATCH_RANGE[1]}")
        rows = rows.orderBy(F.asc_nulls_last("created_at"), "id").limit(limit)
    return rows.select(F.col("id").alias("entry_id"), "player_id", "tournament_id", "created_at", X.payment_link(base, F.col("id"), F.col("tournament_tournament_type")).alias("payment_url"), outcome(F.col("active"), F.col("player_telegram_id"), F.col("telegram_notified"), bot_ready).alias("outcome"))


def apply_batch(entries: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Entries of the batch get their link; those to be sent to are marked as notified."""
    linked = update_keyed(entries, batch.select(F.col("entry_id").alias("id"), "payment_url"), ["id"], ["payment_url"])
    sent = batch.where(F.col("outcome") == "send").select(F.col("entry_id").alias("id"), F.lit(True).alias("telegram_notified"), as_of.alias("telegram_notified_at"))
    return update_keyed(linked, sent, ["id"], ["telegram_notified", "telegram_notified_at"])


def batch_totals(batch: DataFrame) -> DataFrame:
    return batch.agg(F.count("*").alias("processed"), F.count(F.when(F.col("outcome") == "send", 1)).alias("notified"))


#: Entries that a pass takes, and passes at most.
PASS_SIZE, MOST_PASSES = 500, 50


def drain(entries: DataFrame, players: DataFrame, tournaments: DataFrame, as_of: Column, size: int = PASS_SIZE, most: int = MOST_PASSES, base: str = "https://pay.invalid", bot_ready: bool = True) -> DataFrame:
    """What passes over the queue, each of the `size` oldest open entries, would take until it is empty, `most` passes at most: as work_batch, with pass from 1.

    A pass gives its entries a link, so that later ones don't meet them: an entry's place in the
    queue, which is ranked without a window over it, says in which pass it is taken.
    """
    rows = work_batch(entries, players, tournaments, as_of, None, base, bot_ready)
    placed = ranked(rows, None, [F.asc_nulls_last("created_at"), F.col("entry_id")], "queue")
    return placed.select((F.expr(f"_pos div {size}") + 1).cast("int").alias("pass"), *rows.columns).where(F.col("pass") <= most)


def pass_totals(drained: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """(pass, processed, notified) for each pass of drain, and the pass that finds nothing and ends it, if there may be one more."""
    totals = drained.groupBy("pass").agg(F.count("*").alias("processed"), F.count(F.when(F.col("outcome") == "send", 1)).alias("notified"))
    last = totals.agg((F.coalesce(F.max("pass"), F.lit(0)) + 1).alias("pass")).where(F.col("pass") <= most)
    return totals.unionByName(last.select("pass", F.lit(0).cast("long").alias("processed"), F.lit(0).cast("long").alias("notified")))
