"""Notifications as a table: who is to be told of which payment, once for each payment and entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.operators.mutate import insert_missing, update_keyed
from quillroster.sources.staging import staged

OUTBOX = "payment_id string, entry_id bigint, player_id bigint, telegram_id string, kind string, status string, created_at timestamp, sent_at timestamp"


def notices(entries: DataFrame, players: DataFrame, payment_ids: DataFrame, as_of: Column, known: DataFrame | None = None) -> DataFrame:
    """Outbox rows for payments (payment_id): the entries that have one of them (payer), and those that these paid for (partner).

    People without a chat get a row whose status says so. An entry paid for by two of the payments
    has a row for each. Those of known (payment_id, entry_id) are left out.
    """
    # They are the entries of payments.notify_set, with the payment that each is told of.
    asked = payment_ids.select("payment_id").distinct()
    payers = entries.select("id", "player_id", "payment_id").join(asked, "payment_id", "left_semi")
    links = entries.where("paid_by_entry_id IS NOT NULL").select(F.col("id").alias("entry_id"), "player_id", "paid_by_entry_id")
    partnered = not links.isEmpty()
    payers = staged(payers, "payers") if partnered else payers
    rows = payers.select("payment_id", F.col("id").alias("entry_id"), "player_id", F.lit("payer").alias("kind"))
    if partnered:
        partners = links.join(payers.select(F.col("id").alias("paid_by_entry_id"), "payment_id"), "paid_by_entry_id")
        rows = rows.unionByName(partners.select("payment_id", "entry_id", "player_id", F.lit("partner").alias("kind")))
    if known is not None:
        # Before the rows are grouped and have their chats: the join's shuffle is the grouping's, too.
        # Entries come first, as numbers that differ sort faster than texts that don't.
        rows = rows.join(known.select("payment_id", "entry_id"), ["entry_id", "payment_id"], "left_anti")
    once = rows.groupBy("payment_id", "entry_id", "player_id").agg(F.when(F.bool_or(F.col("kind") == "payer"), "payer").otherwise("partner").alias("kind"))
    chat = players.select(F.col("id").alias("player_id"), "telegram_id")
    status = F.when(F.coalesce(F.col("telegram_id"), F.lit("")) == "", "no_chat").otherwise("waiting")
    return once.join(chat, "player_id", "left").select("payment_id", "entry_id", "player_id", "telegram_id", "kind", status.alias("status"), as_of.alias("created_at"), F.lit(None).cast("timestamp").alias("sent_at"))


def enqueue(outbox: DataFrame, found: DataFrame) -> DataFrame:
    """The outbox with the notices whose (payment_id, entry_id) it lacks: however often a payment comes, it is told once."""
    return insert_missing(outbox, found, ["payment_id", "entry_id"])


def mark_sent(outbox: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Waiting rows named by (payment_id, entry_id) are sent."""
    keys = ["payment_id", "entry_id"]
    return update_keyed(outbox, sent.select(*keys).distinct().select(*keys, F.lit("sent").alias("status"), as_of.alias("sent_at")), keys, ["status", "sent_at"], guard=F.col("status") == "waiting")


def admin_notices(pending: DataFrame, tournaments: DataFrame, run_id: int, as_of: Column) -> DataFrame:
    """Outbox rows about the names that a run has left waiting: pending_id, title, starts_at, raw_player_name, candidates (names with their distances, in their order), status, created_at.

    A name that waits again in a later run is told of again: its candidates may be others. An event that isn't known leaves its columns null.
    """
    rows = pending.where((F.col("status") == "pending") & (F.col("sync_run_id") == run_id))
    told = F.transform("candidates", lambda c: F.struct(c["name"].alias("name"), c["dist"].alias("dist")))
    events = tournaments.select(F.col("id").alias("tournament_id"), "title", "starts_at")
    return rows.join(events, "tournament_id", "left").select(F.col("id").alias("pending_id"), "title", "starts_at", "raw_player_name", told.alias("candidates"), F.lit("waiting").alias("status"), as_of.alias("created_at"))


def note_messages(pending: DataFrame, sent: DataFrame) -> DataFrame:
    """pending after notices have been sent (id, admin_message_id): the last message of each row is kept, whatever its status by now; null ids of messages change nothing."""
    last = sent.where("admin_message_id IS NOT NULL").groupBy("id").agg(F.max("admin_message_id").alias("admin_message_id"))
    return update_keyed(pending, last, ["id"], ["admin_message_id"])
