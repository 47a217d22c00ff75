"""Payment events applied to entries, and the checks before a payment is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.functions import money as M
from quillroster.operators.mutate import update_keyed
from quillroster.sources.staging import staged


def payment_changes(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries that events (event, payment_id, amount_text) mark as paid: id, role (payer or partner), paid_by_entry_id, amount.

    Only succeeded payments count, once for each payment id however often they come. Where events have
    arrived_at, the first to arrive counts, with its amount or none (of several at one time, the
    largest); else the amount is the largest that could be read. The payer is the entry of smallest id with that payment id; its
    partner is paid with it, by the same amount, if the scope is pair. Paid entries don't change.
    """
    amount = M.lenient_amount(F.col("amount_text"))
    counted = F.min_by(amount, F.struct("arrived_at", F.negative(amount))) if "arrived_at" in events.columns else F.max(amount)
    # Staged: what is left of the events is known to be small, and isn't made again.
    paid = staged(events.where((F.col("event") == "payment.succeeded") & F.col("payment_id").isNotNull()).groupBy("payment_id").agg(counted.alias("_amount")), "paid")
    payer_ids = staged(entries.select("payment_id", "id").join(paid, "payment_id").groupBy("payment_id").agg(F.min("id").alias("id")), "payer_ids")
    payer = staged(payer_ids.join(paid, "payment_id").join(entries.select("id", "payment_scope", "paid_for_entry_id", "payment_status"), "id"), "payers")
    first = payer.where("payment_status <> 'paid'").select("id", F.lit("payer").alias("role"), F.lit(None).cast("long").alias("paid_by_entry_id"), F.col("_amount").alias("amount"))
    pairs = payer.where("payment_scope = 'pair' AND paid_for_entry_id IS NOT NULL").select(F.col("paid_for_entry_id").alias("id"), F.col("id").alias("paid_by_entry_id"), F.col("_amount").alias("amount"))
    if pairs.isEmpty():
        return first
    open_ = entries.where(F.col("payment_status") != "paid").select("id")
    second = pairs.join(open_, "id", "left_semi").select("id", F.lit("partner").alias("role"), "paid_by_entry_id", "amount")
    both = first.unionByName(second)
    # An entry that pays and is paid for in one batch has paid itself.
    return both.groupBy("id").agg(F.max(F.struct("role", F.negative("paid_by_entry_id").alias("_by"), "amount")).alias("_c")).select("id", F.col("_c.role").alias("role"), F.negative(F.col("_c._by")).alias("paid_by_entry_id"), F.col("_c.amount").alias("amount"))


def paid_entries(entries: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """entries, or a part of them, after the changes that payment_changes has found."""
    new = changes.select(F.col("id").alias("_id"), "role", F.col("paid_by_entry_id").alias("_by"), "amount")
    open_ = F.col("role").isNotNull() & F.coalesce(F.col("payment_status") != "paid", F.lit(False))
    after = {"payment_status": F.lit("paid"), "paid_at": as_of, "paid_by_entry_id": F.coalesce(F.when(F.col("role") == "partner", F.col("_by")), F.col("paid_by_entry_id")), "paid_amount_rub": F.coalesce("amount", "paid_amount_rub")}
    value = lambda c: F.when(open_, after[c]).otherwise(F.col(c)).cast(entries.schema[c].dataType).alias(c) if c in after else F.col(c)
    return entries.join(new, F.col("id") == F.col("_id"), "left").select(*map(value, entries.columns))


def apply_payments(entries: DataFrame, events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next entries, change set). Applying the same events again changes nothing."""
    changes = payment_changes(entries, events)
    return paid_entries(entries, changes, as_of), changes


def notify_set(entries: DataFrame, payment_ids: DataFrame) -> DataFrame:
    """Entries with one of the payment ids, and those that were paid for by such an entry."""
    payers = entries.join(payment_ids.select("payment_id").distinct(), "payment_id", "left_semi")
    partners = entries.join(payers.select(F.col("id").alias("paid_by_entry_id")), "paid_by_entry_id", "left_semi").select(*entries.columns)
    return payers.select(*entries.columns).unionByName(partners).distinct()


def revenue(entries: DataFrame) -> DataFrame:
    """Paid amounts by event; an entry that another has paid for is part of that payment."""
    return entries.where("payment_status = 'paid' AND paid_by_entry_id IS NULL").groupBy("tournament_id").agg(F.sum("paid_amount_rub").cast("decimal(20,2)").alias("revenue"))


def pair_error(payer_id: Column, partner_id: Column, found_id: Column, payer_event: Column, partner_event: Column, partner_status: Column) -> Column:
    """Why an entry can't pay for a partner's; null if it can."""
    return F.when(partner_id.isNull(), F.lit(None).cast("string")).when(payer_id == partner_id, "self").when(found_id.isNull(), "missing").when(payer_event != partner_event, "other_event").when(partner_status == "paid", "already_paid")


def team_error(found: Column, events: Column, kind: Column, open_: Column) -> Column:
    """Why two entries can't be linked as a team: both exist, one event, of teams, neither paid."""
    return F.when(found != 2, "missing").when(events != 1, "other_event").when(kind != "team", "not_team").when(open_ != 2, "already_paid")


def reusable(provider_status: Column, scope: Column, wanted_scope: Column, partner: Column, wanted_partner: Column) -> Column:
    """Whether a pending payment can be offered again."""
    return (provider_status == "pending") & scope.eqNullSafe(wanted_scope) & ((wanted_scope != "pair") | partner.eqNullSafe(wanted_partner))


def mark_manual(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entries (id, manual_note) paid by hand: neither a time nor an amount is kept."""
    new = chosen.select("id", F.lit("paid").alias("payment_status"), F.lit(True).alias("manual_paid"), "manual_note", F.lit(None).cast("string").alias("payment_url"), F.lit(None).cast("string").alias("payment_id"))
    return update_keyed(entries, new, ["id"], ["payment_status", "manual_paid", "manual_note", "payment_url", "payment_id"])
