"""Names in quarantine: their life cycle, and the merge of duplicate people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.operators.mutate import cascade_delete, delete_keyed, insert_missing, last_wins, null_references, update_keyed, upsert, with_new_ids
from quillroster.sources.staging import staged


def quarantine(pending: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Ambiguous names (tournament_id, raw_player_name, normalized_name, candidates, sync_run_id): one pending row for each event and name.

    A pending row that is there takes the new candidates, raw name, run and time; resolved ones stay beside.
    """
    keys = ["tournament_id", "normalized_name"]
    new = last_wins(found.select("tournament_id", "normalized_name", "raw_player_name", "sync_run_id", F.to_json("candidates").alias("_c")), keys, ["raw_player_name"])
    new = new.join(found.select("tournament_id", "normalized_name", "raw_player_name", "candidates").dropDuplicates([*keys, "raw_player_name"]), [*keys, "raw_player_name"]).drop("_c")
    payload = F.struct("tournament_id", "raw_player_name", "normalized_name", F.lit(None).cast("long").alias("created_player_id"))
    new = new.withColumn("payload", payload).withColumn("created_at", as_of).withColumn("status", F.lit("pending"))
    waiting = pending.where(F.col("status") == "pending")
    fresh = with_new_ids(new.join(waiting.select(*keys), keys, "left_anti"), pending, keys)
    kept = update_keyed(pending, new, keys, ["candidates", "raw_player_name", "payload", "sync_run_id", "created_at"], guard=F.col("status") == "pending")
    return kept.unionByName(fresh, allowMissingColumns=True)


def transition(pending: DataFrame, decided: DataFrame, as_of: Column) -> DataFrame:
    """decided (id, status, resolved_player_id): only pending rows change; snoozed ones note when, resolved and approved ones whom."""
    new = decided.select("id", F.col("status").alias("_to"), F.col("resolved_player_id").alias("_who"))
    rows = pending.join(new, "id", "left").withColumn("_hit", (F.col("status") == "pending") & F.col("_to").isNotNull())
    hit = lambda *to: F.col("_hit") & F.col("_to").isin(*to)
    rows = rows.withColumn("notified_at", F.when(hit("snoozed"), as_of).otherwise(F.col("notified_at"))).withColumn("resolved_at", F.when(hit("resolved"), as_of).otherwise(F.col("resolved_at")))
    rows = rows.withColumn("resolved_player_id", F.when(hit("resolved"), F.col("_who")).otherwise(F.col("resolved_player_id")))
    rows = rows.withColumn("payload", F.when(hit("approved") & F.col("_who").isNotNull(), F.col("payload").withField("created_player_id", F.col("_who"))).otherwise(F.col("payload")))
    return rows.withColumn("status", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("status"))).select(*pending.columns)


def _twins(players: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, _target): the other people of each target's normalised name, or of the name that targets give beside it."""
    norm = players.select("id", "normalized_name").where(F.length("normalized_name") > 0)
    wanted = targets.select(F.col("player_id").alias("_target")).distinct()
    if "normalized_name" in targets.columns:
        named = targets.select(F.col("player_id").alias("_target"), "normalized_name").where(F.length("normalized_name") > 0).distinct()
    else:
        named = norm.join(wanted, F.col("id") == F.col("_target")).select("_target", "normalized_name")
    twins = norm.join(named, "normalized_name").where("id <> _target").groupBy("id").agg(F.min("_target").alias("_target"))
    # Who is a target stays.
    return twins.join(wanted.select(F.col("_target").alias("id")), "id", "left_anti")


def merge_plan(players: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (player_id, and normalized_name where the others bear another name) -> what happens to the entries of the other people of that name: id, action (deleted or repointed), player_id.

    An entry is deleted where the target, or an entry of smaller id that moves to it, has that event already.
    """
    moving = entries.join(_twins(players, targets).withColumnRenamed("id", "player_id"), "player_id").select("id", "tournament_id", "_target")
    has = entries.select("tournament_id", F.col("player_id").alias("_target"), F.lit(True).alias("_has")).distinct()
    first = moving.groupBy("tournament_id", "_target").agg(F.min("id").alias("_first"))
    rows = moving.join(has, ["tournament_id", "_target"], "left").join(first, ["tournament_id", "_target"])
    keep = F.col("_has").isNull() & (F.col("id") == F.col("_first"))
    return rows.select("id", F.when(keep, "repointed").otherwise("deleted").alias("action"), F.col("_target").alias("player_id"))


def merge_people(players: DataFrame, entries: DataFrame, aliases: DataFrame, pending: DataFrame, targets: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Next players, entries, aliases and pending rows after duplicates of the targets are merged into them."""
    plan = staged(merge_plan(players, entries, targets), "merge")
    kept = delete_keyed(entries, plan.where("action = 'deleted'"), ["id"])
    kept = update_keyed(kept, plan.where("action = 'repointed'").select("id", "player_id", as_of.alias("last_seen_in_source")), ["id"], ["player_id", "last_seen_in_source"])
    gone = staged(_twins(players, targets).select("id"), "gone")
    gone_entries = plan.where("action = 'deleted'").select("id")
    for column in ("paid_for_entry_id", "paid_by_entry_id"):
        kept = null_references(kept, gone_entries, column)
    return {"players": delete_keyed(players, gone, ["id"]), "entries": kept, "player_aliases": cascade_delete(aliases, gone, "player_id"), "pending_entries": null_references(pending, gone, "resolved_player_id")}


def add_aliases(aliases: DataFrame, learned: DataFrame, as_of: Column) -> DataFrame:
    """learned (alias_name, normalized_alias, player_id, created_by_telegram_id): a known alias changes its person, a new one is added."""
    new = last_wins(learned, ["normalized_alias"], ["player_id"]).withColumn("created_at", as_of)
    fresh = with_new_ids(new.join(aliases.select("normalized_alias"), "normalized_alias", "left_anti"), aliases, ["normalized_alias"])
    known = upsert(aliases, new.join(aliases.select("normalized_alias"), "normalized_alias", "left_semi"), ["normalized_alias"], ["player_id", "alias_name", "created_by_telegram_id"])
    return insert_missing(known, fresh, ["normalized_alias"])


def review_batch(pending: DataFrame, tournaments: DataFrame, limit: int = 50) -> DataFrame:
    """Pending rows nobody has been told about, with their event, the oldest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    rows = pending.where((F.col("status") == "pending") & F.col("notified_at").isNull())
    t = tournaments.select(F.col("id").alias("tournament_id"), "title", "starts_at", "location")
    return rows.join(t, "tournament_id").orderBy(F.asc_nulls_last("created_at"), "id").limit(limit)
