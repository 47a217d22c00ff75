"""Snapshot reconciliation: events and rosters as they are now against the state before."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.functions import timeops as D
from quillroster.operators.mutate import expire, insert_missing, last_wins, update_keyed, upsert, with_new_ids
from quillroster.operators.pending import quarantine
from quillroster.operators.resolve import resolve_in_order
from quillroster.sources.readers import rosters, snapshot_problem, snapshot_rows
from quillroster.sources.schemas import conform
from quillroster.sources.staging import staged


@dataclass
class Reconciled:
    """Next tables, the change set of entries, and one row of counters.

    due: the next tables that nothing else in the import builds on; they are made and staged when tables is first asked for.
    """

    ready: dict[str, DataFrame]
    due: dict[str, DataFrame]
    changes: DataFrame
    counters: DataFrame

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return self.ready | {name: staged(df, name) for name, df in self.due.items()}


def entry_actions(prior: DataFrame, incoming: DataFrame, scope: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(tournament_id, player_id, action) by one full outer join.

    prior: entries with payment_status, manual_paid; incoming: (tournament_id, player_id) pairs of
    the rosters; scope: events that the snapshot has. Actions: new, existing, inactivated (paid or
    by hand, no longer on the roster) and deleted; entries of other events take no part. With listed
    (pairs), prior entries that it lacks are leavers even if incoming has them, and those that only it
    has stay as they are.
    """
    keys = ["tournament_id", "player_id"]
    old = prior.join(scope.select("tournament_id").distinct(), "tournament_id", "left_semi").groupBy(*keys).agg(F.max((F.col("payment_status") == "paid") | F.coalesce("manual_paid", F.lit(False))).alias("_kept"))
    now = incoming.select(*keys).distinct().withColumn("_now", F.lit(True))
    both = old.withColumn("_old", F.lit(True)).join(now, keys, "full_outer")
    stays, leaves = F.col("_now"), F.when(F.col("_kept"), "inactivated").otherwise("deleted")
    if listed is not None:
        both = both.join(listed.select(*keys).distinct().withColumn("_listed", F.lit(True)), keys, "left")
        stays = F.col("_now") & F.col("_listed")
        leaves = F.when(F.col("_listed"), F.lit(None)).otherwise(leaves)
    action = F.when(F.col("_old").isNull(), "new").when(stays, "existing").otherwise(leaves)
    return both.select(*keys, action.alias("action")).where("action IS NOT NULL")


def next_entries(entries: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Entries after the actions: new ones are pending, seen ones active, leavers inactive or gone. actions are read twice: see staging."""
    keys = ["tournament_id", "player_id"]
    rows = entries.join(actions.where("action <> 'new'"), keys, "left").where("action IS NULL OR action <> 'deleted'")
    rows = rows.withColumn("active", F.when(F.col("action") == "existing", True).when(F.col("action") == "inactivated", False).otherwise(F.col("active")))
    rows = rows.withColumn("last_seen_in_source", F.when(F.col("action") == "existing", as_of).otherwise(F.col("last_seen_in_source"))).select(*entries.columns)
    new = actions.where("action = 'new'").select(*keys, as_of.alias("first_seen_in_source"), as_of.alias("last_seen_in_source"), as_of.alias("created_at"))
    return rows.unionByName(conform(with_new_ids(new, entries, keys), "entries").select(*entries.columns))


def next_tournaments(tournaments: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Events upserted on (location, starts_at): the last record wins; archived ones come back; when they were first seen stays."""
    keys = ["location", "starts_at"]
    new = last_wins(events.select(*keys, "position", "ends_at", "organizer", "title", "price_rub", "source_last_updated", "tournament_type"), keys, ["position"]).drop("position")
    new = new.withColumns({"archived_at": F.lit(None).cast("timestamp"), "active": F.lit(True), "last_seen_in_source": as_of, "first_seen_in_source": as_of, "source": F.lit("import")})
    update = ["ends_at", "organizer", "title", "price_rub", "source_last_updated", "tournament_type", "archived_at", "active", "last_seen_in_source", "source"]
    known = upsert(tournaments, new.join(tournaments.select(*keys), keys, "left_semi"), keys, update)
    fresh = with_new_ids(new.join(tournaments.select(*keys), keys, "left_anti"), tournaments, keys)
    return insert_missing(known, conform(fresh, "tournaments"), keys)


def next_players(players: DataFrame, new_names: DataFrame) -> DataFrame:
    """new_names (name, norm): unknown full names are added; a known one's missing normalised name is filled."""
    named = new_names.select(F.col("name").alias("full_name"), F.col("norm").alias("normalized_name")).distinct()
    filled = upsert(players, named.join(players.select("full_name"), "full_name", "left_semi"), ["full_name"], [], fill=["normalized_name"])
    fresh = with_new_ids(named.join(players.select("full_name"), "full_name", "left_anti"), players, ["full_name"])
    return insert_missing(filled, fresh, ["full_name"])


def backfill_names(players: DataFrame) -> DataFrame:
    return players.withColumn("normalized_name", F.coalesce("normalized_name", X.normalize_name_sql(F.col("full_name"))))


def to_archive(tournaments: DataFrame, run_start: Column, cutoff: Column, processed: DataFrame) -> DataFrame:
    """(id, reason): live events that are past, and of the others those that this run has not seen."""
    live = tournaments.where(F.col("archived_at").isNull())
    past = F.coalesce(F.col("starts_at") < cutoff, F.lit(False))
    unseen = F.col("last_seen_in_source").isNull() | (F.col("last_seen_in_source") < run_start)
    missing = live.where(~past & unseen).join(processed.select("id").distinct(), "id", "left_anti").select("id", F.lit("missing").alias("reason"))
    return live.where(past).select("id", F.lit("past").alias("reason")).unionByName(missing)


def archive(tournaments: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    return update_keyed(tournaments, chosen.select("id", as_of.alias("archived_at")), ["id"], ["archived_at"], guard=F.col("archived_at").isNull())


def counters(changes: DataFrame) -> DataFrame:
    """One row with a count for each action."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).cast("int")
    return changes.agg(n("new").alias("entries_new"), n("existing").alias("entries_existing"), n("inactivated").alias("entries_inactivated"), n("deleted").alias("entries_deleted"))


def event_counters(events: DataFrame, cutoff: Column) -> DataFrame:
    """One row: records of events that are taken, and those skipped as undated or past."""
    taken = F.coalesce(F.col("starts_at") >= cutoff, F.lit(False))
    return events.agg(F.count(F.when(taken, 1)).cast("int").alias("tournaments_upsert"), F.count(F.when(~taken, 1)).cast("int").alias("tournaments_skipped_past"))


def duplicate_events(events: DataFrame) -> DataFrame:
    """(location, starts_at, records): events that a snapshot has several times; the last of them is the one that is applied."""
    return events.where("starts_at IS NOT NULL").groupBy("location", "starts_at").agg(F.count("*").alias("records")).where("records > 1")


def reconcile(tables: dict[str, DataFrame], events: DataFrame, run_id: int, as_of: Column, leavers_by_name: bool = False, failed: DataFrame | None = None) -> Reconciled:
    """Apply a snapshot's events to the tables: the whole import as one set of joins.

    Events without a start or past the grace are skipped. Rosters are resolved to people name by name
    in the order of the file (see resolve_in_order); ambiguous names are quarantined. Leavers are judged by resolved people, so that who is found by an alias
    stays; with leavers_by_name by the exact names of the roster instead. Events in failed (location,
    starts_at) are left as they are, and are no missing ones' company: they count as not seen. A
    snapshot without events is refused, as it would archive every event. Each step that later ones
    build on is staged: written once to the shared folder and read back. The caller writes the
    tables, once, as a new version.
    """
    if events.isEmpty():
        raise ValueError("the snapshot has no events")
    cutoff = as_of - D.hours(D.IMPORT_GRACE_HOURS)
    current = events.where(F.col("starts_at") >= cutoff)
    if failed is not None:
        current = current.join(failed.select("location", "starts_at").distinct(), ["location", "starts_at"], "left_anti")
    tournaments = staged(next_tournaments(tables["tournaments"], current, as_of), "tournaments")
    last = last_wins(current.select("location", "starts_at", "position", "participants"), ["location", "starts_at"], ["position"])
    seen = staged(tournaments.select(F.col("id").alias("tournament_id"), "location", "starts_at").join(last, ["location", "starts_at"]).select("tournament_id", "position", "participants"), "seen")
    # Names in the order of the file; the event and the name tell those of several files apart.
    names = rosters(seen, "tournament_id", "position").groupBy("tournament_id", F.col("raw_player_name").alias("name")).agg(F.min(F.struct("position", "place")).alias("_at"))
    names = names.select("tournament_id", "name", F.struct("_at.position", "_at.place", "tournament_id", "name").alias("seq"))
    resolved, fresh = resolve_in_order(names, tables["player_aliases"], tables["players"])
    resolved = staged(resolved, "resolved")
    players = staged(insert_missing(tables["players"], fresh, ["full_name"]), "players")
    ids = players.groupBy(F.col("full_name").alias("name")).agg(F.min("id").alias("_named_id"))
    placed = staged(resolved.join(ids, "name", "left"), "placed")
    here = placed.where("player_id IS NOT NULL")
    listed = placed.where("_named_id IS NOT NULL").select("tournament_id", F.col("_named_id").alias("player_id")) if leavers_by_name else None
    changes = staged(entry_actions(tables["entries"], here, seen, listed), "changes")
    entries = next_entries(tables["entries"], changes, as_of)
    doubtful = placed.where("outcome = 'ambiguous'").select("tournament_id", F.col("name").alias("raw_player_name"), F.col("norm").alias("normalized_name"), "candidates", F.lit(run_id).cast("long").alias("sync_run_id"))
    pending = expire(quarantine(tables["pending_entries"], doubtful, as_of), F.lit(run_id))
    gone = staged(to_archive(tournaments, as_of, cutoff, seen.select(F.col("tournament_id").alias("id"))), "gone")
    after = archive(tournaments, gone, as_of)
    # One row each; the tournaments of a snapshot are never deleted.
    counted = counters(changes).crossJoin(here.agg(F.count_distinct("tournament_id", "player_id").cast("int").alias("players_upsert"))).crossJoin(event_counters(events, cutoff)).crossJoin(gone.agg(F.count("*").cast("int").alias("tournaments_archived"), F.lit(0).alias("tournaments_deleted")))
    return Reconciled(tables | {"players": players}, {"tournaments": after, "entries": entries, "pending_entries": pending}, changes, staged(counted, "counted"))


def import_snapshot(tables: dict[str, DataFrame], docs: DataFrame, run_id: int, as_of: Column, leavers_by_name: bool = False) -> Reconciled:
    """Apply the snapshot documents (value, file, modified_at); one that is broken or has no events stops the import before anything is changed."""
    problems = snapshot_problem(docs).limit(5).collect()
    if problems or docs.isEmpty():
        raise ValueError("no import: " + ("; ".join(f"{r['file']}: {r['problem']}" for r in problems) or "no snapshot"))
    return reconcile(tables, staged(snapshot_rows(docs), "events"), run_id, as_of, leavers_by_name)


def run_row(run_id: int, counted: DataFrame, started_at: Column, finished_at: Column, path: str, modified_at: Column | None = None, error: str | None = None) -> DataFrame:
    """The load-audit row of a run, with the source file's time and, if it failed, why."""
    return conform(counted.withColumns({"id": F.lit(run_id), "source": F.lit("import"), "started_at": started_at, "finished_at": finished_at, "created_at": started_at, "json_path": F.lit(path), "json_mtime": F.lit(None) if modified_at is None else modified_at, "error": F.lit(error)}), "sync_runs")


def import_status(runs: DataFrame, lines: DataFrame, as_of: Column, most_hours: int = 2) -> DataFrame:
    """One row: the last run's start, end, error and age in hours, whether it is recent, and how often the log says that a run began by itself or by hand."""
    last = runs.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(1).select("id", "started_at", "finished_at", "error")
    kinds = lines.agg(F.count(F.when(F.col("value").contains("RUN TYPE: AUTOMATIC"), 1)).alias("automatic_runs"), F.count(F.when(F.col("value").contains("RUN TYPE: MANUAL"), 1)).alias("manual_runs"))
    age = D.age_hours(F.coalesce("finished_at", "started_at"), as_of)
    return kinds.join(last, F.lit(True), "left").withColumn("age_hours", age).withColumn("recent", F.coalesce(age < most_hours, F.lit(False)))  # one row on either side
