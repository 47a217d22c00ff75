"""Read models: roll-up and detail views, lists for a person, pages, load audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.functions import timeops as D
from quillroster.operators.ranking import ranked

PAGE = 10


def event_rollup(tournaments: DataFrame, entries: DataFrame) -> DataFrame:
    """Events that aren't archived, with counts of all, paid and pending entries (inactive ones too); events without entries stay."""
    e = entries.select(F.col("tournament_id").alias("_t"), F.col("id").alias("_e"), "payment_status")
    # Counting before joining: one row for each event is joined, however many entries it has.
    counts = e.groupBy("_t").agg(F.count("_e").alias("entries_total"), F.count(F.when(F.col("payment_status") == "paid", F.col("_e"))).alias("entries_paid"), F.count(F.when(F.col("payment_status") == "pending", F.col("_e"))).alias("entries_pending"))
    live = tournaments.where(F.col("archived_at").isNull())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return live.join(counts, F.col("id") == F.col("_t"), "left").select(F.col("id").alias("tournament_id"), *[c for c in live.columns if c != "id"], zero("entries_total"), zero("entries_paid"), zero("entries_pending"))


def entry_details(entries: DataFrame, players: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Entries with their person's and event's columns, prefixed; entries without either are left out."""
    p = players.select(*[F.col(c).alias(f"player_{c}" if c != "id" else "_p") for c in players.columns])
    t = tournaments.select(*[F.col(c).alias(f"tournament_{c}" if c != "id" else "_t") for c in tournaments.columns])
    return entries.join(p, F.col("player_id") == F.col("_p")).join(t, F.col("tournament_id") == F.col("_t")).drop("_p", "_t")


def last_sync(tournaments: DataFrame) -> DataFrame:
    """One row: the newest source time and the number of live events."""
    return tournaments.agg(F.max("source_last_updated").alias("last_sync"), F.count(F.when(F.col("archived_at").isNull(), 1)).alias("live_tournaments"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last; nulls count as newest, as in a descending SQL sort; ties go to the larger id."""
    return runs.orderBy(F.desc_nulls_first("started_at"), F.desc("id")).limit(1)


def upcoming_dates(tournaments: DataFrame, as_of: Column, most: int = 10, day: Column | None = None) -> DataFrame:
    """The first dates, as people see them, with live events from now on."""
    day = D.shown_date(F.col("starts_at")) if day is None else day
    return tournaments.where(F.col("archived_at").isNull() & (F.col("starts_at") >= as_of)).select(day.alias("day")).distinct().orderBy("day").limit(most)


def on_date(tournaments: DataFrame, day: Column) -> DataFrame:
    return tournaments.where(F.col("archived_at").isNull() & (D.shown_date(F.col("starts_at")) == day)).select("id", "title", "starts_at", "location").orderBy(F.asc_nulls_last("starts_at"), "id")


def upcoming_for_person(entries: DataFrame, tournaments: DataFrame, player_id: Column, as_of: Column) -> DataFrame:
    """A person's active entries in live events that are ahead, by start."""
    own = entries.where((F.col("player_id") == player_id) & (F.col("active") == F.lit(True))).select(F.col("id").alias("entry_id"), "tournament_id", "payment_status")
    ahead = tournaments.where(F.col("archived_at").isNull() & (F.col("starts_at") > as_of)).withColumnRenamed("id", "_t")
    return own.join(ahead, F.col("tournament_id") == F.col("_t")).drop("_t").orderBy(F.asc_nulls_last("starts_at"), "entry_id")


def roster(entries: DataFrame, players: DataFrame, tournament_id: Column) -> DataFrame:
    """Active people of one event, by name."""
    own = entries.where((F.col("tournament_id") == tournament_id) & (F.col("active") == F.lit(True))).select("player_id")
    return own.join(players.select(F.col("id").alias("player_id"), "full_name"), "player_id").orderBy(F.asc_nulls_last("full_name"), "player_id")


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page `number` (from 0) of rows, with place, has_previous and has_next. Only the first pages, and one row more, are placed."""
    first = rows.orderBy(*order).limit((number + 1) * size + 1)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    many = placed.withColumn("_n", F.count("*").over(Window.partitionBy()))
    own = many.where((F.col("place") > number * size) & (F.col("place") <= (number + 1) * size))
    return own.withColumn("has_previous", F.lit(number > 0)).withColumn("has_next", F.col("_n") > (number + 1) * size).drop("_n")


def rosters(entries: DataFrame, players: DataFrame) -> DataFrame:
    """tournament_id, player_id, full_name: each event's active people, once each."""
    own = entries.where(F.col("active") == F.lit(True)).select("tournament_id", "player_id").distinct()
    return own.join(players.select(F.col("id").alias("player_id"), "full_name"), "player_id").select("tournament_id", "player_id", "full_name")


def pages(rows: DataFrame, by: list[str], order: list[Column], size: int = PAGE) -> DataFrame:
    """All pages of each group of rows: place in the group, page (from 0), has_previous and has_next.

    Places come from ranges of (group, order), so that the rows of one very large group are spread over tasks.
    """
    key = by[0] if len(by) == 1 else "_by"
    placed = ranked(rows if len(by) == 1 else rows.withColumn(key, F.struct(*by)), key, order, "pages")
    many = placed.select(*rows.columns, (F.col("_pos") + 1).cast("int").alias("place"), F.floor(F.col("_pos") / size).cast("int").alias("page"), "_total")
    return many.withColumn("has_previous", F.col("page") > 0).withColumn("has_next", F.col("_total") > (F.col("page") + 1) * size).drop("_total")


def pair_names(entries: DataFrame, players: DataFrame) -> DataFrame:
    """entry_id, paid_for_name, paid_by_name: the people behind the entries that an entry paid for or was paid by."""
    names = entries.select(F.col("id").alias("_e"), F.col("player_id").alias("_p")).join(players.select(F.col("id").alias("_p"), "full_name"), "_p").select("_e", "full_name")
    some = entries.where("paid_for_entry_id IS NOT NULL OR paid_by_entry_id IS NOT NULL").select(F.col("id").alias("entry_id"), "paid_for_entry_id", "paid_by_entry_id")
    for side in ("paid_for", "paid_by"):
        n = names.select(F.col("_e").alias(f"{side}_entry_id"), F.col("full_name").alias(f"{side}_name"))
        some = some.join(n, f"{side}_entry_id", "left")
    return some.select("entry_id", "paid_for_name", "paid_by_name")


def confirm_pick(players: DataFrame, tournaments: DataFrame, player_id: int | Column, tournament_id: int | Column) -> DataFrame:
    """One row of one person and one event, named by ids or by expressions over one row that is joined to each."""
    p = players.where(F.col("id") == player_id).select("full_name").limit(1)
    t = tournaments.where(F.col("id") == tournament_id).select("title", "location", "starts_at").limit(1)
    return p.crossJoin(t)  # one row on either side


def dashboard(rollup: DataFrame, as_of: Column, archived: bool = False, past: bool = False) -> DataFrame:
    """The dashboard's rows: archived ones on request, past and undated ones on request; a missing flag counts as active."""
    shown = F.lit(archived) | F.col("archived_at").isNull()
    dated = F.lit(past) | F.coalesce(F.col("starts_at") >= as_of, F.lit(False))
    return rollup.where(shown & dated).withColumn("location", X.blank_to_null(F.col("location"))).withColumn("tournament_type", F.coalesce(X.blank_to_null(F.col("tournament_type")), F.lit("personal"))).withColumn("active", F.coalesce("active", F.lit(True)))


def entry_state(status: Column, active: Column) -> Column:
    off = F.coalesce(~active, F.lit(False))
    return F.when(off & (status == "paid"), "paid_inactive").when(off, "inactive").otherwise("active")


def notice_badge(chat_id: Column, notified: Column) -> Column:
    return F.when(chat_id.isNull() | (chat_id == ""), "no_chat").when(F.coalesce(notified, F.lit(False)), "sent").otherwise("not_sent")


def match_events(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked (ask_id, place_name, starts_at) -> ask_id and the first event (by position) at that second whose location or title is that name."""
    probe = asked.select("ask_id", "place_name", D.to_second(F.col("starts_at")).alias("_at"))
    keyed = events.select("position", F.explode(F.array_distinct(F.array("location", "title"))).alias("place_name"), D.to_second(F.col("starts_at")).alias("_at"))
    return probe.join(keyed, ["place_name", "_at"]).groupBy("ask_id").agg(F.min("position").alias("position"))
