"""Decisions about waiting names, as if they had been taken one by one in their order.

A decision is refused if its row has been decided before, or if its person has been merged away by an
earlier one that stands. So whether a decision stands hangs on earlier ones, and those that contradict
each other are settled by rounds, as names are (resolve.fallen). What stands says when each person is merged into whom;
the merges are followed to their ends by pointer jumping, and the way that an entry takes from person to
person says which of those that meet in an event is the one that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.operators.mutate import cascade_delete, delete_keyed, last_wins, null_references, update_keyed, with_new_ids
from quillroster.operators.pending import add_aliases, transition
from quillroster.operators.ranking import ranked
from quillroster.operators.resolve import fallen
from quillroster.sources.schemas import conform
from quillroster.sources.staging import staged

#: What can be decided about a waiting name.
KINDS = ("resolved", "approved", "new_person", "rejected", "snoozed")
#: One step of an entry's way: when it came, and which of those that came at that time it is.
STEP = "array<struct<at: bigint, tie: bigint>>"


def judged(tables: dict[str, DataFrame], decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions (id, decision, player_id, by and, for their order, seq) -> those that stand, and the refused ones.

    Standing: id, decision, player_id, by, _t (their order), tournament_id, raw_player_name,
    normalized_name. Refused: id, decision, player_id, by, reason (unknown_decision, not_waiting,
    no_person, unknown_person, already_decided, person_gone: the first that holds). Without seq, the order is
    that of id, decision and person.
    """
    seq = ["seq"] if "seq" in decisions.columns else []
    asked = ranked(decisions.select("id", "decision", "player_id", "by", *seq), None, [F.col(c) for c in (*seq, "id", "decision", "player_id", "by")], "asked").drop("_total", *seq).withColumnRenamed("_pos", "_t")
    waiting = tables["pending_entries"].where("status = 'pending'").select("id", "tournament_id", "raw_player_name", "normalized_name", F.lit(True).alias("_waits"))
    there = tables["players"].select(F.col("id").alias("player_id"), F.col("normalized_name").alias("_bears"), F.lit(True).alias("_there"))
    rows = asked.join(waiting, "id", "left").join(there, "player_id", "left")
    named = F.col("decision").isin("resolved", "approved")
    wrong = F.when(~F.coalesce(F.col("decision").isin(*KINDS), F.lit(False)), "unknown_decision").when(F.col("_waits").isNull(), "not_waiting").when(named & F.col("player_id").isNull(), "no_person").when(named & F.col("_there").isNull(), "unknown_person")
    rows = staged(rows.withColumn("reason", wrong), "judged")

    # Of decisions about a row that say the same, the first stands or falls for all.
    said = ["id", "decision", "player_id"]
    fit = rows.where("reason IS NULL").groupBy(*said).agg(F.min(F.struct("_t", "by", "tournament_id", "raw_player_name", "normalized_name", "_bears")).alias("_d")).select(*said, "_d.*")
    fit = staged(fit, "fit")
    before = fit.select(F.col("id").alias("_bid"), F.col("_t").alias("before"))
    same_row = fit.join(before, (F.col("id") == F.col("_bid")) & (F.col("before") < F.col("_t")))
    kills = fit.where((F.col("decision") == "resolved") & (F.length("normalized_name") > 0)).select(F.col("normalized_name").alias("_bears"), F.col("player_id").alias("_into"), F.col("_t").alias("before"))
    same_name = fit.where(named).join(kills, "_bears").where("_into <> player_id AND before < _t")
    edges = same_row.select(F.col("_t").alias("name"), "before").unionByName(same_name.select(F.col("_t").alias("name"), "before")).distinct()
    standing = staged(fit.join(fallen(edges).withColumnRenamed("name", "_t"), "_t", "left_anti").drop("_bears"), "standing")

    taken = standing.groupBy("id").agg(F.min("_t").alias("_taken"))
    late = rows.where("reason IS NULL").join(standing.select("_t"), "_t", "left_anti").join(taken, "id", "left")
    late = late.withColumn("reason", F.when(F.col("_taken") < F.col("_t"), "already_decided").otherwise("person_gone"))
    out = ["id", "decision", "player_id", "by", "reason"]
    return standing, rows.where("reason IS NOT NULL").select(*out).unionByName(late.select(*out))


def _deaths(players: DataFrame, kills: DataFrame) -> DataFrame:
    """kills (_norm, _into, _at) -> person, at, into: when each of the players is first merged into another, and into whom."""
    first = kills.groupBy("_norm", "_into").agg(F.min("_at").alias("_at"))
    two = first.withColumn("_rank", F.row_number().over(Window.partitionBy("_norm").orderBy("_at"))).where("_rank <= 2")
    by_norm = two.groupBy("_norm").agg(F.sort_array(F.collect_list(F.struct("_at", "_into"))).alias("_kills"))
    hit = players.select("id", F.col("normalized_name").alias("_norm")).join(by_norm, "_norm").withColumn("_kill", F.get(F.filter("_kills", lambda k: k["_into"] != F.col("id")), F.lit(0)))
    return hit.where("_kill IS NOT NULL").select(F.col("id").alias("person"), F.col("_kill._at").alias("at"), F.col("_kill._into").alias("into"))


def ways(deaths: DataFrame) -> DataFrame:
    """deaths (person, at, into), later along each way -> person, _root (whom the person ends in), _way (the steps up to there), _through (the people on it, the root last).

    Pointer jumping: each round doubles the steps that are known, so that there are as many rounds as the
    logarithm of the longest way.
    """
    step = F.array(F.struct(F.col("at").cast("long").alias("at"), F.col("person").cast("long").alias("tie")))
    known = staged(deaths.select("person", F.col("into").alias("_root"), step.alias("_way"), F.array("into").alias("_through")), "ways")
    while not known.join(known.select(F.col("person").alias("_root")), "_root", "left_semi").isEmpty():
        further = known.select(F.col("person").alias("_root"), F.col("_root").alias("_end"), F.col("_way").alias("_more"), F.col("_through").alias("_next"))
        on = lambda a, b: F.when(F.col("_end").isNull(), F.col(a)).otherwise(F.concat(a, b))
        known = staged(known.join(further, "_root", "left").select("person", F.coalesce("_end", "_root").alias("_root"), on("_way", "_more").alias("_way"), on("_through", "_next").alias("_through")), "ways")
    return known


def _made(players: DataFrame, deaths: DataFrame, kills: DataFrame, new: DataFrame) -> DataFrame:
    """new (raw_player_name, normalized_name, _t): whom each decision for a new person means: _t, _who, and _born where it makes them.

    The person of that full name, while there; else the one made by the first such decision since the last merge of that name.
    """
    bearer = players.select(F.col("id").alias("_bearer"), F.col("full_name").alias("raw_player_name")).join(deaths.select(F.col("person").alias("_bearer"), F.col("at").alias("_gone")), "_bearer", "left")
    last = new.join(kills.select(F.col("_norm").alias("normalized_name"), "_at"), "normalized_name").where("_at < _t").groupBy("_t").agg(F.max("_at").alias("_since"))
    rows = staged(new.join(bearer, "raw_player_name", "left").join(last, "_t", "left").withColumn("_there", F.col("_bearer").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") > F.col("_t")))).withColumn("_since", F.coalesce("_since", F.lit(-1).cast("long"))), "new_people")
    births = rows.where("NOT _there").groupBy("raw_player_name", "_since").agg(F.min("_t").alias("_born"), F.min("normalized_name").alias("normalized_name"))
    most = players.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one row
    births = staged(ranked(births, None, [F.col("_born")], "births").withColumn("_id", (F.lit(most) + 1 + F.col("_pos")).cast("long")), "births")
    whose = rows.join(births.select("raw_player_name", "_since", "_born", "_id"), ["raw_player_name", "_since"], "left")
    return whose.select("_t", F.when(F.col("_there"), F.col("_bearer")).otherwise(F.col("_id")).alias("_who"), F.when(~F.col("_there") & (F.col("_born") == F.col("_t")), F.col("_id")).alias("_born"), "raw_player_name", "normalized_name")


def _settled(entries: DataFrame, paths: DataFrame, meant: DataFrame, as_of: Column) -> DataFrame:
    """Entries after people have been merged along paths, and those who are meant (tournament_id, _who, _t) have been entered."""
    start = lambda at, tie: F.array(F.struct(at.cast("long").alias("at"), tie.cast("long").alias("tie")))
    nowhere = F.array().cast(STEP)
    moving = entries.select("id", "tournament_id", F.col("player_id").alias("person")).join(paths, "person")
    moving = moving.select("tournament_id", "_root", F.concat(F.reverse("_way"), start(F.lit(-1), F.col("id"))).alias("_key"), "id", F.concat(F.array("person"), F.col("_through")).alias("_by"))
    # Who a decision enters is entered after those whom it merges have come.
    asked = meant.where("tournament_id IS NOT NULL").join(paths.withColumnRenamed("person", "_who"), "_who", "left")
    asked = staged(asked.select("tournament_id", F.coalesce("_root", "_who").alias("_root"), F.concat(F.reverse(F.coalesce("_way", nowhere)), start(F.col("_t"), F.lit(2**62))).alias("_key"), F.lit(None).cast("long").alias("id"), F.concat(F.array("_who"), F.coalesce("_through", F.array().cast("array<bigint>"))).alias("_by"), "_who"), "asked")
    moving = staged(moving, "moving")
    met = moving.unionByName(asked.drop("_who"))
    pairs = met.select("tournament_id", "_root").distinct()
    own = entries.select("id", "tournament_id", F.col("player_id").alias("_root")).join(pairs, ["tournament_id", "_root"], "left_semi").select("tournament_id", "_root", start(F.lit(-1), F.col("id")).alias("_key"), "id", F.array("_root").alias("_by"))
    # The way from the end backwards: at each person, what was there first stays.
    stays = staged(met.unionByName(own).groupBy("tournament_id", "_root").agg(F.min(F.struct("_key", "id", "_by")).alias("_s")).select("tournament_id", "_root", F.col("_s.id").alias("id"), F.col("_s._by").alias("_by")), "stays")
    seen = asked.select("tournament_id", "_root", "_who").join(stays, ["tournament_id", "_root"]).where(F.array_contains("_by", F.col("_who")))
    gone = staged(moving.join(stays.where("id IS NOT NULL").select("id"), "id", "left_anti").select("id"), "gone_entries")
    moved = stays.join(moving.select("id"), "id", "left_semi").select("id", F.col("_root").alias("player_id"), as_of.alias("last_seen_in_source"))
    kept = update_keyed(delete_keyed(entries, gone, ["id"]), moved, ["id"], ["player_id", "last_seen_in_source"])
    kept = update_keyed(kept, seen.where("id IS NOT NULL").select("id").distinct().select("id", F.lit(True).alias("active"), as_of.alias("last_seen_in_source")), ["id"], ["active", "last_seen_in_source"])
    for column in ("paid_for_entry_id", "paid_by_entry_id"):
        kept = null_references(kept, gone, column)
    fresh = with_new_ids(stays.where("id IS NULL").select("tournament_id", F.col("_root").alias("player_id")), entries, ["tournament_id", "player_id"])
    times = {c: as_of for c in ("first_seen_in_source", "last_seen_in_source", "created_at")}
    return kept.unionByName(conform(fresh.withColumns(times), "entries").select(*entries.columns))


def decide(tables: dict[str, DataFrame], decisions: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Apply decisions (id, decision, player_id, by, and seq for their order) about waiting names to all tables that they concern; `refused` has those that were not applied.

    resolved: the name becomes an alias of the person, others who bear it are merged into them, and
    they are entered for the event; approved: the person is entered; new_person: one is made of the raw
    name and entered, the status being approved; rejected and snoozed change the status alone. The tables are as after
    a run one by one: a person merged away takes their aliases with them, and no later decision can name
    them; entries that they were given before go on to whom they were merged into. See judged for what is refused; a decision
    that comes again is, so that it changes nothing.
    """
    standing, refused = judged(tables, decisions)
    players = tables["players"]
    kills = staged(standing.where((F.col("decision") == "resolved") & (F.length("normalized_name") > 0)).select(F.col("normalized_name").alias("_norm"), F.col("player_id").alias("_into"), F.col("_t").alias("_at")), "kills")
    deaths = staged(_deaths(players, kills), "deaths")
    made = staged(_made(players, deaths, kills, standing.where("decision = 'new_person'").select("_t", "raw_player_name", "normalized_name")), "made")
    born = made.where("_born IS NOT NULL").select(F.col("_born").alias("id"), F.col("raw_player_name").alias("full_name"), "normalized_name", "_t")
    again = born.join(kills.withColumnRenamed("_norm", "normalized_name"), "normalized_name").where("_at > _t").groupBy("id").agg(F.min(F.struct("_at", "_into")).alias("_k")).select(F.col("id").alias("person"), F.col("_k._at").alias("at"), F.col("_k._into").alias("into"))
    paths = ways(deaths.unionByName(again))
    gone = paths.select(F.col("person").alias("id"))

    whom = staged(standing.join(made.select("_t", "_who"), "_t", "left").withColumn("_who", F.when(F.col("decision") == "new_person", F.col("_who")).when(F.col("decision").isin("resolved", "approved"), F.col("player_id"))), "whom")
    entries = staged(_settled(tables["entries"], paths, whom.where("_who IS NOT NULL").select("tournament_id", "_who", "_t"), as_of), "entries")
    learned = whom.where("decision = 'resolved'").select(F.col("raw_player_name").alias("alias_name"), F.col("normalized_name").alias("normalized_alias"), "player_id", F.col("by").alias("created_by_telegram_id"), "_t")
    aliases = cascade_delete(staged(add_aliases(tables["player_aliases"], last_wins(learned, ["normalized_alias"], ["_t"]).drop("_t"), as_of), "learned"), gone, "player_id")
    everyone = players.unionByName(born.drop("_t"), allowMissingColumns=True).select(*players.columns)
    status = F.when(F.col("decision") == "new_person", "approved").otherwise(F.col("decision"))
    changed = whom.select("id", status.alias("status"), F.when(F.col("decision").isin("new_person", "resolved"), F.col("_who")).alias("resolved_player_id"))
    pending = null_references(staged(transition(tables["pending_entries"], changed, as_of), "decided"), gone, "resolved_player_id")
    out = {"players": delete_keyed(everyone, gone, ["id"]), "player_aliases": aliases, "pending_entries": pending, "refused": refused}
    return tables | {"entries": entries} | {name: staged(df, name) for name, df in out.items()}
