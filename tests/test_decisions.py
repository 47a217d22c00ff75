"""Decisions as a whole against the same decisions taken one by one in plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillroster.operators import decisions as D
from quillroster.sources import schemas

NOW = "2026-01-10 12:00:00"


def one_by_one(players: dict, entries: list[dict], aliases: dict, pending: dict, asked: list[tuple]):
    """players id -> (full name, norm); entries of id, event, person, active; aliases norm -> id; pending id -> event, raw, norm, status."""
    first, next_id, refused = set(players), max(players) + 1, []
    start = {k: v["status"] for k, v in pending.items()}

    def enter(event, who):
        for e in entries:
            if e["event"] == event and e["person"] == who:
                e["active"] = True
                return
        entries.append({"id": None, "event": event, "person": who, "active": True})

    for _, row_id, kind, who in sorted(asked):
        row = pending.get(row_id)
        if kind not in D.KINDS:
            refused.append((row_id, kind, who, "unknown_decision"))
        elif row is None or start[row_id] != "pending":
            refused.append((row_id, kind, who, "not_waiting"))
        elif kind in ("resolved", "approved") and who is None:
            refused.append((row_id, kind, who, "no_person"))
        elif kind in ("resolved", "approved") and who not in first:
            refused.append((row_id, kind, who, "unknown_person"))
        elif row["status"] != "pending":
            refused.append((row_id, kind, who, "already_decided"))
        elif kind in ("resolved", "approved") and who not in players:
            refused.append((row_id, kind, who, "person_gone"))
        elif kind in ("rejected", "snoozed"):
            row["status"] = kind
        elif kind == "approved":
            row["status"] = kind
            enter(row["event"], who)
        elif kind == "new_person":
            found = [i for i, (full, _) in players.items() if full == row["raw"]]
            if not found:
                players[next_id] = (row["raw"], row["norm"])
                found, next_id = [next_id], next_id + 1
            row["status"] = "approved"
            enter(row["event"], found[0])
        else:
            aliases[row["norm"]] = who
            for wrong in sorted(i for i, (_, norm) in players.items() if norm == row["norm"] and i != who):
                for e in sorted((e for e in entries if e["person"] == wrong), key=lambda e: e["id"] or 10**9):
                    if any(o["person"] == who and o["event"] == e["event"] for o in entries):
                        entries.remove(e)
                    else:
                        e["person"] = who
                del players[wrong]
                for norm in [n for n, i in aliases.items() if i == wrong]:
                    del aliases[norm]
                for other in pending.values():
                    if other.get("who") == wrong:
                        other["who"] = None
            enter(row["event"], who)
            row.update(status="resolved", who=who)
    return refused


def frames(spark, players, entries, aliases, pending):
    make = lambda name, columns, rows: schemas.conform(spark.createDataFrame(rows, columns), name)
    return {
        "players": make("players", "id long, full_name string, normalized_name string", [(i, *v) for i, v in players.items()]),
        "entries": make("entries", "id long, tournament_id long, player_id long, active boolean", [(e["id"], e["event"], e["person"], e["active"]) for e in entries]),
        "player_aliases": make("player_aliases", "id long, normalized_alias string, player_id long", [(n, a, i) for n, (a, i) in enumerate(aliases.items())]),
        "pending_entries": make("pending_entries", "id long, tournament_id long, raw_player_name string, normalized_name string, status string", [(i, p["event"], p["raw"], p["norm"], p["status"]) for i, p in pending.items()]),
    }


def both(spark, players, entries, aliases, pending, asked):
    tables = frames(spark, players, entries, aliases, pending)
    got = D.decide(tables, spark.createDataFrame([(*a, "adm") for a in asked], "seq int, id long, decision string, player_id long, by string"), F.lit(NOW).cast("timestamp"))
    refused = one_by_one(players, entries, aliases, pending, asked)
    known = {r.id for r in tables["entries"].collect()}
    assert {r.id: (r.full_name, r.normalized_name) for r in got["players"].collect()} == players
    mine = Counter((r.id if r.id in known else None, r.tournament_id, r.player_id, r.active) for r in got["entries"].collect())
    assert mine == Counter((e["id"], e["event"], e["person"], e["active"]) for e in entries)
    assert {r.normalized_alias: r.player_id for r in got["player_aliases"].collect()} == aliases
    assert {r.id: (r.status, r.resolved_player_id) for r in got["pending_entries"].collect()} == {i: (p["status"], p.get("who")) for i, p in pending.items()}
    assert Counter(tuple(r)[:3] + (r.reason,) for r in got["refused"].collect()) == Counter(refused)
    return refused, got


@pytest.mark.parametrize("seed", range(5))
def test_random_decisions(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(5)]
    players = {i: (f"P{i}" if rng.random() < 0.7 else f"N{i % 5}x{i}", rng.choice(names)) for i in range(1, 13)}
    players |= {20 + k: (n.upper(), n) for k, n in enumerate(names[:3])}
    places = rng.sample([(e, p) for e in range(4) for p in players], 25)
    entries = [{"id": 100 + k, "event": e, "person": p, "active": rng.random() < 0.5} for k, (e, p) in enumerate(places)]
    aliases = {n: rng.choice(list(players)) for n in ("n1", "n4", "other")}
    pending = {i: {"event": rng.randrange(5), "raw": (n := rng.choice(names)).upper(), "norm": n, "status": "pending" if rng.random() < 0.9 else "expired"} for i in range(14)}
    asked = [(k, rng.randrange(16), rng.choice([*D.KINDS, "resolved", "resolved", "new_person", "resolve"]), rng.choice([*players, *players, None, 999])) for k in rng.sample(range(500), 26)]
    refused, _ = both(spark, players, entries, aliases, pending, asked)
    assert len(asked) > len(refused) > 3


def test_a_chain_of_merges_and_who_is_gone(spark):
    players = {i: (f"P{i}", f"n{i}") for i in range(1, 10)}
    entries = [{"id": 50 + i, "event": 7, "person": i, "active": False} for i in (2, 4, 5)] + [{"id": 90, "event": 8, "person": 1, "active": False}]
    pending = {i: {"event": i, "raw": f"N{i}", "norm": f"n{i}", "status": "pending"} for i in range(1, 10)}
    asked = [(i, i, "resolved", i + 1) for i in range(1, 9)] + [(20, 9, "approved", 3)]
    refused, got = both(spark, players, entries, {}, pending, asked)
    assert refused == [(9, "approved", 3, "person_gone")] and [r.id for r in got["players"].collect()] == [9]
    again = D.decide({k: v for k, v in got.items() if k != "refused"}, spark.createDataFrame([(*a, "adm") for a in asked], "seq int, id long, decision string, player_id long, by string"), F.lit(NOW).cast("timestamp"))
    assert again["refused"].count() == 9 and again["entries"].exceptAll(got["entries"]).count() == 0
