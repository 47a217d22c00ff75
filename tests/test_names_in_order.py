"""Names met one by one, against an import in plain Python; chains of merges and decisions one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillroster.operators import resolve

LIMIT = lambda n: 2 if len(n) <= 8 else 3 if len(n) <= 14 else 4 if len(n) <= 22 else 5


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_by_one(listed: list[tuple], aliases: dict, people: dict) -> tuple[dict, dict]:
    """listed (name, seq), aliases norm -> id, people id -> full name: what becomes of each occurrence, and the people after."""
    people, out = dict(people), {}
    norm = lambda n: " ".join(n.lower().split())
    for name, seq in sorted(listed, key=lambda r: r[1]):
        own = norm(name)
        exact = min((i for i, n in people.items() if n == name), default=None)
        if own in aliases:
            out[name, seq] = ("alias", aliases[own], None)
        elif exact is not None:
            out[name, seq] = ("exact", exact, None)
        else:
            pool = sorted((edits(own, norm(n)), i) for i, n in people.items() if own and norm(n))[: resolve.POOL]
            pool = [(d, i) for d, i in pool if d <= LIMIT(own)]
            near = [(d, i) for d, i in pool if pool[0][0] <= 3 and d <= min(pool[0][0] + 1, LIMIT(own))]
            if near:
                part = lambda k, i: edits(own.split()[k], norm(people[i]).split()[k]) if len(own.split()) > k < len(norm(people[i]).split()) else 999
                scored = sorted((d * 10 + 3 * part(0, i) + 3 * part(1, i), i, d) for d, i in near)[: resolve.SHOWN]
                out[name, seq] = ("ambiguous", None, [i for d, _, i in sorted((d, s, i) for s, i, d in scored)])
            else:
                people[max(people, default=0) + 1] = name
                out[name, seq] = ("new", max(people), None)
    return out, people


@pytest.mark.parametrize("seed, letters, size", [(1, "ab", 5), (2, "abc", 6), (3, "abcdef", 10), (4, "ab ", 12)])
def test_random_rosters_equal_an_import_one_by_one(spark, seed, letters, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(size - 2, size + 2)))
    pool = [w for w in {word() for _ in range(60)} if w.strip() == w and w] + ["Ab", "AB", "aB"]
    people = {i * 3 + 1: n for i, n in enumerate(rng.sample(pool, 4))}
    aliases = {" ".join(n.lower().split()): 1 for n in rng.sample(pool, 3)}
    listed = [(rng.choice(pool), i) for i in rng.sample(range(1000), 150)]
    want, after = one_by_one(listed, aliases, people)
    as_people = spark.createDataFrame([(i, n, " ".join(n.lower().split())) for i, n in people.items()], "id long, full_name string, normalized_name string")
    rows, fresh = resolve.resolve_in_order(spark.createDataFrame(listed, "name string, seq int"), spark.createDataFrame(list(aliases.items()), "normalized_alias string, player_id long"), as_people)
    got = {(r.name, r.seq): (r.outcome, r.player_id, r.candidates and [c.player_id for c in r.candidates]) for r in rows.collect()}
    assert got == want and {r.id: r.full_name for r in fresh.collect()} == {i: n for i, n in after.items() if i not in people}
    assert {o for o, *_ in want.values()} >= {"alias", "exact", "ambiguous", "new"}


def test_a_chain_of_neighbours_is_settled_in_order(spark):
    # Each name is near to the next only: every second one stands.
    names = ["aaaaaaaaaaaa" + "bbb" * k for k in range(12)]
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [("", 50), (None, 51)], "name string, seq int")
    nobody = spark.createDataFrame([], "id long, full_name string, normalized_name string")
    rows, fresh = resolve.resolve_in_order(listed, spark.createDataFrame([], "normalized_alias string, player_id long"), nobody)
    got = {r.name: r.outcome for r in rows.collect()}
    assert [got[n] for n in names] == ["new", "ambiguous"] * 6 and len(got) == 12
    assert [r.id for r in fresh.orderBy("id").collect()] == list(range(1, 7))
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "c")], "name string, before string")
    assert {r.name for r in resolve.fallen(edges).collect()} == {"b", "d"} and resolve.fallen(edges.limit(0)).count() == 0
