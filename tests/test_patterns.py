"""Patterns against LIKE in plain Python."""

from __future__ import annotations

import random
import re

from quillroster.operators.patterns import name_index, unique_match


def like(name: str, pattern: str) -> bool:
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(out, name, re.DOTALL) is not None


def test_random_patterns(spark):
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abcAB% _é\\x") for _ in range(rng.randint(low, high)))
    people = [(i, word(0, 9) if rng.random() < 0.9 else None, word(1, 5) if rng.random() < 0.3 else None) for i in range(80)]
    escaped = lambda text: re.sub(r"([%_\\])", r"\\\1", text)
    made = [(rng.choice(["%", "", "_", "%_"]) + escaped((name := rng.choice(people)[1] or "ab")[rng.randint(0, 3) :][: rng.randint(1, 5)]) + rng.choice(["%", "", "_", "_%"])) for _ in range(250)]
    made += ["%", "", "_", "__", "____%", "_________", "__________%", "%_%", None, "nobody", "%zzz%"]
    frame = spark.createDataFrame(people, "id long, full_name string, lunda_name string")
    probes = spark.createDataFrame([(p,) for p in made], "probe string")
    want = {}
    for p in {p for p in made if p is not None}:
        hits = {i for i, *names in people for n in names if n is not None and like(n.lower(), p.lower())}
        if len(hits) == 1:
            want[p] = hits.pop()
    got = unique_match(probes, frame)
    assert {r.probe: r.player_id for r in got.collect()} == want and len(want) > 30
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = name_index(frame, "full_name", "lunda_name").cache()
    assert {r.probe: r.player_id for r in unique_match(probes, frame, index=kept).collect()} == want
    assert unique_match(probes, frame.limit(0)).count() == 0 and unique_match(probes.limit(0), frame).count() == 0
