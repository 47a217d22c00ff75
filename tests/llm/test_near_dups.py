from __future__ import annotations

import re

import pytest

from quillroster.llm import near_dups
from quillroster.llm.components import components
from quillroster.llm.near_dups import Banding, drop_near_duplicates, near_duplicates


def grams(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def expected(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, set_id, copies, n_links) by comparing every pair of distinct sets."""
    members: dict[frozenset, list[int]] = {}
    out = []
    for i, t in rows:
        if g := grams(t):
            members.setdefault(g, []).append(i)
        else:
            out.append((i, i, i, 1, 0))
    sets = list(members)
    links = {a: [b for b in sets if a is not b and len(a & b) >= 0.8 * len(a | b)] for a in sets}
    root = {}
    for s in sets:
        if s not in root:
            todo, seen = [s], {s}
            while todo:
                for x in links[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            least = min(min(members[x]) for x in seen)
            root |= dict.fromkeys(seen, least)
    for s, ids in members.items():
        out += [(i, root[s], min(ids), len(ids), len(links[s])) for i in ids]
    return sorted(out)


def edited(text: str, at: int, word: str) -> str:
    words = text.split()
    words[at] = word
    return " ".join(words)


def documents(prose) -> list[tuple]:
    rows = [(i, prose(30 + i)) for i in range(20)]
    for k in range(8):
        base = prose(120)
        rows += [(100 + 20 * k + j, edited(base, 7 * j + k, "new") if j else base) for j in range(6)]
        rows += [(100 + 20 * k + 10, base.replace(" ", "\n")), (100 + 20 * k + 11, base)]
    chain = prose(200)  # each is like the next, the first is unlike the last
    for j in range(8):
        rows.append((900 + j, chain))
        chain = edited(edited(chain, 20 * j + 3, "one"), 20 * j + 11, "two")
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "two  words"), (1005, "two word"), (1006, prose(6000))]


def test_as_brute_force(make, prose):
    rows = documents(prose)
    assert sorted(map(tuple, near_duplicates(make(rows)).collect())) == expected(rows)


def test_a_large_group_is_compared_in_tiles_without_losing_or_repeating_links(make, prose, monkeypatch):
    monkeypatch.setattr(near_dups, "TILE_ROWS", 8)
    base = prose(100)
    rows = [(i, edited(base, i, f"w{i}")) for i in range(60)] + [(100, prose(100))]
    assert sorted(map(tuple, near_duplicates(make(rows)).collect())) == expected(rows)


def test_one_document_of_each_class_stays(make, prose):
    rows = documents(prose)
    df = make([*rows, rows[0], (None, rows[0][1])])
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, *_ in expected(rows)})


def test_repeated_rows_and_null_ids(make):
    got = near_duplicates(make([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.copies, r.n_links) for r in got) == [(-1, -1, 1, 0), (-1, 1, 3, 0), (1, 1, 3, 0), (1, 1, 3, 0)]


def test_empty_table(make):
    none = make([(1, "a")]).where("doc_id < 0")
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("recall", [0.99, 0.999999])
def test_bands_meet_the_recall(recall):
    banding = Banding(recall=recall)
    assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= recall


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 140)} | {i: 200 for i in range(201, 209)}
