from __future__ import annotations

import numpy as np
import pytest

from quillroster.llm.decontaminate import Seeds, _folded, best_stretch, contaminated, drop_contaminated

BENCH = "item_id long, text string, _item int"


@pytest.fixture
def planted(spark, make, prose):
    items = [prose(40) for _ in range(4)] + ["short item here", None, ""]
    first = items[0].split()
    swapped = [w if k % 7 else "other" for k, w in enumerate(first)]
    rows = [(i, prose(60)) for i in range(10)]
    rows += [
        (20, f"{prose(30)} {items[1]} {prose(5)}"),  # whole
        (21, f"{prose(3)} {' '.join(swapped)} {prose(30)}"),  # every seventh word replaced
        (22, items[2].upper().replace(" ", ", ")),  # other case and marks
        (23, f"{prose(9)} {' '.join(items[3].split()[10:24])} {prose(9)}"),  # 14 words of it
        (24, f"{prose(9)} {' '.join(items[3].split()[10:20])} {prose(9)}"),  # 10 words only
        (25, f"{prose(5)} Short item, here! {prose(5)}"),
        (26, f"{items[0]} {items[1]}"), (27, None), (28, ""),
        (29, " ".join(w if k % 2 else "other" for k, w in enumerate(first))),  # half of it replaced
    ]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], BENCH)
    return make(rows), bench, {(20, 1), (21, 0), (22, 2), (23, 3), (25, 4), (26, 0), (26, 1)}


def test_planted_overlaps_are_found_and_no_others(planted):
    docs, bench, pairs = planted
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == pairs and len(got) == len(pairs)
    assert {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in got}[20, 1] == (40, 40)


def test_drop_leaves_clean_documents_with_all_their_columns(planted):
    docs, bench, pairs = planted
    got = drop_contaminated(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in pairs}


def test_long_items_and_documents(spark, make, prose):
    long = prose(20_000)
    words = long.split()
    bench = spark.createDataFrame([(1, long, 0), (1, prose(30), 0), (2, prose(12), 0)], BENCH)
    docs = make([(1, f"{prose(50)} {long} {prose(50)}"), (2, " ".join(words[5000:9000])), (3, prose(30_000)), (4, " ".join(w if k % 6 else "other" for k, w in enumerate(words)))])
    got = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert {k: (r.item_id, r.n_words) for k, r in got.items()} == {1: (1, 20_000), 2: (1, 4000), 4: (1, 19_999)}
    assert got[1].start_word == 50 and got[4].start_word == 1 and got[4].n_equal == 20_000 - 3334


def test_as_every_pair_on_every_diagonal(spark, make, prose):
    rng = np.random.default_rng(5)
    items = [prose(int(n)) for n in (5, 6, 9, 13, 14, 20, 40, 41)]
    rows = []
    for k in range(60):
        words = items[k % len(items)].split()
        a = int(rng.integers(0, max(1, len(words) - 12)))
        part = words[a : a + int(rng.integers(5, 30))]
        part = [w if rng.random() > 0.12 else "other" for w in part]
        rows.append((k, f"{prose(int(rng.integers(0, 9)))} {' '.join(part)} {prose(int(rng.integers(0, 9)))}"))
    seeds, want = Seeds(), {}
    for d, text in rows:
        doc = _folded(text).split()
        for i, item in enumerate(items):
            own = _folded(item).split()
            best = (0, 0)
            for shift in range(-len(own) + 1, len(doc)):
                lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
                best = max(best, best_stretch(np.array([own[j] == doc[j + shift] for j in range(lo, hi)]), min(seeds.least_words, len(own)), seeds.substitution_share)[:2])
            if best[0]:
                want[d, i] = best
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in contaminated(make(rows), bench).collect()}
    print(f"pairs {len(want)}, found {len(got)}")
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want) and len(want) > 20


def test_best_stretch_is_the_longest_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        same = rng.random(40) < 0.75
        best = 0
        for s in range(40):
            for e in range(s + 13, 41):
                if same[s] and same[e - 1] and same[s:e].sum() >= 0.8 * (e - s) - 1e-9:
                    best = max(best, e - s)
        assert best_stretch(same, 13, 0.2)[0] == best


def test_nulls_repeats_and_empty_tables(spark, make, prose):
    text = prose(30)
    bench = spark.createDataFrame([(1, text, 0), (None, text, 0)], BENCH)
    docs = make([(None, text), (5, text), (5, text)])
    assert sorted((r.doc_id or -1, r.item_id or -1) for r in contaminated(docs, bench).collect()) == [(-1, -1), (-1, 1), (5, -1), (5, 1)]
    assert contaminated(docs.where("doc_id < 0"), bench).count() == 0
    assert contaminated(docs, bench.where("item_id < 0")).count() == 0
    assert drop_contaminated(docs, bench.where("item_id < 0")).count() == 3


def test_masks_keep_and_ignore_words():
    assert all(m[0] == m[-1] == "1" for m in Seeds().masks) and any("0" in m for m in Seeds().masks)
