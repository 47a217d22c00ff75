"""Items that share an id, and short items of which one word is replaced."""

from __future__ import annotations

from itertools import combinations

import pytest

from quillroster.llm.decontaminate import Seeds, contaminated, drop_contaminated

BENCH = "item_id long, text string, _item int"


def test_every_text_of_an_id_counts(spark, make, prose):
    texts = [prose(30) for _ in range(6)]
    bench = spark.createDataFrame([(None if k < 3 else 7, t, k) for k, t in enumerate(texts)], BENCH)
    docs = make([(k, f"{prose(5)} {t}") for k, t in enumerate(texts)] + [(9, prose(50)), (10, f"{texts[3]} {prose(9)} {texts[4].rsplit(' ', 9)[0]}")])
    got = contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or -1, r.n_words) for r in got) == [(k, -1 if k < 3 else 7, 30) for k in range(6)] + [(10, 7, 30)]
    assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [9]


def test_short_items_with_a_word_replaced(spark, make, prose):
    five, six = prose(5), prose(6)
    bench = spark.createDataFrame([(5, five, 0), (6, six, 0)], BENCH)
    rows = []
    for n, item in ((5, five), (6, six)):
        for k in range(n):
            rows.append((n * 10 + k, f"{prose(4)} {' '.join('other' if i == k else w for i, w in enumerate(item.split()))} {prose(4)}"))
    rows.append((99, f"{prose(4)} {' '.join('other' if i in (1, 3) else w for i, w in enumerate(six.split()))}"))
    got = {(r.doc_id, r.item_id) for r in contaminated(make(rows), bench).collect()}
    # A stretch begins and ends with equal words.
    assert got == {(n * 10 + k, n) for n in (5, 6) for k in range(1, n - 1)}


@pytest.mark.parametrize("n", range(4, 14))
def test_whatever_may_be_replaced_some_mask_is_left(n):
    seeds = Seeds()
    masks = [*seeds.masks, *seeds.holed(n)]
    for gone in combinations(range(1, n - 1), int(n * seeds.substitution_share + 1e-9)):
        assert any(all(c == "0" or k + i not in gone for i, c in enumerate(m)) for m in masks for k in range(n - len(m) + 1))
