"""Substring dedup over several calls with one index."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from quillroster.llm.substring_dedup import FingerprintIndex, substring_dedup


def expected(rows: list[tuple], before: list[tuple], width: int) -> list[tuple]:
    words = lambda rows: [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + width]) for w in words(before) + words(rows) for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words(rows), strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [35, 5])
def test_later_calls_as_brute_force_over_all(spark, make, prose, width):
    once, twice, third, whole = prose(60), prose(45), prose(50), prose(70)
    calls = [
        [(1, f"{prose(20)} {once} {prose(20)}"), (2, f"{prose(9)} {twice}"), (3, f"{twice} {prose(8)}"), (4, whole), (5, prose(90)), (6, "a b"), (None, None)],
        [(1, f"{prose(30)} {once} {prose(4)}"), (12, f"{prose(5)} {third} {prose(5)}"), (13, whole.replace(" ", "\n")), (14, prose(80)), (None, "")],
        [(21, f"{once} {twice}"), (22, f"{prose(3)} {third}"), (23, f"{prose(40)}"), (24, whole), (25, whole)],
    ]
    index, before = FingerprintIndex(spark), []
    for rows in calls:
        got = substring_dedup(make(rows), width=width, index=index)
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows, before, width)
        before += rows


def test_index_of_another_width_is_refused(spark, make, prose):
    index = FingerprintIndex(spark)
    substring_dedup(make([(1, prose(50))]), index=index)
    with pytest.raises(ValueError):
        substring_dedup(make([(1, prose(50))]), width=5, index=index)
