from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillroster.llm.exact_dedup import drop_copies, exact_dedup


def expected(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep, sha = min(ids), hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out)


ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, " a b c"), (1, None), (2, ""), (4, "x" * 5000), (6, "x" * 5000), (7, "x" * 4999 + "y"), (8, "y" + "x" * 4999), (10, "é" * 33), (11, "é" * 33), (12, "é" * 32), (13, "a b c")]
ROWS += [(100 + i, "the very same text") for i in range(60)]


@pytest.mark.parametrize("block_bytes", [4, 2048])
def test_as_brute_force(make, block_bytes):
    got = exact_dedup(make(ROWS), block_bytes=block_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == expected(ROWS)


def test_names_stay_free_of_collisions_when_fingerprints_clash(make):
    got = exact_dedup(make(ROWS), block_bytes=16, fingerprint=lambda c: F.length(c).cast("long") % 2)
    assert sorted(map(tuple, got.collect())) == expected(ROWS)


def test_repeated_rows_and_null_ids(make):
    got = exact_dedup(make([(1, "t"), (1, "t"), (None, "t"), (None, "alone")])).collect()
    assert sorted((r.doc_id is None, r.group_size, r.kept) for r in got) == [(False, 3, False), (False, 3, True), (True, 1, True), (True, 3, False)]


def test_drop_keeps_one_row_with_all_its_columns(make):
    df = make([*ROWS, (3, "a b c"), (None, "a b c")])
    got = drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({keep for _, keep, *_ in expected(ROWS)})


def test_empty_table(make):
    assert exact_dedup(make([(1, "a")]).where("doc_id < 0")).count() == 0
    assert drop_copies(make([(1, "a")]).where("doc_id < 0")).count() == 0
