from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from quillroster.llm.substring_dedup import FingerprintIndex, substring_dedup


def expected(rows: list[tuple], width: int) -> list[tuple]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def documents(prose) -> list[tuple]:
    passage, other = prose(60), prose(35)
    rows = [(i, prose(80)) for i in range(12)]
    rows += [(20 + i, f"{prose(20)}\n{passage}\t{prose(i)}") for i in range(6)]
    rows += [(30, f"{other} mid {other}"), (31, other), (32, " ".join(other.split()[:-1])), (33, "so " * 100), (34, "so " * 36), (35, "")]
    rows += [(36, None), (37, passage), (38, passage.replace(" ", "  ")), (40, f"{passage} {passage}"), (41, prose(3000)), (None, f"{prose(9)} {other}")]
    return rows


@pytest.mark.parametrize("width", [35, 5, 1])
def test_as_brute_force(make, prose, width):
    rows = documents(prose)
    assert sorted(map(tuple, substring_dedup(make(rows), width=width).collect()), key=str) == expected(rows, width)


def test_repeated_rows_are_copies(make, prose):
    rows = [(1, text := prose(50)), (1, text), (2, prose(50))]
    assert sorted(map(tuple, substring_dedup(make(rows)).collect())) == expected(rows, 35)


def test_kept_text(make, prose):
    rows = documents(prose)
    for r in substring_dedup(make(rows), with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_index_finds_what_earlier_batches_had_and_survives_compaction(spark):
    index = FingerprintIndex(spark)
    batch = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], "fingerprint long, n int")
    seen = lambda df: {r.fingerprint for r in df.collect()}
    assert seen(index.ingest(batch(1, 2, 3, 3))) == {3}
    assert seen(index.ingest(batch(2, 4))) == {2}
    assert len(index.runs()) == 2
    index.compact(2)
    assert [level for level, _ in index.runs()] == [1]
    assert seen(index.ingest(batch(1, 4, 9))) == {1, 4}


def test_empty_table(make):
    assert substring_dedup(make([(1, "a")]).where("doc_id < 0")).count() == 0
