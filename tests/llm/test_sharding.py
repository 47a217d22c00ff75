from __future__ import annotations

import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quillroster.llm.sharding import HashTree, assign_shards, placed

ROWS = [(i, None if i % 50 == 0 else "é" * (i % 7)) for i in range(2000)] + [(3, "again"), (3, "again"), (None, "no id")]


def test_digest_columns_slots_and_growth(make):
    got = assign_shards(make(ROWS)).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"key"}
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots: dict[int, list[int]] = {}
    for r in got:
        assert 0 <= r.shard < 40 and (r.grown_shard == r.shard or r.grown_shard == 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    assert 10 < sum(r.grown_shard == 40 for r in got) < 120


def test_changed_weights_move_rows_only_where_they_changed(make):
    df = make(ROWS).select("doc_id")
    before = HashTree([[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]])
    within = HashTree([[[3.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]])  # more weight: rows move into its path only
    both = placed(placed(df, F.col("doc_id"), before, "a"), F.col("doc_id"), within, "b").collect()
    for r in both:
        region = lambda s: s // 4
        if region(r.a) == region(r.b) == 1:
            assert r.a == r.b
        assert region(r.b) == region(r.a) or region(r.b) == 0
    assert any(r.a != r.b for r in both)


def test_weights(make):
    tree = HashTree([[[0.0, 1.0]], [[3.0]]])
    got = placed(make(ROWS).select("doc_id"), F.col("doc_id"), tree, "s").groupBy("s").count().collect()
    counts = {r.s: r["count"] for r in got}
    assert set(counts) == {1, 2} and 2.5 < counts[2] / counts[1] < 3.6
    with pytest.raises(ValueError):
        HashTree([[[0.0]]])


def plainly(key: int | None, tree: HashTree) -> int:
    """The same descent in plain Python."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)

    def draw(name: str, weight: float) -> float:
        return -math.log(((xxhash.xxh64_intdigest(name.encode(), seed) >> 11) + 0.5) / 2**53) / weight

    def least(children: list[tuple]) -> tuple:
        return min((draw(name, w), child) for child, name, w in children if w > 0)[1]

    first, shard, regions, racks = 0, {}, [], {}
    for r, region in enumerate(tree.regions):
        for k, rack in enumerate(region):
            racks[r, k] = sum(rack)
            for s in range(len(rack)):
                shard[r, k, s] = first
                first += 1
        regions.append(((r,), f"r{r}", sum(racks[r, k] for k in range(len(region)))))
    top = least(regions + [((-1, first + i), f"added{i}", w) for i, w in enumerate(tree.added)])
    if top[0] < 0:
        return top[1]
    r = top[0]
    k = least([(k, f"k{r}.{k}", racks[r, k]) for k in range(len(tree.regions[r]))])
    return shard[r, k, least([(s, f"s{r}.{k}.{s}", w) for s, w in enumerate(tree.regions[r][k])])]


@pytest.mark.parametrize("tree", [HashTree.of(40), HashTree.of(40, 1), HashTree([[[0.5, 2.0], [0.0, 1.0]], [[3.0]]], [1.5, 0.0])])
def test_as_a_descent_in_plain_python(make, tree):
    got = placed(make(ROWS).select("doc_id"), F.col("doc_id"), tree, "s").collect()
    assert all(r.s == plainly(r.doc_id, tree) for r in got)


def test_very_long_texts_and_many_equal_rows(make):
    rows = [(7, "x" * 3_000_000), *[(5, "same")] * 3000]
    got = assign_shards(make(rows)).collect()
    slots = sorted(r.slot for r in got if r.shard == plainly(5, HashTree.of(40)) and r.doc_id == 5)
    assert len(got) == 3001 and max(r.size for r in got) == 3_000_016 and len(set(slots)) == 3000 and max(slots) <= 3000


def test_empty_table(make):
    assert assign_shards(make(ROWS).where("doc_id < 0")).count() == 0
