"""The manifest's trees and proofs against a plain one."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from quillroster.llm.merkle import document_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _g int, _h long, _i string, leaf string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def raised(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each node its siblings with their sides; a level without one has none."""
    proofs: list[list] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 2, len(nodes))) for i in range(0, len(nodes), 2)]
        for run in runs:
            for n in run:
                for member in under[n]:
                    proofs[member].append([(nodes[o], "left" if o < n else "right") for o in run if o != n])
        under = [[m for n in run for m in under[n]] for run in runs]
        nodes = [h(*(nodes[n] for n in run)) for run in runs]
    return nodes[0], proofs


def plainly(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: raised([leaf(*r) for r in groups[g]]) for g in langs}
    root, above = raised([trees[g][0] for g in langs])
    out = []
    for lang, upper in zip(langs, above):
        for r, lower in zip(groups[lang], trees[lang][1]):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1) if changed else leaf(*r)
            for level in lower + upper:
                before, after = ("".join(s for s, side in level if side == where) for where in ("left", "right"))
                node = h(before, node, after)
            out.append((r[0], leaf(*r), trees[lang][0], root, h(*(s for level in lower + upper for s, _ in level)), node, node == root))
    return out


def ours(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*r, "a", 1, 2, "b", "c") for r in rows], SCHEMA).repartition(3)
    got = document_manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


def key(row: tuple) -> tuple:
    return tuple((v is not None, v or 0) if i == 0 else v for i, v in enumerate(row))


def test_every_size_of_group_and_odd_rows(spark):
    rows = [(g * 100 + i, f"tëxt {i}", f"l{g}", None if i % 3 else "web", i if i % 4 else None) for g in range(1, 10) for i in range(g)]
    rows += [(5000 + i, None, None, "x", 3) for i in range(7)] + [(None, "no id", "l3", "y", None), (301, "again", "l3", "y", 1), (301, "again", "l3", "y", 1)]
    rows += [(9000, "", "", "", 0), (9007, "long " * 200_000, "é", "s", 2**63 - 1), (9001, "-", "é", "-", -5)]
    assert sorted(ours(spark, rows), key=key) == sorted(plainly(rows), key=key)


def test_tampering_is_found_and_only_tampering(spark):
    rows = [(i, f"t{i}", "en", "web", i) for i in range(200)]
    got = {r[0]: r for r in ours(spark, rows)}
    assert {i for i, r in got.items() if not r[6]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}
    other = {r[0]: r for r in ours(spark, [*rows[:150], (150, "changed", "en", "web", 150), *rows[151:]])}
    assert other[0][3] != got[0][3] and other[0][1] == got[0][1]


def test_one_row_and_none(spark):
    assert ours(spark, [(3, "a", None, None, None)]) == plainly([(3, "a", None, None, None)])
    assert ours(spark, []) == []
