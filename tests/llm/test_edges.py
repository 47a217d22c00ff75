"""Ties, repeats, very long texts, null ids and clashing columns where other tests do not reach."""

from __future__ import annotations


import numpy as np
import pytest

import corpus_pipeline
from quillroster.llm import language_id as L
from quillroster.llm import quality as Q
from quillroster.llm.near_dups import drop_near_duplicates, near_duplicates
from quillroster.llm.queries import vocabulary
from quillroster.llm.substring_dedup import substring_dedup
from quillroster.llm.token_files import token_files
from quillroster.llm.words import STRETCH, Words, normal
from test_classifiers import tongues


def test_quality_of_repeats_ties_and_a_very_long_text(spark, make, prose):
    good = [prose(40) for _ in range(60)]
    rows = [(i, good[i % 60] if i % 2 else "BUY now !!! $$$ click " * 20) for i in range(400)]
    rows += [(900, prose(300_000)), (901, rows[1][1]), (901, rows[1][1]), (None, rows[1][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(1, 0), (1, 1)], "doc_id long, quality int")
    got = Q.quality(make(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    text = dict(rows[:400])
    by_text: dict[str, set] = {}
    for r in got:
        if r.doc_id is None or r.doc_id != 900:
            by_text.setdefault(text.get(r.doc_id, rows[1][1]), set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_the_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(3)
    size = Q.BINS + Q.FORM
    centre = np.zeros(size, np.float32)
    centre[:40] = 1
    for share in (0.3, 0.6, 0.85):
        positive = rng.standard_normal((1200, size)).astype(np.float32) + centre
        unlabelled = rng.standard_normal((2000, size)).astype(np.float32) + np.where(rng.random(2000) < share, 1, -1)[:, None].astype(np.float32) * centre
        assert abs(Q.estimated_prior(positive, unlabelled) - share) < 0.1


def test_language_of_a_very_long_text(make):
    rows = tongues(300) + [(1000, "patako mutu " * 100_000, None), (1001, None, None)]
    got = {r.doc_id: r.lang_pred for r in L.language_id(make(rows, "lang string")).collect()}
    assert got[1000] == "aa" and got[1001] == "und"


def test_starts_of_repeated_ids_do_not_depend_on_how_rows_are_dealt(make, prose):
    rows = [(None, prose(9)), (None, prose(5)), (3, "b"), (3, "a"), (3, "a"), (3, None), (4, prose(20_000)), *((9, prose(k)) for k in range(30))]
    path = vocabulary("word_bpe_49k.json")
    first, second = (sorted(map(tuple, token_files(df, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())) for df in (make(rows), make(rows[::-1]).coalesce(1)))
    assert first == second and [r[0] for r in first] == np.cumsum([0, *(r[2] for r in first[:-1])]).tolist()


def test_hashes_of_a_very_long_text_are_those_of_its_parts(prose):
    short = [normal(prose(300)) for _ in range(120)]
    whole = Words([b" ".join(short)])
    each = np.concatenate([Words([t]).hashes for t in short])
    assert len(whole.joined) > 2 * STRETCH and (whole.hashes == each).all()
    windows, valid = whole.windows(5)
    assert valid.all() and (windows[: len(each) - 4] == Words([b"x " + b" ".join(short)]).windows(5)[0][1:]).all()
    long = Words([b"y" * (3 * STRETCH + 7), b"y" * (3 * STRETCH + 7), b"y" * (3 * STRETCH + 6)])
    assert long.hashes[0] == long.hashes[1] != long.hashes[2]


def test_one_very_long_text_beside_short_ones(make, prose):
    long = prose(400_000)
    words = long.split()
    rows = [(1, long), (2, " ".join(words[1000:1060])), (3, prose(10)), (4, " ".join([*words[:-3], "x", "y", "z"]))]
    removed = {r.doc_id: r.n_removed for r in substring_dedup(make(rows)).collect()}
    assert removed[2] == 60 and removed[3] == 0 and removed[1] >= 399_990
    assert {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert sorted(r.doc_id for r in drop_near_duplicates(make(rows)).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Repeated rows, null ids and columns that stages use names of themselves; no language to learn from."""
    rows = [(i, t, None) for i, t, _ in tongues(30)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, None, None), (7, "", None), (8, "!!", None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, lang, "web", 1, "a", 2, "b", 0.5, "c") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _tag int, lang_pred string, score double, _text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_the_pipeline_with_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, odd_folder)
    # Where no language could be learned, only texts without letters go.
    assert kept.columns == docs.columns and kept.count() == 33 and kept.where("_text = 'c' AND score = 0.5").count() == 33
    got = corpus_pipeline.run(spark, odd_folder).collect()
    assert len(got) == 30 and sum(r.doc_id is None for r in got) == 0 and all(r.n_tokens == len(r.ids) for r in got)
