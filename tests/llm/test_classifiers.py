"""The language network and the quality scorer: gradients, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from quillroster.llm import language_id as L
from quillroster.llm import quality as Q


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = L.BiGru.fresh(["a", "b", "c"], 3, 1)
    net.weights = [w.astype(np.float64) for w in net.weights]
    raw, label = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    # The network computes in single precision; slopes are compared at that precision.
    _, grads = net.gradients(raw, label)
    for k, (w, g) in enumerate(zip(net.weights, grads, strict=True)):
        for _ in range(3):
            at = (rng.integers(0, w.shape[0]), raw.ravel()[rng.integers(0, raw.size)]) if w.ndim == 2 and w.shape[1] == 256 else tuple(rng.integers(0, n) for n in w.shape)
            w[at] += 1e-2
            up = net.gradients(raw, label)[0]
            w[at] -= 2e-2
            down = net.gradients(raw, label)[0]
            w[at] += 1e-2
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3, k


def tongues(n: int) -> list[tuple]:
    """Invented texts in three invented languages."""
    rng = random.Random(3)
    letters = {"aa": ("ptk", "ao"), "bb": ("mnl", "ieu"), "cc": ("zvždч", "ыэ")}
    out = []
    for i in range(n):
        lang = sorted(letters)[i % 3]
        own = letters[lang]
        out.append((i, " ".join("".join(rng.choice(own[0]) + rng.choice(own[1]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_language_of_held_out_rows_and_of_odd_ones(make):
    rows = tongues(600) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?! 34", "bb"), (1003, "pata koka tapo", None), (None, "pata koka tapo kata poka", "aa")]
    got = L.language_id(make(rows, "lang string")).collect()
    lang = {i: x for i, _, x in rows}
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert odd[1000] == odd[1001] == odd[1002] == ("und", 0.0) and odd[1003][0] == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(make):
    df = make([(1, "some text", None), (2, None, None)], "lang string")
    assert {r.lang_pred for r in L.language_id(df).collect()} == {"und"}
    assert L.language_id(df.where("doc_id < 0")).count() == 0


def test_probabilities_are_pooled_over_every_position():
    net = L.train([b"patako" * 16, b"mineli" * 16] * 20, ["a", "b"] * 20, L.Training(steps=40))
    text = b"patako" * 100 + b"mineli" * 300
    p = L.pooled(net, [text, b"", text[:1]])
    assert abs(p[0].sum() - 1) < 1e-4 and p[0, 1] > p[0, 0] and (p[1] == 0).all()


def test_quality_ranks_held_out_rows(spark, make, prose):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        good = i % 3 == 0
        rows.append((i, f"{prose(rng.randint(20, 60)).capitalize()}." if good else " ".join(rng.choice(["BUY", "now", "!!!", "$$$", "click", "8", "win"]) for _ in range(60))))
        if i % 2 == 0:
            labels.append((i, int(good), "x"))
    rows += [(2000, None), (2001, ""), (None, "text without id")]
    labels += [(None, 1, "x"), (2001, None, "x"), (5000, 1, "x")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = Q.quality(make(rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.9


def test_quality_without_labels_or_documents(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = make([(1, "a"), (2, None)])
    assert {r.score for r in Q.quality(df, none).collect()} == {0.5}
    assert Q.quality(df.where("doc_id < 0"), none).count() == 0


def test_the_negative_part_of_the_risk_is_held_at_zero():
    """Unlabelled text that is all positive: without the bound the risk would fall without end."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, Q.BINS + Q.FORM)).astype(np.float32)
    scorer = Q.train(x[:100], x[100:], 0.9)
    assert np.isfinite(scorer.weights).all() and np.abs(scorer.weights).max() < 20
