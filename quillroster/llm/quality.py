"""A quality classifier from positive and unlabelled texts.

A linear model over the frequencies of hashed byte trigrams and a few measures of form minimises
the non-negative unbiased risk: with class prior p, p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]),
the expectations being over trusted positives and over unlabelled text and l the logistic loss. The
prior is estimated from the same two: where a first scorer, learned on half of each, is highest, the
unlabelled texts are positives nearly all, so that the share of the unlabelled there, over that of the
positives, tells the prior; the cut is the one whose upper bound is least. Negative labels are not used.

The fit takes a bounded sample; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import lowest, text_of
from quillroster.llm.words import Words, normal, parts, slices

BINS = 1024
FORM = 14
CLIP, TRIGRAM_SHARE = 4.0, 0.2
THRESHOLD = 0.3


@dataclass(frozen=True)
class Training:
    """positives, unlabelled: rows of each that are taken at most (about; a hash of the id decides)."""

    positives: int = 4000
    unlabelled: int = 6000
    steps: int = 800
    rate: float = 0.05
    decay: float = 1e-4


def _kinds() -> np.ndarray:
    """Byte -> class: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence mark, 6 other ASCII mark."""
    out = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:?'\"-" else 6 if c.isprintable() else 0
    return out


_KIND = _kinds()


def _trigrams(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(22)


def _form(texts: list[bytes]) -> np.ndarray:
    """(texts, FORM) measures of form, each about 0 to 1."""
    out = np.zeros((len(texts), FORM))
    for lo, hi in slices(texts):
        words = Words([normal_words(t) for t in texts[lo:hi]])
        for k, text in enumerate(texts[lo:hi]):
            kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / max(1, len(text))
            own = words.hashes[words.first[k] : words.first[k + 1]]
            n = len(own)
            _, counts = np.unique(own, return_counts=True)
            again = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
            lines = text.split(b"\n")
            out[lo + k] = [*kinds, len(counts) / max(1, n), counts.max(initial=0) / max(1, n), again, 1 - len(set(lines)) / len(lines), min(1, len(text) / max(1, n) / 20), np.log1p(n) / 10, n == 0]
    return out


def normal_words(text: bytes) -> bytes:
    return b" ".join(text.split())


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS + FORM): trigram frequencies, then form."""
    out = np.zeros((len(texts), BINS + FORM), np.float32)
    for i, t in enumerate(texts):
        if len(t) > 2:
            out[i, :BINS] = np.bincount(_trigrams(np.frombuffer(t, np.uint8)), minlength=BINS) / (len(t) - 2)
    out[:, BINS:] = _form(texts)
    return out


@dataclass
class Scorer:
    """score = logistic(bias + weights . measures), the measures as standard() gives them."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in slices(texts):
            # Row by row, so that a text's score does not depend on those beside it.
            f = self.bias + (standard(features(texts[lo:hi]), self.centre, self.spread) * self.weights).sum(axis=1)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return out


def standard(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Measures in standard units; trigrams are held within CLIP and count for less, as each alone tells little."""
    out = (x - centre) / spread
    np.clip(out[:, :BINS], -CLIP, CLIP, out=out[:, :BINS])
    out[:, :BINS] *= TRIGRAM_SHARE
    return out


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, how: Training = Training()) -> Scorer:
    """Descent on the non-negative risk of the whole sample; where the negative part falls below 0, its ascent alone is taken."""
    both = np.concatenate([positive, unlabelled])
    centre, spread = both.mean(axis=0), both.std(axis=0) + 1e-4
    positive, unlabelled = standard(positive, centre, spread), standard(unlabelled, centre, spread)
    w, b = np.zeros(both.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, how.steps + 1):
        p, u = positive, unlabelled
        fp, fu = p @ w + b, u @ w + b
        # l(f) = log(1 + exp(-f)); l(-f) = log(1 + exp(f)), whose slope is logistic(f).
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = -prior * logistic(fp) / len(p), logistic(fu) / len(u)
        if negative >= 0:
            sp, su = up - prior * logistic(-fp) / len(p), uu
        else:
            sp, su = -up, -uu
        g = np.concatenate([sp @ p + su @ u + how.decay * w, [sp.sum() + su.sum()]])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        change = how.rate * (1 - 0.9 * step / how.steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return Scorer(centre, spread, w, float(b), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, how: Training = Training(), slack: float = 0.1) -> float:
    """The share of positives among the unlabelled, by the best top bin of scores of rows that the scorer has not learned from."""
    scorer = train(positive[::2], unlabelled[::2], 0.5, how)
    of = lambda x: standard(x, scorer.centre, scorer.spread) @ scorer.weights
    p, u = np.sort(of(positive[1::2])), np.sort(of(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    above_p = 1 - np.searchsorted(p, p) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    wide = np.sqrt(np.log(4 / slack) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = int(((above_u + wide) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def held_out(id_col: str) -> Column:
    """Fixed rule: labels of rows whose CRC-32 of the id as text is a multiple of 5 are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_kind"), batch.column("_h"), pa.array([f.tobytes() for f in features(texts)], pa.binary())], ["_kind", "_h", "_features"])


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id_col: str, how: Training = Training()) -> Scorer | None:
    """Learn from rows labelled 1 and from rows whatever their label, neither of them held out; None without either.

    Counts are taken over all rows, and a hash of id and text picks the sample (of the label's id, for
    positives); only its features, of fixed length, come to the driver.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull() & ~held_out(label_id_col)).groupBy(F.col(label_id_col).alias("_label_id")).agg(F.max(label_col).alias("_label")).where("_label = 1")
    docs = df.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    ones, total = known.count(), docs.count()
    if not ones or not total:
        return None
    drawn = lambda seed, share, *of: F.xxhash64(F.lit(seed), *of) <= lowest(share)
    positive = docs.join(known.where(drawn(5, how.positives / ones, "_label_id")), F.col("_id") == F.col("_label_id"), "left_semi").select(F.lit(1).alias("_kind"), F.xxhash64("_id", "_text").alias("_h"), "_text")
    unlabelled = docs.where(drawn(6, how.unlabelled / total, "_id", "_text")).select(F.lit(0).alias("_kind"), F.xxhash64("_id", "_text").alias("_h"), "_text")
    sample = sorted(positive.unionByName(unlabelled).mapInArrow(_featured, "_kind int, _h long, _features binary").collect())
    sets = [np.array([np.frombuffer(r["_features"], np.float32) for r in sample if r["_kind"] == k]) for k in (1, 0)]
    return train(*sets, estimated_prior(*sets, how), how) if len(sets[0]) and len(sets[1]) else None


def _scored(scorer: Scorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]
            scores = scorer.scores(texts) if scorer else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores)], ["_id", "score"])

    return run


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", threshold: float = THRESHOLD, how: Training = Training()) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Null text counts as empty and is scored like any other. Labels other than 0 and 1, and those
    without an id, are left out; of several labels for one id the larger counts. Where there is no
    positive or no unlabelled text to learn from, every score is 0.5. Null ids aren't held out.
    Equal texts get equal scores. An empty table gives an empty result. Other columns are not read.
    """
    scorer = fit(df, labels, id_col, text_col, label_col, label_id_col, how)
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    out = rows.mapInArrow(_scored(scorer), f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
    return out.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
