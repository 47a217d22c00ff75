"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every position: two gated recurrent layers, one from either side, read the bytes
of a segment, and a softmax over the languages stands at each position. A document's probabilities
are the mean over all its positions. Gates use x / (1 + |x|) in place of the logistic and tanh
functions. Training, in numpy by backpropagation through time, takes segments of a bounded sample
of labelled rows; prediction reads every byte of every text, many segments side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import lowest, text_of
from quillroster.llm.words import parts

UNKNOWN = "und"
HIDDEN, SEGMENT, LANES = 8, 128, 4096


@dataclass(frozen=True)
class Training:
    """rows: labelled rows taken for each language at most (about; chosen by a hash of the row), one segment of each."""

    rows: int = 600
    segment: int = 96
    steps: int = 220
    batch: int = 256
    rate: float = 0.02
    seed: int = 7


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * _soft(x)


@dataclass
class BiGru:
    """weights: for each direction the byte table (3H, 256), the recurrent matrix (3H, H) and the output (languages, H); then the bias."""

    languages: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> BiGru:
        rng = np.random.default_rng(seed)
        one = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        weights = [w for _ in range(2) for w in (one(3 * hidden, 256), one(3 * hidden, hidden), one(len(languages), hidden))]
        return cls(languages, [*weights, np.zeros(len(languages), np.float32)])

    def _layer(self, table: np.ndarray, back: np.ndarray, out: np.ndarray, raw: np.ndarray, order: range, logits: np.ndarray, trace: list | None = None) -> None:
        """Add one direction's logits for raw (steps, lanes) to logits (steps, languages, lanes)."""
        h_size = back.shape[1]
        h = np.zeros((h_size, raw.shape[1]), np.float32)
        for t in order:
            seen, fed = table.take(raw[t], axis=1), back @ h
            pre = seen[: 2 * h_size] + fed[: 2 * h_size]
            gates = _gate(pre)
            z, r = gates[:h_size], gates[h_size:]
            aim = seen[2 * h_size :] + r * fed[2 * h_size :]
            new = _soft(aim)
            if trace is not None:
                trace.append((t, h, pre, gates, fed[2 * h_size :], aim, new))
            h = h + z * (new - h)
            logits[t] += out @ h

    def logits(self, raw: np.ndarray, traces: tuple | None = None) -> np.ndarray:
        steps, lanes = raw.shape
        logits = np.zeros((steps, len(self.languages), lanes), np.float32) + self.weights[6][:, None]
        for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            self._layer(*self.weights[3 * d : 3 * d + 3], raw, order, logits, traces[d] if traces else None)
        return logits

    def position_probabilities(self, raw: np.ndarray) -> np.ndarray:
        """(steps, languages, lanes)"""
        p = self.logits(raw)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, raw: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        traces: tuple[list, list] = ([], [])
        p = self.logits(raw, traces)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        lanes = np.arange(raw.shape[1])
        loss = float(-np.log(p[:, label, lanes] + 1e-9).mean())
        p[:, label, lanes] -= 1
        p /= raw.size
        grads: list[np.ndarray] = []
        for d in range(2):
            table, back, out = self.weights[3 * d : 3 * d + 3]
            size = back.shape[1]
            g_back, g_out, g_h = np.zeros_like(back), np.zeros_like(out), np.zeros((size, raw.shape[1]), np.float32)
            g_seen = np.zeros((raw.shape[0], 3 * size, raw.shape[1]), np.float32)
            for t, h, pre, gates, fed, aim, new in reversed(traces[d]):
                z, r = gates[:size], gates[size:]
                g_out += p[t] @ (h + z * (new - h)).T
                g_h = g_h + out.T @ p[t]
                g_aim = g_h * z / (1 + np.abs(aim)) ** 2
                g_gates = np.concatenate([g_h * (new - h), g_aim * fed]) * 0.5 / (1 + np.abs(pre)) ** 2
                g_fed = np.concatenate([g_gates, g_aim * r])
                g_seen[t, : 2 * size], g_seen[t, 2 * size :] = g_gates, g_aim
                g_back += g_fed @ h.T
                g_h = g_h * (1 - z) + back.T @ g_fed
            flat = raw.reshape(-1)
            g_table = np.stack([np.bincount(flat, g_seen[:, k].reshape(-1), 256) for k in range(3 * size)]).astype(np.float32)
            grads += [g_table, g_back, g_out]
        return loss, [*grads, p.sum(axis=(0, 2))]


def train(segments: list[bytes], labels: list[str], how: Training = Training(), hidden: int = HIDDEN) -> BiGru:
    """A network for the languages among labels; every language has the same weight."""
    languages = sorted(set(labels))
    net = BiGru.fresh(languages, hidden, how.seed)
    if len(languages) < 2:
        return net
    raw = np.zeros((len(segments), how.segment), np.uint8)
    for i, s in enumerate(segments):
        raw[i, : len(s[: how.segment])] = np.frombuffer(s[: how.segment], np.uint8)
    own = [np.array([i for i, label in enumerate(labels) if label == x]) for x in languages]
    rng = np.random.default_rng(how.seed)
    mean, square = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, how.steps + 1):
        label = rng.integers(0, len(languages), how.batch)
        rows = np.array([own[x][rng.integers(len(own[x]))] for x in label])
        _, grads = net.gradients(np.ascontiguousarray(raw[rows].T), label)
        rate = how.rate * min(1.0, step / 20) * (1 - 0.9 * step / how.steps)
        for w, g, m, v in zip(net.weights, grads, mean, square, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: BiGru, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the positions of each text: (texts, languages); zeros for an empty one."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts])
    sums, owner = np.zeros((len(texts), len(net.languages))), np.repeat(np.arange(len(texts)), counts)
    joined = np.zeros((int(counts.sum()), SEGMENT), np.uint8)
    filled = np.zeros(len(joined), np.int64)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        if n:
            joined[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            filled[at : at + n] = SEGMENT
            filled[at + n - 1] = len(t) - SEGMENT * (n - 1)
        at += n
    for lo in range(0, len(joined), LANES):
        raw, own, size = np.ascontiguousarray(joined[lo : lo + LANES].T), owner[lo : lo + LANES], filled[lo : lo + LANES]
        p = net.position_probabilities(raw)
        short = np.flatnonzero(size < SEGMENT)
        p[:, :, short] *= (np.arange(SEGMENT)[:, None] < size[short])[:, None, :]
        per_lane = p.sum(axis=0)
        for k in range(len(net.languages)):
            sums[:, k] += np.bincount(own, per_lane[k], len(texts))
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def _predicted(net: BiGru | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if net:
                texts = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(batch.column("_text").to_pylist(), batch.column("_letters").to_pylist(), strict=True)]
                at = size = 0
                for i in range(len(texts) + 1):
                    if i == len(texts) or size + len(texts[i]) > 1 << 22 and i > at:
                        p = pooled(net, texts[at:i])
                        for k in range(at, i):
                            if texts[k]:
                                best[k], score[k] = net.languages[int(p[k - at].argmax())], min(1.0, float(p[k - at].max()))
                        at, size = i, 0
                    if i < len(texts):
                        size += len(texts[i])
            drop = {"_text", "_letters"}
            keep = [c for c in batch.schema.names if c not in drop]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(best, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return run


def held_out(id_col: str) -> Column:
    """Fixed rule: rows whose CRC-32 of the id as text leaves 1 modulo 3 are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, how: Training = Training()) -> BiGru | None:
    """Learn from rows that aren't held out and have a text with letters and a language.

    The bound on the sample is how.rows for each language: counts are taken over all rows, then a
    hash of the row decides. The segment that stands for a row lies anywhere in its text.
    """
    text = text_of(text_col)
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("_h")).where(F.col("_text").rlike(r"\p{L}"))
    counts = {r["_lang"]: r["_n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("_n")).collect()}  # one row for each language
    if not counts:
        return None
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, lowest(how.rows / n))])
    start = (1 + F.pmod(F.shiftright("_h", 20), F.greatest(F.lit(1), F.length("_text") - how.segment + 1))).cast("int")
    taken = rows.where(F.col("_h") <= most[F.col("_lang")]).select("_lang", "_h", F.substring("_text", start, F.lit(how.segment)).alias("_part"))
    sample = sorted(taken.collect(), key=lambda r: (r["_h"], r["_part"]))
    return train([r["_part"].encode("utf-8", "surrogatepass") for r in sample], [r["_lang"] for r in sample], how) if sample else None


def identify(df: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns, lang_pred and score. See language_id for odd cases."""
    clash = {c: f"_own{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(c).alias(x) for c, x in clash.items()], text_of(text_col).alias("_text")).withColumn("_letters", F.col("_text").rlike(r"\p{L}"))
    kept = [f for f in rows.schema.fields if f.name not in ("_text", "_letters")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    out = rows.mapInArrow(_predicted(net), schema)
    return out.select(*[F.col(x).alias(c) for c, x in clash.items() if c not in ("lang_pred", "score")], "lang_pred", "score")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: Training = Training()) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score.

    lang_pred is a language learned from the rows that aren't held out, or `und` with score 0 where
    the text is null or has no letter, or where nothing could be learned (an empty table gives an
    empty result). With a single language to learn, it gets score 1. Rows with a null id are
    learned from. Equal texts get equal results; ties go to the language first in sort order. Other
    columns of df are neither read nor returned.
    """
    net = fit(df, id_col, text_col, lang_col, how)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identify(rows, net, "doc_id", "text").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
