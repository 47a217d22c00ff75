"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions.

The patterns' spans are exact rules. The network learns, in numpy, from those spans in a bounded
sample of rows, many of them rewritten as people write such data to keep it from patterns or by
habit (marks spelled out, other separators, no plus sign), among numbers that are none. It adds the
spans that the patterns miss. It reads every character of every text, in windows that overlap. A
window in which every place is so surely outside that no path could be better is settled by that
bound; the others are decoded (Viterbi, and each place's probability). The windows' tags are laid
side by side, each window answering for its middle, so that a span is judged whole wherever windows
end and however long it is. Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import lowest, text_of
from quillroster.llm.words import parts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

#: The contract's patterns. A number's match can only begin where its run of digits does, hence the
#: look-behinds; runs never give back, so that long runs cost linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")

#: Characters of a window, from one to the next, and windows that are read side by side.
WINDOW, STRIDE, LANES = 256, 232, 1024
HIDDEN, SYMBOLS, TAGS, PAD = 8, 131, 9, 130
#: The least mean probability of an added span's characters.
SURE = 0.85


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    # Leading zeros aside, a part of over three digits is too large and isn't turned into a number.
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _symbol_table() -> np.ndarray:
    """Code point -> ASCII for itself, 128 for other letters, 129 for the rest; beyond the table all are the rest."""
    return np.array([c if c < 128 else 128 if chr(c).isalpha() else 129 for c in range(0x3000)], np.uint8)


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_SYMBOL), _SYMBOL.take(points, mode="clip"), np.uint8(129))


def tags_of(spans: list[Span], start: int, size: int) -> np.ndarray:
    """0 outside, 1 + 2 kind where a span begins, 2 + 2 kind inside it."""
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if 0 <= a and b <= size:
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def windows(size: int) -> list[int]:
    """Starts of the windows that cover a text of that size."""
    return list(range(0, max(1, size - (WINDOW - STRIDE)), STRIDE)) if size else []


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _allowed() -> np.ndarray:
    """Transitions: a kind's inside follows its beginning or inside only."""
    out = np.zeros((TAGS, TAGS), bool)
    for a in range(TAGS):
        for b in range(TAGS):
            out[a, b] = b == 0 or b % 2 == 1 or (a > 0 and (a - 1) // 2 == (b - 1) // 2)
    return out


_ALLOWED = _allowed()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """weights: for each direction the symbol table (4H, SYMBOLS), the recurrent matrix (4H, H), the output (TAGS, H); then bias and transitions."""

    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, hidden: int = HIDDEN, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        one = lambda *shape: rng.standard_normal(shape) * 0.25
        net = cls([w for _ in range(2) for w in (one(4 * hidden, SYMBOLS), one(4 * hidden, hidden), one(TAGS, hidden))] + [np.zeros(TAGS), np.zeros((TAGS, TAGS))])
        for table in (net.weights[0], net.weights[3]):
            table[hidden : 2 * hidden] += 1  # cells remember at first
        return net

    def transitions(self) -> np.ndarray:
        return np.where(_ALLOWED, self.weights[7], -1e4)

    def emissions(self, x: np.ndarray, traces: tuple | None = None) -> np.ndarray:
        """x: (steps, lanes) symbols -> (steps, TAGS, lanes)."""
        out = np.zeros((x.shape[0], TAGS, x.shape[1]), self.weights[6].dtype) + self.weights[6][:, None]
        if traces is None:
            for d in range(2):
                self._read_one_way(x, d, out)
            return out
        for d, order in enumerate((range(len(x)), range(len(x) - 1, -1, -1))):
            table, back, read = self.weights[3 * d : 3 * d + 3]
            n = back.shape[1]
            h = c = np.zeros((n, x.shape[1]), back.dtype)
            for t in order:
                pre = table.take(x[t], axis=1) + back @ h
                all_ = _soft(pre)
                gates, aim = 0.5 + 0.5 * all_[: 3 * n], all_[3 * n :]
                i, f, o = gates[:n], gates[n : 2 * n], gates[2 * n :]
                new = f * c + i * aim
                if traces is not None:
                    traces[d].append((t, h, c, pre, gates, aim, new))
                c = new
                h = o * _soft(c)
                out[t] += read @ h
        return out

    def _read_one_way(self, x: np.ndarray, d: int, out: np.ndarray) -> None:
        """Add one direction's emissions to out, in arrays that are made once."""
        table, back, read = self.weights[3 * d : 3 * d + 3]
        n, lanes = back.shape[1], x.shape[1]
        pre, tmp = np.empty((4 * n, lanes), back.dtype), np.empty((4 * n, lanes), back.dtype)
        h, c, kept = np.zeros((n, lanes), back.dtype), np.zeros((n, lanes), back.dtype), np.empty((n, lanes), back.dtype)
        told = np.empty((TAGS, lanes), back.dtype)
        gates, aim = pre[: 3 * n], pre[3 * n :]
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            np.matmul(back, h, out=pre)
            np.take(table, x[t], axis=1, out=tmp, mode="clip")
            pre += tmp
            np.abs(pre, out=tmp)
            tmp += 1
            pre /= tmp
            gates *= 0.5
            gates += 0.5
            c *= gates[n : 2 * n]
            np.multiply(gates[:n], aim, out=kept)
            c += kept
            np.abs(c, out=kept)
            kept += 1
            np.divide(c, kept, out=h)
            h *= gates[2 * n :]
            np.matmul(read, h, out=told)
            out[t] += told

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log sums: (steps, TAGS, lanes) each."""
        move = self.transitions()[:, :, None]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + np.where(_ALLOWED[0], 0, -1e4)[:, None]
        for t in range(1, len(e)):
            a[t] = e[t] + _logsum(a[t - 1][:, None] + move, 0)
        for t in range(len(e) - 2, -1, -1):
            b[t] = _logsum((b[t + 1] + e[t + 1])[None] + move, 1)
        return a, b

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of the tags for each lane, and its gradients."""
        traces: tuple[list, list] = ([], [])
        e = self.emissions(x, traces)
        a, b = self.sums(e)
        total, lanes, move = _logsum(a[-1], 0), np.arange(x.shape[1]), self.transitions()
        at = np.arange(len(x))[:, None]
        score = e[at, tags, lanes].sum(axis=0) + move[tags[:-1], tags[1:]].sum(axis=0)
        g_e = np.exp(a + b - total)
        g_e[at, tags, lanes] -= 1
        g_e /= x.shape[1]
        g_move = np.zeros_like(move)
        for t in range(1, len(x)):
            pair = np.exp(a[t - 1][:, None] + move[:, :, None] + (e[t] + b[t])[None] - total)
            g_move += pair.sum(axis=2)
        np.subtract.at(g_move, (tags[:-1], tags[1:]), 1.0)
        grads: list[np.ndarray] = []
        for d in range(2):
            table, back, read = self.weights[3 * d : 3 * d + 3]
            n = back.shape[1]
            g_table, g_back, g_read = np.zeros_like(table), np.zeros_like(back), np.zeros_like(read)
            g_h = g_c = np.zeros((n, x.shape[1]))
            g_pre_all = np.zeros((len(x), 4 * n, x.shape[1]))
            for t, h, c, pre, gates, aim, new in reversed(traces[d]):
                i, f, o = gates[:n], gates[n : 2 * n], gates[2 * n :]
                out = _soft(new)
                g_read += g_e[t] @ (o * out).T
                g_h = g_h + read.T @ g_e[t]
                g_c = g_c + g_h * o / (1 + np.abs(new)) ** 2
                g_gates = np.concatenate([g_c * aim, g_c * c, g_h * out]) * 0.5 / (1 + np.abs(pre[: 3 * n])) ** 2
                g_pre = np.concatenate([g_gates, g_c * i / (1 + np.abs(pre[3 * n :])) ** 2])
                g_pre_all[t] = g_pre
                g_back += g_pre @ h.T
                g_h, g_c = back.T @ g_pre, g_c * f
            flat = x.reshape(-1)
            for k in range(4 * n):
                g_table[k] = np.bincount(flat, g_pre_all[:, k].reshape(-1), SYMBOLS)
            grads += [g_table, g_back, g_read]
        return float((total - score).mean()), [*grads, g_e.sum(axis=(0, 2)), np.where(_ALLOWED, g_move / x.shape[1], 0)]

    def lean(self) -> Tagger:
        """The same network in single precision, for reading."""
        return Tagger([w.astype(np.float32) for w in self.weights])

    def doubtful(self, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Lanes of emissions in which some other path could be likelier than being outside at all places from lo up to hi.

        What a stretch inside gains over being outside is bounded by its places' gains, each with the
        best transition there is for it: into the stretch, on inside it, and out of it. Stretches that
        lie before lo or behind hi change nothing between.
        """
        move = self.transitions()
        into, on, out = (float(x.max() - move[0, 0]) for x in (move[0, 1:], move[1:, 1:], move[1:, 0]))
        gain = e[:, 1:].max(axis=1) - e[:, 0]
        best = gain[0].astype(np.float64)
        own, some = np.where(lo == 0, best, -np.inf), np.zeros(len(best), bool)
        for t in range(len(e)):
            if t:
                best = np.maximum(best + on, into) + gain[t]
                own = np.where((t >= lo) & (t < hi), best, own + on + gain[t])
            some |= own + (out if t < len(e) - 1 else 0) >= 0
        return np.flatnonzero(some)

    def path(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags (steps, lanes) for emissions."""
        move = np.where(_ALLOWED, self.weights[7], -1e4).astype(e.dtype)
        best = [e[0] + np.where(_ALLOWED[0], 0, -1e4).astype(e.dtype)[:, None]]
        for t in range(1, len(e)):
            best.append((best[-1][:, None] + move[:, :, None]).max(axis=0) + e[t])
        tags = np.zeros((len(e), e.shape[2]), np.int64)
        tags[-1] = best[-1].argmax(axis=0)
        for t in range(len(e) - 2, -1, -1):
            tags[t] = (best[t] + move[:, tags[t + 1]]).argmax(axis=0)
        return tags

    def probabilities(self, e: np.ndarray) -> np.ndarray:
        """Each tag's probability at each place (steps, TAGS, lanes)."""
        e = e.astype(np.float64)
        a, b = self.sums(e)
        return np.exp(a + b - _logsum(a[-1], 0))


_NUMBER = re.compile(r"[0-9]+")
_AT, _DOT = re.compile(r"@|\bat\b", re.IGNORECASE), re.compile(r"\.|\bdot\b", re.IGNORECASE)


def _acceptable(kind: int, text: str) -> bool:
    """What a span of the kind has to have, however it is written; the network decides the rest."""
    numbers = _NUMBER.findall(text)
    digits = sum(map(len, numbers))
    if kind == 0:
        at = list(_AT.finditer(text))
        return len(at) == 1 and at[0].start() > 0 and bool(_DOT.search(text, at[0].end())) and "\n" not in text
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(numbers))
    return 9 <= digits <= 15 and len(numbers) > 1 and not any(c.isalpha() for c in text)


class _Reading:
    """The windows over some texts laid end to end: each answers up to the middle of what it shares with the next one."""

    def __init__(self, tagger: Tagger, texts: list[str]) -> None:
        self.tagger, self.lean = tagger, tagger.lean()
        each = [symbols(t) for t in texts]
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        self.joined = np.concatenate([*each, np.full(WINDOW, PAD, np.uint8)])
        starts = [np.array(windows(len(x)), np.int64) for x in each]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
        at, half = np.concatenate([np.zeros(0, np.int64), *starts]), (WINDOW - STRIDE) // 2
        self.end, size = self.begin[owner + 1], (self.begin[1:] - self.begin[:-1])[owner]
        self.start = self.begin[owner] + at
        self.lo, self.hi = np.where(at == 0, 0, half), np.where(at + WINDOW >= size, size - at, WINDOW - half)

    def emissions(self, some: np.ndarray) -> np.ndarray:
        places = self.start[some] + np.arange(WINDOW)[:, None]
        return self.lean.emissions(np.where(places < self.end[some], self.joined.take(places, mode="clip"), np.uint8(PAD)))

    def answers(self, some: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
        """For each window its lane, the places that it answers for, and where they are in it."""
        for lane, w in enumerate(some.tolist()):
            s, a, b = int(self.start[w]), int(self.lo[w]), int(self.hi[w])
            yield lane, slice(s + a, s + b), slice(a, b)

    def tags(self) -> np.ndarray:
        """The likeliest tag at every place."""
        out = np.zeros(self.begin[-1], np.uint8)
        for k in range(0, len(self.start), LANES):
            some = np.arange(k, min(k + LANES, len(self.start)))
            e = self.emissions(some)
            doubtful = self.lean.doubtful(e, self.lo[some], self.hi[some])
            for j in range(0, len(doubtful), 256):
                part = doubtful[j : j + 256]
                found = self.lean.path(e[:, :, part])
                for lane, there, here in self.answers(some[part]):
                    out[there] = found[here, lane]
        return out

    def sure(self, tags: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """The mean probability of each span's tags (spans ascend, in places of all texts)."""
        p = np.zeros(len(tags), np.float32)
        lows = np.searchsorted(self.start + self.hi, [a for a, _ in spans], side="right")
        highs = np.searchsorted(self.start + self.lo, [b for _, b in spans], side="left")
        wanted = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(lows, highs, strict=True)]))
        for k in range(0, len(wanted), 256):
            some = wanted[k : k + 256]
            each = self.tagger.probabilities(self.emissions(some))
            for lane, there, here in self.answers(some):
                p[there] = each[np.arange(here.start, here.stop), tags[there], lane]
        return np.array([p[a:b].mean() for a, b in spans])


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """Spans that the network finds beside the base ones."""
    out: list[list[Span]] = [[] for _ in texts]
    reading = _Reading(tagger, texts)
    tags, begin = reading.tags(), reading.begin
    inside = np.flatnonzero(tags)
    if not len(inside):
        return out
    kind = (tags[inside].astype(np.int64) - 1) // 2
    opens = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(kind) != 0)]) | (tags[inside] % 2 == 1) | np.isin(inside, begin)
    heads = np.flatnonzero(opens)
    starts, ends = inside[heads], inside[np.append(heads[1:], len(inside)) - 1] + 1
    owners = np.searchsorted(begin, starts, side="right") - 1
    found: list[tuple[int, Span]] = []
    for k, q, a, b in zip(owners.tolist(), kind[heads].tolist(), (starts - begin[owners]).tolist(), (ends - begin[owners]).tolist(), strict=True):
        if b - a > 5 and _acceptable(q, texts[k][a:b]) and not any(x < b and a < y for _, x, y in bases[k]):
            found.append((k, (q, a, b)))
    if found:
        for (k, span), p in zip(found, reading.sure(tags, [(int(begin[k]) + a, int(begin[k]) + b) for k, (_, a, b) in found]), strict=True):
            if p >= SURE:
                out[k].append(span)
    return out


@dataclass(frozen=True)
class Training:
    """marked, others: distinct texts with and without a digit or an at sign that are taken at most (about; a hash of the text decides), each rewritten in so many variants, up to four windows of each."""

    marked: int = 1000
    others: int = 300
    variants: int = 4
    steps: int = 900
    batch: int = 128
    window: int = 80
    rate: float = 0.05
    seed: int = 5


def _spelled(kind: int, own: str, rng: np.random.Generator) -> str:
    """The same data as a pattern would miss it."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    digits = re.sub(r"[^0-9]", "", own)
    if kind == 0:
        at, dot = pick((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", " . "), (" AT ", " DOT "), ("@", " dot "), (" (at) ", "."))
        local, domain = own.rsplit("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return own.replace(".", pick("[.]", " . ", " dot ", "(.)", ". "))
    if kind == 2:
        mark = pick(".", "  ", "/", "_", " - ")
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if len(digits) < 10:
        return own
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10] or 1} {a} {b} {c}", f"{a}/{b}-{c}")


def _other_number(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    n = int(rng.integers(0, 11))
    return (
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(0, 24):02}:{rng.integers(0, 60):02}:{rng.integers(0, 60):02}",
        f"{rng.integers(1, 20)}.{rng.integers(0, 20)}", f"v{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"{d(2)},{d(3)}.{d(2)}", d(int(rng.integers(1, 9))),
        d(int(rng.integers(20, 30))), rng.bytes(int(rng.choice([8, 16, 20]))).hex(), f"#{d(6)}", f"{rng.integers(1, 100)}%", f"{d(3)}/{d(3)}",
    )[n]


def _invented(kind: int, words: list[str], rng: np.random.Generator) -> str:
    """Data of a kind in the pattern's form, of random digits and of a text's words."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: words[int(rng.integers(len(words)))].lower() if words else d(3)
    if kind == 0:
        local = word() + (("", ".", "_", "-")[int(rng.integers(4))] + word()) * int(rng.integers(2)) + d(int(rng.integers(0, 4)))
        return f"{local}@{word()}{('-' + word()) * int(rng.random() < 0.2)}.{('com', 'org', 'net', 'de', 'io', 'edu', 'co.uk', 'example')[int(rng.integers(8))]}"
    if kind == 1:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        first = d(15)
        return first + next(c for c in "0123456789" if luhn(first + c))
    return f"+{rng.integers(1, 99)} {d(3)} {d(3)} {d(4)}"


def _rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A text with its spans and two more, about half of them spelled so that patterns miss them, and with numbers that are none of these."""
    gaps = [m.start() for m in re.finditer(" ", text)]
    words = [w for w in text[:2000].split() if w.isascii() and w.isalpha()]
    new = [(int(rng.integers(4)), g, g) for g in (rng.choice(gaps, 2) if gaps else ()) if not any(a <= g <= b for _, a, b in spans)]
    out, at, moved, size = [], 0, [], 0

    def put(part: str) -> None:
        nonlocal size
        out.append(part)
        size += len(part)

    for kind, a, b in sorted([*spans, *new], key=lambda s: s[1]):
        if a < at:
            continue
        put(text[at:a])
        if rng.random() < 0.3:
            put(f" {_other_number(rng)} ")
        if a == b:
            put(" ")
        own = _invented(kind, words, rng) if a == b or rng.random() < 0.3 else text[a:b]
        own = _spelled(kind, own, rng) if rng.random() < 0.6 else own
        moved.append((kind, size, size + len(own)))
        put(own)
        at = b
        if rng.random() < 0.2:
            put(" " + _other_number(rng))
    return "".join([*out, text[at:]]), moved


def _unsure(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Numbers of a card's length that aren't cards: neither examples nor counterexamples, as the check alone tells them apart."""
    return [m.span() for m in _CARD.finditer(text) if sum(c.isdigit() for c in m[0]) in range(13, 20) and (2, *m.span()) not in spans]


def _examples(seed: int, window: int, variants: int = 1):
    """(_h, _text) -> rows of _h, _x and _tags: windows with their tags, from at most four places of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            hs, xs, ts = [], [], []
            for h, text in zip(batch.column("_h").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                rng, base = np.random.default_rng([seed, h & 0xFFFFFFFF]), base_spans(text)
                for _ in range(variants):
                    new, spans = _rewritten(text, base, rng)
                    odd = _unsure(new, spans)
                    coded = symbols(new)
                    # Three windows about spans or other numbers, and one anywhere.
                    marks = [a for _, a, _ in spans] or [m.start() for m in _ANY.finditer(new)]
                    near = rng.choice(marks, 3) - rng.integers(0, window, 3) if marks else []
                    for s in sorted({max(0, min(int(v), len(new) - window)) for v in [*near, int(rng.integers(0, len(new)))]}):
                        if any(a < s + window and s < b for a, b in odd):
                            continue
                        x = np.full(window, PAD, np.uint8)
                        own = coded[s : s + window]
                        x[: len(own)] = own
                        # A span that the window's edge cuts is known by the part inside.
                        cut = [(k, max(a, s), min(b, s + window)) for k, a, b in spans if a < s + window and s < b]
                        hs.append(h)
                        xs.append(x.tobytes())
                        ts.append(tags_of(cut, s, window).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(xs, pa.binary()), pa.array(ts, pa.binary())], ["_h", "_x", "_tags"])

    return run


def train(x: np.ndarray, tags: np.ndarray, how: Training = Training()) -> Tagger:
    """x, tags: (windows, characters)"""
    tagger, rng = Tagger.fresh(), np.random.default_rng(how.seed)
    mean, square = [np.zeros_like(w) for w in tagger.weights], [np.zeros_like(w) for w in tagger.weights]
    for step in range(1, how.steps + 1):
        rows = rng.integers(len(x), size=how.batch)
        _, grads = tagger.gradients(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(tags[rows].T))
        rate = how.rate * min(1.0, step / 10) * (1 - 0.9 * step / how.steps)
        for w, g, m, v in zip(tagger.weights, grads, mean, square, strict=True):
            np.clip(g, -5, 5, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


def fit(df: DataFrame, text_col: str = "text", how: Training = Training()) -> Tagger | None:
    """A tagger from a bounded sample of distinct texts, those with a digit or an at sign first of all; None where there are none of these."""
    rows = df.select(text_of(text_col).alias("_text")).where("_text <> ''").select("_text", F.xxhash64(F.lit(how.seed), "_text").alias("_h"), F.col("_text").rlike("[0-9@]").alias("_marked"))
    # Texts are told apart by their hashes, so that copies are counted once and only hashes are shuffled.
    n = {r["_marked"]: r["n"] for r in rows.select("_marked", "_h").distinct().groupBy("_marked").agg(F.count("*").alias("n")).collect()}
    if not n.get(True):
        return None
    most = F.when(F.col("_marked"), lowest(how.marked / n[True])).otherwise(lowest(how.others / n.get(False, 1)))
    taken = rows.where(F.col("_h") <= most).dropDuplicates(["_h"]).select("_h", "_text")
    sample = sorted({(r["_h"], r["_x"], r["_tags"]) for r in taken.mapInArrow(_examples(how.seed, how.window, how.variants), "_h long, _x binary, _tags binary").collect()})
    if not sample:
        return None
    stack = lambda k: np.array([np.frombuffer(r[k], np.uint8) for r in sample], np.int64)
    return train(stack(1), stack(2), how)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(tagger: Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column("_text").to_pylist()
            bases = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, bases) if tagger else [[] for _ in texts]
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *counts, pa.array([spans_text(b) for b in bases]), pa.array([spans_text(b + m) for b, m in zip(bases, more, strict=True)])], ["_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans as text.

    Spans are kind:start:end in code points, end exclusive, by kind and start. Null text counts as
    empty and has none. Without a tagger, one is trained on df; a table without digits and at signs
    has nothing to train on, and base spans alone are returned. Null and repeated ids are passed
    through. An empty table gives an empty result. Other columns are not read.
    """
    tagger = tagger or fit(df, text_col)
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return rows.mapInArrow(_found(tagger), schema).withColumnRenamed("_id", "doc_id")
