"""A container format for token ids: adaptive context mixing and range coding in independent blocks.

Ids are cut into blocks of BLOCK_IDS, and each block starts from a fresh model. Three distributions
of the next id are mixed: what followed the two ids before (order 2), what followed the one before
(order 1), and all ids (order 0), each by the counts of the block so far; an id not seen yet has its
share of a fourth, even one. The mixture's weights are learned too, for each pair of classes that
says how often the contexts of order 2 and 1 have been seen. An id is coded as the part of the
mixture that makes it likeliest, by that part's weight, and its interval in that part's counts; both
drive one range coder. Counts and weights are brought up to date when a block has doubled since they
last were, so that a block's first FIRST ids are coded evenly.

A distribution is a sorted list of the ids that followed its context, repeats included: an id's
interval is where it stands there, and a decoded place names the id without a search. Blocks are
coded side by side, one numpy lane each; contexts are hashed to LISTS lists, and contexts that share
a list share its counts.

Container: b"QRC3", then little-endian: u8 nibbles for an id, u32 documents, u64 ids, u32 blocks;
for each document u8 id present, i64 id, u64 length; for each block u32 ids, u32 CRC-32 of its ids
as u32, u32 bytes of payload; then the payloads, 32-bit big-endian digits of the coded number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

MAGIC = b"QRC3"
#: Ids in a block, ids before its first model, and about how many blocks are coded side by side: some 50 bytes for each of their ids.
BLOCK_IDS, FIRST, LANES = 4096, 128, 1024
#: Lists of each order's contexts in a lane.
LISTS = 4096
#: Ids whose counts are looked up together.
AT_ONCE = 1 << 15
#: Weights are out of 1 << SHARE; an interval's width is kept at LEAST or more; contexts are classed by how often they were seen.
SHARE, LEAST, CLASSES = 12, 1 << 30, (1, 2, 4)
_HEAD, _DOC, _BLOCK = struct.Struct("<BIQI"), np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u8")]), np.dtype([("n", "<u4"), ("crc", "<u4"), ("size", "<u4")])
#: Parts of the mixture, in this order: orders 2, 1 and 0, and the even one.
_PARTS, _PAIRS, _LOW = 4, (len(CLASSES) + 1) ** 2, (1 << 20) - 1
_CLASS_OF = np.array([sum(n >= c for c in CLASSES) for n in range(CLASSES[-1] + 1)])
#: Bits of a share's edge.
_EDGE = SHARE + 1


def generations(steps: int) -> Iterator[tuple[int, int]]:
    """Ranges of steps that are coded by one state of the model."""
    lo, hi = 0, FIRST
    while lo < steps:
        yield lo, min(hi, steps)
        lo, hi = hi, hi * 2


def _context(order: int, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The list of a context: of the id before, or of both ids before (64-bit numbers without sign)."""
    if order == 1:
        return before & (LISTS - 1)
    return (before * 0x9E3779B97F4A7C15 + earlier * 0xC2B2AE3D27D4EB4F) >> (65 - LISTS.bit_length())


def _keys(bits: int, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Lane, list and id as one number, for orders 2, 1 and 0: ids (lanes, some)."""
    lane, own = np.arange(len(ids))[:, None] * LISTS, ids.view(np.uint64)
    before, earlier = _before(own, 1), _before(own, 2)
    for order in (2, 1):
        lists = _context(order, before, earlier).view(np.int64)
        lists += lane
        lists <<= bits
        lists |= ids
        yield lists
    yield (lane << bits) | ids


def _class(sizes: np.ndarray) -> np.ndarray:
    return _CLASS_OF.take(np.minimum(sizes, CLASSES[-1]))


def _shares(hits: np.ndarray, known: bool) -> np.ndarray:
    """Below which of 1 << SHARE each part begins: (lanes, pairs of classes, parts + 1). A part without counts has none."""
    room = np.array([[known and two > 0, known and one > 0, known, True] for two in range(len(CLASSES) + 1) for one in range(len(CLASSES) + 1)], np.int64)
    # A pair's own hits count most; a sixteenth of all the lane's hits, and one, are added.
    weights = (hits * 16 + hits.sum(axis=1, keepdims=True) + 16) * room
    sizes = (weights * ((1 << SHARE) - _PARTS) // weights.sum(axis=2, keepdims=True) + 1) * room
    out = np.zeros((*sizes.shape[:2], _PARTS + 1), np.int64)
    np.cumsum(sizes, axis=2, out=out[:, :, 1:])
    out[:, :, _PARTS] = 1 << SHARE
    return out


def _edges(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _spread(steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each step, one in the field of each later generation; the place of its own generation's field, and that field's mask. All fields fit in one number."""
    adds, shifts, masks, at = np.zeros(steps, np.int64), np.zeros(steps, np.int64), np.zeros(steps, np.int64), 0
    for lo, hi in generations(steps):
        adds[:lo] += 1 << at
        shifts[lo:hi], masks[lo:hi] = at, (1 << lo.bit_length()) - 1
        at += lo.bit_length()
    return adds * (masks[-1] > 0), shifts, masks


def _stands(keys: np.ndarray, bits: int, spread: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each id, given as a key, what the generations before its own have in the list of its context: the list's length << 40 | the id's interval (from << 20 | size).

    One sort brings the ids together, list by list and id by id; counts up to each place give all
    three, those for each generation in a field of its own.
    """
    lanes, steps = keys.shape
    adds, shifts, masks = spread
    packed = ((keys << 20) | np.arange(lanes * steps).reshape(lanes, steps)).reshape(-1)
    packed.sort()
    place = packed & _LOW
    step = place % steps if steps & (steps - 1) else place & (steps - 1)
    packed >>= 20
    edge = _edges(packed)
    count = np.zeros(len(packed) + 1, np.int64)
    np.cumsum(adds.take(step), out=count[1:])
    at = count.take(edge)
    head = _edges(packed.take(edge) >> bits)
    held, first = np.diff(np.append(head, len(edge))), at.take(head)
    runs, shift, mask = np.diff(np.append(edge, len(packed))), shifts.take(step), masks.take(step)
    own = (np.repeat(np.diff(np.append(at, count[-1])), runs) >> shift) & mask
    own |= ((np.repeat(at - np.repeat(first, held), runs) >> shift) & mask) << 20
    own |= ((np.repeat(np.repeat(np.diff(np.append(first, count[-1])), held), runs) >> shift) & mask) << 40
    out = np.empty(lanes * steps, np.int64)
    out[place] = own
    return out.reshape(lanes, steps)


def _before(ids: np.ndarray, by: int) -> np.ndarray:
    """The id that many places before each one, 0 before the first."""
    out = np.zeros_like(ids)
    out[:, by:] = ids[:, :-by]
    return out


def _choose(asked: np.ndarray, stands: list[np.ndarray], hits: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ids of a generation: the pair of classes * parts + the likeliest part, its share (from << 16 | size), and where it stands (length of the list << 40 | from << 20 | size). The first generation has no stands."""
    shares = _shares(hits, bool(stands))
    lengths = [x >> 40 for x in stands]
    pair = _class(lengths[0]) * (len(CLASSES) + 1) + _class(lengths[1]) if stands else np.zeros_like(asked)
    row = (np.arange(len(asked))[:, None] * _PAIRS + pair) * (_PARTS + 1)
    shares = shares.reshape(-1)
    edges = [shares.take(row + k) for k in range(_PARTS)]
    part = np.full(asked.shape, _PARTS - 1, np.int8)
    best = ((1 << SHARE) - edges[_PARTS - 1]) * 2.0**-bits
    for k, (length, stand) in enumerate(zip(lengths, stands, strict=True)):
        likely = (edges[k + 1] - edges[k]) * (stand & _LOW) / np.maximum(length, 1)
        better = (likely > best).view(np.int8)
        np.maximum(best, likely, out=best)
        part += better * (k - part)
    part = part.astype(np.int64)
    row += part
    start = shares.take(row)
    row += 1
    # The even part's list has every id once.
    own = np.stack([*stands, (1 << (bits + 40)) | (asked << 20) | 1]) if stands else ((1 << (bits + 40)) | (asked << 20) | 1)[None]
    own = own.reshape(-1).take((part if stands else 0) * asked.size + np.arange(asked.size).reshape(asked.shape))
    return pair * _PARTS + part, (start << 16) | (shares.take(row) - start), own


def _groups(blocks: int) -> Iterator[range]:
    """Blocks that are coded side by side, in groups of about LANES: a step costs much the same for a few as for all, so that no small rest is coded by itself."""
    some = max(1, round(blocks / LANES))
    for k in range(some if blocks else 0):
        yield range(blocks * k // some, blocks * (k + 1) // some)


def _blocks(lanes: int, n: int) -> Iterator[slice]:
    """Lanes that are looked at together: few enough for their numbers to stay in a processor's cache."""
    some = max(1, AT_ONCE // n)
    for i in range(0, lanes, some):
        yield slice(i, min(i + some, lanes))


class _Lists:
    """All lists after some ids of each lane, for decoding."""

    def __init__(self, lanes: int, most: int, bits: int) -> None:
        self.bits = bits
        #: For each part and list: where it begins in self.entries << 32, its length << 8, its class (of order 2, times the number of classes).
        self.heads = [np.zeros(n, np.uint64) for n in (lanes * LISTS, lanes * LISTS, lanes)]
        #: For each place of a list: the id << 40, its interval's first place in the list << 20, its length. First those of the list that has every id once.
        self.entries = np.empty((1 << bits) + 3 * lanes * most, np.uint64)
        every = np.arange(1 << bits, dtype=np.uint64)
        self.even = len(every) << 8
        self.entries[: len(every)] = (every << 40) | (every << 20) | 1

    def learn(self, seen: np.ndarray) -> None:
        """seen (lanes, n): all ids so far. A list that had ids has them still, so that each head is written anew."""
        lanes, n = seen.shape
        bits = self.bits
        begin = 1 << bits
        for some in _blocks(lanes, n) if n else ():
            own = seen[some].astype(np.int64)
            for k, keys in enumerate(_keys(bits, own)):
                keys = keys.reshape(-1)
                keys.sort()
                edge = _edges(keys)
                first, runs = keys.take(edge), np.diff(np.append(edge, len(keys)))
                lists = first >> bits
                head = _edges(lists)
                starts, lists = edge.take(head), lists.take(head)
                sizes = np.diff(np.append(starts, len(keys)))
                first &= (1 << bits) - 1
                first <<= 20
                first |= edge - np.repeat(starts, np.diff(np.append(head, len(edge))))
                self.entries[begin : begin + len(keys)] = np.repeat((first << 20) | runs, runs)
                at = some.start * LISTS + lists if k < 2 else some.start + lists // LISTS
                self.heads[k][at] = ((starts + begin) << 32) | (sizes << 8) | _class(sizes) * (1 if k else len(CLASSES) + 1)
                begin += len(keys)


def _hit_counts(hits: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """hits with those of coded (lanes, some) added."""
    lanes = len(hits)
    at = (np.arange(lanes)[:, None] * (_PAIRS * _PARTS) + coded).reshape(-1)
    return hits + np.bincount(at, minlength=hits.size).reshape(hits.shape)


class _Digits:
    """The low ends and widths of the lanes' intervals; low ends keep 64 bits, and carries are settled at the end."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 62)
        self.out = np.zeros((lanes, steps * 5 // 4 + 8), np.int64)
        #: Where a lane's next digit goes in self.out, and where its first went.
        self.first = np.arange(lanes) * self.out.shape[1]
        self.at = self.first.copy()

    def narrow(self, share: np.ndarray, span: np.ndarray) -> None:
        share, part = share.astype(np.int64), self.width >> SHARE
        low = part * (share >> 16)
        part *= share & 0xFFFF
        part //= span >> 40
        low += part * ((span >> 20) & _LOW)
        part *= span & _LOW
        low = self.low + low.view(np.uint64)
        if (over := low < self.low).any():
            self.out.reshape(-1)[self.at[over] - 1] += 1
        # The digit of a lane that isn't due yet is written over later.
        due = (part < LEAST).astype(np.int64)
        self.out.reshape(-1)[self.at] = (low >> np.uint64(32)).view(np.int64)
        self.at += due
        by = due << 5
        part <<= by
        low <<= by.view(np.uint64)
        self.low, self.width = low, part

    def payload(self, lane: int) -> bytes:
        used, low = int(self.at[lane] - self.first[lane]), int(self.low[lane])
        digits = self.out[lane, : used + 2].copy()
        digits[used:] = low >> 32, low & 0xFFFFFFFF
        # A digit may have passed 32 bits by carries, which go to the digits before it.
        while (over := np.flatnonzero(digits >> 32)).size:
            digits[over - 1] += digits[over] >> 32
            digits[over] &= 0xFFFFFFFF
        return digits.astype(">u4").tobytes()


def _encode_lanes(ids: np.ndarray, bits: int, sizes: list[int]) -> list[bytes]:
    """ids: (lanes, steps); of a lane, so many as sizes says are coded."""
    lanes, steps = ids.shape
    share, span, spread = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int64), _spread(steps)
    for some in _blocks(lanes, steps):
        own = ids[some].astype(np.int64)
        stands, hits = [_stands(keys, bits, spread) for keys in _keys(bits, own)], np.zeros((len(own), _PAIRS, _PARTS), np.int64)
        for lo, hi in generations(steps):
            coded, shares, spans = _choose(own[:, lo:hi], [x[:, lo:hi] for x in stands] if lo else [], hits, bits)
            share[lo:hi, some], span[lo:hi, some] = shares.T, spans.T
            hits = _hit_counts(hits, coded)
    digits, short = _Digits(lanes, steps), {}
    for i, n in enumerate(sizes):
        if n < steps:
            short.setdefault(n, []).append(i)
    payloads: dict[int, bytes] = {}
    for t in range(steps):
        payloads.update((i, digits.payload(i)) for i in short.get(t, ()))
        digits.narrow(share[t], span[t])
    return [payloads[i] if i in payloads else digits.payload(i) for i in range(lanes)]


def _decode_lanes(payloads: list[bytes], steps: int, bits: int) -> np.ndarray:
    lanes = len(payloads)
    most = max(len(p) for p in payloads) // 4 + 2
    table = np.zeros((lanes, most), np.uint64)
    for i, p in enumerate(payloads):
        table[i, : len(p) // 4] = np.frombuffer(p, ">u4")
    lane = np.arange(lanes, dtype=np.uint64)
    # The coded number is below 2**62 of its first two digits' 2**64: the first interval is that wide.
    code, width, digits, used = (table[:, 0] << 32) | table[:, 1], np.full(lanes, 1 << 62, np.uint64), table.reshape(-1), np.arange(lanes) * most + 2
    ids, coded = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), np.uint8)
    hits, model, mask = np.zeros((lanes, _PAIRS, _PARTS), np.int64), _Lists(lanes, max(lo for lo, _ in generations(steps)), bits), (1 << _EDGE) - 1
    earlier = before = np.zeros(lanes, np.uint64)
    base, rows = lane * LISTS, lane * _PAIRS
    for lo, hi in generations(steps):
        model.learn(ids[:lo].T)
        # A pair's shares in one number: where the parts after the first begin, and the end.
        edges = (_shares(hits, lo > 0)[:, :, 1:] << (np.arange(_PARTS) * _EDGE)).sum(axis=2).reshape(-1).view(np.uint64)
        heads = np.stack([lane, lane, model.heads[2], np.full(lanes, model.even, np.uint64)])
        two, one, _, _ = heads
        flat = heads.reshape(-1)
        for t in range(lo, hi):
            # mode: with the others, take copies through a buffer. Of a damaged payload, places may lie outside.
            model.heads[0].take((base + _context(2, before, earlier)).view(np.int64), out=two, mode="clip")
            model.heads[1].take((base + _context(1, before, earlier)).view(np.int64), out=one, mode="clip")
            pair = two + one
            pair &= 255
            ends = edges.take((rows + pair).view(np.int64))
            step = width >> SHARE
            part = (step * (ends & mask) <= code).view(np.uint8)
            part += (step * ((ends >> _EDGE) & mask) <= code).view(np.uint8)
            part += (step * ((ends >> (2 * _EDGE)) & mask) <= code).view(np.uint8)
            part = part.astype(np.uint64)
            pair *= _PARTS
            pair += part
            coded[t] = pair
            head = flat.take((part * lanes + lane).view(np.int64))
            part *= _EDGE
            start = (ends << _EDGE) >> part
            start &= mask
            ends >>= part
            ends &= mask
            ends -= start
            code = code - step * start
            size = head >> 8
            size &= 0xFFFFFF
            step *= ends
            step //= size
            size -= 1
            at = np.minimum(code // step, size)
            head >>= 32
            head += at
            entry = model.entries.take(head.view(np.int64), mode="clip")
            code -= step * ((entry >> 20) & _LOW)
            width = step * (entry & _LOW)
            due = (width < LEAST).astype(np.uint64)
            by = due << 5
            code <<= by
            code |= digits.take(used, mode="clip") * due
            width <<= by
            used += due.view(np.int64)
            earlier, before = before, entry >> 40
            ids[t] = before
        hits = _hit_counts(hits, coded[lo:hi].T)
    return ids.T


@dataclass
class Container:
    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, nibbles: int = 4) -> bytes:
    """One container. Every id must be below 16 ** nibbles, and nibbles at most 4."""
    return pack_all([Container(doc_ids, lengths, ids)], nibbles)[0]


def pack_all(containers: list[Container], nibbles: int = 4) -> list[bytes]:
    """Several containers, each as pack makes it; their blocks are coded side by side."""
    cuts: list[list[np.ndarray]] = []
    for c in containers:
        ids = np.ascontiguousarray(c.ids, np.uint32)
        if nibbles > 4 or len(ids) and int(ids.max()) >> (4 * nibbles):
            raise ValueError(f"an id needs more than {min(nibbles, 4)} nibbles")
        cuts.append([ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)])
    every = [b for cut in cuts for b in cut]
    payloads: list[bytes] = []
    for own in _groups(len(every)):
        group = every[own.start : own.stop]
        # Lanes of shorter blocks go on with zeros that aren't kept.
        table = np.zeros((len(group), max(map(len, group))), np.uint32)
        for i, b in enumerate(group):
            table[i, : len(b)] = b
        payloads += _encode_lanes(table, 4 * nibbles, list(map(len, group)))
    out: list[bytes] = []
    for c, cut in zip(containers, cuts, strict=True):
        own, payloads = payloads[: len(cut)], payloads[len(cut) :]
        docs, blocks = np.zeros(len(c.doc_ids), _DOC), np.zeros(len(cut), _BLOCK)
        docs["has"], docs["id"], docs["n"] = [x is not None for x in c.doc_ids], [x or 0 for x in c.doc_ids], c.lengths
        blocks["n"], blocks["crc"], blocks["size"] = [len(b) for b in cut], [zlib.crc32(b.astype("<u4").tobytes()) for b in cut], [len(p) for p in own]
        out.append(b"".join([MAGIC, _HEAD.pack(nibbles, len(c.doc_ids), len(c.ids), len(cut)), docs.tobytes(), blocks.tobytes(), *own]))
    return out


def unpack(content: bytes) -> Container:
    """Reads a container; a block whose checksum differs is an error that names it."""
    return unpack_all([content])[0]


def unpack_all(contents: list[bytes]) -> list[Container]:
    """Reads several containers, whose blocks are decoded side by side."""
    heads, payloads, sizes = [], [], []
    for content in contents:
        if content[:4] != MAGIC:
            raise ValueError("not a container of token ids")
        nibbles, n_docs, n_ids, n_blocks = _HEAD.unpack_from(content, 4)
        at = 4 + _HEAD.size
        docs = np.frombuffer(content, _DOC, n_docs, at)
        at += docs.nbytes
        blocks = np.frombuffer(content, _BLOCK, n_blocks, at)
        at += blocks.nbytes
        bounds = at + np.concatenate([[0], np.cumsum(blocks["size"].astype(np.int64))])
        heads.append((nibbles, docs, n_ids, blocks))
        payloads += [content[a:b] for a, b in pairwise(bounds.tolist())]
        sizes += blocks["n"].tolist()
    if len({nibbles for nibbles, *_ in heads}) > 1:
        return [unpack(content) for content in contents]
    parts: list[np.ndarray] = []
    for own in _groups(len(payloads)):
        table = _decode_lanes(payloads[own.start : own.stop], max(sizes[own.start : own.stop]), 4 * heads[0][0])
        parts += [table[i - own.start, : sizes[i]] for i in own]
    out: list[Container] = []
    for _, docs, n_ids, blocks in heads:
        own, parts = parts[: len(blocks)], parts[len(blocks) :]
        for i, block in enumerate(own):
            if zlib.crc32(block.astype("<u4").tobytes()) != blocks["crc"][i]:
                raise ValueError(f"block {i} is damaged")
        ids = np.concatenate(own) if own else np.zeros(0, np.uint32)
        if len(ids) != n_ids or int(docs["n"].sum()) != n_ids:
            raise ValueError("the container's index and blocks disagree")
        out.append(Container([int(i) if h else None for h, i in zip(docs["has"], docs["id"], strict=True)], docs["n"].astype(np.int64), ids))
    return out
