"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words: the words under its ones are hashed, those under its zeros
may be anything. Seeds of a corpus and of a benchmark are joined on their hash; a common seed puts a
benchmark item and a document side by side on one diagonal, and there the words around the hit are
compared. A document is contaminated by an item if, on some diagonal, an aligned stretch of at least
`least_words` words (or the whole item, if it is shorter) differs in at most `substitutions` of its
words.

Corpus seeds are first held against a Bloom filter of the benchmark's, of bounded size, so that only
likely hits are shuffled; the exact join follows, and then the words beside the items that were met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import join_same, materialise, text_of
from quillroster.llm.words import Words, mixed, normal, parts, slices

#: Bits of the filter that is sent to every task: 64 to 128 for each benchmark seed, within these bounds.
FILTER_BITS = (1 << 22, 1 << 28)
#: Bits of the filter that one task sets.
SEGMENT_BITS = 1 << 19


@dataclass(frozen=True)
class Seeds:
    """masks: 1 keeps a word, 0 ignores it. Of 13 words of which 2 are replaced, 4 that follow each other are equal; the other masks find most of what has more replaced."""

    masks: tuple[str, ...] = ("1111", "110101", "1100011", "1010011")
    least_words: int = 13
    substitution_share: float = 0.2

    @property
    def span(self) -> int:
        return max(map(len, self.masks))

    def holed(self, n: int) -> list[str]:
        """Masks over a whole item of n words, one for each set of words that may be replaced and that every other mask meets."""
        holes = min(int(n * self.substitution_share + 1e-9), n - 2)
        if n > self.least_words or holes < 1:
            return []
        fits = [{k + i for i, c in enumerate(m) if c == "1"} for m in self.masks for k in range(n - len(m) + 1)]
        missed = [gone for gone in combinations(range(1, n - 1), holes) if all(ones & set(gone) for ones in fits)]
        return ["".join("0" if i in gone else "1" for i in range(n)) for gone in missed]


def _folded(text: str | None) -> bytes:
    """Words are compared in lower case and without marks at their ends."""
    out = []
    for w in (text or "").lower().split():
        w = w.strip(".,;:!?\"'()[]{}*#$%&-_")
        if w:
            out.append(w)
    return normal(" ".join(out))


def seed_hashes(words: Words, seeds: Seeds, holed: list[str] | tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of every seed in every text; holed: masks of short items beside those of seeds."""
    n = len(words.hashes)
    room = np.repeat(words.first[1:], np.diff(words.first))
    hashes, starts = [], []
    for k, mask in [*enumerate(seeds.masks), *(((1 << 32) | int(m, 2), m) for m in holed)]:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        at = np.flatnonzero(np.arange(n) + len(mask) <= room)
        h = np.full(len(at), k + 1, np.uint64)
        for i in ones:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at + i])
        hashes.append(h)
        starts.append(at)
    return np.concatenate(hashes), np.concatenate(starts)


class Bloom:
    """Four probes for each hash. The bits are set in tasks, a segment each."""

    def __init__(self, bits: int) -> None:
        self.bits = np.uint64(bits - 1)
        self.set = np.zeros(bits >> 3, np.uint8)

    def probes(self, h: np.ndarray, k: int) -> np.ndarray:
        h = h if k < 2 else mixed(h)
        return (h >> np.uint64(32) if k % 2 else h) & self.bits

    def found(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may have been added; each probe looks only at what the last one left."""
        at = np.arange(len(h))
        for k in range(4):
            p = self.probes(h[at], k)
            at = at[(self.set[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return at

    @staticmethod
    def of(hashes: DataFrame, bits: int) -> Bloom:
        """The filter of a column _hash: each bit is dealt to its segment's task, and the driver puts the segments side by side."""
        empty = Bloom(bits)

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("_hash").to_numpy(zero_copy_only=False).view(np.uint64)
                p = np.unique(np.concatenate([empty.probes(h, k) for k in range(4)])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((p // SEGMENT_BITS).astype(np.int32)), pa.array((p % SEGMENT_BITS).astype(np.int32))], ["_segment", "_bit"])

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                segments, bit = batch.column("_segment").to_numpy(), batch.column("_bit").to_numpy().astype(np.int64)
                for s in np.unique(segments).tolist():
                    own = held.setdefault(s, np.zeros(SEGMENT_BITS >> 3, np.uint8))
                    at = bit[segments == s]
                    np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["_segment", "_bytes"])

        segments = hashes.select("_hash").mapInArrow(set_bits, "_segment int, _bit int").repartition("_segment").mapInArrow(gathered, "_segment int, _bytes binary")
        size = SEGMENT_BITS >> 3
        # At most FILTER_BITS[1] bits in all, one segment at a time.
        for row in segments.toLocalIterator():
            empty.set[row["_segment"] * size : (row["_segment"] + 1) * size] = np.frombuffer(row["_bytes"], np.uint8)
        return empty


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_item, _text) -> (_item, _words): the word hashes of each item that has words."""
    for batch in parts(batches):
        for item, text in zip(batch.column("_item"), batch.column("_text").to_pylist(), strict=True):
            own = Words([_folded(text)]).hashes.view(np.int64)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], batch.schema.field("_item").type), pa.ListArray.from_arrays(np.array([0, len(own)], np.int32), pa.array(own))], ["_item", "_words"])


def _benchmark_rows(seeds: Seeds):
    """(_item, _text) -> (_item, _hash, _at, _n): a row for each seed, with the item's number of words."""
    low = min(map(len, seeds.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for item, text in zip(batch.column("_item"), batch.column("_text").to_pylist(), strict=True):
                words = Words([_folded(text)])
                n = len(words.hashes)
                if not n:
                    continue
                h, at = seed_hashes(words, seeds, seeds.holed(n))
                if n < low:  # shorter than every mask: the whole item is a seed
                    h, at = np.append(h, words.all_of(0)), np.append(at, 0)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(h), batch.schema.field("_item").type), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(h), n, np.int32))], ["_item", "_hash", "_at", "_n"])

    return run


def _hits(seeds: Seeds, bloom: Bloom, short: list[int], holed: list[str]):
    """(_id, _tag, _text) -> (_id, _tag, _hash, _doc_at): the seeds that may be the benchmark's, and their start words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [_folded(t) for t in batch.column("_text").to_pylist()]
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                h, at = seed_hashes(words, seeds, holed)
                for n in short:  # whole items of few words
                    wins, valid = words.windows(n)
                    h, at = np.concatenate([h, wins[valid]]), np.concatenate([at, np.flatnonzero(valid)])
                some = bloom.found(h)
                if len(some):
                    h, at = h[some], at[some]
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    own = pa.array(owner + lo)
                    yield pa.RecordBatch.from_arrays([batch.column("_id").take(own), batch.column("_tag").take(own), pa.array(h.view(np.int64)), pa.array((at - words.first[owner]).astype(np.int32))], ["_id", "_tag", "_hash", "_doc_at"])

    return run


def best_stretch(same: np.ndarray, least: int, share: float) -> tuple[int, int, int]:
    """(words, equal words, start) of the longest stretch of at least `least` positions whose differing share is within `share`; zeros if none.

    The stretch begins and ends with equal words. With every word's excess of equality over what is
    asked for summed from the left, a stretch is good if the sum at its end isn't below that at its
    start: the last such end is looked up in the greatest sums from the right.
    """
    starts = np.flatnonzero(same)
    if not len(starts):
        return (0, 0, 0)
    equal = np.concatenate([[0], np.cumsum(same)])
    excess = equal - (1 - share) * np.arange(len(equal))
    ahead = np.maximum.accumulate(excess[starts + 1][::-1])  # ascends, from the last end to the first
    last = len(starts) - 1 - np.searchsorted(ahead, excess[starts] - 1e-9)
    sizes = starts[last] + 1 - starts
    i = int(sizes.argmax())
    size, s = int(sizes[i]), int(starts[i])
    return (size, int(equal[s + size] - equal[s]), s) if size >= least else (0, 0, 0)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _tag, _text, _asked) -> a row for each item and diagonal asked for: _skip, the item's words before the document's first, and the hashes of those that lie beside the item."""
    columns = ["_id", "_tag", "_item", "_diagonal", "_skip", "_part"]
    for batch in parts(batches):
        ids, tags = batch.column("_id"), batch.column("_tag")
        for i, (text, asked) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_asked").to_pylist(), strict=True)):
            own = Words([_folded(text)]).hashes.view(np.int64)
            for lo in range(0, len(asked), 256):
                some = asked[lo : lo + 256]
                cut = [own[max(0, x["_diagonal"]) : max(0, x["_diagonal"] + x["_n"])] for x in some]
                at, ends = pa.array([i] * len(some), pa.int32()), np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(at), tags.take(at), pa.array([x["_item"] for x in some], pa.int64()), pa.array([x["_diagonal"] for x in some], pa.int32()), pa.array([max(0, -x["_diagonal"]) for x in some], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cut)))], columns)


def _verified(seeds: Seeds):
    """Diagonals with both sides' words -> (_id, _tag, _item, _best_words, _equal, _start) for those that agree well enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, words, equal, start = [], [], [], []
            diagonal, skip, part, item = (batch.column(c) for c in ("_diagonal", "_skip", "_part", "_words"))
            for i in range(batch.num_rows):
                doc, own, lo = np.asarray(part[i].values), np.asarray(item[i].values), skip[i].as_py()
                best = best_stretch(own[lo : lo + len(doc)] == doc, min(seeds.least_words, len(own)), seeds.substitution_share)
                if best[0]:
                    keep.append(i)
                    words.append(best[0])
                    equal.append(best[1])
                    start.append(diagonal[i].as_py() + lo + best[2])
            own = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in ("_id", "_tag", "_item")], pa.array(words, pa.int32()), pa.array(equal, pa.int32()), pa.array(start, pa.int32())], ["_id", "_tag", "_item", "_best_words", "_equal", "_start"])

    return run


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seeds: Seeds = Seeds(), with_tag: bool = False) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, n_words, n_equal, start_word.

    n_words is the length of the longest agreeing stretch, n_equal its equal words, start_word where
    it begins among the document's words (in lower case, marks at their ends stripped, words of marks
    only left out). Null texts are empty; empty texts and items overlap with nothing. Null ids are
    reported as they are; rows that repeat an id and its text are reported once; of several texts
    under one item id, or under none, each counts, and the longest stretch is reported. Items of fewer
    words than a mask have to occur whole. A seed is a few numbers however long its item and document
    are: words are laid beside each other only where both share a seed, and only as far as the item
    goes. Without benchmark or documents the result is empty. Other columns are not read.
    """
    spark = df.sparkSession
    # Until the end an item is one text under one id; written, its number stays.
    bench = materialise(benchmark.select(F.col(item_col).alias("_item_id"), text_of(item_text_col).alias("_text")).distinct().withColumn("_item", F.monotonically_increasing_id()), "items")
    rows = materialise(bench.select("_item", "_text").mapInArrow(_benchmark_rows(seeds), "_item long, _hash long, _at int, _n int"), "seeds")
    items = materialise(bench.select("_item", "_text").mapInArrow(_item_words, "_item long, _words array<long>"), "words")
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_tag"), text_of(text_col).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    bloom = Bloom.of(rows, min(max(FILTER_BITS[0], 1 << (64 * rows.count()).bit_length()), FILTER_BITS[1]))
    low = min(map(len, seeds.masks))
    few = sorted(r[0] for r in rows.where(F.col("_n") <= max(low, seeds.least_words)).select("_n").distinct().collect())  # one row for each length
    short, holed = [n for n in few if n < low], [m for n in few for m in seeds.holed(n)]
    sent = spark.sparkContext.broadcast(bloom)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hits(seeds, sent.value, short, holed)(batches)

    seen = materialise(docs.mapInArrow(hits, f"_id {id_type}, _tag long, _hash long, _doc_at int"), "hits")
    where = seen.distinct().join(rows, "_hash").select("_id", "_tag", "_item", (F.col("_doc_at") - F.col("_at")).alias("_diagonal"), "_n").distinct()
    # What is gathered for one document are its own hits.
    asked = where.groupBy("_id", "_tag").agg(F.collect_list(F.struct("_item", "_diagonal", "_n")).alias("_asked"))
    beside = join_same(docs, materialise(asked, "asked"), ["_id", "_tag"]).dropDuplicates(["_id", "_tag"]).select("_id", "_tag", "_text", "_asked")
    beside = beside.mapInArrow(_beside, f"_id {id_type}, _tag long, _item long, _diagonal int, _skip int, _part array<long>")
    checked = beside.join(items, "_item").mapInArrow(_verified(seeds), f"_id {id_type}, _tag long, _item long, _best_words int, _equal int, _start int")
    named = checked.join(bench.select("_item", "_item_id"), "_item")
    best = named.groupBy("_id", "_tag", "_item_id").agg(F.max(F.struct(F.col("_best_words").alias("_words"), "_equal", (-F.col("_start")).alias("_back"))).alias("_best"))
    out = best.select(F.col("_id").alias("doc_id"), F.col("_item_id").alias("item_id"), F.col("_best._words").alias("n_words"), F.col("_best._equal").alias("n_equal"), (-F.col("_best._back")).alias("start_word"), "_tag")
    return out if with_tag else out.drop("_tag")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seeds: Seeds = Seeds()) -> DataFrame:
    """df without the rows that overlap with an item, all columns kept."""
    bad = materialise(contaminated(df, benchmark, id_col, text_col, item_col, item_text_col, seeds, with_tag=True).select(F.col("doc_id").alias("_bad_id"), F.col("_tag").alias("_bad_tag")).distinct(), "contaminated")
    return df.join(bad, F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text_of(text_col)) == F.col("_bad_tag")), "left_anti")
