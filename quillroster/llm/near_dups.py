"""N-gram Jaccard join: MinHash banding proposes pairs, the full sets of word n-grams decide.

Rows and bands follow from the threshold and the target recall: a band of r minima agrees with
probability s**r at similarity s, and enough bands are taken for a pair just at the threshold to
meet in one of them with that recall. Band hashes are shuffled; buckets with one member end there.

Documents with equal n-gram sets are one representative. A bucket's representatives are compared in
tiles of bounded size, each pair in the first band in which it meets and nowhere else, so that links
are counted once without listing pairs: a tile returns for each member its number of links and one
edge to the smallest member it is linked to, directly or through others. A bucket that holds very
many rows makes more tiles, not larger ones. Classes are the connected components of those edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import SPACE, join_same, keep_one, materialise, text_of
from quillroster.llm.components import components
from quillroster.llm.words import Words, mixed, normal, parts, slices

ROW = ["_id", "_tag"]
#: A tile's most rows and bytes of text (one longer text is a tile of its own); two tiles meet in a task.
TILE_ROWS, TILE_BYTES = 512, 4 << 20


@dataclass(frozen=True)
class Banding:
    """threshold: least Jaccard similarity; recall: of pairs at the threshold; rows: minima in a band."""

    threshold: float = 0.8
    ngram: int = 5
    recall: float = 0.999999
    rows: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[n:] >> np.uint64(32)).astype(np.uint32)


def band_hashes(grams: np.ndarray, banding: Banding) -> np.ndarray:
    """One 64-bit hash for each band, of the least values of the set under its permutations."""
    times, flip = _constants(banding.bands * banding.rows)
    least = np.full(len(times), 2**32 - 1, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(least, ((x[None, lo : lo + 1024] ^ flip[:, None]) * times[:, None]).min(axis=1), out=least)
    out = np.zeros(banding.bands, np.uint64)
    for column in least.reshape(banding.bands, banding.rows).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return out


def gram_sets(texts: list[bytes], ngram: int) -> list[np.ndarray]:
    """The sorted set of 64-bit n-gram hashes of each normal text; fewer words than n are one gram, none make none."""
    out: list[np.ndarray] = []
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi])
        grams, _ = words.windows(ngram)
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            out.append(np.unique(grams[a : b - ngram + 1]) if b - a >= ngram else np.array([words.all_of(k)], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def _signatures(banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [normal(t) for t in batch.column("_text").to_pylist()]
            sets = gram_sets(texts, banding.ngram)
            bands = [band_hashes(s, banding).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.binary()), lists], ["_id", "_tag", "_size", "_set", "_bands"])

    return run


def _linked(sets: list[np.ndarray], bands: np.ndarray, band: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar members whose first common band is this one; with side, only pairs across it."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    open_ = np.triu(np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-9, 1)
    if side is not None:
        open_ &= side[:, None] != side
    for b in bands[:, :band].T:
        open_ &= b[:, None] != b
    i, j = np.nonzero(open_)
    if len(i) <= 2 * n:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, code = owner[seen[code] > 1], code[seen[code] > 1]
        table = np.zeros((n, n), np.float32)
        for lo in range(0, int(code.max(initial=-1)) + 1, 4096):
            own = (code >= lo) & (code < lo + 4096)
            if own.any():
                part = np.zeros((n, 4096), np.float32)
                part[owner[own], code[own] - lo] = 1
                table += part @ part.T
        common = table[i, j].astype(np.int64)
    if not len(i):
        return i, j
    good = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[good], j[good]


def _compared(banding: Banding):
    """Arrow batches sorted by tile (_band, _hash, _lo, _hi; _rid, _tile, _text) -> (_rid, _root, _links)."""
    columns = ["_band", "_hash", "_lo", "_hi", "_rid", "_tile", "_text"]

    def links(key: tuple, members: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        rids, tiles = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        sets = gram_sets([normal(m[2]) for m in members], banding.ngram)
        bands = np.array([band_hashes(s, banding) for s in sets])
        i, j = _linked(sets, bands, key[0], tiles if key[2] != key[3] else None, banding.threshold)
        counts = np.bincount(i, minlength=len(rids)) + np.bincount(j, minlength=len(rids))
        root = list(range(len(rids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        some = np.flatnonzero(counts).tolist()
        return rids[some].tolist(), [int(rids[top(x)]) for x in some], counts[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        out: tuple[list, list, list] = ([], [], [])

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["_rid", "_root", "_links"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:4] != key:
                    if len(members) > 1:
                        for x, y in zip(out, links(key, members), strict=True):
                            x += y
                    if len(out[0]) > 20_000:
                        yield emitted()
                        out = ([], [], [])
                    key, members = row[:4], []
                members.append(row[4:])
        if len(members) > 1:
            for x, y in zip(out, links(key, members), strict=True):
                x += y
        yield emitted()

    return run


def _classified(df: DataFrame, id_col: str, text_col: str, banding: Banding) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _tag, _set), _set being null for texts without words; and sets (_set, _set_id, _copies, _links, _root, _class)."""
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_tag"), text_of(text_col).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    signed = materialise(docs.mapInArrow(_signatures(banding), f"_id {id_type}, _tag long, _size long, _set binary, _bands array<long>"), "signed")

    first = F.min(F.struct(F.col("_id").isNull().alias("_no_id"), *ROW))
    sets = signed.where("_set IS NOT NULL").groupBy("_set").agg(first.alias("_first"), F.count("*").alias("_copies"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands"))
    sets = materialise(sets.select("_set", F.col("_first._id").alias("_id"), F.col("_first._tag").alias("_tag"), "_copies", "_size", "_bands", F.monotonically_increasing_id().alias("_rid")), "sets")

    members = materialise(sets.select("_rid", "_size", F.posexplode("_bands").alias("_band", "_hash")), "members")
    buckets = members.groupBy("_band", "_hash").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"), F.bit_xor(F.xxhash64("_rid")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "_rid")).alias("_y")).where("_n > 1")
    # A bucket with the very members of an earlier band's has no pair of its own.
    buckets = buckets.groupBy("_n", "_x", "_y").agg(F.min(F.struct("_band", "_hash", "_bytes")).alias("_b"))
    tiles = F.greatest(F.ceil(F.col("_n") / TILE_ROWS), F.ceil(F.col("_b._bytes") / TILE_BYTES)).cast("int")
    buckets = materialise(buckets.select("_b._band", "_b._hash", tiles.alias("_tiles")), "buckets")
    placed = members.join(buckets, ["_band", "_hash"]).withColumn("_tile", F.pmod(F.xxhash64("_rid", "_band"), F.col("_tiles")).cast("int"))
    placed = materialise(placed.select("_band", "_hash", "_rid", "_tile", F.explode(F.expr("sequence(0, _tiles - 1)")).alias("_other")), "placed")

    wanted = materialise(sets.join(placed.select("_rid").distinct(), "_rid", "left_semi").select(*ROW, "_rid"), "wanted")
    # Texts are exchanged whatever the size of wanted, so that small inputs run as large ones do.
    texts = materialise(join_same(docs, wanted.hint("merge"), ROW).dropDuplicates(["_rid"]).select("_rid", "_text"), "texts")
    keyed = placed.join(texts, "_rid").select("_band", "_hash", F.least("_tile", "_other").alias("_lo"), F.greatest("_tile", "_other").alias("_hi"), "_rid", "_tile", "_text")
    key = ["_band", "_hash", "_lo", "_hi"]
    links = materialise(keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared(banding), "_rid long, _root long, _links long"), "links")

    counts = links.groupBy("_rid").agg(F.sum("_links").alias("_links"))
    joined = components(links.select(F.col("_rid").alias("u"), F.col("_root").alias("v")))
    sets = sets.select("_set", "_id", "_copies", "_rid").join(joined.withColumnRenamed("u", "_rid"), "_rid", "left").join(counts, "_rid", "left")
    sets = materialise(sets.withColumn("_root", F.coalesce("root", "_rid")).drop("root"), "rooted")
    classes = sets.groupBy("_root").agg(F.min("_id").alias("_class"))
    sets = materialise(sets.join(classes, "_root").select("_set", F.col("_id").alias("_set_id"), "_copies", "_root", "_class", F.coalesce("_links", F.lit(0)).alias("_links")), "classes")
    return signed.select(*ROW, "_set"), sets


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", banding: Banding = Banding()) -> DataFrame:
    """One row for each input row: doc_id, class_id, set_id, copies, n_links.

    set_id: the smallest id among rows with the same n-gram set; copies: how many rows have it;
    n_links: other sets whose Jaccard similarity to it reaches the threshold; class_id: the smallest
    id of the set's connected component over those links. Texts without words (null counts as empty)
    have no n-grams: each row is its own class, without copies or links. Texts of fewer words than n
    have one n-gram, all their words. Null ids come after all others; repeated rows are copies. An
    empty table gives an empty result. Other columns of df are neither read nor returned.
    """
    signed, sets = _classified(df, id_col, text_col, banding)
    some = signed.where("_set IS NOT NULL").select("_id", "_set").join(sets, "_set").select(F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_set_id").alias("set_id"), F.col("_copies").alias("copies"), F.col("_links").alias("n_links"))
    none = signed.where("_set IS NULL").select(F.col("_id").alias("doc_id"), F.col("_id").alias("class_id"), F.col("_id").alias("set_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", banding: Banding = Banding()) -> DataFrame:
    """df with one row of each class, all columns kept: the smallest id's, null ids last.

    Of an id's several texts in one class, the one whose hash is smallest stays, and of rows that
    repeat an id and its text, any one. Texts without words are no duplicates of each other: all stay.
    """
    rows, sets = _classified(df, id_col, text_col, banding)
    members = rows.where("_set IS NOT NULL").groupBy(*ROW, "_set").agg(F.count("*").alias("_m")).join(sets.select("_set", "_root"), "_set")
    first = members.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("_no_id"), "_id", "_tag", "_m")).alias("_first"))
    stay = materialise(first.select(F.col("_first._id").alias("_k_id"), F.col("_first._tag").alias("_k_tag"), F.col("_first._m").alias("_k_m")), "stay")
    text, words = text_of(text_col), text_of(text_col).rlike(rf"[^{SPACE}]")
    return keep_one(df.where(words), stay, {"_k_id": F.col(id_col), "_k_tag": F.xxhash64(text)}).unionByName(df.where(~words))
