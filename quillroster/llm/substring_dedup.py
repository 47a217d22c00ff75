"""Substring deduplication with a log-structured index of window fingerprints.

A window is `width` consecutive words of one document; each word that is covered by a window whose
word sequence also starts elsewhere is removed. A window's fingerprint is the least hash among its
8-word grams: equal windows have equal fingerprints, and neighbouring windows mostly share one, so
that the index has about two entries for every 29 words.

The index is a folder of immutable runs, each sorted by fingerprint and written once. A batch is
merge-joined with every run (a sort-merge join on the fingerprint), then becomes a run itself; runs
of one level are merged into one of the next. A fingerprint seen twice only nominates windows: they
are verified by a 128-bit BLAKE2 digest of their words, counted over all documents. An index that
serves several calls also keeps its documents' word sequences with their fingerprints, so that
windows of earlier calls are digested and counted where a later one nominates them.

Documents whose word sequences are equal are told apart only at the end: one of each group goes
through the index. All counts are pre-aggregated before they are shuffled, so that a passage in a
third of all documents makes one row for each task, and joins exchange both sides, so that adaptive
execution can split a hot passage. What is gathered for one document is bounded by its own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.llm.common import join_same, materialise, new_table_path, text_of
from quillroster.llm.words import Words, normal, parts, slices, sliding_min

WIDTH, GRAM, BATCHES, FANOUT = 35, 8, 2, 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROW = ["_id", "_tag"]


def _fingerprints(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes by start word; the fingerprint of the window at each word, and whether there is one."""
    grams, _ = words.windows(min(GRAM, width))
    least = sliding_min(grams, width - min(GRAM, width) + 1)
    _, valid = words.windows(width)
    return grams, least, valid[: len(least)]


def _summaries(width: int):
    """Arrow batches (_id, _tag, _text) -> a row for each document with its fingerprints, one seen at several places twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [normal(t) for t in batch.column("_text").to_pylist()]
            prints: list[np.ndarray] = []
            counts: list[int] = []
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                grams, least, valid = _fingerprints(words, width)
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    counts.append(int(b - a))
                    own = np.unique(least[a:b][valid[a:b]])
                    if len(own):
                        at, n = np.unique(grams[a : b - min(GRAM, width) + 1], return_counts=True)
                        own = np.concatenate([own, own[n[np.searchsorted(at, own)] > 1]])
                    prints.append(own.astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prints])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), lists], ["_id", "_tag", "_n", "_sha", "_prints"])

    return run


def _nominated(width: int):
    """Arrow batches (_id, _tag, _text, _marks) -> (_id, _tag, _at, _d1, _d2) for each window whose fingerprint is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [normal(t) for t in batch.column("_text").to_pylist()]
            marks = batch.column("_marks")
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                _, least, valid = _fingerprints(words, width)
                row, at, digests = [], [], []
                for k in range(hi - lo):
                    a, b = words.first[k], min(words.first[k + 1], len(least))
                    if b <= a:
                        continue
                    marked = np.asarray(marks[lo + k].values).astype(np.uint64)
                    found = np.flatnonzero(valid[a:b] & np.isin(least[a:b], marked))
                    row.append(np.full(len(found), lo + k))
                    at.append(found)
                    digests += [hashlib.blake2b(words.joined[s:e], digest_size=16).digest() for s, e in zip(words.starts[a + found].tolist(), words.ends[a + found + width - 1].tolist(), strict=True)]
                if digests:
                    own = pa.array(np.concatenate(row))
                    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([batch.column("_id").take(own), batch.column("_tag").take(own), pa.array(np.concatenate(at).astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["_id", "_tag", "_at", "_d1", "_d2"])

    return run


def _kept(width: int):
    """Arrow batches (_id, _tag, _text, _ats) -> (_id, _tag, _removed, _kept_text, _kept_sha)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            removed, kept = [], []
            for text, ats in zip(batch.column("_text").to_pylist(), batch.column("_ats"), strict=True):
                words = normal(text).split()
                edges = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(ats.values)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + width, -1)
                covered = np.cumsum(edges[:-1]) > 0
                removed.append(int(covered.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~covered).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["_id", "_tag", "_removed", "_kept_text", "_kept_sha"])

    return run


class FingerprintIndex:
    """Immutable sorted runs (fingerprint, n) in one shared folder; n is 2 where it has been seen more than once.

    A run counts once its _SUCCESS marker is there, so a writer that dies leaves the index as it was.
    Beside the runs lie the documents of each call that has ended, in parts of the same kind: a run
    without them can nominate windows, but only documents are counted.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or new_table_path(spark, "index")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, str]]:
        """(level, path) of the runs that are complete."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [f.getPath() for f in self._fs.listStatus(self._path(self.root))]
        return sorted((int(p.getName().split("-")[1]), str(p)) for p in found if p.getName().startswith("run-") and self._fs.exists(self._path(p, "_SUCCESS")))

    def history(self, width: int) -> DataFrame | None:
        """(_id, _text, _prints): the documents of earlier calls, which all had this width; None if there are none."""
        if not self._fs.exists(self._path(self.root)):
            return None
        found = [f.getPath() for f in self._fs.listStatus(self._path(self.root))]
        parts = sorted(str(p) for p in found if p.getName().startswith("docs-") and self._fs.exists(self._path(p, "_SUCCESS")))
        if any(int(p.rsplit("/", 1)[1].split("-")[1]) != width for p in parts):
            raise ValueError(f"the index holds windows of another width than {width}")
        return self.spark.read.schema("_id string, _text string, _prints array<long>").parquet(*parts) if parts else None

    def remember(self, docs: DataFrame, width: int) -> None:
        """Add a call's documents (_id, _text, _prints) at its end."""
        label = new_table_path(self.spark, "x").rsplit("-", 1)[1]
        docs.write.option("compression", "zstd").parquet(f"{self.root}/docs-{width}-{label}")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("fingerprint long, n int").parquet(path)

    def _write(self, counted: DataFrame, level: int) -> DataFrame:
        label = new_table_path(self.spark, "x").rsplit("-", 1)[1]
        path = f"{self.root}/run-{level}-{label}"
        counted.repartitionByRange("fingerprint").sortWithinPartitions("fingerprint").write.option("compression", "zstd").parquet(path)
        return self._read(path)

    @staticmethod
    def _counted(fingerprints: DataFrame) -> DataFrame:
        return fingerprints.groupBy("fingerprint").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))

    def ingest(self, fingerprints: DataFrame) -> DataFrame:
        """Merge-join a batch (fingerprint, n) with every run, add it as a run, and return the fingerprints that have now been seen twice."""
        history = self.runs()
        batch = self._write(self._counted(fingerprints), 0)
        repeated = batch.where("n > 1").select("fingerprint")
        for _, path in history:
            repeated = repeated.unionByName(batch.join(self._read(path).hint("merge"), "fingerprint", "left_semi").select("fingerprint"))
        return repeated.distinct()

    def compact(self, fanout: int = FANOUT) -> None:
        """Merge the runs of each level that has at least fanout of them into one run of the next."""
        level = 0
        while own := [p for k, p in self.runs() if k == level]:
            if len(own) >= fanout:
                merged = self._read(own[0])
                for path in own[1:]:
                    merged = merged.unionByName(self._read(path))
                self._write(self._counted(merged), level + 1)
                for path in own:
                    self._fs.delete(self._path(path), True)
            level += 1


def _summary(df: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_tag"), text_of(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_summaries(width), f"_id {id_type}, _tag long, _n long, _sha string, _prints array<long>")
    return rows, materialise(found, "summaries")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, batches: int = BATCHES, index: FingerprintIndex | None = None, with_text: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    Windows are judged on the input as a whole: every copy of a repeated passage goes, the first one
    too, and rows that repeat an id and its text are copies of each other. Null text has no words;
    texts of fewer than `width` words lose none. An empty table gives an empty result. Other columns
    of df are neither read nor returned. Documents enter the index in `batches` batches. With an index
    of earlier calls (of the same width) windows are judged on their documents and the input as a whole;
    rows of earlier results stay as they are. Only an index that is passed keeps documents.
    """
    spark = df.sparkSession
    rows, summary = _summary(df, id_col, text_col, width)
    id_type = rows.schema["_id"].dataType.simpleString()
    # One document of each group of equal word sequences goes through the index.
    groups = materialise(summary.groupBy("_sha").agg(F.count("*").alias("_copies"), F.min(F.struct(F.col("_id").isNull().alias("_no_id"), *ROW)).alias("_rep")).select("_sha", "_copies", F.col("_rep._id").alias("_rep_id"), F.col("_rep._tag").alias("_rep_tag")), "groups")
    longs = summary.where(F.col("_n") >= width).join(groups, "_sha").where(F.col("_id").eqNullSafe(F.col("_rep_id")) & (F.col("_tag") == F.col("_rep_tag")))
    # Rows that repeat an id and its text are one representative.
    prints = materialise(longs.groupBy(*ROW).agg(F.first("_sha").alias("_sha"), F.first("_prints").alias("_prints")).select(*ROW, F.pmod(F.xxhash64("_sha"), F.lit(batches)).alias("_batch"), F.explode("_prints").alias("fingerprint")), "prints")

    keep = index is not None
    index = index or FingerprintIndex(spark)
    earlier = index.history(width) if keep else None
    repeated = None
    for b in range(batches):
        # Written before runs that it reads are merged away.
        twice = materialise(index.ingest(prints.where(F.col("_batch") == b).select("fingerprint", F.lit(1).alias("n"))), "twice")
        repeated = twice if repeated is None else repeated.unionByName(twice)
        # Runs are merged for the batches to come: the next ones here, or a later call's.
        if keep or b < batches - 1:
            index.compact()
    repeated = materialise(repeated.distinct(), "repeated")

    marks = prints.join(repeated, "fingerprint").groupBy(*ROW).agg(F.collect_set("fingerprint").alias("_marks"))
    # collect_set holds a document's own fingerprints at most. Rows that repeat a text are copies, so
    # that their windows do repeat however often they are counted.
    suspects = materialise(join_same(rows, marks, ROW).select(*ROW, "_text", "_marks"), "suspects")
    windows = materialise(suspects.mapInArrow(_nominated(width), f"_id {id_type}, _tag long, _at int, _d1 long, _d2 long"), "windows")
    counted = windows.select("_d1", "_d2")
    if earlier is not None:
        old = earlier.select("_id", F.explode("_prints").alias("fingerprint")).join(repeated, "fingerprint").groupBy("_id").agg(F.collect_set("fingerprint").alias("_marks"))
        known = earlier.select("_id", F.lit(0).cast("long").alias("_tag"), "_text").dropDuplicates(["_id"]).join(old, "_id")
        before = known.select("_id", "_tag", "_text", "_marks").mapInArrow(_nominated(width), "_id string, _tag long, _at int, _d1 long, _d2 long")
        counted = counted.unionByName(materialise(before.select("_d1", "_d2"), "earlier"))
    shared = materialise(counted.groupBy("_d1", "_d2").agg(F.count("*").alias("_seen")).where("_seen > 1").select("_d1", "_d2"), "shared")
    ats = windows.join(shared, ["_d1", "_d2"]).groupBy(*ROW).agg(F.collect_list("_at").alias("_ats"))
    cut = join_same(suspects.select(*ROW, "_text"), ats, ROW).mapInArrow(_kept(width), f"_id {id_type}, _tag long, _removed long, _kept_text string, _kept_sha string")
    if not with_text:
        cut = cut.drop("_kept_text")
    cut = materialise(cut.dropDuplicates(ROW), "cut")
    if keep:
        # Words that lie beside each other are all that later windows need of a text; equal sequences have one id.
        index.remember(join_same(rows, longs.dropDuplicates(["_sha"]).select(*ROW, "_sha", "_prints"), ROW).dropDuplicates(["_sha"]).select(F.col("_sha").alias("_id"), "_text", "_prints"), width)

    whole = (F.col("_copies") > 1) & (F.col("_n") >= width)
    out = join_same(summary.drop("_prints").join(groups.select("_sha", "_copies"), "_sha"), cut, ROW, "left")
    kept = [F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("_kept_sha", "_sha")).alias("kept_sha256")]
    if with_text:
        original = rows.select(*ROW, F.trim(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", " ")).alias("_own")).dropDuplicates(ROW)
        out = join_same(out, original, ROW)
        kept.append(F.when(whole, F.lit("")).otherwise(F.coalesce("_kept_text", "_own")).alias("kept_text"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.when(whole, F.col("_n")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"), *kept)
