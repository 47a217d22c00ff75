"""Token ids of a corpus in order of document id, written as coded containers and read back.

Rows are range-partitioned and sorted by id; each task tokenises its range and writes containers of
limited size (see coder), as rows of a Parquet table in the shared folder, so that Spark's commit
protocol makes a lost or repeated task harmless on any store. Reading decodes containers one by one;
where a document's ids begin follows from prefix sums over containers and partitions.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillroster.llm.coder import Container, pack_all, unpack_all
from quillroster.llm.common import new_table_path, text_of
from quillroster.llm.words import text_ranges

END_ID = 2
#: A container is closed when it has so many ids; the last document's are all in it.
CONTAINER_IDS = 1 << 22
#: Containers are coded and decoded together until they have so many ids.
TOGETHER_IDS = 1 << 23
#: Parts that half a worker's memory of them holds, the longest of them in characters, and how many go to the library as one text.
PARTS, LONGEST, TOGETHER = 300_000, 64, 100
#: Bytes of text whose chunks are told apart together; a longer text is taken alone.
TEXT_BYTES = 1 << 25
#: Fixed value: marks that end a chunk often and are one word there, together; an apostrophe may begin another.
END_MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
#: Fixed values, of RE2: what ends a word below U+0100, and words of small letters there, which normalizing leaves as they are.
_WORD_END, _SMALL = "[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "^[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+$"
#: The steps before the model for which chunks may be asked for in parts: letters are lowered one by one, and words of letters end before marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
CONTAINER = "part int, seq int, n_docs long, n_ids long, content binary"


def _gathered(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values (of 32 bits), of the given sizes, in the order of which; and each one's size."""
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int64)), pa.py_buffer(values)])
    sizes = size[which]
    return np.frombuffer(runs.take(pa.array(which)).buffers()[2] or b"", np.uint32, int(sizes.sum())), sizes


def _tails(texts: pa.Array, size: np.ndarray) -> pa.Array:
    """The last bytes of each text, as many as size says: some, but not all."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)[1:]
    inside = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
    inside[ends - size] = 1
    inside[ends] = -1
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: len(inside) - 1]
    kept = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(kept))


class Chunks:
    """Ids of texts by the tokenizers library, which is asked once for each part of visible text: white space only separates for these vocabularies.

    Parts that were met lately are remembered in two halves; when the younger is full, the older is forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.model = (Tokenizer.from_file(path) for _ in range(2))
        for t in (self.tokenizer, self.model):
            t.no_padding()
            t.no_truncation()
        steps = json.loads(self.tokenizer.to_str())
        special = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())]
        vocab = self.tokenizer.get_vocab()
        suffix = steps["model"].get("end_of_word_suffix") or ""
        #: Whether chunks are asked for in parts; with other steps before the model they are asked for whole.
        self.parted = bool(suffix) and steps["normalizer"] == _NORMALIZER and steps["pre_tokenizer"] == _PRE_TOKENIZER
        # Words of small letters need none of the steps but this one.
        self.model.normalizer, self.model.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Which ids end a word.
        self.last = np.zeros(max([*vocab.values(), -1]) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        escaped = lambda marks: "".join(f"\\x{{{ord(c):x}}}" for c in marks)
        #: Chunks below U+0100, which nothing is composed with, that end with a word and marks, and where no special token begins.
        self.simple = rf"^[^{escaped({content[0] for content, _ in special})}\x{{100}}-\x{{10ffff}}]*{_WORD_END}[{escaped(END_MARKS)}]*$"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _asked(self, parts: list[str]) -> list[bytes]:
        """The ids of each part in bytes. Many words of small letters go to the model as one text: each ends with an id that ends a word."""
        out: list[bytes | None] = [None] * len(parts)
        at = np.flatnonzero(pc.match_substring_regex(pa.array(parts, pa.string()), _SMALL).to_numpy(zero_copy_only=False)).tolist() if self.parted else []
        for lo in range(0, len(at), TOGETHER):
            some = at[lo : lo + TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" ".join(map(parts.__getitem__, some))], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw, begin = ids.tobytes(), 0
                for i, end in zip(some, (4 * ends).tolist(), strict=True):
                    out[i] = raw[begin:end]
                    begin = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, np.uint32).tobytes()
        return out

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """parts are distinct."""
        out = list(map(self.young.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            out[i] = self.old.get(parts[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, self._asked([parts[i] for i in new]), strict=True):
            out[i] = ids
        for i in missing:
            if len(parts[i]) <= LONGEST:
                self.young[parts[i]] = out[i]
        if len(self.young) > PARTS:
            self.old, self.young = self.young, {}
        return out

    def _parts(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Chunks as they are asked for: simple ones in lower case without the marks at their end, and those marks.

        All parts' texts (dictionary-encoded), first each chunk's word and then the marks; which chunks have marks; and how many parts each has.
        """
        if not self.parted:
            return chunks.dictionary_encode(), np.zeros(0, np.int64), np.ones(len(chunks), np.int64)
        simple, word = pc.match_substring_regex(chunks, self.simple), pc.utf8_rtrim(chunks, END_MARKS)
        size = np.where(simple.to_numpy(zero_copy_only=False), (pc.binary_length(chunks).to_numpy() - pc.binary_length(word).to_numpy()), 0)
        marked = np.flatnonzero(size)
        parts = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(word), chunks), _tails(chunks.take(pa.array(marked)), size[marked])])
        return parts.dictionary_encode(), marked, 1 + (size > 0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each one's with end_id behind, and how many each has."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        parts, marked, many = self._parts(coded.dictionary)
        own = self.ids_of(parts.dictionary.to_pylist())
        # Each chunk's parts one behind the other, then their ids.
        named, at = parts.indices.to_numpy(), np.cumsum(many) - many
        order = np.empty(len(named), np.int32)
        order[at], order[at[marked] + 1] = named[: len(many)], named[len(many) :]
        ids, sizes = _gathered(np.frombuffer(b"".join(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own)) >> 2, order)
        size = np.append(np.add.reduceat(sizes, at) if len(at) else sizes, 1)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        which = np.insert(coded.indices.to_numpy(), bounds[1:], len(many))
        out, sizes = _gathered(np.append(ids, np.uint32(end_id)), size, which)
        return out, np.add.reduceat(sizes, bounds[:-1] + np.arange(len(bounds) - 1)) if len(texts) else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def _containers(path: str, end_id: int, container_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        closed: list[Container] = []

        def coded() -> Iterator[pa.RecordBatch]:
            for i, (c, content) in enumerate(zip(closed, pack_all(closed), strict=True), seq - len(closed)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([len(c.doc_ids)], pa.int64()), pa.array([len(c.ids)], pa.int64()), pa.array([content], pa.binary())], ["part", "seq", "n_docs", "n_ids", "content"])

        for batch in batches:
            keys, texts = batch.column("_id").to_pylist(), batch.column("_text")
            for lo, hi in text_ranges(texts, TEXT_BYTES):
                ids, n = chunks(path).encode(texts.slice(lo, hi - lo), end_id)
                ends = np.cumsum(n)
                done = 0
                while done < len(n):
                    begin = int(ends[done - 1]) if done else 0
                    # Up to the document that fills the container, or all that are left.
                    last = min(int(np.searchsorted(ends, begin + container_ids - size)), len(n) - 1)
                    doc_ids += keys[lo + done : lo + last + 1]
                    lengths.append(n[done : last + 1])
                    held.append(ids[begin : int(ends[last])])
                    size += int(ends[last]) - begin
                    done = last + 1
                    if size >= container_ids:
                        closed.append(Container(doc_ids, np.concatenate(lengths), np.concatenate(held)))
                        doc_ids, lengths, held, size, seq = [], [], [], 0, seq + 1
                        if sum(len(c.ids) for c in closed) >= TOGETHER_IDS:
                            yield from coded()
                            closed.clear()
        if doc_ids:
            closed.append(Container(doc_ids, np.concatenate(lengths), np.concatenate(held)))
            seq += 1
        yield from coded()

    return run


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, container_ids: int = CONTAINER_IDS) -> None:
    """Write the ids of every text, and end_id behind each, to containers under path, in ascending order of id.

    tokenizer_path names a vocabulary of the tokenizers library that drops white space and whose ids
    are below 65,536. Null text counts as empty and has end_id only. Null ids come first; rows that
    repeat an id each have ids of their own, in the order of their texts' 64-bit hashes. An empty
    table makes no container. Other columns are not read. Rows of one id may be split over tasks.
    Ids of another type than whole numbers are refused.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col}: ids have to be whole numbers")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # Equal rows are told apart by where they were read, so that no group of them has to fit into one task.
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange("_id", "_h", "_n").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")
    dealt.mapInArrow(_containers(tokenizer_path, end_id, container_ids), CONTAINER).write.parquet(path)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Container]]:
    sizes = np.cumsum([0, *batch.column("n_ids").to_pylist()])
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + TOGETHER_IDS, side="right")) - 1)
        some = batch.slice(lo, hi - lo)
        yield from zip(some.column("part").to_pylist(), some.column("seq").to_pylist(), unpack_all(some.column("content").to_pylist()), strict=True)
        lo = hi


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, got in _unpacked(batch):
                ends = np.cumsum(got.lengths)
                raw = memoryview(got.ids.astype("<u4")).cast("B")
                bounds = [0, *(4 * ends).tolist()]
                n = len(ends)
                columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(got.doc_ids, pa.int64()), pa.array(ends - got.lengths), pa.array(got.lengths), pa.array([zlib.crc32(raw[a:b]) for a, b in pairwise(bounds)], pa.int64())]
                names = ["part", "seq", "doc_id", "_from", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(got.ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document in the containers under path: doc_id, start, n_tokens, ids_crc32 (and ids).

    Every block's checksum is tested; a damaged one is an error.
    """
    files = spark.read.schema(CONTAINER).parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition that wrote: the only rows that meet in one task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids")).select("part", F.coalesce(F.sum("_ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part_start"))
    starts = sizes.withColumn("_seq_start", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("_part_start") + F.col("_seq_start")).alias("_start"))
    docs = files.select("part", "seq", "n_ids", "content").mapInArrow(_documents(with_ids), "part int, seq int, doc_id long, _from long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("_from")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids to a new folder in the shared one and read it back: see write_token_files and read_token_files."""
    path = new_table_path(df.sparkSession, "tokens")
    write_token_files(df, tokenizer_path, path, id_col, text_col, end_id)
    return read_token_files(df.sparkSession, path)
