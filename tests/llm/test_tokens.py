"""BPE by prefixes against the tokenizers library, and coded token containers as exact round trips."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pyarrow as pa

from quillroster.llm import coder
from quillroster.llm.bpe import bpe_encode, loaded
from quillroster.llm.coder import BLOCK_IDS, Container, pack, pack_all, unpack, unpack_all
from quillroster.llm.queries import vocabulary
from quillroster.llm.token_files import Chunks, read_token_files, token_files, write_token_files

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = ["", None, " ", "  a  b", "it's we'll I'd", "x\n\n\ty \n", "<|endoftext|>", "a<|endoftext|> b<|endoft", "naïve 東京 🦆👩‍👧 ̀é", "1234567 3.14", "  x\x85y", "ſ'ſ ΑΣ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x7f�", "<|startoftext|> Hi"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


TEXT = st.one_of(st.text(max_size=60), st.text("ab the'ings .\n\tS9é東", max_size=200))


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(library, text):
    assert loaded(BYTES).encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_in_the_library(library, ids):
    assert loaded(BYTES).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_table(make, library, prose):
    rows = [*enumerate(ODD), (90, prose(20_000)), (91, "long" * 5000), (91, "again"), (None, "no id")]
    got = bpe_encode(make(rows), BYTES, decode=True).collect()
    want = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in got) == sorted((i or -1, want(t), library.decode(want(t), skip_special_tokens=False)) for i, t in rows)
    assert bpe_encode(make(rows).where("doc_id < 0"), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=40), max_size=12), st.integers(0, 3))
def test_containers_round_trip(documents, repeat):
    documents = documents * (repeat + 1)
    ids = np.array([x for d in documents for x in d], np.uint32)
    keys = [None if k % 5 == 4 else k for k in range(len(documents))]
    got = unpack(pack(keys, np.array([len(d) for d in documents], np.int64), ids))
    assert got.doc_ids == keys and got.ids.tolist() == ids.tolist() and got.lengths.tolist() == [len(d) for d in documents]


def test_blocks_are_independent_checked_and_smaller_than_the_ids():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 5 * BLOCK_IDS + 77) * 7, 49_000).astype(np.uint32)
    content = bytearray(pack([1], np.array([len(ids)]), ids))
    assert len(content) < 0.9 * 2 * len(ids) and (unpack(bytes(content)).ids == ids).all()
    content[-40] ^= 0xFF
    with pytest.raises(ValueError, match="block 5 is damaged"):
        unpack(bytes(content))
    with pytest.raises(ValueError, match="nibbles"):
        pack([1], np.array([1]), np.array([65536], np.uint32))


def test_token_files(make, prose):
    library = Tokenizer.from_file(WORDS)
    library.no_padding()
    library.no_truncation()
    rows = [*enumerate(ODD), (70, prose(9000)), *((100 + i, prose(i)) for i in range(40))]
    got = sorted(map(tuple, token_files(make(rows), WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start = 0
    for (doc_id, text), row in zip(sorted(rows), got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_many_containers_and_odd_ids(spark, make, prose, tmp_path):
    rows = [(None, "no id"), (3, "again"), (3, "and again"), *((i, prose(20)) for i in range(10, 60))]
    path = f"file://{tmp_path}/tokens"
    write_token_files(make(rows), WORDS, path, container_ids=50)
    got = read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(i for i, _ in rows if i is not None)
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)
    containers = spark.read.parquet(path).orderBy("part", "seq").collect()
    ends = np.cumsum([c.n_docs for c in containers]).tolist()
    # A container ends with the document that takes it to 50 ids.
    assert len(containers) > 10 and all(c.n_ids - got[e - 1].n_tokens < 50 for c, e in zip(containers, ends, strict=True))


def test_empty_table(make):
    assert token_files(make([(1, "a")]).where("doc_id < 0"), WORDS).count() == 0


@pytest.fixture(scope="module")
def words():
    library = Tokenizer.from_file(WORDS)
    library.no_padding()
    library.no_truncation()
    return library, Chunks(WORDS)


MARKED = st.text("aBéÄßµªİſ1² \n\t.,;!&$#*'sTrelLvmD<|>-_\u0301\u00a0\x85\u6771", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), MARKED, st.text(max_size=30)), min_size=1, max_size=5))
def test_ids_of_parts_are_the_librarys(words, texts):
    library, chunks = words
    ids, n = chunks.encode(pa.array([t or "" for t in texts], pa.string()), 2)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_the_library_is_asked_once_for_a_word_whatever_marks_and_case_it_has(words):
    chunks, asked = Chunks(WORDS), []
    ask = chunks._asked
    chunks._asked = lambda parts: asked.extend(parts) or ask(parts)
    chunks.encode(pa.array(["Thineren thineren&&& THINEREN.*** thineren!?", "éleven ÉLEVEN### Thineren&&&"]), 2)
    assert sorted(asked) == sorted(["thineren", "&&&", ".***", "!?", "éleven", "###"])


def test_ids_for_a_cased_vocabulary_are_the_librarys(make, tmp_path):
    steps = json.loads(Tokenizer.from_file(WORDS).to_str())
    steps["normalizer"]["normalizers"] = steps["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(steps))
    library = Tokenizer.from_file(str(path))
    texts = ["Hello World, ABC", "hello&&& Été!"]
    got = sorted(map(tuple, token_files(make([*enumerate(texts)]), str(path)).select("doc_id", "n_tokens", "ids_crc32").collect()))
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert got == [(i, len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)]


def test_no_small_rest_of_blocks_is_coded_by_itself(monkeypatch):
    monkeypatch.setattr(coder, "LANES", 8)
    lanes, steps = [], coder._encode_lanes
    monkeypatch.setattr(coder, "_encode_lanes", lambda ids, *rest: lanes.append(len(ids)) or steps(ids, *rest))
    ids = np.random.default_rng(2).integers(0, 900, 17 * BLOCK_IDS + 5).astype(np.uint32)
    assert (unpack(pack([1], np.array([len(ids)]), ids)).ids == ids).all()
    assert lanes == [9, 9]


def test_containers_coded_together_are_those_coded_alone():
    rng = np.random.default_rng(3)
    every = [Container([k], np.array([n]), rng.integers(0, 900, n).astype(np.uint32)) for k, n in enumerate([5000, 0, 1, 4096, 700, 700, 9001])]
    together = pack_all(every)
    assert together == [pack(c.doc_ids, c.lengths, c.ids) for c in every]
    assert [c.ids.tolist() for c in unpack_all(together)] == [c.ids.tolist() for c in every]
