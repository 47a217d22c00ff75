"""Byte-level BPE encoding and decoding, by dynamic programming over prefixes.

Every prefix of a word has exactly one BPE encoding, and that encoding's last token is one of the
vocabulary's tokens that end there. An automaton over the vocabulary lists them, longest first; a
token fits if the prefix before it ends in a token that BPE leaves next to it. The one that fits is
stored for each prefix, and following the stored tokens back from the end gives the ids.

Two tokens are compatible if merging the bytes of both gives those two tokens again. That is
decided by undoing the merges that made them, latest first, and asking at each step whether BPE
would have merged across the border before.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import text_of
from quillroster.llm.words import parts

#: Fixed value: how the byte-level pre-tokenizer splits text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space after and before visible characters always begins a word, so that texts may be cut there.
ODD_SPACE = regex.compile(r"[^\P{White_Space} ] | (?=\p{White_Space})|^ ")
#: Encoded pieces that a worker remembers, the longest of them in characters, and pairs of tokens; when full, they start anew. Workers keep them while other stages run in them.
PIECES, LONGEST, PAIRS = 200_000, 64, 400_000
NEVER = 1 << 60


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """piece of text -> its ids as 32-bit integers in bytes; encodes what is missing."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.encode(piece)
        if len(self) >= PIECES:
            self.clear()
        self[piece] = ids = self.encode(piece)
        return ids


class Bpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form, without normalizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_of_char()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.base = {b: vocab[c] for c, b in alphabet.items() if c in vocab}
        # The last merge that makes a token of its own bytes; tokens that BPE never makes have none.
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, -1, -1) for i in self.base.values()}
        for rank, (a, b) in enumerate(merges):
            if (i := vocab[a + b]) not in self.made:
                self.made[i] = (rank, vocab[a], vocab[b])
        self.compatible: list[dict[int, bool]] = [{} for _ in self.bytes]
        self.pairs = 0
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i in self.made:
            if self._makes_itself(i):
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.words = Pieces(self._encode_word)
        self.spaced = Pieces(lambda piece: self._encode_piece(" " + piece))  # pieces behind a space

    def _makes_itself(self, i: int) -> bool:
        """Whether BPE makes token i of its bytes: its halves do, and nothing is merged across their border before."""
        rank, a, b = self.made[i]
        return rank < 0 or a in self.made and b in self.made and self._border_holds(a, b, rank)

    def _border_holds(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether, as BPE makes tokens a and b side by side, nothing is merged across their border by a rank below until."""
        due, on_right = until, False  # the next merge that takes a token at the border away, and its side
        while True:
            rank = self.merge.get((a, b), (NEVER, 0))[0]
            # Merges of one rank go from left to right: one on the right comes after the border's.
            if rank < due or (on_right and rank == due):
                return False
            made_a, made_b = self.made[a][0], self.made[b][0]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                due, on_right, a = made_a, False, self.made[a][2]
            else:
                due, on_right, b = made_b, True, self.made[b][1]

    def _fits(self, a: int, b: int) -> bool:
        if self.pairs >= PAIRS:
            self.compatible, self.pairs = [{} for _ in self.bytes], 0
        self.pairs += 1
        known = self.compatible[a][b] = self._border_holds(a, b)
        return known

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        token_at, size_at = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)  # by prefix length: last token and its length
        done, compatible = -1, self.compatible
        for end, (token, size) in self.automaton.iter(raw):
            if end == done:
                continue  # this prefix has its token
            start = end + 1 - size
            if start:
                before = token_at[start]
                if before < 0:
                    continue
                fits = compatible[before].get(token)
                if not (self._fits(before, token) if fits is None else fits):
                    continue
            token_at[end + 1], size_at[end + 1] = token, size
            done = end
        out, at = [], len(raw)
        while at:
            if not size_at[at]:
                raise ValueError(f"the vocabulary does not cover {word!r}")
            out.append(token_at[at])
            at -= size_at[at]
        out.reverse()
        return array("i", out).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        words = WORD.findall(piece)
        return self.words[piece] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def _encode_plain(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return b"".join(map(self.words.__getitem__, WORD.findall(text)))
        first, *rest = text.split(" ")
        return self._encode_piece(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers of this machine's byte order."""
        if not self.special_at or not self.special_at.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The bytes of the ids' tokens, gathered from one table."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        return self.table[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """A worker keeps its tables from task to task."""
    return Bpe(path)


def _coded(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in parts(batches):
            texts = batch.column("_text").to_pylist()
            for lo in range(0, batch.num_rows, 500):
                coded = [bpe.encode_bytes(t) for t in texts[lo : lo + 500]]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                columns, names = [batch.column("_id").slice(lo, 500), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"]
                if decode:
                    columns, names = [*columns, pa.array([bpe.decode(flat[a:b]) for a, b in pairwise(ends.tolist())], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row for each input row: doc_id, ids (array of int), and with decode=True decoded, the text of those ids.

    path names a byte-level vocabulary file that every executor can read. Null text counts as empty
    and has no ids. Strings of special tokens in a text become their ids, as in the tokenizers
    library; bytes that aren't UTF-8 decode to U+FFFD. Null and repeated ids are passed through. An
    empty table gives an empty result; other columns of df are neither read nor returned.
    """
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = f"doc_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode
    return rows.mapInArrow(_coded(path, decode), schema)
