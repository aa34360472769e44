"""BPE encoding and decoding by a dynamic programme over prefixes.

BPE is the greedy application of ranked merges.  Two facts make it a table
look-up: the encoding of every prefix of a piece ends in exactly one token, and
a token may follow another exactly if merging would never join across their
border.  So for each prefix the tokens that end there (matches of a suffix
automaton over the vocabulary) are tested for compatibility with the last token
of the prefix they leave; the one that passes is stored, and back-pointers from
the whole piece give the exact ids in linear time, whatever the piece.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty string; other columns are carried through untouched;
repeated rows give repeated results; texts are never cut.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, small

#: Pre-tokenisation of byte-level BPE (fixed value: the vocabulary was built with it).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and tested pairs kept per Python worker.  A full cache becomes the older of two
#: generations, from which what is met again is taken over; pairs start anew.
CACHE_PIECES, CACHE_PAIRS = 100_000, 150_000
#: Pieces longer than this aren't kept.
CACHE_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(plain)
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = {s: b for b, s in enumerate(byte_symbols())}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pair_rank[a, b] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
            if rank <= max(self.rank.get(a, -1), self.rank.get(b, -1)):
                raise ValueError("a merge precedes those that make its parts: not a trained BPE vocabulary")
        usable = [i for s, i in vocab.items() if i in self.parts or len(s) == 1]
        self.suffixes = ahocorasick.Automaton()
        for i in usable:
            raw = self.token_bytes[i].decode("latin-1")
            self.suffixes.add_word(raw, (i, len(raw)))
        self.suffixes.make_automaton()
        self._joins: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._find = regex.compile(PIECES).findall
        self._special_at = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max(self.token_bytes) + 1
        self.byte_table = [self.token_bytes.get(i, b"") for i in range(size)]
        self.byte_sizes = [len(b) for b in self.byte_table]
        self.lengths = np.array([len(b) for b in self.byte_table], dtype=np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side.

        The symbol at the border runs down the right edge of ``left`` and the
        left edge of ``right`` as merges are undone.  A merge across the border
        happens if both its parts stand there when its turn comes: before the
        parent on the left is made, and not after the parent on the right is
        (of equal ranks the leftmost goes first).
        """
        key = left << 32 | right
        known = self._joins.get(key)
        if known is not None:
            return known
        rights, node = [], right
        until = len(self.pair_rank)
        while True:
            rights.append((node, until))
            if node not in self.parts:
                break
            until, node = self.rank[node], self.parts[node][0]
        ok, node, until = True, left, len(self.pair_rank)
        while ok:
            for other, other_until in rights:
                rank = self.pair_rank.get((node, other))
                if rank is not None and rank < until and rank <= other_until:
                    ok = False
                    break
            if node not in self.parts:
                break
            until, node = self.rank[node], self.parts[node][1]
        if len(self._joins) >= CACHE_PAIRS:
            self._joins.clear()
        self._joins[key] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8").decode("latin-1")
        last = [-1] * (len(raw) + 1)
        compatible, tested = self.compatible, self._joins.get
        for end, (token, length) in self.suffixes.iter(raw):
            end += 1
            if last[end] < 0:
                if end == length:
                    last[end] = token
                    continue
                left = last[end - length]
                if left >= 0:
                    ok = tested(left << 32 | token)
                    if compatible(left, token) if ok is None else ok:
                        last[end] = token
        ids, at, size = [], len(raw), self.byte_sizes
        while at > 0:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def _packed(self, text: str) -> bytes:
        pieces = self._find(text)
        found = list(map(self._pieces.get, pieces))
        if None in found:
            known, older = self._pieces, self._older
            for k, packed in enumerate(found):
                if packed is None:
                    piece = pieces[k]
                    packed = known.get(piece)
                    if packed is None:
                        packed = older.get(piece)
                        if packed is None:
                            ids = self.encode_piece(piece)
                            packed = struct.pack(f"<{len(ids)}I", *ids)
                        if len(piece) <= CACHE_CHARS:
                            if len(known) >= CACHE_PIECES:
                                self._older = older = known
                                self._pieces = known = {}
                            known[piece] = packed
                    found[k] = packed
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._special_at is None or not any(s in text for s in self.special):
            return self._packed(text)
        out, at = [], 0
        for m in self._special_at.finditer(text):
            out += [self._packed(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._packed(text[at:])])

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.byte_table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per Python worker and path."""
    return Bpe(path)


def encode_decode(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed little-endian u32, as training shards store
    them) and ``decoded`` in place of the text column.

    A narrow map: no shuffle, memory bounded by an Arrow batch and the cache.
    ``vocab_path`` must exist on every worker machine, as installed packages do.
    """
    ship(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    clash = {f.name.lower() for f in rest} & {"ids", "decoded"}
    if clash:
        rest = [f for f in rest if f.name.lower() not in clash]
    out = T.StructType([*rest, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in small(batches, n):
            packed = [bpe.encode(t) if t else b"" for t in batch.column(n).to_pylist()]
            decoded = [bpe.decode(p) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=[*(f.name for f in rest), "ids", "decoded"])

    return docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{text_col}`")).mapInArrow(run, out)
