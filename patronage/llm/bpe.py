"""Byte-level BPE by longest matches and backtracking.

A text is cut into pieces by the tokenizer's pattern. In a piece, an
Aho-Corasick automaton over the vocabulary (bytes written as Latin-1
characters) gives the longest token at every position. Tokens are laid from
the left, longest first; a token may follow another only if the merges would
keep the border between them. Where no token fits, the last one is taken back
and a shorter one tried; positions from which no ending exists are marked, so
every position is given up at most once and the work is linear in the piece.
The result is that of merging pairs by rank.
"""

from __future__ import annotations

import base64
import gc
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.llm.common import fresh, set_aside

#: Pieces a worker remembers in each of two halves; when the young half is full it becomes the old one.
MEMO = 1 << 17
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1 << 18
#: Longer pieces are not remembered.
MEMO_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Memo(dict):
    """Tokens by piece, as packed 32-bit numbers; what is missing is computed.

    Bounded: a full memory moves to ``old`` and a new one is begun, which takes
    over from ``old`` what is asked for again.
    """

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = array("i", self.compute(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Coder:
    """Encoder and decoder over one vocabulary, built once in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.width = [len(t) for t in self.tokens]
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token) - 1))
        if self.ids:
            self.automaton.make_automaton()
        self.shorter = self._shorter()
        self.pairs: dict[int, bool] = {}
        self._find_halves()
        self.memo = Memo(self.piece)

    def _shorter(self) -> list[int]:
        """For each token the longest token that it starts with, or -1."""
        out = [-1] * len(self.tokens)
        for token, rank in self.ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (shorter := self.ids.get(token[:n])) is not None:
                    out[rank] = shorter
                    break
        return out

    def _find_halves(self) -> None:
        """The two tokens whose merge makes each token; a token that no merge makes is its own half."""
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            head = self.shorter[rank]
            while head >= 0:
                tail = self.ids.get(token[self.width[head] :])
                if tail is not None and head < rank and tail < rank and self._compatible(head, tail):
                    self.left[rank], self.right[rank] = head, tail
                    self.merged[head, tail] = rank
                    break
                head = self.shorter[head]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        Undo merges on both sides of the border, latest first; if two tokens
        that touch it at some moment could have merged before the next merge
        beside them, the border would have gone.
        """
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            undo_a = a > b
            for _ in range(2):
                if undo_a and self.right[a] != a:
                    limit, a = a, self.right[a]
                    break
                if not undo_a and self.left[b] != b:
                    limit, b = b + 1, self.left[b]
                    break
                undo_a = not undo_a
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._compatible(a, b)
        return known

    def piece(self, s: str) -> list[int]:
        """Tokens of one piece, given as Latin-1 characters."""
        if (whole := self.ids.get(s)) is not None:
            return [whole]
        width, shorter, compatible, known, end_of_piece = self.width, self.shorter, self.compatible, self.pairs, len(s)
        longest = {last - reach: token for last, (token, reach) in self.automaton.iter(s)}  # later ones are longer
        dead: set[int] = set()
        out: list[int] = []
        at, token, previous = 0, longest.get(0, -1), -1
        while True:
            while token >= 0:
                if at + width[token] not in dead and (
                    previous < 0 or (fits := known.get(previous << 32 | token)) or fits is None and compatible(previous, token)
                ):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += width[token]
                if at == end_of_piece:
                    return out
                previous, token = token, longest.get(at, -1)
                continue
            dead.add(at)
            if not out:
                raise ValueError("the vocabulary cannot spell a piece: single bytes are missing")
            token = out.pop()
            at -= width[token]
            previous = out[-1] if out else -1

    def pack(self, text: str) -> bytes:
        """Token numbers as packed 32-bit numbers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pack(text), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[tuple, Coder] = {}


def _coder(vocabulary, pattern: str) -> Coder:
    """The worker's coder of a broadcast vocabulary."""
    key = (vocabulary.value[0], pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary.value[1], pattern)
        gc.freeze()  # the tables stay as long as the worker: the collector need not walk them
    return _coders[key]


def _ship(spark: SparkSession, ranks_path: str):
    """The vocabulary as a broadcast: its size is that of the rank file, not of the data."""
    return spark.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the token numbers of the whole ``text``; null and empty texts give an empty list.

    Special tokens are not recognised: their strings are ordinary text.
    """
    vocabulary = _ship(df.sparkSession, ranks_path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder, flat, ends = _coder(vocabulary, pattern), bytearray(), [0]
        for t in texts:
            flat += coder.pack(t.as_py() or "")
            ends.append(len(flat) // 4)
        return _lists(flat, ends)

    # Marked so that a reader of the numbers, such as decode, does not make the planner encode twice.
    return df.withColumn(out, ids.asNondeterministic()(F.col(text)))


def _lists(flat: bytearray, ends: list[int]) -> pa.Array:
    """Lists of 32-bit numbers that end at ``ends``, over the packed numbers as they are."""
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add both ``encode``'s numbers and the bytes that ``decode`` spells from them, in one pass over the texts.

    Columns named like an output are replaced, others pass through.
    """
    vocabulary = _ship(df.sparkSession, ranks_path)

    @F.arrow_udf("struct<ids array<int>, decoded binary>")
    def both(texts: pa.Array) -> pa.Array:
        coder, flat, ends, spelled, byte_ends = _coder(vocabulary, pattern), bytearray(), [0], bytearray(), [0]
        for t in texts:
            packed = coder.pack(t.as_py() or "")
            flat += packed
            ends.append(len(flat) // 4)
            spelled += coder.decode(array("i", packed))
            byte_ends.append(len(spelled))
        offsets = pa.py_buffer(np.array(byte_ends, np.int32))
        bytes_ = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(spelled)])
        return pa.StructArray.from_arrays([_lists(flat, ends), bytes_], ["ids", "decoded"])

    inner, restore = set_aside(df, [text], [out, decoded])
    pair = fresh("both", inner, [out, decoded])
    added = inner.withColumn(pair, both.asNondeterministic()(F.col(text)))
    return restore(added.select("*", F.col(pair)["ids"].alias(out), F.col(pair)["decoded"].alias(decoded)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that the token numbers spell; a null list gives no bytes."""
    vocabulary = _ship(df.sparkSession, ranks_path)

    @F.arrow_udf("binary")
    def spelled(lists: pa.Array) -> pa.Array:
        coder = _coder(vocabulary, pattern)
        ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        return pa.array([coder.decode(ids[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())

    return df.withColumn(out, spelled(F.col(ids)))


def id_digest(ids: Column) -> Column:
    """SHA-256 of the decimal numbers joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
