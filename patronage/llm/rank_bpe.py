"""Byte-level BPE by a contiguous array of ranks.

A text is cut at the tokenizer's added tokens, then into words by the
byte-level pattern. A word is one token per byte at first, each reaching to the
next boundary; beside every token but the last stands the rank at which it
merges with its right neighbour. The smallest rank is searched again and
again, leftmost first: the boundary there is deleted and the ranks of the two
neighbouring pairs are looked up anew. Short words, nearly all there are, hold
both arrays in one piece of memory, so a scan costs less than keeping a queue.
Words of over ``SCANNED`` bytes would cost the square of their length; they
take the same merges in the same order from a heap of ranks and places.

What the tokenizers library gives is reproduced, from the same file: merges
are those listed for a pair of tokens, and the library's own character classes
hold (its Unicode tables may be older than those of ``regex``; see ``Splitter``).
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from array import array
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import pre_tokenizers

#: Bytes of the longest word whose ranks are scanned.
SCANNED = 256
#: Words a worker remembers in each of two halves, and the longest one that is.
MEMO, MEMO_CHARS = 1 << 18, 48
#: Two tokens, or a rank and a token, share a number.
TOKEN_BITS = 20
TOKEN_MASK, NEVER = (1 << TOKEN_BITS) - 1, 1 << 60


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """Tokens as bytes by number, merges by pair, and added tokens of a byte-level BPE file.

    A file that asks for more than byte-level BPE (a normalizer, pieces for
    unknown words, added tokens that strip blanks, ...) raises ValueError.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split, joined = file["model"], file["pre_tokenizer"] or {}, file["decoder"] or {}
    plain = (
        model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not file["normalizer"] and split.get("type") == joined.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split["add_prefix_space"] and not any(a[k] for a in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        raise ValueError(f"{path} asks for more than byte-level BPE")
    code = {letter: byte for byte, letter in byte_letters().items()}
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    added = {a["content"]: a["id"] for a in file["added_tokens"]}
    size = max([*ids.values(), *added.values()], default=-1) + 1
    if size > TOKEN_MASK:
        raise ValueError(f"{path} has over {TOKEN_MASK} tokens")
    spelled: list[bytes] = [b""] * size
    for token, number in (ids | added).items():
        known = all(c in code for c in token)
        spelled[number] = bytes(code[c] for c in token) if known else token.encode()
    return {
        "single": [ids.get(letter, -1) for _, letter in sorted(byte_letters().items())], "spelled": spelled, "added": added,
        "merges": {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)},
    }


def character_classes(characters: list[str]) -> dict[str, str]:
    """The class of each character in the tokenizers library: letter, number, blank (``L``, ``N``, ``S``) or other (``O``)."""
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    out = {}
    for c in characters:
        if c == " ":  # the only one that joins what follows
            out[c] = "S"
            continue
        # How the library parts "a?1?!" with the character in place of "?": letters join the a, numbers the 1, others the "!".
        ends = {b for _, (_, b) in cut(f"a{c}1{c}!")}
        out[c] = "L" if 1 not in ends else "N" if 2 not in ends else "S" if 4 in ends else "O"
    return out


class Splitter:
    """Words of a text as the tokenizers library cuts them.

    Its Unicode tables are older than those of Python's modules, so the
    classes of characters are asked of the library itself, a block of 256
    when one of its characters first appears; ``re`` then cuts by them. Texts
    with letters or numbers beyond the basic plane are cut by the library.
    """

    def __init__(self):
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.blocks: set[int] = set()
        self.far: dict[str, str] = {}  # classes of characters beyond the basic plane
        self.runs: dict[str, list[str]] = {kind: [] for kind in "LNSO"}
        self._learn({"a"})

    def _learn(self, characters: set[str]) -> None:
        """Take in the blocks of these characters."""
        self.far |= character_classes([c for c in characters if c > "\uffff" and c not in self.far])
        new = {ord(c) >> 8 for c in characters if c <= "\uffff"} - self.blocks
        if not new:
            return
        self.blocks |= new
        for block in new:
            of = character_classes([chr(p) for p in range(block << 8, block + 1 << 8) if not 0xD800 <= p < 0xE000])
            for kind, run in groupby(of, of.get):
                run = list(run)
                self.runs[kind].append(f"{re.escape(run[0])}-{re.escape(run[-1])}")
        letters, numbers, blanks, others = ("".join(self.runs[kind]) for kind in "LNSO")
        self.words = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{letters}{numbers}{blanks}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
        ).findall
        self.unknown = re.compile(f"[^{letters}{numbers}{blanks}{others}]").search

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self.unknown(text):
            here = set(text)
            self._learn(here)
            if any(self.far.get(c, "O") != "O" for c in here):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.words(text)


class Remembered(dict):
    """Packed tokens by word; a missing word is encoded. A full memory becomes the old one, from which words that come again are taken over."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = array("i", self.encode(word.encode())).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Ranks:
    """Encoder and decoder over one tokenizer file, built once in each worker."""

    def __init__(self, tokenizer: dict):
        self.single, self.spelled, self.added = tokenizer["single"], tokenizer["spelled"], tokenizer["added"]
        # Rank and merged token in one number by the two tokens in one number: the least number is the first merge.
        self.merges = {a << TOKEN_BITS | b: rank << TOKEN_BITS | merged for (a, b), (rank, merged) in tokenizer["merges"].items()}
        self.pairs = {
            (a, b): self.merges.get(self.single[a] << TOKEN_BITS | self.single[b], NEVER) if min(self.single[a], self.single[b]) >= 0 else NEVER
            for a in range(256) for b in range(256)
        }
        longest_first = sorted(filter(None, self.added), key=len, reverse=True)
        self.parts = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.split = Splitter()
        self.memo = Remembered(self.word)

    def _bytes(self, word: bytes) -> list[int]:
        tokens = [self.single[b] for b in word]
        if -1 in tokens:
            raise ValueError("the vocabulary cannot spell a word: single bytes are missing")
        return tokens

    def word(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        if len(word) > SCANNED:
            return self.long_word(word)
        find, tokens = self.merges.get, self._bytes(word)
        ranks = [*map(self.pairs.__getitem__, zip(word, word[1:], strict=False))]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            merged = tokens[at] = low & TOKEN_MASK
            del tokens[at + 1], ranks[at]  # the boundary between the two
            if at:
                ranks[at - 1] = find(tokens[at - 1] << TOKEN_BITS | merged, NEVER)
            if at < len(ranks):
                ranks[at] = find(merged << TOKEN_BITS | tokens[at + 1], NEVER)
        return tokens

    def long_word(self, word: bytes) -> list[int]:
        """The same for long words: ranks and places in a heap, tokens linked to their neighbours."""
        find, tokens = self.merges.get, self._bytes(word)
        n = len(tokens)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := find(tokens[i] << TOKEN_BITS | tokens[i + 1]))]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or tokens[i] != a or tokens[j] != b:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = low & TOKEN_MASK, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (m := find(tokens[k] << TOKEN_BITS | tokens[right[k]])):
                    heapq.heappush(heap, (m, k, tokens[k], tokens[right[k]]))
        return [t for t in tokens if t >= 0]

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def pack(self, text: str) -> bytes:
        """Token numbers as packed 32-bit numbers; added tokens in the text are tokens."""
        if self.parts is None or not self.parts.search(text):
            return self._words(text)
        out, at = bytearray(), 0
        for found in self.parts.finditer(text):
            out += self._words(text[at : found.start()]) + array("i", [self.added[found[0]]]).tobytes()
            at = found.end()
        return bytes(out + self._words(text[at:]))

    def decode(self, ids) -> str:
        """The text that the numbers spell; numbers that no token has spell nothing, bytes that are no UTF-8 become U+FFFD."""
        size, spelled = len(self.spelled), self.spelled
        return b"".join([spelled[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


_ranks: dict[str, Ranks] = {}


def _coder(tokenizer) -> Ranks:
    """The worker's coder of a broadcast tokenizer."""
    path, content = tokenizer.value
    if path not in _ranks:
        _ranks.clear()
        _ranks[path] = Ranks(content)
        gc.freeze()  # the tables stay as long as the worker: the collector need not walk them
    return _ranks[path]


def _ship(spark: SparkSession, path: str):
    """The tokenizer as a broadcast: its size is that of the file, not of the data."""
    return spark.sparkContext.broadcast((path, read_tokenizer(path)))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids``, the token numbers of the whole ``text``, and ``decoded``, the text that they spell.

    ``path`` names a byte-level BPE file of the tokenizers library. Null and
    empty texts give an empty list and an empty text. Rows are mapped one by
    one, so ties and repeated rows do not matter, and an empty table stays
    empty. A word of any length is merged whole. Other columns pass
    through; ones that already have the name of an output are replaced,
    unless it is ``text`` itself, which raises.
    """
    if text in (ids, decoded):
        raise ValueError(f"{text} is the input")
    tokenizer = _ship(df.sparkSession, path)

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def both(texts: pa.Array) -> pa.Array:
        coder, flat, ends, out = _coder(tokenizer), bytearray(), [0], []
        for t in texts:
            packed = coder.pack(t.as_py() or "")
            flat += packed
            ends.append(len(flat) // 4)
            out.append(coder.decode(array("i", packed)))
        numbers = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers), pa.array(out, pa.string())], ["ids", "decoded"])

    # One struct under the name of an output, so no name of the caller's is needed for it; marked so that its two readers share one run.
    added = df.drop(ids, decoded).withColumn(ids, both.asNondeterministic()(F.col(text)))
    return added.withColumns({ids: F.col(ids)["ids"], decoded: F.col(ids)["decoded"]})


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text that the numbers in ``ids`` spell; a null list spells the empty text, null numbers nothing."""
    tokenizer = _ship(df.sparkSession, path)

    @F.arrow_udf("string")
    def spelled(lists: pa.Array) -> pa.Array:
        coder = _coder(tokenizer)
        return pa.array([coder.decode([i for i in one.as_py() or () if i is not None]) for one in lists], pa.string())

    return df.withColumn(out, spelled(F.col(ids)))


def id_digest(ids: Column) -> Column:
    """SHA-256 of the decimal numbers joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
