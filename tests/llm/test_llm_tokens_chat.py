"""Byte-level BPE against the tiktoken library; chat windows read back."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from patronage.llm import bpe, chat

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(PATH), PATTERN)


def test_any_mix_of_pieces(library, coder):
    rng = random.Random(1)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "a", "xyz", "é", "ß", "😀", "1", "'s", "\x85", "\x1c", "<|endoftext|>", "aaaa", "　"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert coder.encode(s).tolist() == library.encode_ordinary(s)
        assert coder.decode(coder.encode(s).tolist()) == s.encode()


def test_long_pieces_and_every_letter(library, coder):
    rng = random.Random(2)
    for s in ["a" * 3001, "abcde" * 2000, " " * 5000, "".join(rng.choices("abcdefghilmnorst", k=20_000))]:
        assert coder.encode(s).tolist() == library.encode_ordinary(s)
    for point in range(0, 0x30000, 7):
        if not 0xD800 <= point < 0xE000:
            s = f"a{chr(point)} {chr(point)}b1"
            assert coder.encode(s).tolist() == library.encode_ordinary(s)


def test_a_full_memory_changes_nothing(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    fresh = bpe.Coder(bpe.read_ranks(PATH), PATTERN)
    s = "some words come again and some words do not, somewhere wordless " * 5
    assert fresh.encode(s).tolist() == library.encode_ordinary(s)


def test_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Coder({b"a": 0}, PATTERN).encode("b")


def test_tables(spark, frame, library):
    texts = [None, "", " ", "plain text", "plain text", "x" * 50_000 + " é", "\\ud800"]
    df = frame([(i, t, "kept", -1) for i, t in enumerate(texts)], "doc_id int, text string, ids string, n int")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    for r in bpe.round_trip(df, PATH, PATTERN).collect():
        assert (r.ids, r.decoded, r.text) == (rows[r.doc_id].ids, rows[r.doc_id].decoded, rows[r.doc_id].text)
    empty = df.where("doc_id < 0")
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH, PATTERN).count() == 0


def expected(turns):
    conv = defaultdict(list)
    for c, t, r, x in turns:
        conv[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, ts in conv.items():
        ts.sort(key=lambda x: (x[0], x[1] if x[0] else 0, x[2], hashlib.md5(x[3].encode()).hexdigest()))
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(df).collect()}


def test_windows_give_back_every_turn(frame):
    rng = random.Random(3)
    parts = ["<|end|>", "<|user|>", "\\", "\\l", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|>", "<|", "é😀", "\n", "|", "<", "word "]
    turns = [
        (rng.choice([None, *range(20)]), k, rng.choice(["user", "assistant", "<|x|>", "a|", None]),
         rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(0, 120)))])) for k in range(900)
    ] + [(c, -1, "system", "be good " * rng.randint(1, 80)) for c in range(0, 20, 2)]
    w = chat.windows(frame(turns, SCHEMA), budget=256, history_tokens=64).cache()
    assert digests(w) == expected(turns)
    for r in w.collect():
        assert r.tokens <= 256 or r.n_turns == 1 or r.first_turn == 0 and r.n_turns == 2
        seen = chat.parse(r.formatted)
        assert len(seen) == r.n_context + r.n_turns and r.n_context <= 3
        if r.conv_id is not None and r.conv_id % 2 == 0:
            assert seen[0][0] == "system"


def test_history_repeats_without_loss(frame):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 6) for k in range(12)]
    rows = chat.windows(frame(turns, SCHEMA), budget=60, history_tokens=25).orderBy("first_turn").collect()
    assert len(rows) > 3 and any(r.n_context for r in rows)
    targets = [r.formatted[s.start : s.end] for r in rows for s in r.loss]
    assert targets == [f"turn {k} " * 6 for k in range(1, 12, 2)]


def test_one_conversation_of_many_ranges(spark, frame):
    turns = [(5, k, "assistant" if k % 3 else "user", f"said {k}") for k in range(3000)] + [(6, 0, "user", "alone")]
    w = chat.windows(frame(turns, SCHEMA, 7))
    assert digests(w) == expected(turns)


def test_rare_conversations(frame):
    turns = [(1, 0, "system", "only this"), (2, None, "user", "a"), (2, None, "user", "a"), (2, 1, "user", None), (3, 0, "user", "long " * 5000), (3, 1, "assistant", "ok")]
    df = frame([(*t, "x", 9) for t in turns], SCHEMA + ", formatted string, loss int")
    assert digests(chat.windows(df)) == expected(turns)
    assert chat.windows(df.where("turn > 99")).count() == 0 and not digests(chat.windows(df.where("turn > 99")))
