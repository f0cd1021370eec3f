"""Rank-array BPE against the tokenizers library; whitening against a direct decomposition."""

import hashlib
import json
import math
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from patronage.llm import rank_bpe, whitening
from patronage.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return rank_bpe.Ranks(rank_bpe.read_tokenizer(PATH))


def same(library, coder, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert list(array("i", coder.pack(text))) == want
    assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_any_mix_of_pieces(library, coder):
    rng = random.Random(1)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "a", "é", "ß", "日", "😀", "1", "²", "'s", "'S", "\x85", "\x1c", "\x00", "　", "<|endoftext|>", "<|endof", "text|>", "�", "՘"]
    for _ in range(3000):
        same(library, coder, "".join(rng.choices(parts, k=rng.randint(0, 30))))


def test_every_character(library, coder):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000][::5]
    for at in range(0, len(points), 500):
        same(library, coder, "".join(f"a{chr(p)}1{chr(p)}? {chr(p)}x" for p in points[at : at + 500]))


def test_any_numbers_decode(library, coder):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode([10**6, -1]) == ""


def test_short_and_long_words_take_the_same_merges(library, coder):
    rng = random.Random(3)
    for _ in range(2000):
        word = bytes(rng.choices(b"thesinaodr", k=rng.randint(1, rank_bpe.SCANNED)))
        assert coder.word(word) == coder.long_word(word)
    for text in ["a" * 20_001, "abcde" * 3000, " " * 5000, "日本" * 4000, "x" * 256, "x" * 257]:
        same(library, coder, text)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        rank_bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    file = json.load(open(PATH))
    file["normalizer"] = {"type": "NFC"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        rank_bpe.read_tokenizer(str(path))


def test_tables_of_texts(frame, library):
    texts = [None, "", " ", "plain text", "plain text", "x" * 50_000 + " é", "a<|endoftext|>b"]
    df = frame([(i, t, "kept", 7.0, "k") for i, t in enumerate(texts)], "doc_id int, text string, IDS string, decoded double, both string")
    for r in rank_bpe.round_trip(df, PATH).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded, r.both, r.text) == (want, texts[r.doc_id] or "", "k", texts[r.doc_id])
    empty = rank_bpe.round_trip(df.where("doc_id < 0"), PATH)
    assert empty.count() == 0 and rank_bpe.decode(empty, PATH).count() == 0
    lists = frame([([50256, None, 64],), (None,)], "ids array<int>")
    assert {r.decoded for r in rank_bpe.decode(lists, PATH).collect()} == {"<|endoftext|>a", ""}
    with pytest.raises(ValueError):
        rank_bpe.round_trip(df, PATH, ids="text")


def test_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op12_rank_bpe"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (len(ids), *digests)


# --- whitening -------------------------------------------------------------------


def checked(a):
    values, axes = whitening.spectral_components(a)
    size = max(np.abs(a).max(initial=0), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max(initial=0) < 1e-13 * size * max(1, len(a))
    assert np.abs(axes.T @ axes - np.eye(len(a))).max(initial=0) < 1e-13 and np.abs(a @ axes - axes * values).max(initial=0) < 1e-13 * size * max(1, len(a))


def test_components_of_any_spectrum():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    spectra = [np.arange(48.0), 10.0 ** -np.arange(48), np.repeat([1.0, 2, 3], 16), 1 + 1e-9 * np.arange(48), np.r_[1e6, np.ones(47)], np.r_[np.arange(4.0), np.zeros(44)], -np.arange(48.0), np.ones(48)]
    for s in spectra:
        checked((q * s) @ q.T)
    for a in (np.zeros((0, 0)), np.zeros((3, 3)), np.eye(5), np.diag([3.0, 1, 2]), np.array([[2.0, 1], [1, 2]]), np.array([[5.0]]), np.array([[0.0, 1], [1, 0]])):
        checked(a)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (v * np.sign(w)) @ v.T).max() < 1e-12


def direct(rows, most=16):
    """Rows by the definitions, with a library decomposition of the exact covariance."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = {}
    for (i, _), v in zip(rows, x, strict=True):
        away = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        out.setdefault(i, []).append((away, np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) @ u / np.sqrt(e)))
    return n, e / np.trace(centred.T @ centred / n), out


def agree(got, rows, most=16):
    n, shares, want = direct(rows, most)
    assert len(got) == sum(map(len, want.values())) * len(shares)
    signs = {}
    for r in got:
        options = [w for w in want[r.vec_id] if w[0] == int(r.deviation)]
        assert r.n == n and options and r.explained == pytest.approx(shares[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        near = [s for s in (1, -1) if any(abs(s * r.whitened - w[1][r.component - 1]) < 1e-6 for w in options)]
        assert near
        if abs(r.whitened) > 1e-3:
            signs.setdefault(r.component, set(near)).intersection_update(near)
    assert all(signs.values())


def test_whitening_against_the_definitions(spark, frame):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 20)) * (1 + np.arange(20)) + 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(0, rows[5][1])]
    odd = [(-1, None), (-2, []), (-3, [1.0] * 19 + [None]), (-4, [1.0] * 19 + [float("nan")]), (-5, [1.0] * 19 + [float("-inf")]), (-6, [1e300] * 20), (-7, [1.0] * 3)]
    df = frame(rows + odd, "vec_id long, embedding array<double>", 5)
    agree(whitening.whiten(df).collect(), rows)
    agree(whitening.whiten(df, most=3).collect(), rows, 3)


def test_rare_vectors(spark, frame):
    schema = "vec_id long, embedding array<float>, whole string, component string, whitened int, n int, value string, place int"
    more = ("w", "c", 1, 2, "v", 3)
    few = frame([(1, [1.0, 2.0], *more), (2, [1.0, 2.5], *more), (2, [1.0, 2.5], *more), (3, None, *more)], schema)
    got = whitening.whiten(few).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened, 9), int(r.deviation), r.whole, r.value, r.place) for r in got) in (
        [(1, 1, s, 1024, "w", "v", 3), (2, 1, -s, 1024, "w", "v", 3), (2, 1, -s, 1024, "w", "v", 3)] for s in (1.0, -1.0)
    )
    assert whitening.whiten(few.where("vec_id = 2")).count() == 0  # one vector has no variance
    assert whitening.whiten(few.where("vec_id = 9")).count() == 0


def test_large_entries_stay_exact(frame):
    rows = [(i, [float(i * 10**9), float(-i), 1e14 + i]) for i in range(50)]
    got = whitening.whiten(frame(rows, "vec_id long, embedding array<double>")).collect()
    want = direct(rows)[2]
    assert got and all(int(r.deviation) == want[r.vec_id][0][0] for r in got)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    agree(QUERIES["op11_whitening"](spark, FOLDER).collect(), rows)
