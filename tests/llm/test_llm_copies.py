"""Near copies, links among vectors and repeated strings against brute force; mixing."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from patronage.llm import mixing, ngram_join, repeats, vector_links


def classes(ids, linked):
    """Smallest reachable id and number of links, from a symmetric relation on positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(ids)
    for i, j in linked:
        links[i] += 1
        links[j] += 1
        root[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = x if low[r] is None else min(low[r], x)
    return [(low[find(i)], links[i]) for i in range(len(ids))]


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_links(texts, least=0.8):
    sets = [grams(t) for t in texts]
    return [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9
    ]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    texts = [None, "", " \n", "a b", "a  b", "b a", "a b c d e", "a b c d e"]
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 400))]
        texts += [edited(rng, words, rng.randint(0, 1 + len(words) // 60)) for _ in range(rng.randint(1, 5))]
    hot = [f"h{i}" for i in range(200)]
    return texts + [edited(rng, hot, rng.randint(0, 6)) for _ in range(60)] + [" ".join(f"v{i}" for i in range(20_000))] * 2


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies(frame, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    texts = corpus(random.Random(4))
    ids = random.Random(5).sample(range(10_000), len(texts))
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)]
    out = {r.doc_id: r for r in ngram_join.near_copies(frame(rows, "doc_id long, text string, class_id string, digest int", 5)).collect()}
    assert [(out[i].class_id, out[i].n_links) for i in ids] == classes(ids, jaccard_links(texts))


def test_near_copies_of_odd_tables(frame):
    df = frame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_copies(df).collect()), key=str)
    assert out == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (None, None, None)]
    assert ngram_join.near_copies(df.where("doc_id > 9")).count() == 0


def vectors(rng):
    out = []
    for size, noise in ((400, 0.01), (60, 0.05), (25, 0.09), (3, 0.02), (3, 0.02)):
        centre = rng.standard_normal(32)
        out += list(centre / np.linalg.norm(centre) + noise * rng.standard_normal((size, 32)) / np.sqrt(1))
    out += list(rng.standard_normal((300, 32)))
    return [list(map(float, v)) for v in out] + [out[0].tolist()] * 3


@pytest.mark.parametrize("leaf, block", [(1024, 2048), (64, 40)])
def test_vector_links(frame, monkeypatch, leaf, block):
    monkeypatch.setattr(vector_links, "LEAF_ROWS", leaf)
    monkeypatch.setattr(vector_links, "BLOCK_ROWS", block)
    vs = vectors(np.random.default_rng(6))
    ids = random.Random(7).sample(range(10_000), len(vs))
    x = np.array(vs) / np.linalg.norm(vs, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = classes(ids, [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if j < i])
    df = frame([(i, v, "x") for i, v in zip(ids, vs, strict=True)], "vec_id long, embedding array<double>, links string", 5)
    out = {r.vec_id: r for r in vector_links.link_vectors(df).collect()}
    got = [(out[i].component_id, out[i].n_links) for i in ids]
    found, there = sum(n for _, n in got), sum(n for _, n in want)
    assert found <= there and found >= 0.99 * there  # recall; and nothing below the cosine
    if leaf == 1024:  # one leaf: nothing can be missed
        assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


@pytest.mark.parametrize("share, noise", [(1.0, 0.35), (1.0, 0.5), (1 / 3, 0.3)])
def test_loose_groups_meet_in_the_forest(monkeypatch, share, noise):
    """Recall on rows that were not fitted, where all or a third of the table shares a direction."""
    monkeypatch.setattr(vector_links, "LEAF_ROWS", 64)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    group = centre / np.linalg.norm(centre) + noise * rng.standard_normal((int(8000 * share), 64)) / 8
    x = rng.permutation(np.concatenate([group, rng.standard_normal((8000 - len(group), 64))]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vector_links.Forest(x[:4000], 8000, 0.9, 0.999)
    assert not len(forest.centres) and forest.trees[0] is not None
    met, leaves = np.zeros((4000, 4000), bool), defaultdict(list)
    for i, cells in enumerate(forest.leaves(x[4000:])):
        for c in cells:
            leaves[c].append(i)
    for rows in leaves.values():
        met[np.ix_(rows, rows)] = True
    near = np.triu(x[4000:] @ x[4000:].T >= 0.9, 1)
    assert near.sum() > 1000 and (near & met).sum() >= 0.998 * near.sum()


def test_more_trees_than_allowed_mean_larger_leaves(monkeypatch):
    monkeypatch.setattr(vector_links, "LEAF_ROWS", 64)
    monkeypatch.setattr(vector_links, "MOST_TREES", 3)
    rng = np.random.default_rng(5)
    x = rng.standard_normal(64) / 8 + 0.4 * rng.standard_normal((2000, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vector_links.Forest(x, 2000, 0.9, 0.999)
    cells = [set(c) for c in forest.leaves(x)]
    near = [(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)]
    assert len(forest.trees) <= 4 and sum(bool(cells[i] & cells[j]) for i, j in near) >= 0.998 * len(near) > 0


def test_odd_vectors(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e-30, 0.0]), (4, [1e30, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (12, [0.0, 1.0]), (13, [-0.0, 3.0])]
    df = frame(rows, "vec_id long, embedding array<float>")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_links.link_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11)]
    assert out == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), (12, 1, 12, True), (13, 1, 12, False),
                          (None, 0, None, None), *alone], key=str)
    assert vector_links.link_vectors(df.where("vec_id > 99")).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repetitive(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, hot = prose(90), prose(40)
    texts = [None, "", "short", "a" * 700, "ab" * 130, "ab" * 131 + "c", "x" * 199, "y" * 200, "z" * 201, "é" * 150]
    texts += [prose(rng.randint(1, 200)) + (passage[rng.randint(0, 40) :] if rng.random() < 0.4 else "") + prose(rng.randint(0, 60)) for _ in range(30)]
    texts += [prose(30) + hot + prose(30) for _ in range(40)] + [prose(400)] * 3
    return texts + [texts[12] + texts[13], passage * 3]


def test_matching_statistics():
    rng = random.Random(8)
    for _ in range(60):
        parts = [bytes(rng.choices(rng.choice([b"a", b"ab", b"abc"]), k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        best, begin = repeats.matching_statistics(parts)
        for a, p in enumerate(parts):
            for i in range(len(p)):
                most = 0
                for b, q in enumerate(parts):
                    for j in range(len(q)):
                        k = 0
                        while (a, i) != (b, j) and i + k < len(p) and j + k < len(q) and p[i + k] == q[j + k]:
                            k += 1
                        most = max(most, k)
                assert best[begin[a] + i] == most


@pytest.mark.parametrize("route, bucket, chunk", [(10**6, 10**6, 1 << 20), (2000, 3000, 1 << 20), (10**6, 10**6, 64)])
def test_repeated_strings(frame, monkeypatch, route, bucket, chunk):
    monkeypatch.setattr(repeats, "ROUTE_BYTES", route)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    texts = repetitive(random.Random(9))
    rows = [(i if i % 7 else None, t, i, b"x", "y", 1, 2, 3) for i, t in enumerate(texts)]
    df = frame(rows, "doc_id long, text string, n long, kept binary, spans string, d int, c int, route int", 4)
    if chunk != 1 << 20:  # the workers read the module: check the cut of one text here
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        for t in texts:
            first, count, *_ = repeats.segments((t or "").encode(), 200)
            assert first.tolist() == (np.cumsum(count) - count).tolist() and count.sum() == max(0, len((t or "").encode()) - 199)
        return
    out = {r.n: r for r in repeats.remove_repeats(df.drop("spans")).collect()}
    assert {(r.d, r.c, r.route) for r in out.values()} == {(1, 2, 3)}
    got = [(out[i].n_bytes, out[i].n_removed, out[i].n_spans, hashlib.sha256(bytes(out[i].kept)).hexdigest()) for i in range(len(texts))]
    assert got == brute_repeats(texts, 200)
    assert all(set(out[i].kept_text) <= set(t or "") for i, t in enumerate(texts))


def test_repeats_in_odd_tables(frame):
    df = frame([("1", "q" * 200), ("1", "q" * 200), ("2", "r" * 200)], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect()) == [("1", 200), ("1", 200), ("2", 0)]
    assert repeats.remove_repeats(df.where("doc_id = '9'")).count() == 0


def test_whole_characters():
    data = "aéb".encode()
    assert repeats.whole_characters(data, np.array([[0, 2]])).tolist() == [[0, 1]]
    assert repeats.whole_characters(data, np.array([[2, 4]])).tolist() == [[3, 4]]
    assert repeats.merged([5, 9, 0, 3, 3, 4, 8, 12]).tolist() == [[0, 4], [5, 12]]


def test_mix_reaches_its_targets(frame):
    rng = random.Random(10)
    sizes = {"a": 400, "b": 30, "c": 60, "d": 5, "é": 80, None: 20}
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(10**6, None, "a"), (10**6, None, "a"), (None, "x y z", "b"), (None, "x y", "b")]
    df = frame([(*r, -1, 7, 8, 9) for r in rows], "doc_id long, text string, source string, size int, whole int, weight int, extra int")
    out = mixing.mix(df, (5, 2, 1), 1.5).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(9), (5, 2, 1), 1.5).collect()))
    total = sum(len((t or "").split()) for _, t, _ in rows)
    targets = {r.source: r.target for r in out}
    assert sum(targets.values()) == pytest.approx(1.5 * total) and len(out) == len(rows)
    order = sorted((s for s in targets if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    level = max(t / weight[s] for s, t in targets.items())
    for s, t in targets.items():
        own = [r for r in out if r.source == s]
        size = sum(r.size for r in own)
        assert own[0].source_size == size and t == pytest.approx(min(2 * size, level * weight[s]))
        assert abs(sum(r.taken for r in own) - t) <= max(r.size for r in own) and all(r.taken <= 2 * r.size for r in own)
    assert mixing.expand(mixing.mix(df, (5, 2, 1), 1.5)).count() == sum(r.repeats for r in out)


def test_mix_of_nothing(frame):
    df = frame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(df, (5, 2, 1), 1.5).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(df.where("doc_id > 9"), (1,), 1.5).count() == 0
