"""The divergence audit against its definitions by brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from patronage.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    docs = [(s or "", g or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        holders = Counter(w for _, g, ws in docs if g == lang for w in set(ws))
        kept = {w for w, n in holders.items() if n >= least}
        uses = defaultdict(Counter)
        for s, g, ws in docs:
            if g == lang:
                uses[s].update(w for w in ws if w in kept)
        whole = sum(uses.values(), Counter())

        def shares(counts, kept=kept):
            n = sum(counts.values())
            return {w: 1 + 1_000_000_000 * (counts[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in uses.items()}, shares(whole)
        for s in uses:
            items = [("pair", o, sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept)) for o in uses if o != s]
            ranked = [(part, item, v, i) for i, (part, item, v) in enumerate(sorted(items, key=lambda x: (-x[2], x[1].encode())), 1)]
            own = [(w, (p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])) for w in kept if uses[s][w] and p[s][w] > q[w]]
            ranked += [("term", w, v, i) for i, (w, v) in enumerate(sorted(own, key=lambda x: (-x[1], x[0].encode())), 1) if i <= top]
            out += [(lang, s, *r) for r in ranked]
    return sorted(out)


def corpus(rng, n):
    words = ["The", "the", "x9y", "naïve", "日本", "ÉCOLE", "école", "a-b", "o'clock", "\x85", "z_z", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " 12 ", *[" ".join(rng.choices(words[: rng.randint(3, 31)], k=rng.randint(0, 60)))] * 12])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, "", "a", "a", "a", "b", "c", "é", "Z"])))
    return [*rows, (n, "seldom", "xx", "one"), (n + 1, None, "xx", "two"), (n + 2, "alone " * 50_000, "yy", "q"), (0, "the the", "en", "a"), (0, "the the", "en", "a")]


def result(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 3), (1, 1)])
def test_against_brute_force(frame, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "SOURCES", blocks[0])
    monkeypatch.setattr(divergence, "TERMS", blocks[1])
    rows = corpus(random.Random(blocks[0]), 300)
    assert result(frame(rows, SCHEMA, 4)) == brute(rows)


def test_other_limits_and_a_full_memory(frame, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rows = corpus(random.Random(5), 120)
    assert result(frame(rows, SCHEMA, 4), least=2, top=3) == brute(rows, 2, 3)


def test_rare_tables(frame):
    df = frame([(1, "a b", "en", "s", "t", 1, 2)], SCHEMA + ", term string, n int, block int")
    assert result(df) == [] and result(df.where("doc_id > 1")) == []
    two = frame([(1, "a b", None, "s", "x"), (2, "c", None, None, "y")], SCHEMA + ", words string")
    assert result(two) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_of_large_groups_are_exact():
    n, words = np.array([[10**15, 7]]), np.array([[9 * 10**15]])
    got = divergence.shares(n, words, 1000)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 2) // (9 * 10**15 + 2000) for c in n[0]]]
