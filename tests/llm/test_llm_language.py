"""The language classifier against a direct kernel ridge regression, and with many labels."""

import numpy as np

from patronage.llm import language


def texts(rng, alphabet, n, size=60):
    return ["".join(rng.choice(list(alphabet), size)) for _ in range(n)]


def direct(rows, own, n):
    """Margins of a kernel ridge regression in its dual form, every language weighing the same, with a free offset."""
    z = rows / np.sqrt(rows.sum(1, keepdims=True))
    w = 1.0 / np.bincount(own)[own]
    y = np.where(own[:, None] == np.arange(n), 1.0, -1.0)
    mean, centre = (w @ z) / w.sum(), (w @ y) / w.sum()
    root = np.sqrt(w)[:, None]
    s = root * (z - mean)
    alpha = np.linalg.solve(s @ s.T + language.RIDGE / n * np.eye(len(z)), root * (y - centre))
    weights = s.T @ alpha
    return lambda x: (x / np.sqrt(x.sum(1, keepdims=True)) - mean) @ weights + centre


def test_margins_are_those_of_kernel_ridge_regression():
    rng = np.random.default_rng(0)
    groups = {"aa": texts(rng, "abcdefgh ", 30), "bb": texts(rng, "efghijkl ", 12), "cc": texts(rng, "ijklmnop ", 45)}  # all rows are landmarks
    packed = {k: language._rows(v) for k, v in groups.items()}
    model = language.fit(packed)
    own = np.repeat(np.arange(3), [len(v) for v in groups.values()])
    margins = direct(np.concatenate(list(packed.values())).astype(float), own, 3)
    new = language._rows(texts(rng, "abcdefghijklmnop ", 50)).astype(float)
    got = (new @ model.weights.astype(float)) / np.sqrt(new.sum(1, keepdims=True)) + model.offset
    assert np.abs(got - margins(new)).max() < 1e-4


def test_every_label_is_learned(frame, monkeypatch):
    monkeypatch.setattr(language, "FIT_TOTAL", 400)
    monkeypatch.setattr(language, "LANDMARK_TOTAL", 160)
    monkeypatch.setattr(language, "GROUP", 40)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        alphabet = "".join(chr(0x4E00 + 8 * k + i) for i in range(8))
        rows += [(len(rows) + i, t, f"l{k:03d}") for i, t in enumerate(texts(rng, alphabet, 14))]
    df = frame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert len(model.languages) == 120
    out = language.predict(df, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_ties_go_to_the_first_name():
    model = language.Model(["a", "b"], np.zeros((1 << language.BITS, 2), np.float32), np.zeros(2))
    assert model.predict(["some text"])[0] == ["a"]
