"""Language by a string kernel: presence of blended n-grams, Nystrom landmarks, one-versus-rest ridge regression.

The kernel of two texts is the number of character n-grams (of one to
``ORDER`` characters) that both have, divided by the root of the product of
their numbers. Landmarks are labelled texts; the kernel against them, whitened
by the landmarks' own kernel, is the feature space in which one ridge
regression per language is solved. Scoring a batch is one matrix product:
presence rows times landmark columns times regression weights, the latter two
multiplied once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import set_aside
from patronage.session import materialize

#: n-grams of 1 to ORDER characters fall into 2^BITS columns by hash.
ORDER, BITS = 3, 13
#: Bound of the sample that is fitted, in expectation, and landmarks, both per language; ridge.
FIT_ROWS, LANDMARKS, RIDGE = 600, 64, 1e-2
#: With many languages each gives fewer: rows of all together (but so many of each), landmarks of a group of languages, and the size of a group.
FIT_TOTAL, LEAST_ROWS, LANDMARK_TOTAL, GROUP = 1 << 16, 8, 2048, 512
#: Most rows of a table that is broadcast (a label and a count each).
BROADCAST_ROWS = 20_000
#: Rows of one matrix product.
BATCH = 256

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(text: str, into: np.ndarray) -> None:
    """Mark the columns of the n-grams that the whole text has; letters are lower-cased, text runs in chunks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = points * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(points), 1 << 20):
        part = points[at : at + (1 << 20) + ORDER - 1]
        h = np.zeros(len(part) + 1, np.uint64)
        for n in range(1, min(ORDER, len(part)) + 1):
            h = (h[: len(part) - n + 1] ^ (h[: len(part) - n + 1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + part[n - 1 :]
            into[((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)] = 1


def _rows(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, t in zip(x, texts, strict=True):
        presence(t, row)
    return x


class Model:
    """Fitted weights: a column per language over the n-gram columns."""

    def __init__(self, languages: list[str], weights: np.ndarray, offset: np.ndarray):
        self.languages, self.weights, self.offset = languages, weights, offset

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score in 0..1 of each text; ``und`` and 0 where there is no letter or nothing was learned."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for at in range(0, len(use), BATCH):
            rows = use[at : at + BATCH]
            x = _rows([texts[i] for i in rows])
            margins = (x @ self.weights) / np.sqrt(x.sum(1, keepdims=True)) + self.offset
            best = margins.argmax(1)
            e = np.exp(4.0 * (margins - margins.max(1, keepdims=True)))
            share = e.max(1) / e.sum(1)
            for i, b, s in zip(rows, best, share, strict=True):
                names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def _scaled(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(texts_by_language: dict[str, np.ndarray]) -> Model:
    """Kernel ridge regression on presence rows (one array per language, rows in a fixed order).

    Languages are solved in groups of ``GROUP``, each over landmarks of its own
    and against the rows of all languages. The regression's moments are added
    up language by language, so memory is that of a group's landmarks and of one
    language's rows, however many languages there are.
    """
    languages = sorted(texts_by_language)
    groups = [range(at, min(at + GROUP, len(languages))) for at in range(0, len(languages), GROUP)]
    parts = [_fit_group(texts_by_language, languages, group) for group in groups]
    if not parts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    weights, offsets = zip(*parts, strict=True)
    return Model(languages, np.hstack(weights), np.concatenate(offsets))


def _fit_group(rows: dict[str, np.ndarray], languages: list[str], group: range) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a group of languages, each against all the rest."""
    n, each = len(languages), max(1, min(LANDMARKS, LANDMARK_TOTAL // len(group)))
    marks = _scaled(np.concatenate([rows[languages[i]][:each] for i in group]))
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > values.max() * 1e-9
    whiten = vectors[:, good] / np.sqrt(values[good])  # Nystrom: features whose products give back the kernel
    # Every language weighs the same: its rows count as one mean, its targets are 1 for itself and -1 for the others.
    means, square = np.zeros((n, whiten.shape[1])), np.zeros((whiten.shape[1],) * 2)
    for i, k in enumerate(languages):
        phi = (_scaled(rows[k]) @ marks.T) @ whiten
        means[i] = phi.mean(0)
        square += phi.T @ phi / len(phi)
    mean, centre = means.mean(0), 2.0 / n - 1.0
    spread = square - n * np.outer(mean, mean)
    met = (2 * means[group.start : group.stop] - means.sum(0) - n * centre * mean).T
    beta = np.linalg.solve(spread + RIDGE * np.eye(len(spread)) / n, met)
    return (marks.T @ (whiten @ beta)).astype(np.float32), centre - mean @ beta


def held_out(key: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows that are not held out.

    At most about ``fit_rows`` rows of a language and ``FIT_TOTAL`` of all are
    used (``LEAST_ROWS`` of each language in any case), chosen by hash of the
    key, so what the driver fits has a bound whatever the table holds; every
    label is learned. Texts without a letter teach nothing; a table without a
    labelled row gives a model that answers ``und``. Repeated rows count again;
    of equal scores the first language by name is given. A text of any length
    is read whole.
    """
    labelled = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    labelled = labelled.where(F.col("l").isNotNull() & ~held_out(F.col("k")) & F.coalesce(F.col("t"), F.lit("")).rlike(r"\p{L}"))
    counts = materialize(labelled.groupBy("l").agg(F.count("*").alias("c")), "labels")
    languages = counts.count()
    if not languages:
        return fit({})
    each = max(LEAST_ROWS, min(fit_rows, FIT_TOTAL // languages))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.col("t")).cast("binary")), 1, 13), 16, 10).cast("long")
    known = labelled.withColumn("p", place).join(F.broadcast(counts) if languages <= BROADCAST_ROWS else counts.hint("merge"), "l")
    chosen = F.col("p") < F.floor(F.lit(2.0**52) * F.least(F.lit(1.0), F.lit(float(each)) / F.col("c")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_rows([t.as_py()])[0].astype(bool)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["l", "p", "bits"])

    sample = known.where(chosen).select("l", "p", "t").mapInArrow(pack, "l string, p long, bits binary")
    by: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect()):
        by.setdefault(r["l"], []).append(bytes(r["bits"]))
    return fit({k: np.unpackbits(np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1), axis=1) for k, v in by.items()})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the text alone; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.offset))  # 2^BITS by languages

    @F.arrow_udf("struct<lang_pred string, score double>")
    def guess(texts: pa.Array) -> pa.Array:
        scorer, names, scores = Model(*shared.value), [], []
        for at in range(0, len(texts), BATCH):
            n, s = scorer.predict(texts.slice(at, BATCH).to_pylist())
            names += n
            scores += s.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    inner, restore = set_aside(docs, [text], ("lang_pred", "score"))
    out = inner.withColumn("_guess", guess.asNondeterministic()(F.col(text).cast("string")))
    return restore(out.select("*", "_guess.*"))
