"""N-gram Jaccard join: MinHash bands choose whom to compare, whole n-gram sets decide.

Texts become sets of hashed word n-grams. Texts with one set form a class and
are compared once. Band hashes of the MinHash signature are shuffled; texts
that meet in a bucket become candidates, and each candidate gets a home: the
smallest class met in any of its buckets. Homes are cut into blocks of bounded
size, and two blocks that share a bucket meet in one task, with whole sets,
once. There the overlap of all pairs is counted by a sparse product over
shared n-grams; only link counts and a spanning forest leave the task, never
the pairs. Components then come from the forests.

Joins ask for a merge, so the job has one plan at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patronage.llm.common import components, set_aside
from patronage.session import materialize

NGRAM, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Bounds of a block: texts, and n-grams of all its texts (one longer text is a block of its own).
BLOCK_TEXTS, BLOCK_GRAMS = 512, 2_000_000


def choose_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows with the most rows whose recall at ``similarity`` is reached within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes.

    Words are runs without ASCII white space. A text of fewer than ``n`` words
    has one n-gram, all its words; a null or blank text has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(n, len(words))
    grams = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        grams = _mixed(grams) + h[k : len(words) - span + 1 + k]
    return np.unique(_mixed(grams))


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _band_hashes(grams: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(low, (grams[at : at + 1024, None] * factors).min(0), out=low)
    key = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        key = _mixed(key) + column
    return _mixed(key).view(np.int64)


def _factors(count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc``, hash of the text, digest of the n-gram set, its size and its band hashes; blank texts have nulls."""
    doc_type = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(bands * rows)
        for batch in batches:
            digests, sizes, hashes = [], [], []
            for t in batch.column(1):
                grams = gram_set(t.as_py(), n)
                digests.append(_digest(grams) if len(grams) else None)
                sizes.append(len(grams))
                hashes.append(_band_hashes(grams, factors, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc", "check", "digest", "grams", "bands"],
            )

    return _texts(docs, key, text).mapInArrow(sign, f"doc {doc_type}, check long, digest binary, grams long, bands array<long>")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, its text ``t``, and ``check``, a hash of the text that tells rows of one number apart."""
    return docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t")).withColumn("check", F.xxhash64("t"))


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the number of members it shares with every set: a row of the sparse product."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(df)])
    postings = owner[np.argsort(ids, kind="stable")]
    for i, end in enumerate(np.cumsum(sizes)):
        mine = ids[end - sizes[i] : end]
        mine = mine[df[mine] > 1]
        n = df[mine]
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[mine], n)
        shared = np.bincount(postings[into], minlength=len(sets))
        shared[i] = sizes[i]
        yield i, shared


def _verify(similarity: float):
    def verify(pair: tuple, rows: pa.Table) -> pa.Table:
        one_block = pair[0].as_py() == pair[1].as_py()
        found: dict[bytes, tuple[int, int, np.ndarray]] = {}
        for r in rows.select(["block", "digest", "copies", "set"]).to_pylist():
            found[r["digest"]] = (r["block"], r["copies"], np.frombuffer(r["set"], np.uint64))
        digests = sorted(found)
        side, copies = np.array([found[d][0] for d in digests]), np.array([found[d][1] for d in digests])
        sets = [found[d][2] for d in digests]
        sizes, label, links = np.array([len(s) for s in sets]), np.arange(len(sets)), np.zeros(len(sets), np.int64)
        for i, shared in overlaps(sets):
            # The same expression on whole numbers for both orders of a pair.
            linked = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
            linked[i] = False
            if not one_block:
                linked &= side != side[i]
            if linked.any():
                links[i] = copies[linked].sum()
                met = np.unique(label[linked])
                if len(met) > 1 or met[0] != label[i]:
                    met = np.append(met, label[i])
                    label[np.isin(label, met)] = met.min()
        out = np.flatnonzero(links)
        return pa.table({
            "digest": pa.array([digests[i] for i in out], pa.binary()), "links": pa.array(links[out], pa.int64()),
            "root": pa.array([digests[label[i]] for i in out], pa.binary()),
        })

    return verify


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``digest`` and ``set`` of each wanted class, read from the text of its first document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for digest, t in zip(batch.column(0), batch.column(1), strict=True):
                grams = gram_set(t.as_py(), n)
                if len(grams) and _digest(grams) == digest.as_py():  # another text under the same number and hash is not the one
                    kept.append((digest.as_py(), grams.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], pa.binary())], names=["digest", "set"]
            )

    texts = _texts(docs, key, text)
    return wanted.select("doc", "check", "digest").join(texts.hint("merge"), ["doc", "check"]).select("digest", "t").mapInArrow(read, "digest binary, set binary")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id``, ``n_links``, ``copy_of``.

    Two documents are linked if the Jaccard similarity of their n-gram sets is
    ``similarity`` or more. ``copy_of`` is the smallest key with the same set,
    ``class_id`` the smallest key that links lead to, ``n_links`` the number
    of other rows linked directly. Repeated rows are documents that are copies
    of each other. Blank and null texts link with nothing; rows with a null
    key are not compared and have a null class. Other columns do not matter;
    an empty table gives an empty one.
    """
    bands, rows = choose_bands(similarity, recall)
    sigs = materialize(signatures(docs, key, text, n, bands, rows), "signatures")
    known = sigs.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    classes = materialize(
        known.groupBy("digest").agg(
            F.min(F.struct("doc", "check")).alias("x"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
        ).select("digest", "x.*", "copies", "grams", "bands"), "classes",
    )
    met = classes.select("digest", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("c"), F.min("digest").alias("hub")).where("c > 1")
    members = materialize(met.join(shared.hint("merge"), "bucket").select("bucket", "digest", "hub"), "buckets")

    homes = members.groupBy("digest").agg(F.min("hub").alias("home")).join(classes.select("digest", "doc", "check", "copies", "grams").hint("merge"), "digest")
    homes = materialize(homes, "homes")
    blocks = homes.groupBy("home").agg(F.count("*").alias("c"), F.sum("grams").alias("g")).select(
        "home", F.ceil(F.greatest(F.col("c") / BLOCK_TEXTS, F.col("g") / BLOCK_GRAMS)).alias("parts")
    )
    homes = materialize(
        homes.join(blocks.hint("merge"), "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("digest"), F.col("parts")))).drop("home"), "blocks"
    )
    # Blocks meet if a bucket has members of both; each pair of blocks once, each block once with itself.
    meet = members.join(homes.select("digest", "block").hint("merge"), "digest").select("bucket", "block").distinct()
    meet = meet.groupBy("bucket").agg(F.sort_array(F.collect_set("block")).alias("s")).where(F.size("s") > 1).select("s").distinct()
    apart = meet.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a < b").distinct()
    own = homes.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    pairs = materialize(apart.union(own), "pairs")
    places = pairs.select(F.col("a").alias("block"), "a", "b").union(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b"))

    sets = _sets(docs, homes, key, text, n).join(homes.select("digest", "block", "copies").hint("merge"), "digest")
    found = sets.join(places.hint("merge"), "block").select("a", "b", "block", "digest", "copies", "set").groupBy("a", "b").applyInArrow(
        _verify(similarity), "digest binary, links long, root binary"
    )
    found = materialize(found, "links")
    reached = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    linked = links.join(reached, links["digest"] == reached["node"]).drop("node").join(classes.select("digest", "doc"), "digest")
    first = linked.groupBy("component_id").agg(F.min("doc").alias("class_id"))
    linked = linked.join(first, "component_id").select("digest", "links", "class_id")
    each = classes.select("digest", F.col("doc").alias("copy_of"), "copies").join(linked.hint("merge"), "digest", "left")
    return sigs.select("doc", F.when(F.col("doc").isNotNull(), F.col("digest")).alias("digest")).join(each.hint("merge"), "digest", "left").select(
        F.col("doc").alias(key), F.coalesce("class_id", "copy_of", "doc").alias("class_id"),
        F.when(F.col("doc").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("copy_of", "doc").alias("copy_of"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that links hold together the one with the smallest number.

    A row is known by its number and text, so rows that share a number alone
    are documents of their own; rows without a number come last. Of repeated
    rows one stays; blank rows without a number all stay. Columns of any name
    pass through.
    """
    inner, restore = set_aside(docs, [key, text], [])
    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # sorts as the numbers do
    nameless = F.col(key).isNull() & ~whole.rlike(r"[^\x09-\x0D ]")
    known = inner.where(~nameless).withColumn("_row", F.concat(F.coalesce(number, F.lit("Z")), F.md5(whole)))
    first = near_copies(known, "_row", text, **how).where("_row = class_id").select("_row").distinct()
    kept = known.join(first.hint("merge"), "_row", "left_semi").drop("_row")
    columns = [F.col(f"`{c}`") for c in inner.columns]
    row = F.concat(F.coalesce(number, F.lit("Z")), F.md5(whole))
    rows = kept.groupBy(row.alias("_row")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return restore(rows.select("row.*").unionByName(inner.where(nameless)))
