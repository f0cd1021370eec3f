"""Long repeated strings, found with run-length indexes of what could repeat.

Every string of ``length`` bytes has a route: the smallest hash of the
``GRAM``-byte strings in it. Consecutive starts with one route form a segment,
so equal strings, wherever they stand, lie in segments of one route. Routes
met once hold nothing repeated (a hash found twice in one segment counts as
two). The distinct segments of the others, each with
its number of occurrences, are dealt into buckets by route.

A bucket is joined to one text and indexed: its Burrows-Wheeler transform is
cut into runs, and the longest common extension with the suffix before (after)
is measured only at run starts (run ends) and at segment starts. A stream over
the text gives every other place its matching statistic: it is one less than
at the place before. A string repeats if the statistic reaches ``length`` or
its segment occurs more than once. Spans then go back to all occurrences.

A route whose distinct segments exceed a bucket, such as a passage in a large
share of all texts, each time with other neighbours, is dealt string by string
instead, counted before the shuffle. Joins ask for a merge, so the job has one
plan at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import set_aside, total
from patronage.session import materialize

LENGTH, GRAM = 200, 32
#: Starts of one segment at most; bytes of a bucket, and of a route that is dealt by segments.
SEGMENT_STARTS, BUCKET_BYTES, ROUTE_BYTES = 1024, 250_000, 1_000_000
#: Starts hashed at a time, so that the longest text needs no more memory than its bytes.
CHUNK = 1 << 20
#: Ends a segment in the joined text; no byte of UTF-8.
END = 255

_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram``-byte string; ``gram`` is a power of two."""
    h, span = _BYTE[b], 1
    while span < gram:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :])


def _met_twice(h: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """Routes whose hash stands at two places of one segment, as in periodic text."""
    reach = np.concatenate([np.zeros(width - 1, np.uint64), m, np.zeros(width - 1, np.uint64)])
    lowest = h[h == ~_window_min(~reach, width)]  # those that are the smallest of some window
    return lowest[1:][lowest[1:] == lowest[:-1]]


def segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First starts, numbers of starts and routes of the segments of a text, and routes that may repeat within a segment."""
    first, count, route, again = [], [], [], []
    b = np.frombuffer(data, np.uint8)
    gram = min(GRAM, length)
    width = length - gram + 1
    for at in range(0, max(0, len(b) - length + 1), CHUNK):
        h = _gram_hashes(b[at : at + CHUNK + length - 1], gram)
        m = _window_min(h, width)
        again.append(_met_twice(h, m, width).view(np.int64))
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        cut = np.unique(np.concatenate([[0], cut, _split_long(np.concatenate([[0], cut, [len(m)]]))]))
        first.append(cut + at)
        count.append(np.diff(np.append(cut, len(m))))
        route.append(m[cut].view(np.int64))
    return tuple(np.concatenate(x or [np.empty(0, np.int64)]) for x in (first, count, route, again))


def _split_long(edges: np.ndarray) -> np.ndarray:
    long = np.flatnonzero(np.diff(edges) > SEGMENT_STARTS)
    return np.concatenate([np.arange(edges[i], edges[i + 1], SEGMENT_STARTS) for i in long]) if len(long) else np.empty(0, np.int64)


# --- the index of one bucket -------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, in byte order."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _suffix_order(words: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that still share their rank are sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    span = 8
    while True:
        alone = first & np.append(first[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        open_ = order[at]
        later = open_ + span
        key = rank[open_] * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        key, open_ = key[turn], open_[turn]
        order[at] = open_
        first[at[1:]] = key[1:] != key[:-1]
        first[at[0]] = True
        rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
        span *= 2


def _extension(words: np.ndarray, p: np.ndarray, q: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length of the common start of the suffixes at ``p`` and ``q``, at most ``left``."""
    n, out = len(words), np.zeros(len(p), np.int64)
    active, k = np.arange(len(p)), 0
    while len(active):
        a, b = p[active] + k, q[active] + k
        inside = np.maximum(a, b) < n
        diff = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(1 << 63))
        same = diff == 0
        bits = np.zeros(len(diff), np.int64)  # equal leading bytes of the word
        for j in range(1, 8):
            bits += (diff >> np.uint64(64 - 8 * j)) == 0
        out[active] = k + np.where(same, 8, bits)
        active = active[same & (k + 8 < left[active])]
        k += 8
    return np.minimum(out, left)


def matching_statistics(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined parts the longest string there that also starts elsewhere in them, within its part.

    Returned with the places where the parts begin.
    """
    text = np.frombuffer(b"".join(part + bytes([END]) for part in parts), np.uint8)
    sizes = np.array([len(part) + 1 for part in parts])
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes - 1, sizes) - np.arange(len(text))
    words = _words(text)
    order = _suffix_order(words)
    before = text[order - 1]  # the transform; before the first place stands the last
    change = before[1:] != before[:-1]
    starts, ends = np.concatenate([[True], change]), np.concatenate([change, [True]])
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    best = np.zeros(len(text), np.int64)
    for step, sampled in ((-1, starts), (1, ends)):
        sampled = sampled.copy()
        sampled[place[begin]] = True
        rows = np.flatnonzero(sampled)
        beside = rows + step
        known = (beside >= 0) & (beside < len(text))
        p = order[rows]
        value = np.zeros(len(rows), np.int64)
        value[known] = _extension(words, p[known], order[beside[known]], left[p[known]])
        at_place = np.full(len(text), -1, np.int64)
        at_place[p] = value
        last = np.maximum.accumulate(np.where(at_place >= 0, np.arange(len(text)), 0))
        best = np.maximum(best, at_place[last] - (np.arange(len(text)) - last))
    return best, begin


def _index(length: int):
    def index(rows: pa.Table) -> pa.Table:
        parts = rows["bytes"].to_pylist()
        weight = rows["n"].to_numpy()
        best, begin = matching_statistics(parts)
        sizes = np.array([len(x) for x in parts])
        own = np.repeat(np.arange(len(parts)), sizes + 1)
        inside = np.arange(len(best)) - begin[own]
        repeated = (inside + length <= sizes[own]) & ((best >= length) | (weight[own] > 1))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2] - 1
        spans = np.stack([inside[lo], inside[hi] + length], 1).ravel() if len(lo) else np.empty(0, np.int64)
        offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(own[lo], minlength=len(parts)))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spans, pa.int32()))
        return pa.table({"route": rows["route"], "digest": rows["digest"], "spans": lists}).filter(pa.array(np.diff(offsets) > 0))

    return index


# --- the job -----------------------------------------------------------------------------------------------------


def _named(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """What stands for a text in the job: its number (its hash, where that is null or no number) and its checksum."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    numeric = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.coalesce(F.col(key).cast("long"), F.xxhash64(whole)) if numeric else F.xxhash64(F.col(key).cast("string"), whole)
    return {"_rep_d": number, "_rep_c": F.crc32(whole.cast("binary")), "_rep_t": whole}


def _scan(length: int, full: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(t.as_buffer().to_pybytes() if t.is_valid else b"", length) for t in batch.column(2)]
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for f in found for x in f[2:]]))], names=["route"])
                continue
            route = pa.array(np.concatenate([f[2] for f in found]))
            own = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            digests = []
            for t, (first, count, *_) in zip(batch.column(2), found, strict=True):
                view = memoryview(t.as_buffer())
                digests += [xxhash.xxh3_64_intdigest(view[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
            columns = [
                batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), route, pa.array(np.array(digests, np.uint64).view(np.int64)),
                pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "c", "route", "digest", "at", "starts"])

    return scan


def _cut_out(length: int):
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"route": [], "digest": [], "n": [], "hot": [], "bytes": []}
            for t, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = t.as_buffer().to_pybytes()
                for x in wanted.as_py():
                    for name in ("route", "digest", "n", "hot"):
                        out[name].append(x[name])
                    out["bytes"].append(data[x["at"] : x["at"] + x["starts"] + length - 1])
            types = {"route": pa.int64(), "digest": pa.int64(), "n": pa.int64(), "hot": pa.bool_(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], names=list(out))

    return cut_out


def _strings(length: int):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for route, digest, n, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                view = memoryview(data)
                each = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(data) - length + 1)]
                k = len(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([route] * k), pa.array([digest] * k), pa.array([n] * k), pa.array(range(k), pa.int32()), pa.array(each, pa.binary())],
                    names=["route", "digest", "n", "at", "string"],
                )

    return strings


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans``: byte places of all strings that stand elsewhere too, as start, end, start, end, ...

    Spans come unmerged and in no order; null where there are none. See ``remove_repeats``.
    """
    named = docs.withColumns(_named(docs, key, text))
    slim = named.select("_rep_d", "_rep_c", "_rep_t").where(F.octet_length("_rep_t") >= length)
    routes = slim.mapInArrow(_scan(length, False), "route long").groupBy("route").agg(F.count("*").alias("c"))
    routes = materialize(routes.where("c > 1").select("route"), "routes")
    found = slim.mapInArrow(_scan(length, True), "d long, c long, route long, digest long, at long, starts int")
    found = materialize(found.join(routes.hint("merge"), "route"), "segments")

    # Of equal segments one is read and indexed.
    reps = found.groupBy("route", "digest").agg(F.count("*").alias("n"), F.min(F.struct("d", "c", "at", "starts")).alias("x"))
    reps = materialize(reps.select("route", "digest", "n", "x.*"), "segments")
    size = F.col("starts") + (length - 1)
    hot = reps.groupBy("route").agg(F.sum(size).alias("b")).where(F.col("b") > ROUTE_BYTES).select("route", F.lit(True).alias("hot"))
    wanted = reps.join(hot.hint("merge"), "route", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = wanted.groupBy("d", "c").agg(F.collect_list(F.struct("route", "digest", "n", "hot", "at", "starts")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"d": "_rep_dx", "c": "_rep_cx"})
    same = (F.col("_rep_d") == F.col("_rep_dx")) & (F.col("_rep_c") == F.col("_rep_cx"))
    cut = slim.join(wanted.hint("merge"), same).select("_rep_t", "wanted").mapInArrow(
        _cut_out(length), "route long, digest long, n long, hot boolean, bytes binary"
    )
    cut = materialize(cut, "segment-bytes")

    volume = total(reps, b=F.sum(size))["b"] or 0
    buckets = max(1, -(-volume // BUCKET_BYTES))
    indexed = cut.where("not hot").dropDuplicates(["route", "digest"]).withColumn("bucket", F.pmod(F.xxhash64("route"), F.lit(buckets)))
    spans = indexed.groupBy("bucket").applyInArrow(_index(length), "route long, digest long, spans array<int>")
    strings = cut.where("hot").dropDuplicates(["route", "digest"]).select("route", "digest", "n", "bytes").mapInArrow(
        _strings(length), "route long, digest long, n long, at int, string binary"
    )
    often = strings.groupBy("string").agg(F.sum("n").alias("total")).where("total > 1").select("string")
    single = strings.join(often.hint("merge"), "string").groupBy("route", "digest").agg(
        F.flatten(F.collect_list(F.array("at", F.col("at") + length))).alias("spans")
    )
    spans = materialize(spans.union(single), "spans")
    at = F.col("at").cast("int")
    marks = found.join(spans.hint("merge"), ["route", "digest"]).select("d", "c", F.transform("spans", lambda x: x + at).alias("s"))
    marks = marks.groupBy(F.col("d").alias("_rep_dx"), F.col("c").alias("_rep_cx")).agg(F.flatten(F.collect_set("s")).alias("spans"))
    return named.drop("spans").join(marks.hint("merge"), same, "left").drop("_rep_d", "_rep_c", "_rep_t", "_rep_dx", "_rep_cx")


def merged(spans: list[int] | None) -> np.ndarray:
    """Spans as a sorted array of disjoint [start, end) rows; those that touch become one."""
    x = np.array(spans or [], np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    if not len(x):
        return x
    reach = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)
    return np.stack([x[new, 0], reach[last]], 1)


def remaining(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans narrowed to the characters of which every byte is in them."""
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) and ``kept_text``; columns of these names are replaced.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere,
    in this row or another; all occurrences go, judged on the input.
    ``kept_text`` is the same cut at whole characters: one goes if all its
    bytes do. Null texts count as empty, texts shorter than ``length`` stay
    as they are, repeated rows repeat each other, keys may be null. One row
    out for each row in; columns of other names pass through.
    """
    inner, restore = set_aside(docs, [key, text], ["n_bytes", "n_removed", "n_spans", "kept", "kept_text"])
    marked = repeated_spans(inner, key, text, length)

    @F.arrow_udf("struct<n_bytes long, n_removed long, n_spans long, kept binary, kept_text string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            data, x = (t.as_buffer().to_pybytes() if t.is_valid else b""), merged(s.as_py())
            rows.append({
                "n_bytes": len(data), "n_removed": int((x[:, 1] - x[:, 0]).sum()), "n_spans": len(x), "kept": remaining(data, x),
                "kept_text": remaining(data, whole_characters(data, x)).decode(),
            })
        return pa.array(rows, pa.struct([
            ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string()),
        ]))

    out = marked.withColumn("_cut", cut.asNondeterministic()(F.col(text).cast("string"), F.col("spans")))
    return restore(out.select("*", "_cut.*"))
