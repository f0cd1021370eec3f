"""How far the word use of sources diverges, language by language.

Documents become counts per language, source and term in their tasks, so that a
term crosses the network once a task and not once a use. Every pair of a
language's sources is compared over all its kept terms by a partition of a cube:
sources fall into blocks of about ``SOURCES``, terms into blocks of about
``TERMS``, and a task owns one (source block, source block, term block) cell.
The counts of a source block are replicated to the cells that need them, that
is once per source block of the language, a cell adds up what its terms
contribute to all its pairs, and the cells' sums are added along the term axis.
A cell's size is bound by the two block sizes, whatever a source or a term holds.

All numbers are whole: shares in thousand-millionths, and the divergence of two
shares as the floor of their squared difference over their sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.session import materialize

#: A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 10
UNIT = 1_000_000_000
#: Sources and terms that a block holds, about.
SOURCES, TERMS = 64, 4096
#: Terms of documents that a task gathers before it adds them up, and rows of such sums that it holds before it hands them on.
GATHERED, HELD = 200_000, 500_000
#: Most groups of language and source that are broadcast (some hundred bytes each), and most terms given for one.
BROADCAST_ROWS, TOP = 20_000, 10

#: Bytes of terms: A-Z lower-cased, a-z and all of non-ASCII characters; others part them.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


PACKED = "lang string, term string, n long, docs long, sources array<struct<source: string, n: long, docs: long>>"


class _Counts:
    """Uses of terms by group of language and source, and documents that hold them, as far as a task has read."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.tables: list[pa.Table] = []
        self._clear()

    def _clear(self) -> None:
        self.terms: list[bytes] = []
        self.uses: list[int] = []
        self.owners: list[tuple[int, int]] = []

    def add(self, group: tuple[str, str], text: bytes) -> None:
        here = Counter(text.translate(LETTERS).split())
        self.terms.extend(here)
        self.uses.extend(here.values())
        self.owners.append((self.groups.setdefault(group, len(self.groups)), len(here)))
        if len(self.terms) >= GATHERED:
            self.settle()

    def settle(self) -> None:
        """What has been read since the last time becomes a table, a row per group and term."""
        if self.owners:
            owner, times = np.array(self.owners).T
            read = pa.table({"group": np.repeat(owner, times), "term": pa.array(self.terms, pa.binary()), "n": pa.array(self.uses, pa.int64())})
            self.tables.append(_summed(read, [("n", "sum"), ("n", "count")]))
            self._clear()
        if len(self.tables) > 1:
            self.tables = [_summed(pa.concat_tables(self.tables), [("n", "sum"), ("docs", "sum")])]

    def full(self) -> bool:
        return bool(self.tables) and self.tables[0].num_rows >= HELD

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        """A row per language and term, with its sources in a list, so that a rare term crosses the network and is sorted once."""
        self.settle()
        if not self.tables:
            return
        table, names = self.tables.pop(), list(self.groups)
        languages = sorted({g for g, _ in names})
        language_of = np.array([languages.index(g) for g, _ in names])
        group, terms = table.column("group").to_numpy(), table.column("term").combine_chunks().dictionary_encode()
        term = terms.indices.to_numpy()
        key = language_of[group] * len(terms.dictionary) + term
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        n, docs = table.column("n").to_numpy()[order], table.column("docs").to_numpy()[order]
        sources = pa.array([s for _, s in names], pa.string()).take(pa.array(group[order]))
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(starts, len(order)), pa.int32()), pa.StructArray.from_arrays([sources, pa.array(n), pa.array(docs)], ["source", "n", "docs"])
        )
        first = order[starts]
        packed = pa.table({
            "lang": pa.array(languages, pa.string()).take(pa.array(language_of[group[first]])), "term": terms.dictionary.cast(pa.string()).take(pa.array(term[first])),
            "n": np.add.reduceat(n, starts), "docs": np.add.reduceat(docs, starts), "sources": lists,
        })
        yield from packed.to_batches(max_chunksize=1 << 16)


def _summed(table: pa.Table, sums: list[tuple[str, str]]) -> pa.Table:
    out = table.group_by(["group", "term"], use_threads=False).aggregate(sums)
    return out.rename_columns({"_".join(sums[0]): "n", "_".join(sums[1]): "docs"}).select(["group", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``n`` uses, ``docs`` that hold it, and both by source in a list; a row per task, more from one that fills its memory."""

    def count(batches):
        counts = _Counts()
        for rows in batches:
            langs, sources = (rows.column(i).to_pylist() for i in range(2))
            for g, s, text in zip(langs, sources, rows.column(2), strict=True):
                counts.add((g, s), text.as_py() or b"")
                if counts.full():
                    yield from counts.hand_on()
        yield from counts.hand_on()

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(count, PACKED)


def joined(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with what is known of their language and source.

    The groups are broadcast if their counted rows are few; more are joined by
    a shuffle, where a group has at most as many rows as terms.
    """
    small = groups.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(groups) if small else groups.hint("merge"), ["lang", "source"])


def share(n: Column, words: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (n + 2) / (words + 2 * kept))``, exact."""
    return 1 + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), words + 2 * kept)


def shares(n: np.ndarray, words: np.ndarray, kept: int) -> np.ndarray:
    """The same of arrays: a long division, three digits at a time, exact for groups of up to 9 * 10**15 words."""
    by = words + 2 * kept
    out, rest = np.divmod(n + 2, by)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PAIR_ROW = "lang string, a string, b string, value long, terms long, unused long, kept long"


def compare_cell(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
    """What the terms of one cell add to each pair of its two source blocks.

    Rows without a term name the sources. Terms that a cell has not seen are
    unused in all its sources; ``unused`` is what each of them adds to a pair.
    """
    lang, x, y = (k.as_py() for k in key[:3])
    head, used = cell.filter(pc.field("term").is_null()), cell.filter(pc.field("term").is_valid())
    sources, blocks = head.column("source").to_pylist(), head.column("block").to_numpy()
    words, kept = head.column("words").to_numpy(), head.column("kept")[0].as_py()
    place = {s: i for i, s in enumerate(sources)}
    terms = used.column("term").combine_chunks().dictionary_encode()
    n = np.zeros((len(sources), len(terms.dictionary)), np.int64)
    rows = np.fromiter((place[s] for s in used.column("source").to_pylist()), np.int64, used.num_rows)
    n[rows, terms.indices.to_numpy()] = used.column("n").to_numpy()
    by = words[:, None]
    p = shares(n, by, kept) if kept else n
    plain = shares(np.zeros_like(by), by, kept) if kept else np.zeros_like(by)
    left, right = np.flatnonzero(blocks == x), np.flatnonzero(blocks == y)
    out = {c: [] for c in ("a", "b", "value", "unused")}
    for i in left:
        others = right[right > i] if x == y else right
        if not len(others) or not kept:
            values = unused = np.zeros(len(others), np.int64)
        else:
            values, unused = apart(p[i], p[others]).sum(1), apart(plain[i], plain[others])[:, 0]
        out["a"] += [sources[i]] * len(others)
        out["b"] += [sources[j] for j in others]
        out["value"] += values.tolist()
        out["unused"] += unused.tolist()
    size = len(out["a"])
    return pa.table(
        [pa.array(c, t) for c, t in (
            ([lang] * size, pa.string()), (out["a"], pa.string()), (out["b"], pa.string()), (out["value"], pa.int64()),
            ([n.shape[1]] * size, pa.int64()), (out["unused"], pa.int64()), ([kept] * size, pa.int64()),
        )], names=["lang", "a", "b", "value", "terms", "unused", "kept"],
    )


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far each source of a language stands from its others.

    Terms are runs of letters (all non-ASCII characters count as letters), with
    A-Z lower-cased; a language keeps those in at least ``least`` of its
    documents. Part ``pair`` ranks every other source of the language by the sum
    of the divergences of all kept terms; part ``term`` gives the ``top`` kept
    terms that a source uses more than its language does, by their divergence.
    Ranks begin at 1, fall by value and break ties by the item's bytes.

    Null texts, languages and sources count as empty ones, which are a language
    and a source like others; each row is a document, so repeated rows count
    again. A source without terms is compared by its counts of zero; a language
    without kept terms has pairs of value 0 and no terms; a source alone in its
    language has no pair. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    docs = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.col(text).alias("text")
    )
    # One exchange by language and term serves the choice of terms, the sums by source and the mark of each term's first source.
    of_term = Window.partitionBy("lang", "term")
    chosen = term_counts(docs).repartition("lang", "term").select(
        "lang", "term", "sources", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs")
    ).where(F.col("lang_docs") >= least)
    counted = chosen.select("lang", "term", "lang_n", F.inline("sources")).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.max("lang_n").alias("lang_n")
    )
    first = (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("one")
    kept = materialize(counted.select("lang", "source", "term", "n", "lang_n", first), "kept-terms")
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum("one").alias("one"))
    groups = docs.select("lang", "source").distinct().join(words.hint("merge"), ["lang", "source"], "left").na.fill(0)
    of_lang = groups.groupBy("lang").agg(
        F.sum("words").alias("lang_words"), F.sum("one").alias("kept"),
        F.ceil(F.count("*") / SOURCES).cast("int").alias("source_blocks"), F.greatest(F.lit(1), F.ceil(F.sum("one") / TERMS)).cast("int").alias("term_blocks"),
    )
    groups = materialize(
        groups.drop("one").join(of_lang.hint("merge"), "lang")
        .withColumn("block", F.pmod(F.xxhash64("source"), "source_blocks").cast("int")), "sources",
    )
    return pairs(kept, groups).unionByName(own_terms(kept, groups, top))


def ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of a language's sources, both ways, over the cells of the cube."""
    used = joined(kept.select("lang", "source", "term", "n"), groups).withColumn("t", F.pmod(F.xxhash64("term"), "term_blocks").cast("int"))
    named = groups.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).withColumns(
        {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}
    )
    columns = ["lang", "source", "block", "term", "n", "words", "kept", "source_blocks", "t"]
    slices = used.select(*columns).unionByName(named.select(*columns))
    slices = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)))
    cells = slices.select(
        "lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "t", "source", "block", "term", "n", "words", "kept"
    )
    sums = cells.groupBy("lang", "x", "y", "t").applyInArrow(compare_cell, PAIR_ROW)
    total = sums.groupBy("lang", "a", "b").agg(
        (F.sum("value") + (F.max("kept") - F.sum("terms")) * F.max("unused")).alias("value")
    )
    both = total.select("lang", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )), "value")
    return ranked(both, "pair")


def own_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that each source uses more than its language does."""
    p, q = share(F.col("n"), F.col("words"), F.col("kept")), share(F.col("lang_n"), F.col("lang_words"), F.col("kept"))
    rows = joined(kept, groups).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    return ranked(rows.withColumn("value", value), "term").where(F.col("rank") <= top)


def audit_sql() -> str:
    """SQL for the rows of ``audit`` with its usual parameters over the table ``documents``."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
uses AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM uses GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}),
of_lang AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_words FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM uses JOIN kept USING (lang, term) GROUP BY lang, source, term),
words AS (SELECT lang, source, sum(n) AS words FROM counts GROUP BY lang, source),
sources AS (SELECT DISTINCT lang, source FROM docs),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
  1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(w.words, 0) + 2 * o.v) AS p, 1 + {UNIT}::HUGEINT * (k.lang_n + 2) // (o.lang_words + 2 * o.v) AS q
  FROM sources s JOIN kept k USING (lang) JOIN of_lang o USING (lang) LEFT JOIN words w ON s.lang = w.lang AND s.source = w.source
  LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= {TOP}"""
