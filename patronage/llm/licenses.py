"""Licence notices in texts, by a positional index over rare licence words.

The index lists, for the rarest words of each template's key phrase (by
document frequency over the corpus), the templates and places that have them.
A file looks up every one of these words that it has, every meeting of word
and posting proposes that a template lies at one offset, and equal proposals
are one. At each proposed place the template's words are compared, weighed by
rarity; a notice counts if enough of them are there and its key phrase is
there whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import let, set_aside, total

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, key phrase and text of the notices looked for; the key phrase is a part of the text.
TEMPLATES = (
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "the apache license version 2 0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal public domain dedication"),
    ("creative-commons", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("gpl-notice", "gnu general public license", "this work is licensed under the gnu general public license version"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
)
#: Phrases that count wherever their words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words of a key phrase that are indexed, and the weighed share of a template that must be there.
INDEXED, MATCH = 2, 0.6
#: Indexed words of a file that ``scan_sql`` looks up at most; ``scan`` looks up all, so they differ on files with more.
SQL_WORDS = 16

VOCABULARY = sorted({w for _, _, text in TEMPLATES for w in text.split()} | {w for p, _ in PHRASES for w in p.split()})


def license_words(text: Column) -> Column:
    """Words in lower case (A-Z only): runs of digits, letters and characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def rarity(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word over all rows; at most one number per word reaches the driver."""
    known = F.filter(license_words(F.col(text)), lambda w: w.isin(VOCABULARY))
    n = total(docs, n=F.count("*"))["n"]
    found = docs.select(F.explode(F.array_distinct(known)).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in found}
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1e-9 for w in VOCABULARY}


def _index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Templates and places of the indexed words."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, key, text) in enumerate(TEMPLATES):
        for w in sorted(set(key.split()), key=lambda w: (-idf[w], w))[:INDEXED]:
            out.setdefault(w, []).extend((t, at) for at, x in enumerate(text.split()) if x == w)
    return out


def _alignments(hits: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Distinct (template, offset) proposed by the indexed words of a file, however many it has."""
    entries = F.array(*[
        F.struct(F.lit(w).alias("w"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in places]).alias("places"))
        for w, places in sorted(index.items())
    ])
    indexed = F.filter(hits, lambda h: h["w"].isin(list(index)))
    propose = lambda found: let(F.array_distinct(F.transform(found, lambda h: h["w"])), lambda present: F.array_distinct(
        F.flatten(F.transform(F.filter(entries, lambda e: F.array_contains(present, e["w"])), lambda e: F.flatten(F.transform(
            F.filter(found, lambda h: h["w"] == e["w"]),
            lambda h: F.transform(e["places"], lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["at"]).alias("off"))),
        )))),
    ))
    return let(indexed, lambda found: F.when(F.size(found) > 0, propose(found)).otherwise(F.array().cast("array<struct<t:int,off:int>>")))


def _verified(words: Column, alignments: Column, idf: dict[str, float]) -> Column:
    """Label and score of each proposed place whose key phrase is whole and whose score is enough."""
    rows = []
    for label, key, text in TEMPLATES:
        ws = text.split()
        k = next(i for i in range(len(ws)) if ws[i : i + len(key.split())] == key.split())
        parts = [
            F.struct(F.lit(w).alias("w"), F.lit(idf[w] / sum(idf[x] for x in ws)).alias("share"), F.lit(k <= i < k + len(key.split())).alias("key"))
            for i, w in enumerate(ws)
        ]
        rows.append(F.struct(F.lit(label).alias("label"), F.array(*parts).alias("parts")))
    place = lambda off, i: F.when(off + i >= 0, F.get(words, off + i))

    def score(a: Column, templates: Column) -> Column:
        return let(F.get(templates, a["t"]), lambda t: let(
            F.transform(t["parts"], lambda p, i: F.struct(
                F.coalesce(place(a["off"], i) == p["w"], F.lit(False)).alias("met"), p["share"].alias("share"), p["key"].alias("key"))),
            lambda met: F.struct(
                t["label"].alias("label"),
                F.aggregate(met, F.lit(0.0), lambda s, m: s + F.when(m["met"], m["share"]).otherwise(0.0)).alias("score"),
                F.forall(met, lambda m: m["met"] | ~m["key"]).alias("whole"),
            ),
        ))

    scores = lambda ts: F.filter(F.transform(alignments, lambda a: score(a, ts)), lambda s: s["whole"] & (s["score"] >= MATCH))
    none = F.array().cast("array<struct<label:string,score:double,whole:boolean>>")
    return F.when(F.size(alignments) > 0, let(F.array(*rows), scores)).otherwise(none)


OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``; such columns are replaced.

    ``n_base`` counts all places of the base phrases, the two places their
    first and last start (words from 0; null if none). ``labels`` adds those
    of the notices found; ``score`` is the best notice's share, 0 if none. A
    null or empty text has no words and empty label lists. One row out for
    each row in; an empty table gives an empty one.
    """
    idf = rarity(docs, text)
    index = _index(idf)
    looked_up = sorted({*index, *(p.split()[0] for p, _ in PHRASES)})

    def found(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: h["w"].isin(looked_up))

        def phrases(h: Column) -> Column:
            label = F.lit(None).cast("string")
            for phrase, name in PHRASES:
                ws = phrase.split()
                here = h["w"] == ws[0]
                for k, w in enumerate(ws[1:], 1):
                    here = here & F.coalesce(F.get(words, h["at"] + k) == w, F.lit(False))
                label = F.when(here, F.lit(name)).otherwise(label)
            return F.struct(h["at"].alias("at"), label.alias("label"))

        return let(hits, lambda hits: F.struct(
            F.size(words).alias("n"), F.filter(F.transform(hits, phrases), lambda x: x["label"].isNotNull()).alias("base"),
            let(_alignments(hits, index), lambda a: _verified(words, a, idf)).alias("notices"),
        ))

    inner, restore = set_aside(docs, [text], OUTPUTS)
    marked = inner.withColumn("_found", let(license_words(F.col(text)), found))
    base, notices = F.col("_found.base"), F.col("_found.notices")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return restore(marked.withColumns({
        "n_words": F.col("_found.n").cast("long"), "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda b: b["at"])).cast("long"),
        "last_word": F.array_max(F.transform(base, lambda b: b["at"])).cast("long"),
        "base_labels": joined(F.transform(base, lambda b: b["label"])),
        "labels": joined(F.concat(F.transform(base, lambda b: b["label"]), F.transform(notices, lambda n: n["label"]))),
        "score": F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(notices, lambda n: n["score"])), F.lit(0.0))),
    }))


def scan_sql(source: str = "documents") -> str:
    """DuckDB SQL for ``scan`` over ``source``: the same index, one row per word."""
    rows = []
    for t, (label, key, text) in enumerate(TEMPLATES):
        ws, ks = text.split(), key.split()
        k = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        rows += [f"({t}, '{label}', {i}, '{w}', {str(k <= i < k + len(ks)).lower()})" for i, w in enumerate(ws)]
    phrases = " UNION ALL ".join(
        f"SELECT p0.rid, p0.pos, '{label}' AS label FROM placed p0 "
        + " ".join(f"JOIN placed p{k} ON p{k}.rid = p0.rid AND p{k}.pos = p0.pos + {k} AND p{k}.w = '{w}'" for k, w in enumerate(phrase.split()) if k)
        + f" WHERE p0.w = '{phrase.split()[0]}'" for phrase, label in PHRASES
    )
    vocabulary = ", ".join(f"('{w}')" for w in VOCABULARY)
    return rf"""WITH templates(t, label, pos, w, key) AS (VALUES {', '.join(rows)}), vocabulary(w) AS (VALUES {vocabulary}),
rows AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {source}),
each AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM rows),
placed AS (SELECT rid, w, pos FROM each WHERE w IN (SELECT w FROM vocabulary)),
weights AS (SELECT v.w, ln((1 + (SELECT count(*) FROM rows)) / (1 + count(DISTINCT p.rid))) + 1e-9 AS idf
  FROM vocabulary v LEFT JOIN placed p ON p.w = v.w GROUP BY v.w),
keys AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY idf DESC, w) AS r FROM (SELECT DISTINCT t, w FROM templates WHERE key) JOIN weights USING (w)),
indexed AS (SELECT x.* FROM templates x JOIN keys k ON k.t = x.t AND k.w = x.w AND k.r <= {INDEXED}),
ranked AS (SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY idf DESC, w) AS r
  FROM (SELECT DISTINCT rid, w FROM placed WHERE w IN (SELECT w FROM indexed)) JOIN weights USING (w)),
aligned AS (SELECT DISTINCT p.rid, t.t, t.label, p.pos - t.pos AS off FROM placed p JOIN ranked r ON r.rid = p.rid AND r.w = p.w AND r.r <= {SQL_WORDS}
  JOIN indexed t ON t.w = p.w),
scored AS (SELECT a.rid, a.label, sum(CASE WHEN p.w = t.w THEN idf ELSE 0 END) / sum(idf) AS score, bool_and(NOT t.key OR coalesce(p.w = t.w, false)) AS whole
  FROM aligned a JOIN templates t ON t.t = a.t JOIN weights v ON v.w = t.w LEFT JOIN placed p ON p.rid = a.rid AND p.pos = a.off + t.pos
  GROUP BY a.rid, a.t, a.label, a.off),
notices AS (SELECT rid, label, score FROM scored WHERE whole AND score >= {MATCH}),
base AS ({phrases}),
base_of AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
all_of AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM notices) GROUP BY rid),
best AS (SELECT rid, max(score) AS score FROM notices GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, round(least(1, coalesce(score, 0)), 6)::DOUBLE AS score
FROM rows LEFT JOIN base_of b USING (rid) LEFT JOIN all_of a USING (rid) LEFT JOIN best USING (rid)"""
