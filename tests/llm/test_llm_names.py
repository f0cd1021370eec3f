"""Other columns of a table, however they are called, neither break an operator nor get lost."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from patronage.llm import bpe, language, licenses, mixing, ngram_join, quality, repeats
from patronage.llm.common import set_aside

INNER = [
    "_words", "_lines", "_host", "_host_of", "_place", "_source", "_whole", "_cut", "_copy", "_found", "_both", "_rep_t", "_rep_d", "_rep_c", "_guess", "_row",
    "spans", "both", "size_", "extra", "whole", "copy", "x.y", "carried", "n_docs", "_cross", "_turn", "_s", "_most", "_tied", "_at", "weight",
]
TEXT = "the licence of the work is the mit license and all rights reserved to the owner of it " * 4


def table(frame):
    rows = [(i, TEXT + str(i % 3), "en", f"s{i % 2}", 7) for i in range(12)] + [(12, None, None, None, 7), (12, "", "de", "s0", 7)]
    df = frame(rows, "doc_id long, text string, lang string, source string, n_words int")
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in INNER})


OPERATORS = {
    "op3": (lambda df: mixing.mix(df, (5, 2, 1), 1.5), mixing.OUTPUTS),
    "op3 repeated": (lambda df: mixing.expand(mixing.mix(df, (1,), 1.0)), mixing.OUTPUTS),
    "op4": (lambda df: quality.judge(df), quality.ADDED),
    "op5": (lambda df: bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), ("ids", "decoded")),
    "op6": (lambda df: licenses.scan(df), licenses.OUTPUTS),
    "op8": (lambda df: ngram_join.keep_first(df), ()),
    "op9": (lambda df: language.predict(df, language.learn(df)), ("lang_pred", "score")),
    "op10": (lambda df: repeats.remove_repeats(df), ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_name_may_stand_beside_the_inputs(frame, name):
    operator, outputs = OPERATORS[name]
    df = table(frame)
    out = operator(df)
    assert out.columns == [c for c in df.columns if c not in outputs] + list(outputs)
    rows = out.collect()
    assert len(rows) > 0 and (name in ("op8", "op3 repeated") or len(rows) == 14)
    left = [c for c in INNER if c not in outputs]
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in left)
    assert out.where("doc_id < 0").count() == 0


def test_set_aside_gives_back_order_and_replaces_in_any_case(frame):
    df = frame([(1, "a", 2, 3)], "k int, Out string, `b.c` int, z int")
    inner, restore = set_aside(df, ["z"], ["out"])
    assert len(inner.columns) == 2
    got = restore(inner.withColumn("out", F.lit("new")))
    assert got.columns == ["k", "b.c", "z", "out"] and tuple(got.first()) == (1, 2, 3, "new")
    inner, restore = set_aside(df, ["z"], ["out"], carry=["k"])
    assert tuple(restore(inner.withColumn("out", F.lit("new"))).first()) == (1, "new")


def test_repeated_rows_of_a_source_come_near_its_target(frame):
    rows = [(1, "ten words are in this text which comes quite often", "a")] * 100 + [(i, "one two three four five", "b") for i in range(40)]
    out = mixing.mix(frame(rows, "doc_id long, text string, source string", 5), (5, 2), 1.5).collect()
    for s, size in (("a", 10), ("b", 5)):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size and all(r.taken <= 2 * r.size for r in mine)


def test_rows_of_one_number_meet_only_their_own_text(frame):
    rows = [(7, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(60)] + [(7, "same words again " * 9)] * 40 + [(8, "same words again " * 9)]
    df = frame(rows, "doc_id long, text string")
    out = ngram_join.near_copies(df).collect()
    assert len(out) == 101 and {r.n_links for r in out} == {0, 40} and sum(r.n_links == 40 for r in out) == 41
    assert ngram_join.keep_first(df).count() == 61
