"""The registered queries of the text operators against their SQL, and the pipeline against its parts by brute force."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from patronage.llm import bpe
from patronage.llm.common import components
from patronage.llm.queries import QUERIES, SQL
from test_llm_copies import brute_repeats, classes, jaccard_links
from test_llm_text import brute_quality
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(QUERIES) == sorted(["pipeline", *(n for n in QUERIES if n.startswith("op"))])
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    assert compare(connect(FOLDER), SQL[name], QUERIES[name](spark, FOLDER)) is None


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def test_near_copies_of_documents(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op8_ngram_join"](spark, FOLDER).collect()}
    want = classes([d.doc_id for d in documents], jaccard_links([d.text for d in documents]))
    assert [(rows[d.doc_id].class_id, rows[d.doc_id].n_links) for d in documents] == want


def test_repeats_of_documents(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op10_run_length_index"](spark, FOLDER).collect()}
    assert [tuple(rows[d.doc_id])[1:] for d in documents] == brute_repeats([d.text for d in documents], 200)


def test_links_of_embeddings(spark):
    rows = {r.vec_id: r for r in QUERIES["op7_vector_links"](spark, FOLDER).collect()}
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if j < i]
    assert [(rows[r.vec_id].component_id, rows[r.vec_id].n_links) for r in table] == classes([r.vec_id for r in table], pairs)


def test_bpe_of_documents(spark, documents):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}
    )
    rows = {r.doc_id: r for r in QUERIES["op5_byte_bpe"](spark, FOLDER).collect()}
    for d in documents:
        ids = library.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_chat_query(spark):
    rows = {r.conv_id: r for r in QUERIES["op1_chat_windows"](spark, FOLDER).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].loss_chars == len(said) and rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    assert sum(r.n_turns for r in rows.values()) == len(turns) + 2
    assert sum(r.loss_chars for r in rows.values()) == sum(len(t.text or "") for t in turns if t.role == "assistant") + len(said)


def test_pages_and_languages_keep_rows(spark):
    pages = QUERIES["op2_html_text"](spark, FOLDER).collect()
    assert len(pages) == 50 and all(p.n_chars == len(p.text) and "<" not in p.text for p in pages)
    held = QUERIES["op9_language"](spark, FOLDER).where("held_out").count()
    assert QUERIES["op9_language"](spark, FOLDER).count() == 200 and 20 < held < 80


def test_components(spark, frame):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200), (7, 7)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component_id for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, **{i: 500 for i in range(500, 540)}}


def test_pipeline_by_parts(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == [n for n, _ in corpus_pipeline.STAGES] and len(by) == 5
    one = by["quality rules"](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in one} == {d.doc_id for d in documents if not brute_quality(d.text)[-1]}  # no host is rejected here
    two_df = by["n-gram Jaccard join"](spark, spark.createDataFrame(one, docs.schema), FOLDER)
    two = sorted(two_df.collect())
    want = classes([d.doc_id for d in one], jaccard_links([d.text for d in one]))
    assert [r.doc_id for r in two] == sorted(d.doc_id for d, (c, _) in zip(one, want, strict=True) if d.doc_id == c)
    three = sorted(by["suffix-array dedup"](spark, spark.createDataFrame(two, docs.schema), FOLDER).collect())
    assert [len(r.text.encode()) for r in three] >= [b - g for b, g, *_ in brute_repeats([r.text for r in two], 200)]
    assert all(r.n_chars == len(r.text) for r in three) and [r.doc_id for r in three] == [r.doc_id for r in two]
    mixed = by["mixing sources to target weights"](spark, spark.createDataFrame(three, docs.schema), FOLDER).collect()
    words = sum(len(r.text.split()) for r in three)
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * words) < 0.2 * words and mixed[0].__fields__ == docs.columns
    last = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in mixed)
    text = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in three}
    assert all(r.decoded_sha256 == text[r.doc_id] for r in last.collect())


def test_stages_take_odd_rows(spark, frame):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema).union(docs.limit(20))
    for start in (odd, docs.where("doc_id < 0")):
        part = start
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, FOLDER)
        assert part.count() >= 0
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, FOLDER).count() >= 0, name


def test_near_copies_of_rows_that_share_a_number(spark, frame):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, texts["a"]), (5, texts["a"]), (5, texts["b"]), (5, texts["c"]), (5, texts["c"]), (-2, texts["c"] + "  "), (None, texts["d"]), (None, texts["d"]),
            (None, texts["b"]), (7, None), (7, None), (None, " "), (None, " ")]
    df = frame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_copies(spark, df, FOLDER).collect()
    want = [(1, texts["a"]), (5, texts["b"]), (-2, texts["c"] + "  "), (None, texts["d"]), (7, None), (None, " "), (None, " ")]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
