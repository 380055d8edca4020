"""Every operator and stage on nulls, repeats, empty tables and clashing column names."""

from types import SimpleNamespace

import pytest

import corpus_pipeline
from cohortspark.llm import (
    bpe,
    exact_dedup,
    language_id,
    licenses,
    packing,
    phrase_dedup,
    pii,
    quality,
    scratch,
    shingle_join,
    url_filter,
)
from cohortspark.llm.queries import QUERIES, tokenizer_path
from tests.llm.fixtures import documents, edge_texts

WORDS = tokenizer_path("word_bpe_49k.json")
OPERATORS = {
    "exact": exact_dedup.mark_exact_copies,
    "bpe": lambda d: bpe.encode_and_decode(d, tokenizer_path("byte_bpe_50k.json")),
    "pii": pii.report,
    "join": shingle_join.link_components,
    "licenses": licenses.scan,
    "quality": quality.judge,
    "language": lambda d: language_id.identify(d, tokenizer_path("piece_bpe_32k.model")),
    "phrases": phrase_dedup.repeated,
}


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, edge_texts(), extra=True).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(edge, name):
    rows = OPERATORS[name](edge).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edge, name):
    assert OPERATORS[name](edge.where("false")).count() == 0


def test_packing_edges(edge):
    assert {r.doc_id for r in packing.pack(edge, WORDS).collect()} == {
        r.doc_id for r in edge.collect()}
    assert packing.pack(edge.where("false"), WORDS).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "no scheme", "x"), (3, "http://A.ORG", "x"),
         (3, "http://A.ORG/", "x"), (4, "http://example.org/en/12?q#f", "x"),
         (5, "https://m.example.com/de/1", "x"), (6, "http://x/a.org/", "x"),
         (None, "ftp://spam.net/é" + "a" * 5000, "x"), (7, "http:///p", "x"),
         (8, "http://notexample.org/es/", "x")],
        "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path[:7]): (r.rule, r.verdict)
           for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        (1, "", ""): (None, "block"), (2, "", ""): (None, "block"),
        (3, "a.org", ""): (None, "allow"), (3, "a.org", "/"): ("org/", "allow"),
        (4, "example.org", "/en/12"): ("example.org/en/1", "block"),
        (5, "m.example.com", "/de/1"): ("com/de/", "block"),
        (6, "x", "/a.org/"): (None, "allow"), (None, "spam.net", "/éaaaaa"): (None, "block"),
        (7, "", "/p"): (None, "block"), (8, "notexample.org", "/es/"): ("org/", "allow")}
    assert url_filter.judge_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stage_keeps_columns(spark, edge, stage):
    out = stage[1](spark, edge, "")
    assert out.columns == edge.columns
    assert out.count() <= edge.count()
    assert stage[1](spark, edge.where("false"), "").count() == 0


def test_quality_stage_drops_short_and_repeated(spark, edge):
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, edge, "").collect()}
    assert not kept & {1, 2, 3, 4, 8, 9}


def test_exact_stage_leaves_one_row_a_text(spark, edge):
    rows = corpus_pipeline.STAGES[1][1](spark, edge, "").collect()
    texts = [(r.text or "").lower() for r in rows]
    assert len(texts) == len(set(texts))
    assert 14 in {r.doc_id for r in rows} and 13 not in {r.doc_id for r in rows}


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize(("master", "alone"), [("local", True), ("local[4]", True), ("yarn", False),
                                               ("local-cluster[2,1,1024]", False)])
def test_no_local_folder_on_a_cluster(master, alone):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}"))
    if alone:
        assert scratch.shared_folder(session).startswith("file:///")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session)
