"""The source audit against a plain count of every term of every source."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import divergence
from cohortspark.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import documents, edge_texts
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs, top):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    groups, docs = {}, {}
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = sum(sources.values(), Counter())

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1)
                        for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("least_docs", "block", "side"), [(2, 16_384, 64), (1, 8, 2), (9, 64, 1)])
def test_edge_texts(spark, least_docs, block, side):
    df = documents(spark, edge_texts(), extra=True).cache()
    want = plain([(r.text, r.lang, r.source) for r in df.collect()], least_docs, 7)
    got = rows_of(divergence.audit(df, least_docs=least_docs, top=7, block=block, side=side))
    assert got == want


def test_many_sources_ties_and_a_source_without_terms(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiouäß"]
    data = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), "en", f"s{rng.randint(0, 11)}")
            for _ in range(150)]
    data += [("1 2 ... 3", "en", "digits"), (None, None, None), ("a a a", "xx", "only")]
    data += [("the same words", "en", s) for s in ("twin1", "twin2")] * 3
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(4)
    assert rows_of(divergence.audit(df, least_docs=3, block=16, side=4)) == plain(data, 3, 50)


def test_empty_table(spark):
    df = documents(spark, edge_texts()).where("false")
    assert divergence.audit(df).count() == 0


def test_bitsets_and_lists_of_bits_agree():
    rng = np.random.default_rng(3)
    for width in (1, 63, 64, 65, 700):
        rows = []
        for name in "ab":
            counts = rng.choice([0, 0, 1, 1, 1, 2, 3, *range(50, 90)], width)
            levels = np.unique(counts[counts > 0])
            places = [np.flatnonzero(counts == c).astype("<u4") for c in levels]
            rows.append((counts, {
                "source": name, "bucket": 0, "width": width, "n_words": int(counts.sum()),
                "n_terms": width, "counts": levels.tolist(), "sizes": [len(x) for x in places],
                "bits": [divergence.as_bits(x, width) for x in places]}))
        (x, a), (y, b) = rows
        p, q = (1 + 10**9 * (c + 5) // (int(c.sum()) + 5 * width) for c in (x, y))
        a, b = divergence.SourceLevels(a), divergence.SourceLevels(b)
        assert width < 700 or (len(a.sets) and len(a.places))
        assert divergence.divergence(a, b) == int(np.abs(p - q).sum())


def test_long_text_in_slices(monkeypatch):
    text = ("Ab1cd Äé-x " * 50 + "z" * 100).encode()
    whole = [t for run in divergence.term_runs(text) for t in run]
    monkeypatch.setattr(divergence, "SLICE_BYTES", 7)
    runs = list(divergence.term_runs(text))
    assert len(runs) > 20 and [t for run in runs for t in run] == whole
    assert whole[:4] == [b"ab", b"cd", "Äé".encode(), b"x"]


def test_counts_are_handed_on_in_lots(monkeypatch):
    counts = divergence.TermCounts()
    counts.add(("en", "s"), b"a a b")
    counts.add(("en", "s"), b"b")
    batch = next(counts.hand_on()).to_pylist()
    assert {(r["term"], r["n"], r["docs"]) for r in batch} == {("a", 2, 1), ("b", 2, 2)}


@pytest.mark.parametrize("name", ["op11_source_divergence"])
def test_query_matches_sql(spark, name):
    result = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert "problem" not in result and "types" not in result, result
