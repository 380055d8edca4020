"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortspark.llm import (
    exact_dedup,
    language_id,
    licenses,
    packing,
    phrase_dedup,
    pii,
    quality,
    shingle_join,
)
from cohortspark.llm.bpe import ByteBpe
from cohortspark.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.fixtures import SPACED, ascii_lower, documents, edge_texts
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    result = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert "problem" not in result and "types" not in result, result


def test_exact_copies(spark):
    rows = [r for r in edge_texts() if r[0] is not None] + [(900 + i, "Hot text") for i in range(200)]
    got = exact_dedup.mark_exact_copies(documents(spark, rows), heavy=4, tracked=64).collect()
    groups = defaultdict(list)
    for k, t in rows:
        groups[sha(ascii_lower(t))].append(k)
    want = Counter((k, max(groups[h]), len(groups[h]), k == max(groups[h]), h)
                   for h, ks in groups.items() for k in ks)
    assert Counter(map(tuple, got)) == want


def test_bpe_round_trip():
    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ByteBpe(path)
    rng = random.Random(1)
    texts = [t or "" for _, t in edge_texts()] + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|",
                                                  "it's  DON'T\n\n x\r\n", " \xa0 a\xa0\xa0 b", "é" * 700]
    texts += ["".join(rng.choice(" \n\tabcTHE'st.,!é日09\xa0\x1c😀̈<|>") for _ in range(rng.randint(0, 40)))
              for _ in range(800)]
    for text, (ids, shown) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert shown.decode() == ",".join(map(str, want))
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False) == text


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c)
                    for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def test_pii_base_spans(spark):
    rng = random.Random(3)
    texts = ["a@b.c%x@d.e _foo@x.y", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1",
             "4111 1111 1111 1111 and 4111-1111-1111-1111", "++1 (555) 123-4567) +1((((",
             "a" * 20000 + "@x.y", "é" * 5 + "joe@x.org 😀 +49 30 1234567", "1" * 20000,
             "x@y.z " * 700, "a@b" + ".c" * 8000, None]
    texts += ["".join(rng.choice("ab@.%-+ 0123456789()é _") for _ in range(rng.randint(0, 60)))
              for _ in range(300)]
    for r in pii.report(documents(spark, list(enumerate(texts)))).collect():
        text = texts[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text)
                 if passes(k, m.group())]
        counts = Counter(k for k, _, _ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in PII], text[:80]
        shown = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == sha(",".join(shown)), text[:80]
        assert set(shown) <= set(r.spans.split(",")) | {""}


def test_pii_mask(spark):
    texts = ["call +49 30 1234567!", "a@b.cd and 10.0.0.1", "number 9807915762804490", None, ""]
    got = {r.doc_id: r.text for r in pii.mask(documents(spark, list(enumerate(texts)))).collect()}
    assert got[0] == "call [PHONE]!" and got[1] == "[EMAIL] and [IP]"
    assert got[3] is None and got[4] == ""


def shingles(text: str | None, width: int) -> frozenset:
    words = SPACED.findall(ascii_lower(text))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def linked(rows, width: int, percent: int) -> dict:
    """Smallest key each key is linked with, by comparing all pairs."""
    sets = [(k, shingles(t, width)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in parent}


def near_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, "a", "A", "a b", "b a", "x y z", "X Y Z", "x y z w"]
    for _ in range(14):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        first = text
        for _ in range(rng.randint(1, 14)):
            text = list(text if rng.random() < 0.6 else first)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[i] = rng.choice(words)
                else:
                    text.insert(i, rng.choice(words))
            texts.append(" ".join(text))
    shared = " ".join(rng.choice(words) for _ in range(30))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
              for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, width, percent", [(5, 4, 85), (6, 5, 80)])
def test_jaccard_components(spark, seed, width, percent):
    rows = near_rows(seed)
    want = linked(rows, width, percent)
    for r in shingle_join.link_components(documents(spark, rows), width, percent).collect():
        assert r.n_shingles == len(shingles(dict(rows)[r.doc_id], width))
        assert r.component_id == want[r.doc_id]


def test_jaccard_repeated_and_null_keys(spark):
    rows = [(3, "a b c d e"), (3, "v w x y z"), (4, "A b c d e"), (5, "v w x y z"), (None, "a b c d e"),
            (None, "solo words here now"), (6, None), (6, None)]
    got = shingle_join.link_components(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.component_id is not None) == [
        ("3", 3), ("3", 3), ("4", 3), ("5", 3), ("6", 6), ("6", 6), ("None", 3)]


def test_open_stars_are_compared(spark):
    """Two stars whose centres do not link but whose members do."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:100]), " ".join(words[3:103]), " ".join(words[6:106]),
             " ".join(words[9:109]), " ".join(words[12:112]), " ".join(words[200:300])]
    rows = list(enumerate(texts))
    want = linked(rows, 4, 85)
    got = {r.doc_id: r.component_id
           for r in shingle_join.link_components(documents(spark, rows)).collect()}
    assert got == want and got[4] == 0


def test_cells_never_count_less_than_their_shingles(spark):
    """Shared passages come last in the order, so texts that only share one do not meet."""
    rng = random.Random(11)
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    passages = [own(f"p{k}", 60) for k in range(3)]
    rows = [(i, f"{own(i, 15)} {rng.choice(passages)} {own(f'{i}z', 15)}") for i in range(90)]
    docs, rule = documents(spark, rows).repartition(5), shingle_join.Rule()
    levels = shingle_join.cell_levels(shingle_join.describe(docs, rule, "text", "doc_id"))
    words = [text.split() for _, text in rows]
    times = Counter(" ".join(w[i:i + 4]) for w in words for i in range(len(w) - 3))
    sets = [s for _, part in shingle_join.text_sets(pa.array([t for _, t in rows]), 4) for s in part]
    hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert sorted(counts) == sorted(times.values())
    assert (levels[shingle_join.cells_of(hashes)] >= shingle_join.level(counts)).all()
    nodes = docs.selectExpr("doc_id AS node", "doc_id AS star", "true AS alone")
    lists = shingle_join.star_lists(
        shingle_join.postings(docs, nodes, levels, rule, "text", "doc_id"))
    assert lists.groupBy("token").count().where("count > 5").isEmpty()
    assert shingle_join.list_pairs(lists, rule, ("star", "star")).isEmpty()


def test_near_copies_gather_around_the_text_they_were_made_from(spark):
    """Copies that link with their origin but not with each other: one star, whatever its key."""
    rng = random.Random(5)
    origin = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(900, " ".join(origin))]
    for i in range(40):
        changed = list(origin)
        for at in rng.sample(range(10, 290), 6):
            changed[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    docs, rule = documents(spark, rows), shingle_join.Rule(5, 80)
    classes = shingle_join.describe(docs, rule, "text", "doc_id").where("block IS NULL") \
        .withColumnRenamed("doc_key", "node")
    pairs = shingle_join.star_pairs(classes.select("node", "keys", "sketch"))
    found = shingle_join.links(shingle_join.compare(pairs, docs, rule, "text", "doc_id"), rule).collect()
    assert len(found) >= 36 and {r.b for r in found} == {900}
    rows_out = shingle_join.link_components(docs, 5, 80).collect()
    assert {r.component_id for r in rows_out} == {0}


def test_positions_skip_list_pairs(spark):
    """Texts of one hot source that share boilerplate only meet on no list."""
    common = " ".join(f"c{i}" for i in range(100))
    rows = [(i, common + " " + " ".join(f"own{i}x{j}" for j in range(10))) for i in range(80)]
    docs, rule = documents(spark, rows), shingle_join.Rule()
    levels = shingle_join.cell_levels(shingle_join.describe(docs, rule, "text", "doc_id"))
    assert (levels >= shingle_join.level(np.array(80))).sum() == 97
    nodes = docs.selectExpr("doc_id AS node", "doc_id AS star", "true AS alone")
    posted = shingle_join.postings(docs, nodes, levels, rule, "text", "doc_id", 50)
    lists = shingle_join.star_lists(posted)
    assert lists.groupBy("token").count().where("count = 80").count() >= 5
    long = [r.token for r in lists.where("long").select("token").distinct().collect()]
    met = spark.createDataFrame([], "a long, b long")
    for kind in ("long", "false AS long"):
        met = met.unionByName(shingle_join.list_pairs(
            lists.selectExpr("token", "star", "least", "reach", kind), rule, ("star", "star")))
        given = lists.withColumnsRenamed({"star": "owner"}).selectExpr(
            "token", "owner", "owner AS own_star", "-1L AS side", "least", "reach")
        assert shingle_join.meetings(given, ["token"], rule).count() == 0
    given = given.where(given.token.isin(long))
    assert given.count() > 400 and shingle_join.long_list_tasks(given, 8).count() == 0
    assert met.count() == 0


@pytest.mark.parametrize("part", [3, 20, 4096])
def test_long_lists_in_parts(spark, part):
    rng = random.Random(part)
    entries = []
    for star in range(150):
        for token in rng.sample(range(4), 2):
            n = rng.choice([40, 41, 45, 60])
            entries.append((token, star, n, n * 100 // 85 - rng.choice([0, 0, 4, 10, 20])))
    want = {(a[1], b[1]) for a in entries for b in entries
            if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]}
    lists = spark.createDataFrame(entries, "token long, star long, least long, reach long")
    for long in ("false", "token > 0"):
        got = shingle_join.list_pairs(lists.selectExpr("*", f"{long} AS long"), shingle_join.Rule(),
                                      ("star", "star"), part).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    tasks = shingle_join.long_list_tasks(lists.selectExpr(
        "token", "star AS owner", "star AS own_star", "least", "reach"), part)
    largest = tasks.groupBy("token", "one", "two").count().agg({"count": "max"}).first()[0]
    assert part > 20 or largest <= 12 * part  # parts are dealt by hash


def test_license_places(spark):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(2)
    texts = ["", None, "UNDER THE MIT-License cc by nc by nc apache license, version 2.0", "under the mit",
             "Ünder thé mit license é日本 a\x7fb", "cc by nc " * 900]
    texts += [" ".join(rng.choice("under the mit license cc by nc apache version 2 foo".split())
                       for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for r in licenses.scan(documents(spark, list(enumerate(texts)))).collect():
        words = word.findall(ascii_lower(texts[r.doc_id]))
        places = [(i, label) for p, label in phrases for i in range(len(words) - len(p) + 1)
                  if words[i:i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(","))


def test_license_templates_with_changes(spark):
    text = licenses.TEMPLATES[0][1]
    changed = "intro words " + text[:300] + " changed here " + text[300:] + " the end"
    part = licenses.TEMPLATES[4][1][:80]
    got = {r.doc_id: r for r in licenses.scan(documents(
        spark, [(0, changed), (1, part), (2, "the software is good")])).collect()}
    assert got[0].labels == "mit" and 0.8 < got[0].score <= 1 and got[0].spans[0].first_word == 2
    assert got[1].labels == "" and got[2].labels == "" and got[2].score < 0.2


def test_quality_counts_and_outliers(spark):
    rng = random.Random(7)
    words = ["house", "river", "stone", "light", "walks", "under", "green", "hills", "again", "over"]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(
        rng.randint(2, 12)))) for i in range(150)]
    rows += [(500 + i, " ".join(f"{rng.choice(words)}$$ #{rng.choice(words)}|" for _ in range(60)))
             for i in range(8)]
    rows += [(600, None), (601, "few words only"), (602, "same words again " * 30),
             (603, "line one\nline one\n \n \nother\nline one\n" + "x y z")]
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    for k, t in rows:
        ws = SPACED.findall(t or "")
        seen, lines = set(), 0
        for line in (t or "").split("\n"):
            if SPACED.search(line):
                lines += line in seen
                seen.add(line)
        grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
        times = Counter(grams)
        inside = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(ws), sum(map(len, ws)), lines, len(inside))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(ws) < 10 or 100 * len(inside) > 20 * len(ws))
        assert r.kept <= (not r.base_failed)
    assert all(got[i].kept for i in range(150) if not got[i].base_failed)
    assert not any(got[500 + i].kept for i in range(8))


@pytest.mark.parametrize("copies", [True, False])
def test_quality_third_of_a_group_is_junk(spark, copies):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("house", "river", "stone", "light", "walk") for b in "abcdefgh"]
    good = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 120)))) for i in range(200)]
    junk = [" ".join(rng.choice(words) + rng.choice(["", "", "$", "#"]) for _ in range(90)) for _ in range(100)]
    rows = good + [(1000 + i, junk[0 if copies else i]) for i in range(100)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s0' AS source")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[k].kept for k, _ in good) and not any(got[1000 + i].kept for i in range(100))


def log_determinant(points: np.ndarray) -> float:
    floor = np.diag([quality.FLOORS[d] ** 2 for d in quality.DIMS])
    scatter = quality.CONSISTENCY * np.cov(points.T, bias=True) + floor
    return float(np.linalg.slogdet(scatter)[1])


def vector_rows(spark, groups: dict[str, np.ndarray]):
    names = ", ".join(f"x_{d} double" for d in quality.DIMS)
    return spark.createDataFrame(
        [("en", g, *map(float, x)) for g, xs in groups.items() for x in xs],
        f"g_lang string, g_source string, {names}").repartition(3)


def test_quality_determinant_against_all_half_sets(spark):
    rng = np.random.default_rng(3)
    groups = {f"mixed{i}": rng.normal(0, rng.uniform(0.2, 2, 5), (10, 5)) for i in range(12)}
    groups |= {f"apart{i}": np.vstack([rng.normal(0, 0.3, (6, 5)), rng.normal(6, 3, (4, 5))])
               for i in range(6)}
    groups |= {"one": np.ones((1, 5)), "same": np.ones((7, 5))}
    rows = vector_rows(spark, groups)
    got = {r.g_source: r for r in quality.least_determinant(quality.concentrated(rows)).collect()}
    assert got.keys() == groups.keys()
    for g, points in groups.items():
        sets = [points[list(c)] for n in range(-(-len(points) // 2), len(points) + 1)
                for c in itertools.combinations(range(len(points)), n)]
        least = min(map(log_determinant, sets))
        centre = [got[g][f"m_{d}"] for d in quality.DIMS]
        used = min(sets, key=lambda x: abs(x.mean(0) - centre).max() + 1e-9 * len(x))
        assert np.allclose(used.mean(0), centre) and got[g].log_det >= least - 1e-6
        assert abs(log_determinant(used) - got[g].log_det) < 1e-6
        if g.startswith("apart") or len(points) < 10:
            assert abs(got[g].log_det - least) < 1e-6


def test_quality_smallest_determinant_of_the_starts_wins(spark):
    rng = np.random.default_rng(5)
    groups = {"high": np.vstack([rng.normal(0, 0.05, (55, 5)), rng.normal(8, 0.05, (45, 5))]),
              "low": np.vstack([rng.normal(8, 0.05, (55, 5)), rng.normal(0, 0.05, (45, 5))])}
    rows = vector_rows(spark, groups)
    single = [{r.g_source: r.log_det for r in quality.concentrated(rows, (share,)).collect()}
              for share in quality.STARTS]
    # the upper quartile stays in the lesser cluster of one group, the lower in that of the other
    assert single[2]["high"] > single[0]["high"] + 1 and single[0]["low"] > single[2]["low"] + 1
    for r in quality.least_determinant(quality.concentrated(rows)).collect():
        assert r.log_det == min(x[r.g_source] for x in single)
        assert all(abs(r[f"m_{d}"] - (0 if r.g_source == "high" else 8)) < 0.2 for d in quality.DIMS)


def test_quality_steps_have_small_plans(spark):
    """A step is planned for every step of every start, so the driver pays for each column."""
    rng = np.random.default_rng(7)
    points = rng.normal(0, 1, (60, 5)) @ rng.normal(0, 1, (5, 5))
    rows = vector_rows(spark, {"one": points, "null": np.zeros((1, 5))})
    estimates = quality.first_estimates(rows, quality.STARTS)
    following = quality.concentrate(rows, estimates)
    assert len(quality.improved(estimates, following).columns) <= 10
    for r in following.where("g_source = 'one'").collect():
        scatter = np.zeros((5, 5))
        scatter[np.tril_indices(5)] = r.scatter
        scatter = np.tril(scatter) + np.tril(scatter, -1).T
        factor = np.linalg.inv(np.linalg.cholesky(scatter))
        assert np.allclose(factor[np.tril_indices(5)], r.inverse)
        assert abs(np.linalg.slogdet(scatter)[1] - r.log_det) < 1e-9


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = language_id.identify(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_needs_letters(spark):
    rows = [(i, t) for i, t in enumerate(["12 34 !", None, "", "² ½ ٣", "wort"] * 3)]
    for r in language_id.identify(documents(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect():
        assert (r.lang_pred == "und") == (rows[r.doc_id][1] != "wort")


def vocabulary():
    """Pieces of the fixed vocabulary by text; byte pieces by their byte."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    ids = range(model.vocab_size())
    plain = sorted({model.id_to_piece(i) for i in ids
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
    return {w: i for i, w in enumerate(plain)}, len(plain)


def segmentations(word, known, first_byte):
    """Piece numbers of every way to segment a word, one by one."""
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        head = [known[word[:j]]] if word[:j] in known else (
            [first_byte + b for b in word[0].encode()] if j == 1 else None)
        if head is not None:
            yield from (head + rest for rest in segmentations(word[j:], known, first_byte))


def test_lattice_sums_all_segmentations():
    lattice = language_id.PieceLattice(tokenizer_path("piece_bpe_32k.model"))
    known, first_byte = vocabulary()
    assert (lattice.size, lattice.first_byte) == (first_byte + 256, first_byte)
    p = np.random.default_rng(0).random((lattice.size + 1, 2)) / lattice.size
    p[-1] = 0
    words = ["the", "einschließlich", "x", "ab", "日本", "ສະບາຍ", "aᚠb"]
    got = lattice.log_probabilities(words, p)
    counts = lattice.expected_counts(words, np.arange(1.0, 8.0), p[:, :1])
    want, likelihood = np.zeros(lattice.size), 0.0
    for i, word in enumerate(words):
        ways = list(segmentations("▁" + word, known, first_byte))
        share = np.array([[p[w, k].prod() for w in ways] for k in (0, 1)])
        assert np.allclose(got[i], np.log(share.sum(axis=1)))
        likelihood += (i + 1) * got[i, 0]
        for w, x in zip(ways, share[0] / share[0].sum(), strict=True):
            np.add.at(want, w, (i + 1) * x)
    assert np.allclose(counts[:-1], want) and np.isclose(counts[-1], likelihood)


def test_long_words_are_not_cut():
    """A word of thousands of letters has the product of its parts where no piece joins them."""
    lattice = language_id.PieceLattice(tokenizer_path("piece_bpe_32k.model"))
    known, first_byte = vocabulary()
    p = np.full((lattice.size + 1, 1), 1.0 / lattice.size)
    p[-1] = 0
    rune = "ᚠ"  # no piece, and no piece holds it
    assert not any(rune in w for w in known)
    each = np.log(p[0, 0]) * 3
    start = lattice.log_probabilities([rune], p)[0, 0] - each
    got = lattice.log_probabilities([rune * 3000], p)[0, 0]
    assert np.isclose(got, start + 3000 * each)
    counts = lattice.expected_counts([rune * 3000], np.array([2.0]), p)
    assert np.allclose(counts[[first_byte + b for b in rune.encode()]], 6000)
    mixed = "straße" * 400
    joined = lattice.log_probabilities([mixed, mixed + "x"], p)[:, 0]
    assert np.isfinite(joined).all() and joined[1] < joined[0]


def test_fit_raises_the_likelihood_until_it_settles(spark):
    words = spark.createDataFrame([("de", "einschließlich", 5), ("de", "ein", 9), ("de", "ᚠ", 1),
                                   ("en", "the", 7), ("en", "then", 3)],
                                  "label string, word string, n long").repartition(2)
    path = tokenizer_path("piece_bpe_32k.model")
    lattice = language_id.PieceLattice.shared(path)
    rows = words.collect()
    labels, p = language_id.fit(words, path, 1e-4)
    assert labels == ["de", "en"] and np.allclose(p.sum(axis=0), 1)
    for k, label in enumerate(labels):
        own = [r for r in rows if r.label == label]
        q, before = np.full((lattice.size + 1, 1), 1.0 / lattice.size), -np.inf
        q[-1] = 0
        for _ in range(100):
            counts = lattice.expected_counts([r.word for r in own],
                                             np.array([float(r.n) for r in own]), q)
            if np.allclose(q, p[:, [k]], rtol=1e-9):
                break
            assert counts[-1] > before
            before = counts[-1]
            q[:-1, 0] = (counts[:-1] + language_id.SMOOTHING) / (
                counts[:-1].sum() + language_id.SMOOTHING * lattice.size)
        else:
            raise AssertionError("the fit is no round of the plain iteration")


def test_packing_is_whole(spark):
    rows = [(i, t) for i, (_, t) in enumerate(edge_texts())]
    rows += [(300, "<|endoftext|> hi <|ENDOFTEXT|>"), (301, "It's don't WE'LL' x'..y"),
             (302, "İSTANBUL Σας. naïve… “q”, l’homme é, Å.")]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packing.pack(documents(spark, rows), tokenizer_path("word_bpe_49k.json")).collect():
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for parts, most in [*((v, len(ids[k])) for k, v in pieces.items()),
                        *((v, None) for v in places.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == most if most else at <= 4096 and at & (at - 1) == 0


def test_packing_keeps_documents_whole():
    rng = random.Random(8)
    sizes = [min(int(rng.paretovariate(1.1) * 60), 20_000) for _ in range(3000)] + [64, 128, 1, 1]
    bins, rows = packing.HarmonicBins(256, 1000, classes=8), []
    for key, n in enumerate(sizes):
        rows += bins.add(key, np.full(n, key, "<u4").tobytes())
        assert len(bins.open) <= 8 and all(b.used < 256 for b in bins.open.values())
    streamed = {r[5] for r in rows}
    rows += bins.flush()
    places, pieces = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, sequence, offset in rows:
        assert total == sizes[key] and crc == zlib.crc32(np.full(length, key, "<u4").tobytes())
        places[sequence].append((offset, length, key, start))
        pieces[key].append((start, length))
    for key, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sizes[key]
    closers = 0
    for sequence, parts in places.items():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or (sequence not in streamed and at & (at - 1) == 0)
        if sequence in streamed:
            # the fixed count of a class's items, then fillers, of which only the last is cut
            _, first, key, _ = min(parts)
            count = min(256 // first, 8)
            items = sorted(parts)[:count]
            assert all(min(256 // n, 8) == count for _, n, _, _ in items)
            assert all(start + n == sizes[k] for _, n, k, start in items) or first == 256
            cut = [p for p in sorted(parts)[count:] if p[1] + p[3] < sizes[p[2]]]
            assert cut in ([], [max(parts)])
            closers += len(cut)
    fitting = [k for k, n in enumerate(sizes) if n <= 256]
    uncut = sum(len(pieces[k]) == 1 for k in fitting)
    assert uncut >= len(fitting) - closers - 8 and uncut > 0.5 * len(fitting)


def cut_words(rows, window: int) -> Counter:
    words = [SPACED.findall(t or "") for _, t in rows]
    times = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (k, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if times[tuple(w[i:i + window])] > 1
                for j in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[k, len(w), len(gone), sha(" ".join(kept))] += 1
    return out


@pytest.mark.parametrize("window, share", [(35, 20_000), (12, 20_000), (12, 2)])
def test_repeated_passages(spark, window, share):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)] + ["é", "日本", "a.b"]
    shared = [[rng.choice(words) for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = [*edge_texts(), (0, "x " * 200), (1, "p q r " * 40), (2, "y " * 34), (3, "y " * 34)]
    for i in range(200, 290):
        text: list[str] = []
        for _ in range(rng.randint(1, 5)):
            text += rng.choice(shared) if rng.random() < 0.5 else [
                rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(text)))
    got = phrase_dedup.repeated(documents(spark, rows), window=window, share=share).collect()
    assert Counter(map(tuple, got)) == cut_words(rows, window)


def test_pipeline_stages_compose(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, FOLDER).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "exact_dedup":
            best = {}
            for k, t in before.items():
                best[ascii_lower(t)] = max(k, best.get(ascii_lower(t), k))
            assert after.keys() == set(best.values())
        if name == "near_dedup":
            want = linked(sorted(before.items()), 5, 80)
            assert after.keys() == {k for k in before if want[k] == k}
        if name == "pii":
            assert not any(passes(k, m.group()) for t in after.values() for k, p in PII.items()
                           for m in re.finditer(p, t or ""))
    packed = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == after.keys()
