"""How far the sources of a language differ in their words, exactly.

Every language keeps the terms of at least ``least_docs`` of its documents. Each of its sources,
and the language as a whole, gives a kept term the smoothed share
``1 + floor(10^9 (count + 5) / (N + 5 V))``. Two sources differ by the sum of the absolute
differences of their shares over all kept terms; a source stands out by the terms whose share
exceeds the language's.

Count-level bitmaps: a source's terms lie in levels, one per count, each a bitset over the places
of a block of terms. AND plus popcount of two sources' levels gives the cells of their joint count
table; a cell is multiplied by the difference of its two shares, and the cells of terms that a
source lacks come by complement, from popcounts alone. A level of few terms is kept as the list of
its set bits, as compressed bitmaps do, and met by testing these bits.

On Spark: terms are counted where texts are read and summed in one shuffle on (language, term),
which also counts the term's documents. Terms are dealt by hash to blocks of about ``block``
terms, a row of bitsets for each source and block; blocks are compared apart, their sums added.
Many sources are dealt to buckets of about ``side``, and a task meets two buckets of one block at
a time, so no task holds more than some 2 x ``side`` rows of bitsets, whatever the skew.

Null text, language and source count as empty strings. A group whose texts hold no term takes part
with counts of zero. Repeated rows count as often as they occur. A very long text is counted in
slices; only its distinct terms are held. Where a language keeps no term, its sources differ by 0.
An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored

LEAST_DOCS = 30
TOP_TERMS = 50
BLOCK = 16_384
SIDE = 64
SMOOTH = 5
SCALE = 1_000_000_000
ENTRIES = 250_000  # counted terms a task holds before it hands them on
SLICE_BYTES = 4_000_000

# A-Z to a-z, all other ASCII but letters to the space, bytes of other characters unchanged
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in turn, in lists from slices of about ``SLICE_BYTES``."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + SLICE_BYTES)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


class TermCounts:
    """Occurrences and documents of terms by (language, source), handed on in bounded lots."""

    schema = "lang string, source string, term string, n long, docs long"

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, group: tuple[str, str], text: bytes) -> None:
        n, docs = self.groups.setdefault(group, (Counter(), Counter()))
        met: set[bytes] = set()
        for run in term_runs(text):
            n.update(run)
            met.update(run)
        docs.update(met)

    def held(self) -> int:
        return sum(len(n) for n, _ in self.groups.values())

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in self.groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(terms)),
                 pa.repeat(pa.scalar(source, pa.string()), len(terms)),
                 pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        self.groups.clear()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = TermCounts()
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        for i, group in enumerate(zip(langs, sources, strict=True)):
            counts.add(group, texts[i].as_py())
            if i % 64 == 63 and counts.held() > ENTRIES:
                yield from counts.hand_on()
    yield from counts.hand_on()


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n of each term that its language keeps, and the language's ``total``."""
    counted = docs.mapInArrow(count_terms, TermCounts.schema).repartition("lang", "term")
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"),
                                                         F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    return (sums.withColumns({"total": F.sum("n").over(everywhere),
                              "in_docs": F.sum("docs").over(everywhere)})
            .where(F.col("in_docs") >= least_docs)
            .select("lang", "source", "term", "n", "total"))


def share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (whole + 5 terms)), in exact decimals."""
    over = (F.lit(SCALE).cast("decimal(38,0)") * (count + SMOOTH))
    return F.lit(1) + F.call_function("div", over, (whole + SMOOTH * terms).cast("decimal(38,0)"))


def term_blocks(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Block and place of each kept term; places count from 0 in each block."""
    order = Window.partitionBy("lang", "block").orderBy("term")
    return (kept.select("lang", "term").distinct().join(sizes.select("lang", "blocks"), "lang")
            .select("lang", "term", F.expr("pmod(xxhash64(term), blocks)").alias("block"))
            .withColumn("place", F.row_number().over(order) - 1))


def encode_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: its distinct counts, the terms of each, and these as a bitset or a list of bits."""
    for batch in batches:
        counts, sizes, bits = [], [], []
        widths = batch.column("width").to_pylist()
        for width, cells in zip(widths, batch.column("cells"), strict=True):
            flat = cells.values.flatten() if cells.is_valid else [pa.array([], pa.int64())] * 2
            place, n = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in flat)
            order = np.lexsort((place, n))
            place = place[order].astype("<u4")
            levels, first = np.unique(n[order], return_index=True)
            runs = np.split(place, first[1:]) if len(first) else []
            counts.append(levels.tolist())
            sizes.append([len(r) for r in runs])
            bits.append([as_bits(r, width) for r in runs])
        keep = [batch.column(c) for c in ("lang", "source", "block", "n_terms", "n_words", "width",
                                          "bucket", "buckets")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(counts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
             pa.array(bits, pa.list_(pa.binary()))],
            ["lang", "source", "block", "n_terms", "n_words", "width", "bucket", "buckets",
             "counts", "sizes", "bits"])


LEVELS = ("lang string, source string, block long, n_terms long, n_words long, width long,"
          " bucket long, buckets long, counts array<long>, sizes array<int>, bits array<binary>")


def words_of(width: int) -> int:
    """64-bit words of a bitset over ``width`` places."""
    return -(-width // 64)


def dense(size: int, width: int) -> bool:
    """Whether a level's bitset is no larger than the list of its bits."""
    return 8 * words_of(width) <= 4 * size


def as_bits(places: np.ndarray, width: int) -> bytes:
    if not dense(len(places), width):
        return places.tobytes()
    flags = np.zeros(64 * words_of(width), bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").tobytes()


class SourceLevels:
    """One source's levels in a block of terms, with the share of each count."""

    def __init__(self, row: dict) -> None:
        self.source, self.bucket, self.width = row["source"], row["bucket"], row["width"]
        whole = row["n_words"] + SMOOTH * row["n_terms"]
        share_of = lambda c: 1 + SCALE * (c + SMOOTH) // whole if whole else 0
        self.none = share_of(0)
        shares = np.array([share_of(c) for c in row["counts"]], np.int64)
        sizes = np.array(row["sizes"], np.int64)
        full = np.array([dense(s, self.width) for s in sizes.tolist()], bool)
        bits = row["bits"]
        self.size = int(sizes.sum())
        self.shares = np.concatenate([shares[full], shares[~full]])  # dense levels first
        self.sizes = np.concatenate([sizes[full], sizes[~full]])
        self.sets = np.array([np.frombuffer(bits[i], "<u8") for i in np.flatnonzero(full)],
                             np.uint64).reshape(int(full.sum()), words_of(self.width))
        lists = [np.frombuffer(bits[i], "<u4") for i in np.flatnonzero(~full)]
        places = np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int64)
        level = np.repeat(np.arange(len(self.sets), len(self.shares)), [len(x) for x in lists])
        order = np.argsort(places)
        self.places, self.levels = places[order], level[order]


def tested(a: SourceLevels, b: SourceLevels) -> tuple[np.ndarray, np.ndarray]:
    """Levels (of a, of b) of the terms in a's lists and b's bitsets: these bits are tested."""
    bit = (b.sets[:, a.places >> 6] >> (a.places & 63).astype(np.uint64)) & np.uint64(1)
    in_b, at = np.nonzero(bit)
    return a.levels[at], in_b


def divergence(a: SourceLevels, b: SourceLevels) -> int:
    """Sum over the block's terms of the absolute difference of the two sources' shares."""
    in_a, in_b = np.zeros(len(a.shares), np.int64), np.zeros(len(b.shares), np.int64)
    value = 0
    if len(a.sets) and len(b.sets):
        cells = np.array([np.bitwise_count(s & b.sets).sum(axis=1) for s in a.sets], np.int64)
        gap = np.abs(a.shares[:len(a.sets), None] - b.shares[None, :len(b.sets)])
        value += int((cells * gap).sum())
        in_a[:len(a.sets)] += cells.sum(axis=1)
        in_b[:len(b.sets)] += cells.sum(axis=0)
    _, x, y = np.intersect1d(a.places, b.places, assume_unique=True, return_indices=True)
    met = [(a.levels[x], b.levels[y]), tested(a, b), tested(b, a)[::-1]]
    for of_a, of_b in met:
        value += int(np.abs(a.shares[of_a] - b.shares[of_b]).sum())
        in_a += np.bincount(of_a, minlength=len(in_a))
        in_b += np.bincount(of_b, minlength=len(in_b))
    # zeros by complement: terms of one source only, and of neither
    value += int(((a.sizes - in_a) * np.abs(a.shares - b.none)).sum())
    value += int(((b.sizes - in_b) * np.abs(b.shares - a.none)).sum())
    neither = a.width - a.size - b.size + int(in_a.sum())
    return value + neither * abs(a.none - b.none)


def compare_buckets(table: pa.Table) -> pa.Table:
    """Divergence of each two sources of two buckets (or of one) in one block of terms."""
    rows = table.to_pylist()
    i, j, lang = rows[0]["i"], rows[0]["j"], rows[0]["lang"]
    sources = [SourceLevels(r) for r in rows]
    pairs = list(combinations(sources, 2) if i == j else product(
        [s for s in sources if s.bucket == i], [s for s in sources if s.bucket == j]))
    values = [divergence(a, b) for a, b in pairs]
    return pa.table({
        "lang": pa.array([lang] * 2 * len(pairs), pa.string()),
        "source": pa.array([a.source for a, _ in pairs] + [b.source for _, b in pairs], pa.string()),
        "item": pa.array([b.source for _, b in pairs] + [a.source for a, _ in pairs], pa.string()),
        "value": pa.array(values * 2, pa.int64())})


def source_groups(docs: DataFrame, cells: DataFrame, kept_sizes: DataFrame, side: int) -> DataFrame:
    """Every (lang, source): kept terms and words of the language, its own words, its bucket."""
    groups = docs.select("lang", "source").distinct()
    words = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_words"))
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / side).alias("buckets"))
    return (groups.join(words, ["lang", "source"], "left").join(many, "lang")
            .join(kept_sizes, "lang", "left")
            .select("lang", "source", "buckets",
                    F.expr("pmod(xxhash64(source), buckets)").alias("bucket"),
                    F.coalesce("n_words", F.lit(0)).alias("n_words"),
                    F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                    F.coalesce("lang_words", F.lit(0)).alias("lang_words"),
                    F.coalesce("blocks", F.lit(1)).alias("blocks")))


def source_levels(cells: DataFrame, places: DataFrame, groups: DataFrame) -> DataFrame:
    """Encoded levels, a row for each source and each block of its language."""
    widths = places.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    held = (cells.join(places, ["lang", "term"]).groupBy("lang", "source", "block")
            .agg(F.collect_list(F.struct(F.col("place").cast("long"), "n")).alias("cells")))
    spots = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.col("blocks") - 1)))
    rows = (spots.join(widths, ["lang", "block"], "left")
            .join(held, ["lang", "source", "block"], "left")
            .select("lang", "source", "block", "n_terms", "n_words",
                    F.coalesce("width", F.lit(0)).alias("width"), "bucket", "buckets", "cells"))
    return rows.mapInArrow(encode_levels, LEVELS)


def pair_divergence(levels: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of a language's sources."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))
    dealt = (levels.withColumn("other", other)
             .withColumns({"i": F.least("bucket", "other"), "j": F.greatest("bucket", "other")})
             .drop("other", "buckets"))
    parts = dealt.groupBy("lang", "block", "i", "j").applyInArrow(
        compare_buckets, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each term whose share exceeds the language's."""
    own = share(F.col("n"), F.col("n_words"), F.col("n_terms"))
    whole = share(F.col("total"), F.col("lang_words"), F.col("n_terms"))
    return (cells.join(groups, ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value"))
            .where("value > 0"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK,
          side: int = SIDE) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                          for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    cells = stored(kept_counts(plain, least_docs), "divergence-counts")
    sizes = (cells.select("lang", "term", "total").distinct().groupBy("lang")
             .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("lang_words"))
             .withColumn("blocks", F.ceil(F.col("n_terms") / block)))
    groups = stored(source_groups(plain, cells, sizes, side), "divergence-groups")
    levels = stored(source_levels(cells, term_blocks(cells, sizes), groups), "divergence-levels")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    parts = [("pair", ranked(pair_divergence(levels))),
             ("term", ranked(telling_terms(cells, groups)).where(F.col("rank") <= top))]
    pairs, terms = (rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
                    for name, rows in parts)
    return pairs.unionByName(terms)
