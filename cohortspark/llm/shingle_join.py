"""N-gram Jaccard join with set-relation skipping.

A document's set holds the distinct shingles of ``width`` consecutive lower-cased words; with
fewer words, the whole sequence is the one shingle. Two documents link when
100 * intersection >= percent * union. The join keeps what later steps need of a set small and
never forms all pairs of a group:

* Equal sets are one class, counted by digest; the smallest key stands for it.
* Answers from similar sets: classes gather in stars. Each class is compared with at most one
  other of a like minimum-hash sketch, and joins it if they link. That one is the middle of the
  largest group of near copies it is found in, so that most copies of a text are in one star and
  the stars of a group do not all meet on its lists. A member's links are
  derived from its star's: with d the Jaccard distance (a metric) and t the largest distance
  of a link, members a and b of stars A and B can only link if
  d(A, B) <= d(A, a) + t + d(b, B).
* Inverted lists: prefix filtering over a global order of shingles (frequent ones last) gives
  lists of stars. The order comes from counts of all shingles of all rows in ``CELLS`` cells by
  hash: a shingle's cell is never counted lower than the shingle itself, so a passage that
  many texts share comes after what is a text's own, and texts that only share it do not meet. From the first common shingle of a link on, both sets hold t / (1 + t) of
  both sizes; so a size and a position reach up to one largest size of a partner. A list is
  kept in blocks of equal size and reach, and only blocks that reach each other are paired:
  skipped entries cost nothing. Entries that do not reach their own size (beyond the index
  prefix) meet smaller sets only. Lists that may be longer than ``PART``, by the count of their
  cell, are planned from their counts per size and reach, cut into parts of ``PART`` entries, and joined part by part in many tasks;
  parts that reach no other part are left out before the join.
* Of two linking sets, all but a few of the prefix shingles that come first in the order are
  common. The other lists verify this: pairs that meet on too few lists are dropped.
* Star pairs that share a list are compared by their centres. Where the bound leaves members
  open, members are compared with the other centre first, and only pairs of stars that are
  then still in different components compare members with each other, through lists again.

Every comparison is exact on whole sets, so no link between different texts is lost; copies and
members of one star are not compared with each other, as they are connected already.
Components are found by label propagation over the links in Spark.

The order of shingles is a broadcast of ``CELLS`` bytes, whatever the input. It decides how much
work the lists save and never what links.

Null or empty text, or text without words, has an empty set, links with nothing and is its own
component. Rows sharing a key are one document and its links are those of any of them. Rows
with a null key take the component of an equal set that has a key, or null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored
from cohortspark.llm.words import Words, mixed, spaced, word_slices

WIDTH = 4
PERCENT = 85
CELL_BITS = 22
CELLS = 1 << CELL_BITS
BLOCK = 1 << 16  # cells a row of counts
SKETCH = 64
CROWD = 8  # classes of a key from which a star's centre is chosen by their sketches
KEYS = 4
SHARE = 10_000
PART = 4096
SALTS = 32
LIKELY = 0.7  # share of equal sketch cells from which a comparison is tried
ORDER_BITS = np.uint64(1) << np.uint64(63)


@dataclass(frozen=True)
class Rule:
    """Width of shingles and the least similarity in per cent."""

    width: int = WIDTH
    percent: int = PERCENT

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """How many shingles, in the global order, meet any linking set's."""
        return sizes - -(-sizes * self.percent // 100) + 1

    def reach(self, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The largest linking set whose first common shingle has ``rest`` of ``n`` from it on."""
        return rest * (100 + self.percent) // self.percent - n


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice, and each text's first place in them."""
    h, first = words.hashes(), words.first
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        full = mixed(full * multiplier + h[k:len(h) - width + 1 + k])
    starts = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    out = full[np.minimum(starts, max(0, len(full) - 1))] if len(full) else np.zeros(
        bounds[-1], np.uint64)
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        whole = np.uint64(0)
        for x in h[first[t]:first[t + 1]]:
            whole = mixed(np.array([whole * multiplier + x + np.uint64(1)]))[0]
        out[bounds[t]] = whole
    return out, bounds


def text_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, in slices with their first row."""
    inside = spaced()
    for row, words in word_slices(column, inside, lower=True):
        with np.errstate(over="ignore"):
            hashes, bounds = shingle_hashes(words, width)
        yield row, [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class CellCounts:
    """How many sets of one task hold a shingle of each cell (with repeats of a cell)."""

    def __init__(self) -> None:
        self.counts = np.zeros(CELLS, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += [cells_of(s) for s in sets]
        if sum(map(len, self.waiting)) > CELLS:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=CELLS)
            self.waiting = []

    def blocks(self) -> list[tuple[int, bytes]]:
        """Compressed counts of blocks of cells, those without counts left out."""
        self.settle()
        parts = self.counts.reshape(-1, BLOCK)
        return [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(parts) if x.any()]


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """Eighths of a binary order of magnitude, in a byte; 0 for counts up to 1."""
    return np.ceil(8 * np.log2(np.clip(counts, 1, 1 << 31))).astype(np.uint8)


def sketch(s: np.ndarray) -> tuple[list[int], bytes]:
    """Grouping keys and a one-byte-a-cell minimum-hash sketch of a sorted set."""
    cells = np.searchsorted(s, np.arange(SKETCH, dtype=np.uint64) << np.uint64(58))
    ends = np.append(cells[1:], len(s))
    filled = ends > cells
    least = np.zeros(SKETCH, np.uint64)
    least[filled] = s[cells[filled]]
    shown = np.where(filled, (mixed(least) & np.uint64(0xFF)) | np.uint64(1), 0).astype(np.uint8)
    quarters = cells[::SKETCH // KEYS]
    limit = np.append(quarters[1:], len(s))
    keys = [int(s[a].astype(np.int64)) for a, b in zip(quarters, limit, strict=True) if b > a]
    return keys, shown.tobytes()


def describe(docs: DataFrame, rule: Rule, text: str, key: str) -> DataFrame:
    """Per row: doc_key, n, digest, keys, sketch. Also rows of a block and its cells' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = CellCounts()
        for batch in batches:
            for row, sets in text_sets(batch.column(1), rule.width):
                cells.add(sets)
                marks = [sketch(s) for s in sets]
                yield rows(batch.column(0).slice(row, len(sets)), [len(s) for s in sets],
                           [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                           [m[0] for m in marks], [m[1] for m in marks])
        counted = cells.blocks()
        yield rows(pa.nulls(len(counted), pa.int64()), None, None, None, None,
                   [b for b, _ in counted], [c for _, c in counted])

    def rows(keys, n, digest, grouping, sketches, block=None, counts=None) -> pa.RecordBatch:
        size = len(keys)
        column = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays(
            [keys, column(n, pa.int64()), column(digest, pa.binary()),
             column(grouping, pa.list_(pa.int64())), column(sketches, pa.binary()),
             column(block, pa.int32()), column(counts, pa.binary())],
            names=["doc_key", "n", "digest", "keys", "sketch", "block", "counts"])

    wanted = docs.select(F.col(key).cast("long").alias("doc_key"),
                         F.coalesce(F.col(text), F.lit("")).alias("t"))
    return wanted.mapInArrow(run, "doc_key long, n long, digest binary, keys array<long>, "
                                  "sketch binary, block int, counts binary")


def cell_levels(described: DataFrame) -> np.ndarray:
    """The ``level`` of each cell's count over all rows: ``CELLS`` bytes, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                total[block] = total[block] + more if block in total else more
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([level(c).tobytes() for c in total.values()], pa.binary())],
            names=["block", "levels"])

    found = described.where("block IS NOT NULL").select("block", "counts").repartition(
        "block").mapInArrow(run, "block int, levels binary").toArrow()
    levels = np.zeros(CELLS, np.uint8)
    for block, part in zip(found["block"].to_pylist(), found["levels"].to_pylist(), strict=True):
        levels[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(part, np.uint8)
    return levels


# comparing sets

def compare(pairs: DataFrame, docs: DataFrame, rule: Rule, text: str, key: str,
            changes: bool = False) -> DataFrame:
    """Exact sizes for pairs of keys (a, b): a, b, common, total (sizes of both sets).

    With ``changes`` also what a's set has gained and lost against b's.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "join-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_key")).distinct()
    texts = stored(docs.select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("t")).where(
        "t IS NOT NULL").join(needed, "doc_key", "left_semi"), "join-texts")
    left = pairs.join(texts.select(F.col("doc_key").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_key").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            a, b, ta, tb = batch.columns
            common, total, gained, lost = [], [], [], []
            for row, sets in text_sets(ta, rule.width):
                for i, s in enumerate(sets, row):
                    other = tb[i].as_py()
                    if other != last[0]:  # rows come ordered by b
                        last = (other, next(text_sets(pa.array([other]), rule.width))[1][0])
                    common.append(len(np.intersect1d(s, last[1], assume_unique=True)))
                    total.append(len(s) + len(last[1]))
                    if changes:
                        gained.append(np.setdiff1d(s, last[1], assume_unique=True).tobytes())
                        lost.append(np.setdiff1d(last[1], s, assume_unique=True).tobytes())
            columns = [a, b, pa.array(common, pa.int64()), pa.array(total, pa.int64())]
            columns += [pa.array(x, pa.binary()) for x in (gained, lost)] if changes else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["a", "b", "common", "total", *(["gained", "lost"] if changes else [])]
    schema = "a long, b long, common long, total long"
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(
        run, schema + ", gained binary, lost binary" * changes), "join-compared")


def links(compared: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that link: a, b and their distance d."""
    union = F.col("total") - F.col("common")
    return compared.where(100 * F.col("common") >= rule.percent * union).select(
        "a", "b", (1 - F.col("common") / union).alias("d"))


# stars

def alike(pairs: DataFrame) -> DataFrame:
    """``like``: the share of equal cells of ``sketch`` and ``other_sketch``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH)
                        for c in batch.columns[-2:])
            filled = (one > 0) | (two > 0)
            same = ((one == two) & filled).sum(axis=1) / np.maximum(1, filled.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(same)], names=names)

    kept = pairs.drop("sketch", "other_sketch")
    names = [*kept.columns, "like"]
    schema = ", ".join(f"{c} {kind}" for c, kind in kept.dtypes) + ", like double"
    return pairs.select(*kept.columns, "sketch", "other_sketch").mapInArrow(run, schema)


def group_centres(spread: DataFrame) -> DataFrame:
    """k, centre, other_sketch, n: a class of each group of a key and the group's size.

    Of ``CROWD`` or more classes the one most like the group's commonest value of each sketch
    cell: near copies of one text differ from it less than from each other. Else the earliest.
    """
    groups = spread.groupBy("k").agg(F.min(F.struct("node", "sketch")).alias("first"),
                                     F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = spread.join(groups.where(F.col("n") >= CROWD).select("k"), "k")
    cells = (F.mode(F.hex(F.substring("sketch", i + 1, 1)), True).alias(f"c{i}") for i in range(SKETCH))
    commonest = crowded.groupBy("k").agg(*cells).select(
        "k", F.unhex(F.concat(*(f"c{i}" for i in range(SKETCH)))).alias("other_sketch"))
    middle = alike(crowded.join(commonest, "k").select("k", "node", "sketch", "other_sketch")) \
        .groupBy("k").agg((-F.max(F.struct("like", -F.col("node")))["col2"]).alias("middle"))
    found = spread.join(middle, "k").where("node = middle").groupBy("k").agg(
        F.min(F.struct("node", "sketch")).alias("best"))
    return groups.join(found, "k", "left").withColumn("best", F.coalesce("best", "first")).select(
        "k", F.col("best.node").alias("centre"), F.col("best.sketch").alias("other_sketch"), "n")


def star_pairs(classes: DataFrame) -> DataFrame:
    """For each class at most one centre (b) of a like sketch, of the largest group of a key.

    Centres are ranked by the size of their groups; a class only joins one ranked before it.
    """
    spread = classes.select("node", "sketch", F.explode("keys").alias("k"))
    centres = stored(group_centres(spread), "join-centres")
    rank = centres.groupBy("centre").agg(F.max("n").alias("rank"))
    own = rank.select(F.col("centre").alias("node"), F.col("rank").alias("own"))
    met = (spread.join(centres.drop("n"), "k").where("node <> centre").drop("k")
           .join(rank, "centre").join(own, "node", "left")
           .where("own IS NULL OR rank > own OR (rank = own AND centre < node)"))
    likely = alike(met.select("node", "centre", "rank", "sketch", "other_sketch")).where(
        F.col("like") >= LIKELY)
    best = likely.groupBy(F.col("node").alias("a")).agg(
        F.max(F.struct("rank", "like", -F.col("centre"))).alias("m"))
    return best.select("a", (-F.col("m.col3")).alias("b"))


def stars(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Every class with its star's centre and its distance from it: node, star, d."""
    members = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(
        F.col("a").alias("node"), F.col("m.b").alias("star"), F.col("m.d").alias("d"))
    moved = members.select(F.col("node").alias("star"))
    fixed = members.join(moved, "star", "left_anti")  # a centre is no member itself
    return classes.select("node").join(fixed, "node", "left").select(
        "node", F.coalesce("star", "node").alias("star"), F.coalesce("d", F.lit(0.0)).alias("d"))


# inverted lists

def postings(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, rule: Rule, text: str,
             key: str, part: int = PART) -> DataFrame:
    """Prefix shingles of the documents in ``nodes`` (node, star, alone): token, star, alone, node,
    n, reach, long.

    ``reach`` is the size of the largest set that links if this is the first common shingle;
    ``long`` tells that the shingle's list may have more than ``part`` entries.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    most = level(np.array(part))
    held = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t")).where(
        "t IS NOT NULL").join(nodes.select("node", "star", "alone"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            for row, sets in text_sets(batch.column(1), rule.width):
                tokens, reaches = [], []
                for s in sets:
                    take = int(rule.prefix(np.array(len(s)))) if len(s) else 0
                    tokens.append(first_in_order(s, take, levels))
                    reaches.append(rule.reach(len(s), len(s) - np.arange(len(tokens[-1]))))
                counts = [len(t) for t in tokens]
                part = batch.slice(row, len(sets))
                where = pa.array(np.repeat(np.arange(len(sets)), counts))
                token = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), part.column(2).take(where),
                     part.column(3).take(where), part.column(0).take(where),
                     pa.array(np.repeat([len(s) for s in sets], counts), pa.int64()),
                     pa.array(np.concatenate(reaches), pa.int64()),
                     pa.array(levels[cells_of(token)] > most)],
                    names=["token", "star", "alone", "node", "n", "reach", "long"])

    return held.select("node", "t", "star", "alone").mapInArrow(
        run, "token long, star long, alone boolean, node long, n long, reach long, long boolean")


def first_in_order(s: np.ndarray, take: int, levels: np.ndarray) -> np.ndarray:
    """The first ``take`` of a sorted set in the global order: by level of the cell, then hash."""
    return s[np.argsort(levels[cells_of(s)], kind="stable")[:take]]


def reaching(group: np.ndarray, least: np.ndarray, reach: np.ndarray, most: int = 1 << 20
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of entries of one group that reach each other, each pair once, in slices.

    Entries come ordered by group, least and falling reach. Work is one step for each block of
    equal least and reach and each size in its reach, and one for each pair given.
    """
    if not len(group):
        return
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (least[1:] != least[:-1])
    rung = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    deep = np.int64(1) << 32
    place = rung * deep + (deep - 1 - np.clip(reach, 0, deep - 1))
    # the last rung in reach of each entry, by group and size
    groups = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    sizes = groups[starts] * deep + least[starts]
    last = np.searchsorted(sizes, groups * deep + np.clip(reach, 0, deep - 1), side="right") - 1
    block = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    length = np.diff(np.append(block, len(group)))
    active = last[block] >= rung[block]
    block, length = block[active], length[active]
    if not len(block):
        return
    # each block with each rung in reach, and what of the rung reaches back
    spans = last[block] - rung[block] + 1
    of = np.repeat(np.arange(len(block)), spans)
    to = rung[block][of] + np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans)
    until = np.searchsorted(place, to * deep + (deep - 1 - least[block][of]), side="right")
    own = to == rung[block][of]
    some = until > starts[to]
    of, to, until, own = of[some], to[some], until[some], own[some]
    # each entry of the block; within its own rung it meets those after it
    times = length[of]
    i = np.repeat(block[of], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin = np.where(np.repeat(own, times), i + 1, np.repeat(starts[to], times))
    count = np.maximum(0, np.repeat(until, times) - begin)
    total = np.cumsum(count)
    at = 0
    while at < len(i):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        n = count[at:end]
        left = np.repeat(i[at:end], n)
        right = np.repeat(begin[at:end], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        if len(left):
            yield left, right
        at = end


def meetings(lists: DataFrame, by: list[str], rule: Rule) -> DataFrame:
    """Pairs (a, b) of entries of one list that reach each other.

    ``lists``: the columns ``by`` (the list), owner, own_star, side, least, reach. Entries of the
    same side meet only where it is null.
    """
    ordered = lists.withColumn("back", -F.col("reach")).repartition(*by).sortWithinPartitions(
        *by, "least", "back")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            changed = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:len(by)]], axis=0))
            open_from = int(changed[-1]) + 1 if len(changed) else 0
            held = [x[open_from:] for x in now]
            yield from pairs([x[:open_from] for x in now])
        if held is not None:
            yield from pairs(held)

    def pairs(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner, star, side, least, reach = c[len(by):]
        changed = np.any([x[1:] != x[:-1] for x in c[:len(by)]], axis=0)
        group = np.cumsum(np.append(True, changed)) if len(owner) else owner
        for i, j in reaching(group, least, reach):
            meet = (star[i] != star[j]) & ((side[i] != side[j]) | (side[i] < 0))
            i, j = owner[i[meet]], owner[j[meet]]
            found = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return ordered.select(*by, "owner", "own_star", "side", "least", "reach").mapInArrow(
        run, "a long, b long")


def list_parts(cells: DataFrame, part: int) -> DataFrame:
    """A plan of long lists from their ``cells``: token, least, reach and n entries.

    Rows with chunks: the first part of a cell and over how many it is dealt. Rows with other:
    two parts (part, other) that hold cells in reach of each other.
    """
    ordered = cells.withColumn("beyond", F.col("reach") < F.col("least")).repartition(
        "token").sortWithinPartitions("token", "beyond", "least", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != last:
                    yield plan(held)
                    held = []
                held.append(row)
                last = row[0]
        if held:
            yield plan(held)

    def plan(rows: list[tuple]) -> pa.RecordBatch:
        first, chunks = [], []
        at, filled, was = -1, part, None
        for _, _, _, n, beyond in rows:
            if filled + n > part or beyond != was:  # the next part
                at, filled, was = at + 1, 0, beyond
            first.append(at)
            chunks.append(max(1, -(-n // part)))
            at, filled = at + chunks[-1] - 1, filled + n
        least, reach = (np.array([r[k] for r in rows]) for k in (1, 2))
        first, chunks = np.array(first), np.array(chunks)
        met: set[tuple[int, int]] = set()
        for c in range(len(rows)):
            others = np.flatnonzero((least <= reach[c]) & (least[c] <= reach) & (first >= first[c]))
            for f, k in sorted({(int(first[o]), int(chunks[o])) for o in others}):
                met |= {(min(x, y), max(x, y)) for x in range(first[c], first[c] + chunks[c])
                        for y in range(f, f + k)}
        pairs = np.array(sorted(met), np.int64).reshape(-1, 2)
        none = lambda n: pa.nulls(n, pa.int64())
        token = pa.array(np.full(len(rows) + len(pairs), rows[0][0]), pa.int64())
        both = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())])
        return pa.RecordBatch.from_arrays(
            [token, both(least, none(len(pairs))), both(reach, none(len(pairs))),
             both(first, pairs[:, 0]), both(chunks, none(len(pairs))),
             both(none(len(rows)), pairs[:, 1])],
            names=["token", "least", "reach", "part", "chunks", "other"])

    return ordered.select("token", "least", "reach", "n", "beyond").mapInArrow(
        run, "token long, least long, reach long, part long, chunks long, other long")


def long_list_tasks(lists: DataFrame, part: int = PART) -> DataFrame:
    """Entries of long lists once for each pair of parts they are needed in: token, one, two,
    owner, own_star, side, least, reach. No list has to be in one task."""
    lists = stored(lists, "join-long")
    plan = stored(list_parts(lists.groupBy("token", "least", "reach").agg(
        F.count(F.lit(1)).alias("n")), part), "join-parts")
    cells = plan.where("chunks IS NOT NULL").select(
        "token", "least", "reach", F.col("part").alias("first"), "chunks",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mark = F.xxhash64("owner")
    placed = (lists.withColumn("salt", F.pmod(mark, F.lit(SALTS)).cast("int"))
              .join(cells, ["token", "least", "reach", "salt"])
              .withColumn("part", F.col("first") + F.pmod(F.shiftright(mark, 8), "chunks"))
              .drop("salt", "first", "chunks"))
    pairs = plan.where("other IS NOT NULL").select("token", F.col("part").alias("one"),
                                                   F.col("other").alias("two"))
    needed = pairs.withColumn("part", F.col("one")).unionByName(
        pairs.where("one <> two").withColumn("part", F.col("two")))
    return placed.join(needed, ["token", "part"]).withColumn(
        "side", F.when(F.col("one") == F.col("two"), F.lit(-1).cast("long")).otherwise(F.col("part")))


def list_pairs(lists: DataFrame, rule: Rule, columns: tuple[str, ...],
               part: int = PART) -> DataFrame:
    """Pairs of owners that may link for their sizes and positions on some list.

    ``lists``: token, the owner columns, least (size), reach and long: whether the list is dealt
    over several tasks.
    """
    owner, star = columns
    entries = lists.select("token", F.col(owner).alias("owner"), F.col(star).alias("own_star"),
                           "least", "reach", "long")
    short = entries.where("NOT long").withColumn("side", F.lit(-1).cast("long"))
    dealt = long_list_tasks(entries.where("long").drop("long"), part)
    return meetings(short, ["token"], rule).unionByName(
        meetings(dealt, ["token", "one", "two"], rule)).distinct()


def enough_lists(pairs: DataFrame, lists: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that share as many lists as any link needs.

    ``lists``: token, owner; ``sizes``: owner, least, most. A link has t / (1 + t) of both sizes
    in common, so the set whose prefix ends first in the order has all but its size less that
    many of its prefix shingles in the other's prefix. The shingles of the owner on fewer lists
    are looked up among the other's.
    """
    t = rule.percent / 100
    needed = pairs.select(F.explode(F.array("a", "b")).alias("owner")).distinct()
    lists = stored(lists.join(needed, "owner", "left_semi").distinct(), "join-shared")
    counted = sizes.join(lists.groupBy("owner").agg(F.count(F.lit(1)).alias("lists")), "owner")
    side = lambda x: counted.select(F.col("owner").alias(x), *(
        F.col(c).alias(f"{c}_{x}") for c in ("least", "most", "lists")))
    need = lambda x, y: (t / (1 + t) * (F.col(f"most_{x}") + F.col(f"least_{y}"))
                         - t * F.col(f"most_{x}") - 1e-6)
    fewer = F.col("lists_a") <= F.col("lists_b")
    asked = pairs.join(side("a"), "a").join(side("b"), "b").select(
        F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"),
        F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"),
        F.least(need("a", "b"), need("b", "a")).alias("need"))
    met = (asked.join(lists.withColumnRenamed("owner", "few"), "few")
           .join(lists.withColumnRenamed("owner", "many"), ["token", "many"])
           .groupBy("few", "many").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")))
    return met.where("met >= need").select(F.col("few").alias("a"), F.col("many").alias("b"))


def star_lists(posted: DataFrame) -> DataFrame:
    """One entry a star and shingle, with the bounds of its members."""
    crowds = posted.where("NOT alone").groupBy("token", "star").agg(
        F.min("n").alias("least"), F.max("reach").alias("reach"), F.first("long").alias("long"))
    return crowds.unionByName(posted.where("alone").select(
        "token", "star", F.col("n").alias("least"), "reach", "long"))


# components

def components(edges: DataFrame, name: str = "join-components") -> DataFrame:
    """node, component (smallest node it is connected with) of every node with an edge."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "join-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("component")), name)
    while True:
        # the smallest label next door, then the label's own label
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        better = label.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(better.join(jump, "component", "left").select(
            "node", F.least("component", "further").alias("component"), "was"), name)
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label


def open_star_pairs(compared: DataFrame, starred: DataFrame, label: DataFrame,
                    rule: Rule, centres_done: bool = False) -> DataFrame:
    """Star pairs in different components whose members may yet link.

    ``centres_done``: members were compared with the other star's centre already, which
    settles pairs with a star of one.
    """
    reach = starred.groupBy("star").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("size"))
    of = label.select(F.col("node").alias("star"), "component")
    known = reach.join(of, "star", "left").withColumn("component", F.coalesce("component", "star"))
    side = lambda x: known.select(F.col("star").alias(x), F.col("reach").alias(f"reach_{x}"),
                                  F.col("size").alias(f"size_{x}"), F.col("component").alias(f"c_{x}"))
    d = 1 - F.col("common") / (F.col("total") - F.col("common"))
    most = 1 - rule.percent / 100
    return (compared.join(side("a"), "a").join(side("b"), "b").withColumn("d", d)
            .where("c_a <> c_b AND size_a > 1 AND size_b > 1" if centres_done
                   else "c_a <> c_b AND size_a + size_b > 2")
            .where(F.col("d") <= F.col("reach_a") + F.col("reach_b") + most + 1e-9)
            .select("a", "b", "d", "reach_a", "reach_b"))


def set_rows(docs: DataFrame, nodes: DataFrame, rule: Rule, text: str, key: str) -> DataFrame:
    """The whole sets of some documents: node, gained (sorted shingle hashes)."""
    held = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t")).where(
        "t IS NOT NULL").join(nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in text_sets(batch.column(1), rule.width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "gained"])

    return held.mapInArrow(run, "node long, gained binary")


def derived_links(open_pairs: DataFrame, starred: DataFrame, changes: DataFrame, docs: DataFrame,
                  rule: Rule, text: str, key: str) -> DataFrame:
    """Members of open stars that link with the other star's centre, one a star pair and share.

    What a member has in common with a set follows from what its centre has, by the shingles it
    gained and lost: so a star's answers need the other set and the members' few changes, not
    the members. ``changes``: a (member), b (centre), gained, lost. A large star is dealt in
    shares of ``SHARE`` members.
    """
    turned = open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    crowd = starred.where("node <> star").groupBy("star").agg(
        F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    asked = stored(open_pairs.select("a", "b").unionByName(turned)
                   .join(crowd, F.col("a") == F.col("star")).select("star", "b", "shares"),
                   "join-asked")
    wide = asked.select("star", "shares").distinct()
    whole = stored(set_rows(docs, asked.select(F.explode(F.array("star", "b")).alias("node"))
                            .distinct(), rule, text, key), "join-sets")
    share = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    none = F.lit(None).cast("binary").alias("lost")
    centres = whole.join(wide, F.col("node") == F.col("star")).select(
        "star", share, F.lit(0).alias("kind"), "node", "gained", none)
    members = (changes.withColumnsRenamed({"a": "node", "b": "star"}).join(wide, "star")
               .join(starred.where("node <> star").select("node", "star"), ["node", "star"], "left_semi")
               .select("star", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"),
                       F.lit(1).alias("kind"), "node", "gained", "lost"))
    others = whole.join(asked, F.col("node") == F.col("b")).select(
        "star", share, F.lit(2).alias("kind"), "node", "gained", none)
    dealt = (centres.unionByName(members).unionByName(others).repartition("star", "share")
             .sortWithinPartitions("star", "share", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, last = None, None
        for batch in batches:
            found = []
            for s, share, kind, node, gained, lost in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if (s, share) != last:
                    star, last = StarAnswers(rule), (s, share)
                values = np.frombuffer(gained, np.uint64)
                if kind == 0:
                    star.centres.append(values)
                elif kind == 1:
                    star.add(node, values, np.frombuffer(lost, np.uint64))
                else:
                    member = star.linked(values)
                    if member is not None:
                        found.append((member, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return stored(dealt.mapInArrow(run, "a long, b long"), "join-derived")


class StarAnswers:
    """One share of a star: the centre's set and the members' changes."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.centres: list[np.ndarray] = []  # several where rows share the centre's key
        self.nodes: list[int] = []
        self.changed: list[np.ndarray] = []
        self.gains: list[int] = []
        self.flat = None

    def add(self, node: int, gained: np.ndarray, lost: np.ndarray) -> None:
        self.nodes.append(node)
        self.changed += [gained, lost]
        self.gains.append(len(gained) - len(lost))

    def linked(self, other: np.ndarray) -> int | None:
        """The member most similar to ``other``, if it links."""
        if not self.nodes or not len(other):
            return None
        if self.flat is None:
            lengths = [len(c) for c in self.changed]
            self.flat = np.concatenate(self.changed)
            self.owner = np.repeat(np.arange(len(lengths)) // 2, lengths)
            self.sign = np.repeat(np.tile([1, -1], len(self.nodes)), lengths)
        at = np.minimum(np.searchsorted(other, self.flat), len(other) - 1)
        hit = other[at] == self.flat
        change = np.bincount(self.owner[hit], self.sign[hit], len(self.nodes))
        for centre in self.centres:
            common = len(np.intersect1d(centre, other, assume_unique=True)) + change
            union = len(centre) + np.array(self.gains) + len(other) - common
            ratio = common / np.maximum(union, 1)
            best = int(ratio.argmax())
            if 100 * int(common[best]) >= self.rule.percent * int(union[best]):
                return self.nodes[best]
        return None


def member_checks(open_pairs: DataFrame, posted: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Members of open star pairs that share a list with members of the other star."""
    stars_open = open_pairs.select(F.explode(F.array("a", "b")).alias("star")).distinct()
    lists = posted.join(stars_open, "star", "left_semi").select(
        "token", "node", "star", F.col("n").alias("least"), "reach", "long")
    by_node = sizes.groupBy(F.col("node").alias("owner")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"))
    met = stored(list_pairs(lists, rule, ("node", "star")), "join-met")
    return enough_lists(met, lists.select("token", F.col("node").alias("owner")), by_node, rule)


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id. Keys must be integers."""
    rule = Rule(width, percent)
    described = stored(describe(docs, rule, text, key), "join-described")
    levels = cell_levels(described)
    rows = described.where("block IS NULL").select("doc_key", "n", "digest", "keys", "sketch")
    by_set = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_key").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch")), "join-classes")
    classes = by_set.where("node IS NOT NULL")

    # a key with several sets stays out of stars: changes are told from one set
    one_set = classes.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).where("sets = 1")
    tried = compare(star_pairs(classes.join(one_set, "node", "left_semi")), docs, rule, text, key, changes=True)
    found = links(tried, rule)
    nodes = classes.select("node").distinct()
    starred = stored(stars(nodes, found), "join-stars")

    alone = starred.groupBy("star").agg((F.count(F.lit(1)) == 1).alias("alone"))
    posted = stored(postings(docs, starred.join(alone, "star"), levels, rule, text, key), "join-postings")
    by_star = starred.join(classes.select("node", "n"), "node").groupBy(
        F.col("star").alias("owner")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = stored(list_pairs(star_lists(posted), rule, ("star", "star")), "join-met")
    met = enough_lists(met, posted.select("token", F.col("star").alias("owner")), by_star, rule)
    compared = compare(met, docs, rule, text, key)
    edges = found.select("a", "b").unionByName(links(compared, rule).select("a", "b"))
    label = components(edges)

    still = stored(open_star_pairs(compared, starred, label, rule), "join-open")
    if not still.isEmpty():
        changes = tried.select("a", "b", "gained", "lost")
        edges = edges.unionByName(derived_links(still, starred, changes, docs, rule, text, key))
        label = components(edges)
        still = stored(open_star_pairs(compared, starred, label, rule, True), "join-open")
        if not still.isEmpty():
            checked = compare(member_checks(still, posted, classes, rule), docs, rule, text, key)
            label = components(edges.unionByName(links(checked, rule).select("a", "b")))

    of_set = by_set.join(label, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("set_component"))
    of_key = label.select(F.col("node").alias("doc_key"), F.col("component").alias("key_component"))
    return (rows.select("doc_key", "n", "digest").join(of_set, "digest", "left")
            .join(of_key, "doc_key", "left")
            .select(F.col("doc_key").cast(docs.schema[key].dataType).alias(key),
                    F.col("n").alias("n_shingles"),
                    F.coalesce(F.least("set_component", "key_component"), "doc_key")
                    .alias("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """``docs`` with the smallest key of each component; rows without a key stay."""
    found = link_components(docs, width, percent, text, key)
    gone = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
