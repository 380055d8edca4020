"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one text; a word goes if a window over it has a word
sequence that also starts anywhere else, in the same text or another.

* Each window is filed under its anchor, the gram of ``GRAM`` words with the least hash in it.
  Equal windows have equal anchors, so only anchors met at two places or more can belong to
  repeated windows, and only texts with such anchors are looked at further. Runs of windows
  with one anchor travel as one stretch of text.
* Stretches are dealt to shards by anchor. A shard confirms which windows recur among its
  stretches, compiles them into an Aho-Corasick automaton over words, and streams its stretches
  through it to locate every occurrence.
* A frequent anchor is salted over as many shards as its count asks for. What a salted shard
  met once is counted over the anchor's other shards by hash, so nothing is lost by salting.
* Located windows are gathered per text, and the text is cut in one pass.

Whole copies are found first, by digest: of equal texts one is searched, and the words of all of
them go if there are enough for a window. Null or empty text has no words. Rows are told apart
by key and text; rows that repeat both are copies of each other. Joined words have one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored
from cohortspark.llm.words import Words, mixed, spaced, word_slices

WINDOW = 35
GRAM = 10
SHARE = 20_000  # texts of one anchor that a shard takes
CHUNK_WINDOWS = 3000  # windows behind one automaton, more only where one anchor has more
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 2**64))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` values."""
    n = len(values) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    powers = np.full(len(values), _B, np.uint64)
    powers[0] = 1
    back = np.full(n, _B_INVERSE, np.uint64)
    back[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * np.multiply.accumulate(powers))])
    return mixed((sums[length:] - sums[:n]) * np.multiply.accumulate(back))


def least_of(values: np.ndarray, length: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``length``."""
    place = np.arange(len(values))
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        reach += step
    return place


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Of all windows of a slice: first word, text, anchor and the anchor's place."""
    grams = run_hashes(words.hashes(), min(GRAM, window))
    place = least_of(grams, window - min(GRAM, window) + 1)
    starts = np.arange(len(place))
    text = np.searchsorted(words.first, starts, side="right") - 1
    inside = starts + window <= words.first[text + 1] if len(starts) else np.zeros(0, bool)
    return starts[inside], text[inside], grams[place[inside]], place[inside]


def describe(docs: DataFrame, window: int) -> DataFrame:
    """Per row: doc_key, digest, n_words, whole (digest of its words), anchors.

    An anchor that a text has at several places is listed twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = spaced()
        for batch in batches:
            for row, words in word_slices(batch.column(2), inside, lower=False):
                _, text, anchor, place = anchors(words, window)
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
                text, anchor = text[new], anchor[new].view(np.int64)
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                third = np.zeros(len(text), bool)
                third[2:] = (text[2:] == text[:-2]) & (anchor[2:] == anchor[:-2])
                text, anchor = text[~third], anchor[~third]
                n = len(words.first) - 1
                bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n),
                     pa.array(np.diff(words.first), pa.int64()),
                     pa.array([hashlib.sha256(words.text(a, b)).hexdigest() for a, b in zip(
                         words.first[:-1], words.first[1:], strict=True)]),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(anchor, pa.int64()))],
                    names=["doc_key", "digest", "n_words", "whole", "anchors"])

    return docs.mapInArrow(run, f"doc_key {docs.schema['doc_key'].dataType.simpleString()}, "
                                "digest binary, n_words long, whole string, anchors array<long>")


def stretches(texts: DataFrame, window: int) -> DataFrame:
    """Stretches of windows under wanted anchors: anchor, salt, salts, rid, start, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = spaced()
        for batch in batches:
            wanted, salts = batch.column(2), batch.column(3)
            rids = batch.column(0).to_numpy()
            for row, words in word_slices(batch.column(1), inside, lower=False):
                start, text, anchor, _ = anchors(words, window)
                anchor = anchor.view(np.int64)
                first = np.ones(len(start), bool)
                first[1:] = ((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                             | (start[1:] != start[:-1] + 1))
                at = np.flatnonzero(first)
                end = np.append(at[1:], len(start))
                rows = []
                bounds = np.searchsorted(text[at], np.arange(len(words.first)))
                for t in range(len(words.first) - 1):
                    a, b = bounds[t], bounds[t + 1]
                    here = dict(zip(wanted[row + t].as_py(), salts[row + t].as_py(), strict=True))
                    rid = int(rids[row + t])
                    for i in range(a, b):
                        value = int(anchor[at[i]])
                        if value in here:
                            s, n = int(start[at[i]]), here[value]
                            rows.append((value, rid % n, n, rid, s - int(words.first[t]),
                                         words.text(s, s + int(end[i] - at[i]) + window - 1)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["anchor", "salt", "salts", "rid", "start", "text"])

    return texts.mapInArrow(run, "anchor long, salt long, salts long, rid long, start long, "
                                 "text binary")


class Shard:
    """Stretches of some anchors: confirm, compile, locate."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.rows: list[tuple] = []
        self.windows = 0

    def add(self, row: tuple) -> None:
        words = row[5].split(b" ")
        self.rows.append((*row[:5], words))
        self.windows += len(words) - self.window + 1

    def finish(self) -> list[tuple]:
        """Located runs (rid, start, windows, null, null), and for salted anchors every distinct
        window (rid, start, null, hash, times)."""
        if not self.rows:
            return []
        ids: dict[bytes, int] = {}
        flat: list[int] = []
        begin = []
        for row in self.rows:
            begin.append(len(flat))
            flat += [ids.setdefault(w, len(ids) + 1) for w in row[5]]
            flat.append(0)  # no pattern holds it
        sizes = np.array([len(r[5]) for r in self.rows]) - self.window + 1
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(stretch)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.array(begin)[stretch] + offset
        anchor = np.array([r[0] for r in self.rows], np.int64).view(np.uint64)[stretch]
        # word hashes, not ids, so that other shards give a window the same hash
        worth = np.array([0, *(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                               for w in ids)], np.uint64)
        key = mixed(run_hashes(worth[np.array(flat)], self.window)[place] ^ anchor)
        _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True,
                                             return_counts=True)
        out = self._locate(flat, place[first[times > 1]], place, stretch, offset)
        for k in np.flatnonzero(np.array([r[2] for r in self.rows])[stretch[first]] > 1):
            i = first[k]
            row = self.rows[stretch[i]]
            out.append((row[3], row[4] + int(offset[i]), None, int(key[i].astype(np.int64)),
                        min(2, int(times[k]))))
        self.rows, self.windows = [], 0
        return out

    def _locate(self, flat: list[int], confirmed: np.ndarray, place: np.ndarray,
                stretch: np.ndarray, offset: np.ndarray) -> list[tuple]:
        if not len(confirmed):
            return []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for at in confirmed.tolist():
            automaton.add_word(tuple(flat[at:at + self.window]), 1)
        automaton.make_automaton()
        ends = np.array([end for end, _ in automaton.iter(tuple(flat))])
        hit = np.searchsorted(place, ends - self.window + 1)
        stretch, offset = stretch[hit], offset[hit]
        first = np.ones(len(hit), bool)
        first[1:] = (stretch[1:] != stretch[:-1]) | (offset[1:] != offset[:-1] + 1)
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(hit)))
        return [(self.rows[s][3], self.rows[s][4] + int(o), int(n), None, None)
                for s, o, n in zip(stretch[at], offset[at], runs, strict=True)]


def locate(parts: DataFrame, window: int) -> DataFrame:
    """Occurrences of recurring windows: rid, start, windows; or hash and times (see Shard)."""
    dealt = parts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(window), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last and shard.windows >= CHUNK_WINDOWS:
                    out += shard.finish()
                last = row[:2]
                shard.add(row)
            yield rows(out)
        yield rows(shard.finish())

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["rid", "start", "windows", "hash", "times"])

    return dealt.mapInArrow(run, "rid long, start long, windows long, hash long, times long")


def cut(texts: DataFrame, window: int) -> DataFrame:
    """rid, n_removed, kept of texts with their located ``runs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = spaced()
        for batch in batches:
            for row, words in word_slices(batch.column(1), inside, lower=False):
                n = len(words.first) - 1
                gone, kept = [], []
                for t in range(n):
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    steps = np.zeros(b - a + 1, np.int64)
                    for r in batch.column(2)[row + t].as_py():
                        steps[r["start"]] += 1
                        steps[r["start"] + r["windows"] + window - 1] -= 1
                    stays = np.flatnonzero(np.cumsum(steps[:-1]) == 0) + a
                    gone.append(b - a - len(stays))
                    kept.append(b" ".join(words.text(k, k + 1) for k in stays.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary())], names=["rid", "n_removed", "kept"])

    return texts.select("rid", "text", "runs").mapInArrow(
        run, "rid long, n_removed long, kept binary").select(
        "rid", "n_removed", F.col("kept").cast("string").alias("kept"))


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
             share: int = SHARE, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256, and the kept words if
    asked (null where nothing was removed)."""
    source = docs.select(F.col(key).alias("doc_key"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select("doc_key", F.unhex(F.md5("text")).alias("digest"), "text")
    described = stored(describe(source, window), "phrases-described")

    # one text of each set of copies; its number stays the same once written
    classes = described.groupBy(F.col("digest").alias("of")).agg(
        F.min("doc_key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
    single = stored(described.join(classes, (F.col("digest") == F.col("of"))
                                   & F.col("doc_key").eqNullSafe(F.col("first_key")))
                    .select(F.monotonically_increasing_id().alias("rid"), "doc_key", "digest",
                            "copies", "anchors"), "phrases-single")

    met = single.select("rid", F.explode("anchors").alias("anchor"))
    again = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchor", F.ceil(F.col("n") / share).cast("long").alias("salts"))
    wanted = met.distinct().join(again, "anchor").groupBy("rid").agg(
        F.collect_list(F.struct("anchor", "salts")).alias("wanted"))
    asked = single.select("rid", F.col("doc_key").alias("k"), F.col("digest").alias("d")).join(
        wanted, "rid")
    texts = stored(source.join(asked, F.col("doc_key").eqNullSafe(F.col("k"))
                               & (F.col("digest") == F.col("d")))
                   .select("rid", "text", "wanted.anchor", "wanted.salts"), "phrases-texts")

    located = stored(locate(stretches(texts, window), window), "phrases-located")
    # windows a salted shard met once, counted over all shards of their anchor
    once = located.where("hash IS NOT NULL")
    across = once.groupBy("hash").agg(F.count(F.lit(1)).alias("shards")).where("shards > 1")
    late = once.where("times = 1").join(across, "hash", "left_semi").select(
        "rid", "start", F.lit(1).cast("long").alias("windows"))
    runs = (located.where("windows IS NOT NULL").select("rid", "start", "windows").unionByName(late)
            .groupBy("rid").agg(F.collect_list(F.struct("start", "windows")).alias("runs")))
    done = cut(texts.dropDuplicates(["rid"]).join(runs, "rid"), window)
    done = stored(done.select("rid", "n_removed", F.sha2("kept", 256).alias("sha"),
                              *(["kept"] if with_text else [])), "phrases-cut")

    result = single.select("rid", F.col("digest").alias("of"), "copies").join(done, "rid", "left")
    result = result.dropDuplicates(["of"])
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = described.join(result, F.col("digest") == F.col("of"), "left").select(
        F.col("doc_key").alias(key), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
        .alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole"))
        .alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept_text")]
          if with_text else []))
    return out
