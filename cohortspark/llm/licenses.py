"""License scans with a generalised suffix automaton.

The automaton is built once per worker over the words of all templates. A text's words are
streamed through it and give matching statistics: at each word the longest run ending there
that occurs in some template. Runs of at least ``LEAST_MATCH`` words are chained per template,
in the order of text and template, by a weighted chain over template places; what the best
chain covers of a template is its coverage. A label holds if one of its templates is covered to
``LEAST_COVERAGE`` or one of its phrases stands in the text. Phrases are found apart, at every
place where their words stand consecutively.

Words outside all templates end a match at once, so only runs of known words reach the
automaton; knownness is tested on word hashes of a whole slice at a time.

Null text counts as empty: no words, no labels, score 0. The score is 1 with a phrase, else the
largest coverage. Texts are scanned whole, one by one; repeated rows are scanned each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.license_texts import PHRASES, TEMPLATES
from cohortspark.llm.words import Words, alphanumeric, ascii_lowered, find_words, word_slices

LEAST_MATCH = 4
LEAST_COVERAGE = 0.6


class SuffixAutomaton:
    """All substrings of several word sequences, with the places where they end."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end)
        for s, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, w)
                self.ends[last].append((s, i + 1))
        # a state's places are also those of the states it links to
        for state in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            held = self.next[last][w]
            return held if self.length[held] == self.length[last] + 1 else self._copy(last, w, held)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            held = self.next[at][w]
            self.link[new] = (held if self.length[held] == self.length[at] + 1
                              else self._copy(at, w, held))
        return new

    def _copy(self, at: int, w: int, held: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[held], dict(self.next[held]))
        self.link[held] = copy
        while at >= 0 and self.next[at].get(w) == held:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def matches(self, words: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match that no longer one ending later contains."""
        state, length = 0, 0
        for i, w in enumerate(words):
            before = (i, length, state)
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length <= before[1] and before[1] >= least:
                yield before
        if length >= least:
            yield len(words), length, state


class Chain:
    """Heaviest chain of matches of one template, in the order they come."""

    def __init__(self) -> None:
        self.ends: list[int] = []      # rising template ends
        self.best: list[tuple] = []    # rising (covered, first text word, end of text match)

    def add(self, text_start: int, text_end: int, start: int, end: int) -> None:
        k = bisect_right(self.ends, start)
        covered, first = end - start, text_start
        if k:
            covered, first = covered + self.best[k - 1][0], self.best[k - 1][1]
        k = bisect_right(self.ends, end)
        if k and self.best[k - 1][0] >= covered:
            return
        if k and self.ends[k - 1] == end:
            k -= 1
        stop = k
        while stop < len(self.ends) and self.best[stop][0] <= covered:
            stop += 1
        self.ends[k:stop], self.best[k:stop] = [end], [(covered, first, text_end)]


class LicenseScanner:
    """Templates and phrases made ready for scanning slices of words."""

    def __init__(self, templates: Sequence[tuple[str, str]],
                 phrases: Sequence[tuple[str, str]]) -> None:
        words = [self._hashes(t) for t in (*(text for _, text in templates),
                                           *(phrase for phrase, _ in phrases))]
        self.known = np.unique(np.concatenate(words))
        ids = [np.searchsorted(self.known, w) for w in words]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(w) for w in ids[:len(templates)]]
        self.automaton = SuffixAutomaton([w.tolist() for w in ids[:len(templates)]])
        self.phrases = list(zip((label for _, label in phrases), ids[len(templates):], strict=True))

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        data = ascii_lowered()[np.frombuffer(text.encode(), np.uint8)]
        return find_words(data, np.array([0, len(data)]), alphanumeric()).hashes()

    @classmethod
    @cache
    def shared(cls, templates: tuple, phrases: tuple) -> LicenseScanner:
        return cls(templates, phrases)

    def scan(self, words: Words) -> list[dict]:
        """Findings of each text of a slice."""
        ids = self._ids(words.hashes())
        found = [{"places": [], "named": set(), "coverage": {}, "spans": []}
                 for _ in range(len(words.first) - 1)]
        for label, phrase in self.phrases:
            for text, place in self._places(words, ids, phrase):
                found[text]["places"].append(place)
                found[text]["named"].add(label)
        for text, start, stop in self._runs(words, ids):
            found[text].setdefault("chains", {})
            self._chain(found[text]["chains"], ids[start:stop].tolist(),
                        start - int(words.first[text]))
        for f in found:
            for t, chain in f.pop("chains", {}).items():
                covered, first, end = chain.best[-1]
                share = covered / self.sizes[t]
                label = self.labels[t]
                f["coverage"][label] = max(share, f["coverage"].get(label, 0.0))
                if share >= LEAST_COVERAGE:
                    f["spans"].append((label, first, end, share))
            f["spans"].sort()
        return found

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    @staticmethod
    def _places(words: Words, ids: np.ndarray, phrase: np.ndarray) -> Iterator[tuple[int, int]]:
        last = len(ids) - len(phrase) + 1
        if last < 1:
            return
        hit = np.ones(last, bool)
        for k, w in enumerate(phrase):
            hit &= ids[k:last + k] == w
        for at in np.flatnonzero(hit):
            text = int(np.searchsorted(words.first, at, side="right")) - 1
            if at + len(phrase) <= words.first[text + 1]:
                yield text, int(at - words.first[text])

    @staticmethod
    def _runs(words: Words, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, start, stop) of runs of known words long enough for a match."""
        n = len(ids)
        known = ids >= 0
        begins, closes = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        closes[:-1] &= ~known[1:]
        edges = words.first[:-1][np.diff(words.first) > 0]
        begins[edges] = known[edges]
        closes[edges[edges > 0] - 1] = known[edges[edges > 0] - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        long = stops - starts >= LEAST_MATCH
        texts = np.searchsorted(words.first, starts[long], side="right") - 1
        assert n == words.first[-1]
        yield from zip(texts.tolist(), starts[long].tolist(), stops[long].tolist(), strict=True)

    def _chain(self, chains: dict[int, Chain], run: list[int], first: int) -> None:
        for end, length, state in self.automaton.matches(run, LEAST_MATCH):
            for template, at in self.automaton.ends[state]:
                chains.setdefault(template, Chain()).add(
                    first + end - length, first + end, at - length, at)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id",
         templates: Sequence[tuple[str, str]] = TEMPLATES,
         phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and spans: label, first word, end word and coverage of covered templates."""
    kind = docs.schema[key].dataType.simpleString()
    templates, phrases = tuple(templates), tuple(phrases)
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                      ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, inside = LicenseScanner.shared(templates, phrases), alphanumeric()
        for batch in batches:
            for first, words in word_slices(batch.column(1), inside, lower=True):
                found = scanner.scan(words)
                labels = [f["named"] | {k for k, c in f["coverage"].items() if c >= LEAST_COVERAGE}
                          for f in found]
                score = [1.0 if f["named"] else min(1.0, max(f["coverage"].values(), default=0.0))
                         for f in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(found)),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([len(f["places"]) for f in found], pa.int64()),
                    pa.array([min(f["places"], default=None) for f in found], pa.int64()),
                    pa.array([max(f["places"], default=None) for f in found], pa.int64()),
                    pa.array([",".join(sorted(f["named"])) for f in found], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[dict(zip(("label", "first_word", "end_word", "coverage"), s,
                                        strict=True)) for s in f["spans"]] for f in found],
                             pa.list_(span))],
                    names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels",
                           "labels", "score", "spans"])

    wanted = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return wanted.mapInArrow(
        run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, "
             "base_labels string, labels string, score double, spans array<struct<label:string,"
             "first_word:bigint,end_word:bigint,coverage:double>>")
