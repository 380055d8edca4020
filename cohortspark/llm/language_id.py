"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a
word is the sum over all ways to segment it into pieces, computed by the forward algorithm; a
text's score for a language is the sum of its words' log-probabilities. A character that is no
piece of its own counts as the vocabulary's byte pieces of its UTF-8 form. Piece probabilities
are learned by expectation-maximisation: forward-backward gives each piece's expected count in
the training words, starting from equal probabilities for all pieces, until a round raises no
language's likelihood by more than ``TOLERANCE`` of itself.

The model is fitted on at most about ``train_rows`` labelled rows a language (all rows where
there are fewer; chosen by a hash of the key), a documented bound; their words are counted in
Spark, and each round is one job over the counted words whose result has at most pieces x
languages rows. Prediction reads every whole text in one pass without a shuffle; words are
scored once per worker and remembered in a bounded table, which all tasks of a worker share.

Words are runs of letters in lower case, of any length: forward sums are rescaled where they
get small, and only the last few are held. A very long word costs some 20 microseconds a letter.
Null text and text without a letter get ``und`` and score 0. The score is the posterior of the
predicted language, all languages being equally likely before; ties go to the first label in
order. Rows are predicted one by one, repeated ones too; only the text is looked at, and other
columns are not read, so their names cannot clash. If no row has a label, every text is ``und``.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored
from cohortspark.llm.word_tokens import byte_slices

UNKNOWN = "und"
TRAIN_ROWS = 20_000
TOLERANCE = 1e-3  # of the log-likelihood, by which a last round may still raise it
SMOOTHING = 0.05
SMALL = 1e-120  # forward and backward sums below are rescaled
REMEMBERED = 500_000
LONGEST_REMEMBERED = 40
SLICE_BYTES = 2_000_000
WORDS_AT_ONCE = 20_000
START = "▁"
CHUNK = regex.compile(rb"[A-Za-z\x80-\xff]+")
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_words(chunk: bytes) -> list[str]:
    """The words of a run of letter-like bytes."""
    return LETTERS.findall(chunk.decode("utf-8", "replace").lower())


class PieceLattice:
    """All segmentations of words into pieces, many words at a time.

    Pieces are numbered in order, then the 256 byte pieces. Rows of probabilities ``p`` follow
    these numbers; the last row, of no piece, is zeros.
    """

    _shared: dict[str, PieceLattice] = {}

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({model.id_to_piece(i) for i in range(model.vocab_size())
                         if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.first_byte = len(pieces)
        self.size = len(pieces) + 256
        self.longest = max(map(len, pieces))
        # every start of a piece by its hash: the piece that it is itself, and whether one goes on
        starts: dict[int, int] = {}
        goes_on = set()
        for i, piece in enumerate(pieces):
            h = 0
            for k, c in enumerate(piece):
                h = (h * int(BASE) + ord(c) + 1) % 2**64
                if k < len(piece) - 1:
                    starts.setdefault(h, -1)
                    goes_on.add(h)
            starts[h] = i
        self.hashes = np.array(sorted(starts), np.uint64)
        self.piece = np.array([starts[h] for h in sorted(starts)])
        self.goes_on = np.array([h in goes_on for h in sorted(starts)])

    @classmethod
    def shared(cls, path: str) -> PieceLattice:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def spans(self, words: list[str]) -> Iterator[list[tuple]]:
        """For each position of words of one length, what may start there in some of them.

        (end, rows, pieces, None), or (end, rows, None, characters) of those that are no piece.
        """
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n)
        for i in range(n):
            found = []
            live, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for k in range(i, min(n, i + self.longest)):
                h = h * BASE + codes[live, k].astype(np.uint64) + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                whole = known & (self.piece[at] >= 0)
                if whole.any():
                    found.append((k + 1, live[whole], self.piece[at[whole]], None))
                if k == i and not whole.all():
                    found.append((k + 1, live[~whole], None, codes[live[~whole], k]))
                onward = known & self.goes_on[at]
                live, h = live[onward], h[onward]
                if not len(live):
                    break
            yield found

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Groups of words of one length: places, and the words with the start mark."""
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for places in groups.values():
            for at in range(0, len(places), WORDS_AT_ONCE):
                part = places[at:at + WORDS_AT_ONCE]
                yield np.array(part), [START + words[i] for i in part]

    def byte_pieces(self, chars: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """Byte pieces of each distinct character, and which of them each character is."""
        distinct, which = np.unique(chars, return_inverse=True)
        return [[self.first_byte + b for b in chr(c).encode("utf-8", "surrogatepass")]
                for c in distinct.tolist()], which

    def weight(self, pieces: np.ndarray | None, chars: np.ndarray | None,
               p: np.ndarray) -> np.ndarray:
        """Probability of each span, a column a language."""
        if chars is None:
            return p[pieces]
        spelled, which = self.byte_pieces(chars)
        return np.array([p[b].prod(axis=0) for b in spelled])[which]

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Words x languages."""
        out = np.zeros((len(words), p.shape[1]))
        for places, marked in self.by_length(words):
            shape = (len(places), p.shape[1])
            # sums of the positions from i on, in a ring; each in the same scale
            ring = [np.zeros(shape) for _ in range(self.longest + 1)]
            ring[0][:] = 1.0
            scale = np.zeros(shape)
            for i, found in enumerate(self.spans(marked)):
                here = ring[i % len(ring)]
                if here.min() < SMALL:
                    by = here.copy()
                    for sums in ring:
                        sums /= by
                    scale += np.log(by)
                for j, rows, pieces, chars in found:
                    ring[j % len(ring)][rows] += here[rows] * self.weight(pieces, chars, p)
                here[:] = 0.0  # becomes the position behind the ring's last
            out[places] = np.log(ring[len(marked[0]) % len(ring)]) + scale
        return out

    def expected_counts(self, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in ``words``, each seen ``times``; ``p`` has one column.

        The last entry is the words' log-likelihood.
        """
        total = np.zeros(self.size + 1)
        for places, marked in self.by_length(words):
            n, count = len(marked[0]), len(places)
            met, shares = [], []
            spans = [[(j, rows, pieces, chars, self.weight(pieces, chars, p))
                      for j, rows, pieces, chars in found] for found in self.spans(marked)]
            ways = [np.zeros((count, 1)) for _ in range(n + 1)]
            ways[0][:] = 1.0
            scale = [np.zeros((count, 1))]
            for i in range(n):
                if ways[i].min() < SMALL:
                    by = ways[i].copy()
                    for j in range(i, min(n, i + self.longest) + 1):
                        ways[j] /= by
                    scale[i] = scale[i] + np.log(by)
                for j, rows, _, _, weight in spans[i]:
                    ways[j][rows] += ways[i][rows] * weight
                scale.append(scale[i])
            whole = np.log(ways[n]) + scale[n]
            total[self.size] += float((whole[:, 0] * times[places]).sum())
            rest = [np.zeros((count, 1)) for _ in range(n)] + [np.ones((count, 1))]
            back = np.zeros((count, 1))
            for i in range(n - 1, -1, -1):
                inside = ways[i] * np.exp(scale[i] + back - whole) * times[places][:, None]
                for j, rows, pieces, chars, weight in spans[i]:
                    onward = weight * rest[j][rows]
                    rest[i][rows] += onward
                    share = (inside[rows] * onward)[:, 0]
                    if chars is None:
                        met.append(pieces)
                        shares.append(share)
                    else:
                        spelled, which = self.byte_pieces(chars)
                        for b, x in zip(spelled, np.bincount(which, share), strict=True):
                            np.add.at(total, b, x)
                if rest[i].min() < SMALL:
                    by = rest[i].copy()
                    for j in range(i, min(n, i + self.longest) + 1):
                        rest[j] /= by
                    back = back + np.log(by)
            total += np.bincount(np.concatenate([*met, np.zeros(0, np.int64)]),
                                 np.concatenate([*shares, np.zeros(0)]), self.size + 1)
        return total


def is_training(key: Column) -> Column:
    """Rows whose CRC-32 of the key as text leaves another remainder than 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 != 1, F.lit(False))


def training_words(docs: DataFrame, text: str, key: str, lang: str, train_rows: int) -> DataFrame:
    """Counted words of the training rows: label, word, n."""
    rows = docs.where(is_training(F.col(key)) & F.col(lang).isNotNull())
    shares = rows.groupBy(F.col(lang).alias("label")).agg(
        F.least(F.lit(1.0), F.lit(float(train_rows)) / F.count(F.lit(1))).alias("share"))
    shares = F.broadcast(shares)  # one row a language
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) / 1_000_000
    chosen = (rows.select(F.col(lang).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("t"),
                          place.alias("place"))
              .join(shares, "label").where("place < share").select("label", "t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for first, texts in byte_slices(batch.column(1), SLICE_BYTES):
                seen: dict[str, Counter] = defaultdict(Counter)
                for label, t in zip(labels[first:], texts):
                    seen[label].update(CHUNK.findall(t))
                rows = Counter()
                for label, chunks in seen.items():
                    for c, n in chunks.items():
                        for w in letter_words(c):
                            rows[label, w] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()),
                     pa.array([r[1] for r in rows], pa.string()),
                     pa.array(list(rows.values()), pa.int64())], names=["label", "word", "n"])

    counted = chosen.mapInArrow(count, "label string, word string, n long")
    return counted.groupBy("label", "word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, pieces: str,
        tolerance: float = TOLERANCE) -> tuple[list[str], np.ndarray]:
    """Labels in order and the (pieces + 1) x labels probabilities, the last row zeros."""
    labels = [r.label for r in words.select("label").distinct().orderBy("label").collect()]
    size = PieceLattice.shared(pieces).size
    place = {label: k for k, label in enumerate(labels)}
    p = np.full((size + 1, len(labels)), 1.0 / size)
    p[size] = 0.0
    context = words.sparkSession.sparkContext
    likelihood = np.full(len(labels), -np.inf)
    while labels:
        sent = context.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, total = PieceLattice.shared(pieces), {}
            held: dict[str, list[tuple[str, int]]] = defaultdict(list)

            def take(k: str) -> None:
                words, times = zip(*held.pop(k), strict=True)
                got = lattice.expected_counts(list(words), np.array(times, float),
                                              sent.value[:, [place[k]]])
                total[k] = total.get(k, 0.0) + got

            for batch in batches:
                for label, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held[label].append((word, n))
                for k in [k for k, found in held.items() if len(found) >= WORDS_AT_ONCE]:
                    take(k)
            for k in list(held):
                take(k)
            for k, counts in total.items():
                piece = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[k]] * len(piece), pa.int32()),
                     pa.array(piece.astype(np.int32)), pa.array(counts[piece])],
                    names=["label", "piece", "n"])

        got = (words.mapInArrow(expect, "label int, piece int, n double")
               .groupBy("label", "piece").agg(F.sum("n").alias("n")).toArrow())
        counts = np.zeros((size + 1, len(labels)))
        counts[got["piece"].to_numpy(), got["label"].to_numpy()] = got["n"].to_numpy()
        before, likelihood = likelihood, counts[size]
        if (likelihood - before <= tolerance * np.abs(likelihood)).all():
            break
        p = p.copy()
        p[:size] = (counts[:size] + SMOOTHING) / (counts[:size].sum(axis=0) + SMOOTHING * size)
    return labels, p


class WordScores:
    """Remembered log-probabilities of chunks, one row of a growing array each."""

    _shared: dict[tuple[str, bytes], WordScores] = {}

    @classmethod
    def shared(cls, pieces: str, p: np.ndarray) -> WordScores:
        """The worker's memory for one model; another model's is given up."""
        key = pieces, hashlib.sha256(p.tobytes()).digest()
        if key not in cls._shared:
            cls._shared = {key: cls(PieceLattice.shared(pieces), p)}
        return cls._shared[key]

    def __init__(self, lattice: PieceLattice, p: np.ndarray) -> None:
        self.lattice, self.p = lattice, p
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.p.shape[1] + 1))

    def learn(self, chunks: list[bytes]) -> None:
        """Rows for new chunks: log-probability by language, then the number of words."""
        split = [letter_words(c) for c in chunks]
        words = list({w for ws in split for w in ws})
        scores = self.lattice.log_probabilities(words, self.p)
        at = {w: i for i, w in enumerate(words)}
        fresh = np.zeros((len(chunks), self.p.shape[1] + 1))
        for i, ws in enumerate(split):
            if len(ws) == 1:
                fresh[i, :-1] = scores[at[ws[0]]]
            elif ws:
                fresh[i, :-1] = scores[[at[w] for w in ws]].sum(axis=0)
            fresh[i, -1] = len(ws)
        for i, c in enumerate(chunks, len(self.rows)):
            self.row[c] = i
        self.rows = np.concatenate([self.rows, fresh])

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Texts x (languages, words): summed rows of their chunks."""
        chunks = [CHUNK.findall(t) for t in texts]
        new = {c for cs in chunks for c in cs if c not in self.row}
        if new:
            self.learn(list(new))
        row = self.row.__getitem__
        out = np.array([self.rows[np.fromiter(map(row, cs), np.int64, len(cs))].sum(axis=0)
                        for cs in chunks]).reshape(len(texts), -1)
        if len(self.row) > REMEMBERED or any(len(c) > LONGEST_REMEMBERED * 100 for c in new):
            self.clear()
        return out


def predict(docs: DataFrame, labels: list[str], p: np.ndarray, pieces: str, text: str = "text",
            key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores.shared(pieces, sent.value)
        for batch in batches:
            for first, texts in byte_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(first, len(texts))
                got = scores.texts(texts)
                named, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if labels:
                    best = got[:, :-1].argmax(axis=1)
                    top = got[np.arange(len(texts)), best]
                    share = 1.0 / np.exp(got[:, :-1] - top[:, None]).sum(axis=1)
                    for i in np.flatnonzero(got[:, -1]):
                        named[i], sure[i] = labels[best[i]], float(share[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(named), pa.array(sure)],
                    names=[key, "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
    wanted = docs.select(F.col(key), held_out.alias("held_out"),
                         F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return wanted.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, "
                                  "score double")


def identify(docs: DataFrame, pieces: str, text: str = "text", key: str = "doc_id",
             lang: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the training rows of ``docs`` and predict all rows."""
    words = stored(training_words(docs, text, key, lang, train_rows), "language-words")
    labels, p = fit(words, pieces)
    return predict(docs, labels, p, pieces, text, key)
