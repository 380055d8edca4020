"""Harmonic packing of tokenised documents into sequences.

Documents fall into reciprocal-capacity classes: class j holds documents of more than
capacity / (j + 1) and at most capacity / j tokens, the last class (``CLASSES``) all shorter
ones. A bin of class j takes exactly j documents whole, whatever other classes or other workers
do. It then closes: the documents that come next fill its gap, whole where they fit, and the
first that does not fit gives its head and goes on with the rest. A document over the capacity
fills sequences of its own first. So a document is cut only where it exceeds the capacity or
closes a bin. Each task packs its own rows with at most one open bin a class (``CLASSES`` times
capacity ids) and nothing is shuffled. What is open at the end of a task is poured into full
sequences and last ones of a power of two tokens. Every sequence is therefore full or has a
power-of-two length, and needs no padding.

Null or empty text is the single end token. A row is packed once per row, so repeated rows
and repeated keys each get pieces of their own; columns other than key and text are not read, so
their names cannot clash. An empty table gives an empty result. A very long text is encoded whole
by one task. ``sequence_id`` is the task's number times 2**40 plus the task's count of sequences;
it depends on how the table is split into tasks but not on the order in which tasks run or are
repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.word_tokens import WordEncoder

CAPACITY = 4096
CLASSES = 64
END_ID = 2
SLICE_BYTES = 2_000_000
PIECE_COLUMNS = ("start long, length long, ids_crc32 long, doc_tokens long, "
                 "sequence_id long, offset long")


def full_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of full sequences and powers of two that ``tokens`` can be poured into."""
    whole, rest = divmod(tokens, capacity)
    return [capacity] * whole + [1 << k for k in reversed(range(rest.bit_length()))
                                 if rest >> k & 1]


class Bin:
    """Pieces of one sequence: (key, start, ids, tokens of the document)."""

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2]) // 4


class HarmonicBins:
    """Open bins of one task, one a class, and the bin whose gap is being filled."""

    def __init__(self, capacity: int, first_id: int, classes: int = CLASSES) -> None:
        self.capacity, self.next_id, self.classes = capacity, first_id, classes
        self.open: dict[int, Bin] = {}
        self.closing: Bin | None = None

    def add(self, key, ids: bytes) -> list[tuple]:
        """Pack a document of 4-byte ids; the rows of the sequences this completes."""
        total, start, done = len(ids) // 4, 0, []

        def piece(length: int) -> tuple:
            return key, start, ids[4 * start:4 * (start + length)], total

        if self.closing:
            head = min(total, self.capacity - self.closing.used)
            self.closing.add(piece(head))
            start = head
            if self.closing.used == self.capacity:
                done += self._place(self.closing)
                self.closing = None
        while total - start > self.capacity:
            alone = Bin()
            alone.add(piece(self.capacity))
            start += self.capacity
            done += self._place(alone)
        if start < total:
            count = min(self.capacity // (total - start), self.classes)
            home = self.open.setdefault(count, Bin())
            home.add(piece(total - start))
            if len(home.pieces) == count:
                done += self._complete(self.open.pop(count))
        return done

    def _complete(self, full: Bin) -> list[tuple]:
        """A bin with its count of documents leaves, or waits for its gap to be filled."""
        if full.used == self.capacity:
            return self._place(full)
        self.closing = full
        return []

    def _place(self, full: Bin) -> list[tuple]:
        placed, offset = [], 0
        for key, start, ids, total in full.pieces:
            placed.append((key, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        return placed

    def flush(self) -> list[tuple]:
        """Pour what is still open into full sequences and sequences of a power of two."""
        left = [*([self.closing] if self.closing else []),
                *(self.open[count] for count in sorted(self.open))]
        pieces = [p for b in left for p in b.pieces][::-1]
        placed = []
        for length in full_lengths(sum(b.used for b in left), self.capacity):
            poured = Bin()
            while poured.used < length:
                key, start, ids, total = pieces.pop()
                take = min(len(ids) // 4, length - poured.used)
                poured.add((key, start, ids[:4 * take], total))
                if 4 * take < len(ids):
                    pieces.append((key, start + take, ids[4 * take:], total))
            placed += self._place(poured)
        self.open, self.closing = {}, None
        return placed


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``tokenizer`` is the path of a tokenizers file.

    ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ready: list[tuple] = []
            keys = batch.column(0)
            for first, ids_of_docs in encoder.encode_column(batch.column(1), SLICE_BYTES):
                for i, ids in enumerate(ids_of_docs, first):
                    ready += bins.add(keys[i].as_py(), ids + end)
                if len(ready) > 50_000:
                    yield rows(ready, keys.type)
                    ready = []
            yield rows(ready, keys.type)
            last = keys.type
        if bins.open or bins.closing:
            yield rows(bins.flush(), last)

    def rows(placed: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*placed, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]],
            names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    wanted = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return wanted.mapInArrow(run, f"`{key}` {key_type.simpleString()}, {PIECE_COLUMNS}")
