"""Byte-level BPE with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves of a segment tree; a leaf holds the rank of the pair it
forms with its right neighbour (and its place, so that the minimum is the leftmost pair of the
lowest rank). The root names the next merge. A merge changes three leaves, and the tree is
mended on their paths alone: a logarithmic point update. Merging ends when the root is empty.
The trees of many words of like length are rows of one array and advance together, so each
step is a few array operations however many words take part; a word of any length is encoded
in about n log n steps.

A text is cut into words by the vocabulary's own pattern. White space starts a word and is
never followed across the next one, so a text is first cut at white space and the ids of each
cut are remembered per worker (a bounded table). Null text counts as empty and gives no ids,
the digest of nothing and an empty decoded text. A special token's string in a text is that
token, as the tokenizers library has it. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.word_tokens import byte_slices

# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                r"|\s+(?!\S)|\s+")
# white space that bytes.split and friends do not know
OTHER_SPACE = regex.compile(r"[^\P{White_Space}\t-\r ]")
CUT = regex.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+\z".replace(rb"\z", rb"\Z"))
# an optional line end, a word of ASCII or Latin-1 letters, a full stop or comma: cut as it stands
SIMPLE = re.compile(rb"(\n?)( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")
REMEMBERED = 500_000
LONGEST_REMEMBERED = 40
SLICE_BYTES = 1_000_000
TREE_CELLS = 1 << 21  # leaves handled at once
NONE = np.int64(1) << np.int64(62)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, and their bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers format."""

    _shared: dict[str, ByteBpe] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, symbols = data["model"]["vocab"], byte_symbols()
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])])
                                 + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in token) if all(
                c in symbols for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])],
                                np.int64)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m)
                  for m in data["model"]["merges"]]
        self.base = np.int64(len(self.bytes_of))
        pairs = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank = pairs[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.words = regex.compile(WORD_PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.marks = [s.encode() for s in self.special]
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]
        # ids of words and cuts, little-endian 32-bit and in decimal with commas
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    @classmethod
    def shared(cls, path: str) -> ByteBpe:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of each word in both forms; words are grouped by the size of their trees."""
        found: list[tuple[bytes, bytes]] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for size, rows in by_size.items():
            step = max(1, TREE_CELLS // size)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], size), strict=True):
                    found[i] = ids
        return found

    def _merge(self, words: list[bytes], size: int) -> list[tuple[bytes, bytes]]:
        n = len(words)
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8)
        sym = self.byte_id[raw].reshape(n, size)
        place = np.arange(size)
        inside = place[None, :] < lengths[:, None]
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        # leaf: rank * size + place
        rank = np.full((n, size), NONE, np.int64)
        rank[:, :-1] = self.ranks(sym[:, :-1], sym[:, 1:])
        paired = place[None, :] + 1 < lengths[:, None]
        tree[:, size:] = np.where(paired & (rank < NONE), rank * size + place, NONE)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2],
                                             tree[:, level + 1:2 * level:2])
            level = half
        alive = inside
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % size
            gone = after[rows, at]
            sym[rows, at] = self.merged[root // size]
            alive[rows, gone] = False
            nxt = after[rows, gone]
            after[rows, at] = nxt
            has_next = nxt < lengths[rows]
            before[rows[has_next], nxt[has_next]] = at[has_next]
            prev = before[rows, at]
            leaf = np.concatenate([gone, at, np.maximum(prev, 0)])
            who = np.concatenate([rows, rows, rows])
            value = np.full(len(leaf), NONE)
            k = len(rows)
            r = self.ranks(sym[rows, at], sym[rows, np.minimum(nxt, size - 1)])
            value[k:2 * k] = np.where(has_next & (r < NONE), r * size + at, NONE)
            r = self.ranks(sym[rows, np.maximum(prev, 0)], sym[rows, at])
            value[2 * k:] = np.where(r < NONE, r * size + prev, NONE)
            keep = np.ones(3 * k, bool)
            keep[2 * k:] = prev >= 0
            leaf, who, value = leaf[keep] + size, who[keep], value[keep]
            tree[who, leaf] = value
            while leaf[0] > 1:
                leaf = leaf >> 1
                tree[who, leaf] = np.minimum(tree[who, 2 * leaf], tree[who, 2 * leaf + 1])
            rows = rows[tree[rows, 1] < NONE]
        flat, bounds = sym[alive], np.concatenate([[0], np.cumsum(alive.sum(axis=1))]).tolist()
        raw, shown = flat.astype("<u4").tobytes(), [self.decimal[i] for i in flat.tolist()]
        return [(raw[4 * a:4 * b], b",".join(shown[a:b]))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def learn(self, cuts: set[bytes]) -> list[bytes]:
        """Remember the ids of new cuts; the long ones are returned, to be forgotten soon."""
        known, simple, words = self.known, SIMPLE.fullmatch, self.words.findall
        parts = {c: list(filter(None, m.groups())) if (m := simple(c))
                 else [w.encode() for w in words(c.decode())] for c in cuts}
        new = [w for w in set(chain.from_iterable(parts.values())) if w not in known]
        known.update(zip(new, self.merge_words(new), strict=True))
        for c, ws in parts.items():
            if c not in known:
                ids = [known[w] for w in ws]
                known[c] = (b"".join([i[0] for i in ids]), b",".join([i[1] for i in ids]))
        return [w for w in chain(new, parts) if len(w) > LONGEST_REMEMBERED]

    def cuts(self, text: bytes) -> list[bytes]:
        """The text in cuts that encode on their own."""
        if text.isascii() and not any(c in text for c in b"\x1c\x1d\x1e\x1f"):
            return CUT.findall(text)
        if OTHER_SPACE.search(text.decode()) or any(c in text for c in b"\x1c\x1d\x1e\x1f"):
            return [text] if text else []
        return CUT.findall(text)

    def pieces(self, text: bytes) -> list[bytes | int]:
        """Cuts of the text, with special tokens as their ids."""
        if not any(m in text for m in self.marks):
            return self.cuts(text)
        found, at, shown = [], 0, text.decode()
        for m in self.specials.finditer(shown):
            found += [*self.cuts(shown[at:m.start()].encode()), self.special[m.group()]]
            at = m.end()
        return found + self.cuts(shown[at:].encode())

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text (UTF-8): its ids as little-endian 32-bit, and in decimal with commas."""
        pieces = [self.pieces(t) for t in texts]
        for i in self.special.values():
            self.known[i] = (int(i).to_bytes(4, "little"), str(i).encode())
        long_words = self.learn({p for ps in pieces for p in ps if p not in self.known})
        known = self.known
        encoded = []
        for ps in pieces:
            parts = [known[p] for p in ps]
            encoded.append((b"".join([p[0] for p in parts]), b",".join([p[1] for p in parts])))
        if len(self.known) > REMEMBERED:
            self.known = {}
        else:
            for w in long_words:
                self.known.pop(w, None)
        return encoded

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian 32-bit ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode_and_decode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
                      with_outputs: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and the ids and decoded text if asked."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.shared(tokenizer)
        for batch in batches:
            for first, texts in byte_slices(batch.column(1), SLICE_BYTES):
                encoded = bpe.encode(texts)
                decoded = [bpe.decode(ids).decode("utf-8", "replace") for ids, _ in encoded]
                columns = [batch.column(0).slice(first, len(texts)),
                           pa.array([len(ids) // 4 for ids, _ in encoded], pa.int64()),
                           pa.array([hashlib.sha256(d).hexdigest() for _, d in encoded]),
                           pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_outputs:
                    columns += [pa.array([np.frombuffer(ids, "<u4").astype(np.int32)
                                          for ids, _ in encoded], pa.list_(pa.int32())),
                                pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_outputs:
        schema += ", ids array<int>, decoded string"
    wanted = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return wanted.mapInArrow(run, schema)
