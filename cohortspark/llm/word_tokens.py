"""Token ids of whole texts through a per-word memory.

The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are
the ids of its white-space separated words in turn. Each worker remembers the ids of words it
has met (a bounded table, emptied when full) and asks the tokenizers library only for new ones.
Texts in which a special token's string may occur are encoded whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

REMEMBERED = 1_600_000
WORDS_AT_ONCE = 2000
LONGEST_REMEMBERED = 40
# a word that ends in ASCII letters, then closing marks: the marks are tokens of their own
TAIL = re.compile(rb"([^<']*[a-z])([.,;:!?*#$%&|]+)")
SPECIAL = b"<|"


class WordEncoder:
    """Little-endian 32-bit ids of texts, one memory for all tasks of a worker process."""

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids: dict[bytes, bytes] = {}
        specials = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                          if t.special and not (t.lstrip or t.rstrip))
        self.parting = specials[-1] if specials else None

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the library."""
        return [struct.pack(f"<{len(e)}I", *e.ids)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words. A special token parts them in one text, which is cut at its id."""
        if self.parting is None:
            return self.whole([w.decode() for w in words])
        found = []
        mark, between = self.parting[0], self.parting[1].encode()
        for at in range(0, len(words), WORDS_AT_ONCE):
            joined = between.join(words[at:at + WORDS_AT_ONCE]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids,
                           "<u4")
            raw, marks = ids.tobytes(), np.flatnonzero(ids == mark)
            found += [raw[a:b] for a, b in zip([0, *(4 * (marks + 1)).tolist()],
                                               [*(4 * marks).tolist(), len(raw)], strict=True)]
        return found

    def learn(self, words: set[bytes]) -> list[bytes]:
        """Add the ids of new words to the memory; the long ones, to be forgotten soon."""
        tails = {w: m.groups() for w in words if (m := TAIL.fullmatch(w))}
        parts = {w for w in words if w not in tails}.union(*tails.values())
        new = [p for p in parts if p not in self.ids]
        ids = self.ids
        ids.update(zip(new, self.each(new), strict=True))
        for w, (core, marks) in tails.items():
            ids[w] = ids[core] + ids[marks]
        return [w for w in chain(new, tails) if len(w) > LONGEST_REMEMBERED]

    def encode(self, texts: list[bytes]) -> list[bytearray]:
        """Ids of each text (UTF-8)."""
        # bytes.lower and bytes.split know ASCII only: other capitals and spaces are the tokenizer's
        words = [None if SPECIAL in t else t.lower().split() for t in texts]
        look = self.ids.get
        found = [None if ws is None else list(map(look, ws)) for ws in words]
        unknown = {w for ws, ids in zip(words, found, strict=True) if ids and None in ids
                   for w, i in zip(ws, ids, strict=True) if i is None}
        long_words = self.learn(unknown)
        encoded = []
        for t, ws, ids in zip(texts, words, found, strict=True):
            if ws is None:
                encoded.append(bytearray(self.whole([t.decode()])[0]))
            else:
                if unknown and None in ids:
                    ids = [look(w) if i is None else i for w, i in zip(ws, ids, strict=True)]
                encoded.append(bytearray(b"".join(ids)))
        if len(self.ids) > REMEMBERED:
            self.ids = {}
        else:
            for w in long_words:
                self.ids.pop(w, None)
        return encoded

    def encode_column(self, column: pa.Array, most: int) -> Iterator[tuple[int, list[bytearray]]]:
        """Ids of a text column in slices of about ``most`` bytes, with each slice's first row."""
        for first, texts in byte_slices(column, most):
            yield first, self.encode(texts)


def byte_slices(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts as UTF-8, in runs of about ``most`` bytes."""
    first, size, texts = 0, 0, []
    for i, value in enumerate(column.cast(pa.binary())):
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            first, size, texts = i + 1, 0, []
    if texts:
        yield first, texts
