"""URL filters as one bit-parallel wildcard automaton.

Every glob rule becomes a run of bits in multiword Shift-And masks: a literal symbol moves its
bit on, ``*`` makes a bit hold itself on any symbol. All rules advance together, one symbol
column of a whole batch of URLs at a time, so a batch of n URLs of length m takes m steps on an
n x words matrix whatever the number of rules.

The canonical URL is the host, a separator that no text contains, and the path. A rule
``host/path`` is two globs, ``host SEP path*`` and ``*.host SEP path*``, which makes it fit the
host and its subdomains. Among fitting site rules the longest wins; equal lengths are decided
by the rule listed first. Where no site rule fits, the verdict is the method's: ``block`` if
one of the general globs fits or the URL has no host, else ``allow``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has empty host and
path and no rule. Repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.exact_dedup import ascii_lower

# The site rules (verdict, rule).
SITE_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# General globs over host SEP path, ``^`` standing for the separator.
BLOCK_GLOBS = ("*casino*^*", "*cheap-pills*^*", "*spam*^*", "*porn*^*", "*xxx*^*",
               "*^*/wp-login*", "*^*/cgi-bin/*", "*^*/cart/*", "*^*/login*", "*^*.exe")
SEPARATOR = 256
WORD = 64
SLICE_ROWS = 2048


class ShiftAnd:
    """Multiword Shift-And over byte strings with one separator symbol."""

    def __init__(self, globs: Sequence[str]) -> None:
        states = [self._states(g) for g in globs]
        total = sum(len(s) for s in states)
        self.words = max(1, -(-total // WORD))
        self.masks = np.zeros((SEPARATOR + 1, self.words), np.uint64)
        self.hold = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        at = 0
        for run in states:
            # a run's first state stands for "nothing read yet"
            self._set(self.start, at)
            for i, (symbol, holds) in enumerate(run):
                if symbol is not None:
                    self._set(self.masks[symbol], at + i)
                if holds:
                    self._set(self.hold, at + i)
            at += len(run)
            self.final.append(divmod(at - 1, WORD))

    @staticmethod
    def _states(glob: str) -> list[list]:
        """Start state, then one state a literal; ``*`` lets the state before it hold."""
        run: list[list] = [[None, False]]
        for part in glob:
            if part == "*":
                run[-1][1] = True
            else:
                symbols = [SEPARATOR] if part == "^" else list(part.encode())
                run += [[s, False] for s in symbols]
        return run

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // WORD] |= np.uint64(1 << (bit % WORD))

    def fits(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """URLs x rules: which rules fit; ``symbols`` is URLs x longest, padded at the right."""
        state = np.tile(self.start, (len(lengths), 1))
        order = np.argsort(-lengths, kind="stable")
        state, symbols, lengths = state[order], symbols[order], lengths[order]
        one, top = np.uint64(1), np.uint64(WORD - 1)
        for i in range(symbols.shape[1]):
            live = int(np.searchsorted(-lengths, -i, side="left"))  # those longer than i
            if not live:
                break
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.masks[symbols[:live, i]]) | (now & self.hold)
        found = np.empty((len(lengths), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            found[order, k] = (state[:, word] >> np.uint64(bit)) & one
        return found


def site_globs(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return f"{host}^{slash}{path}*", f"*.{host}^{slash}{path}*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (ascii_lower(F.regexp_extract(after, r"\A([^/?#]*)", 1)),
            F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1))


def symbol_matrix(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of host, separator and path, one URL a row."""
    lengths = np.array([len(h) + len(p) + 1 for h, p in zip(hosts, paths, strict=True)])
    symbols = np.zeros((len(hosts), int(lengths.max(initial=0))), np.uint16)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        symbols[i, :len(h)] = np.frombuffer(h, np.uint8)
        symbols[i, len(h)] = SEPARATOR
        symbols[i, len(h) + 1:lengths[i]] = np.frombuffer(p, np.uint8)
    return symbols, lengths


def judge_urls(pages: DataFrame, url: str = "url", key: str = "page_id",
               rules: Sequence[tuple[str, str]] = SITE_RULES,
               block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """One row per page: key, host, path, rule, verdict."""
    key_type = pages.schema[key].dataType.simpleString()
    ranked = sorted(rules, key=lambda r: -len(r[1]))  # stable: ties stay as listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([g for _, r in ranked for g in site_globs(r)] + list(block_globs))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                hosts, paths = (part.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
                # URLs of like length go together, so that a long one widens few rows
                by_length: dict[int, list[int]] = {}
                for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                    by_length.setdefault((len(h) + len(p)).bit_length(), []).append(i)
                rule, verdict = [None] * len(hosts), [""] * len(hosts)
                for rows in by_length.values():
                    found = automaton.fits(*symbol_matrix([hosts[i] for i in rows],
                                                          [paths[i] for i in rows]))
                    for i, fits in zip(rows, found, strict=True):
                        rule[i], verdict[i] = decide(fits, bool(hosts[i]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=[key, "host", "path", "rule", "verdict"])

    def decide(fits: np.ndarray, has_host: bool) -> tuple[str | None, str]:
        if has_host:
            for k, (says, name) in enumerate(ranked):
                if fits[2 * k] or fits[2 * k + 1]:
                    return name, says
        blocked = not has_host or fits[2 * len(ranked):].any()
        return None, "block" if blocked else "allow"

    host, path = url_parts(F.col(url))
    return pages.select(F.col(key), host.alias("host"), path.alias("path")).mapInArrow(
        run, f"`{key}` {key_type}, host string, path string, rule string, verdict string")
