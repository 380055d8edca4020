"""Small tables with the cases every operator must stand: nulls, ties, repeats, long texts."""

from __future__ import annotations

import random
import re
import string

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("digest", "node", "token", "row", "spans", "kept", "key", "n", "start", "label",
           "text_sha256", "component_id", "anchor", "rid", "gone", "s", "failed", "candidates")


def ascii_lower(text: str | None) -> str:
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def edge_texts() -> list[tuple]:
    """(doc_id, text) with nulls in both, empty and blank texts, repeats, ties and a long text."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ß", "日本", "x.y,", "AND", "the"]
    shared = [rng.choice(words) for _ in range(60)]
    rows: list[tuple] = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "A"), (6, "a b"), (None, "a"),
        (None, None), (7, "Mail joe@example.org or +1 (555) 555-1234 now"), (8, "x " * 9000),
        (9, "A" * 3000), (10, "Released under the MIT License. " * 3), (10, "other text"),
        (11, "4111 1111 1111 1111 at 10.0.0.255"), (12, "é̈ İ ² ½ ٣ \x85 \x1c"),
    ]
    rows += [(12, "repeated row")] * 3 + [(13, "Repeated row"), (14, "repeated ROW")]
    for i in range(20, 60):
        text: list[str] = []
        for _ in range(rng.randint(1, 4)):
            text += shared if rng.random() < 0.3 else [
                rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n"]).join(text)))
    rows += [(100 + i, rows[30][1]) for i in range(4)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, extra: bool = False, partitions: int = 3):
    """A documents table of (doc_id, text) rows, with clashing columns if asked."""
    langs, sources = ("en", "de", None), ("s0", "s1", None)
    data = [(k, t, langs[i % 3], sources[i % 2], len(t) if t is not None else None,
             *(["clash"] * len(CLASHES) if extra else [])) for i, (k, t) in enumerate(rows)]
    names = [f"{c} string" for c in CLASHES] if extra else []
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *names])
    return spark.createDataFrame(data, schema).repartition(partitions)
