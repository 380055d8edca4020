"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary over all digests (``approx_top_k``: a frequent-items sketch of
``tracked`` counters, merged over tasks) names the digests that can be frequent. Their exact
sizes and winners are counted with a map-side partial aggregate, and those at most ``heavy``
rows are broadcast, so copies of a frequent text are decided where they are read and never
meet in one task. All other digests are rarer than about 3.5 / ``tracked`` of the rows or
outside the ``heavy`` largest, and go through an ordinary shuffle on the digest.

Null text counts as empty. Texts are equal when identical after lower-casing A-Z only. Among
equal texts the largest key stays. Rows that repeat a key count in ``group_size``; in
``mark_exact_copies`` each row with the winning key is marked kept, as the key is all that
tells rows apart, while ``drop_exact_copies`` leaves a single row of each text. A null key
loses against any other; a group of null keys has a null ``keep_id`` and is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored

HEAVY = 256
TRACKED = 4096


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased, in UTF-8; null as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def frequent_digests(keyed: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` digests, every one with a share over about 1 / ``heavy`` among them."""
    top = keyed.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    return (top.select(F.explode("top").alias("t"))
            .where("t.count > 1").select(F.col("t.item").alias("digest")))


def group_winners(keyed: DataFrame) -> DataFrame:
    """Size and largest key of each digest."""
    return keyed.groupBy("digest").agg(F.max("doc_key").alias("keep_id"),
                                       F.count(F.lit(1)).alias("group_size"))


def heavy_winners(keyed: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """Exact winners of the frequent digests; a table of at most ``heavy`` rows."""
    frequent = F.broadcast(frequent_digests(keyed, heavy, tracked))
    return stored(group_winners(keyed.join(frequent, "digest", "left_semi")), "dedup-heavy")


def _split(docs: DataFrame, text: str, key: str, heavy: int, tracked: int):
    """Digest table, heavy winners and winners of the other digests."""
    keyed = stored(docs.select(F.col(key).alias("doc_key"),
                               text_digest(F.col(text)).alias("digest")), "dedup-digests")
    winners = heavy_winners(keyed, heavy, tracked)
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return keyed, winners, rest


def mark_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id",
                      heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    keyed, winners, rest = _split(docs, text, key, heavy, tracked)
    marked = (keyed.join(F.broadcast(winners), "digest")
              .unionByName(rest.join(group_winners(rest), "digest")))
    return marked.select(
        F.col("doc_key").alias(key), "keep_id", "group_size",
        F.col("doc_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id",
                      heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``docs`` with one row of each text, columns unchanged.

    Copies of a frequent text are dropped where they are read; only rows of other texts are shuffled.
    """
    _, winners, rest = _split(docs, text, key, heavy, tracked)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(key).alias("doc_key"), text_digest(F.col(text)).alias("digest"))
    same = [F.col("k.digest") == F.col("w.digest"),
            F.col("k.doc_key").eqNullSafe(F.col("w.keep_id"))]
    frequent = held.alias("k").join(F.broadcast(winners.alias("w")), same, "left_semi")
    rare = held.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    others = rare.alias("k").join(group_winners(rest).alias("w"), same, "left_semi")
    return (frequent.dropDuplicates(["digest"]).unionByName(others.dropDuplicates(["digest"]))
            .select("row.*"))
