"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cohortspark.llm import conversations
from cohortspark.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
SCHEMA = "conv_id long, turn long, role string, text string, signature string, conv string"


def cheapest(rows):
    """(cost, audit, lines) of (role, text, gone, truncated) rows: best first over all edits."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        done.add((at, state))
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(queue, (cost + 3, audit + "I", at, new, (*lines, f"{name}:")))
        if at < len(rows):
            role, text, gone, truncated = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if not gone:
                stay = cost + 3 * truncated
                heapq.heappush(queue, (stay + 3, audit + "R", at + 1, new,
                                       (*lines, f"{name}:{text}")))
                if role[:1] in ({"": "su"}.get(state, new)) and role:
                    heapq.heappush(queue, (stay, audit + "K", at + 1, role[0],
                                           (*lines, f"{role}:{text}")))
    raise AssertionError


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain(original, rows):
    """The report of each conversation, row by row."""
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            ended = re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            fault = (0 if BLANK.match(text) else 1 if (role, text) in seen
                     else 2 if not ended else None)
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role, text, fault in (0, 1), fault == 2))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au")
                      for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(marks)
        out[conv] = (gaps, *counts, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                       r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(partitions)


def mixed_rows():
    rng = random.Random(8)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system"] * 2 + ["tool", "", "Sys", "u", "äh", None]
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", None, "one. two", "end.\n", "Ä?"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]), rng.choice(roles),
                         rng.choice(texts)))
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (0, 1, 2, None, None)]
    rows += [(70, None, "user", "Yes."), (70, None, "user", "Yes."), (71, 3, "user", None)]
    return rows


def test_mixed_conversations(spark):
    rows = mixed_rows()
    got = report(conversations.repair_damaged(table(spark, rows)))
    assert got == plain(rows, list(damaged(rows)))


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]),
             rng.choice(["a.", "b", "", f"text {t}.", f"text {t}"])) for t in range(1500)]
    rows += [(c, t, "user", "Hm.") for c in (6, 8) for t in (1, 2, 4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = report(conversations.repair_damaged(table(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows, list(damaged(rows)))


def test_dropped_conversation_and_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = report(conversations.repair_damaged(table(spark, [(lost, 0, "user", "Hello.")])))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair_damaged(table(spark, mixed_rows()).where("false")).count() == 0


def test_automaton_on_all_short_signatures():
    """Every signature of up to four rows, in the order that shares their suffixes."""
    symbols = "suaoSUAO-"
    signatures = [""]
    for _ in range(4):
        signatures += [s + c for s in signatures[-len(symbols) ** _:] for c in symbols]
    nodes = [conversations.END]
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        nodes, cost = [conversations.END], 0
        for symbol in reversed(signature.encode()):
            node, more = conversations.node_before(symbol, nodes[-1])
            nodes.append(node)
            cost += more
        rows = [({"-": "x", "o": "x"}.get(c, c.lower()).replace("o", "x"), "", c == "-", c.isupper())
                for c in signature]
        want = cheapest(rows)
        assert (cost + nodes[-1].cost[0], conversations.best_audit(nodes)) == want[:2], signature
    assert len(conversations.NODES) < 500  # equal nodes are one


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("abc", "abd", 2), ("abc", "ab", 2),
                                           ("x", "y", 0), ("aaaa", "aaab", 3), ("abcd", "xbcd", 0)])
def test_common_prefix(a, b, n):
    assert conversations.common_prefix(a, b) == n


@pytest.mark.parametrize("name", ["op12_conversation_repair"])
def test_query_matches_sql(spark, name):
    result = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert "problem" not in result and "types" not in result, result
