"""Cheapest repair of damaged conversations into the role order ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first), then role, then digest of the text, so
that equal rows are adjacent and the order does not depend on partitioning. A row's first fault
counts: blank, duplicate (role and text seen earlier in the conversation), truncated. Edits keep
a row (0), rerole it to user or assistant (3), delete it (4; blank and duplicate rows must go) or
insert an empty user or assistant row (3); a truncated row that stays adds 3.

Suffix-shared automaton: a conversation's signature has one symbol a row, its role's initial and
fault. The distinct signatures of all conversations are sorted from their ends, so that signatures
with a common suffix follow each other and share its nodes; a task holds the nodes of the current
signature only. Each node gets, once for all conversations, the cost to go and the least audit
suffix from each of the grammar's four states. An audit suffix is kept as its first edit, the
state behind it and its rank among the node's four, which orders equal costs without any string;
nodes that agree in all of these are one node, so the automaton stays minimal and small.

On Spark: copies of a row are counted where they are read, and first sights of (role, text) are a
minimum, so neither meets in one task. Rows without texts are range-partitioned by conversation,
turn, role and digest; a conversation with a third of all rows is cut into pieces over many tasks
and only its pieces, one byte a row, are put together. Texts move once, for the repaired digest:
a hash reads its conversation in turn, so rows stream through it sorted and are not held. As a
result holds a conversation's audit in one string, a conversation has fewer than 2^31 rows.

Nulls: ``damage`` reads every null as one space, in ids for the hash as well; null turns and
conversation ids stay null in the result, and rows of a null id are one conversation. Repeated
rows count as often as they occur. A conversation whose rows were all dropped has zeros, an empty
audit and the digest of the empty string. An empty table gives an empty result. Extra columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored

KEEP, REROLE, DELETE, INSERT = b"KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NO_WAY = 1 << 60

# grammar states: nothing yet, after a system row, after a user row, after an assistant row
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES = (BEGIN, SYSTEM, USER, ASSISTANT)
ROLE_AFTER = ("user", "user", "assistant", "user")  # the role that rerole and insert give there
STATE_AFTER = (USER, USER, ASSISTANT, USER)
TAKES = ({ord("s"): SYSTEM, ord("u"): USER}, {ord("u"): USER}, {ord("a"): ASSISTANT},
         {ord("u"): USER})
MAY_END = (BEGIN, ASSISTANT)

# signature symbols: a role's initial, in capitals if truncated; o for any other role
GONE = ord("-")
LETTERS = {ord(c): (ord(c.lower()), TRUNCATED_COST if c.isupper() else 0) for c in "suaoSUAO"}

BLANK = r"^[\x20\x09-\x0D]*$"
ENDED = r"[.!?][\x20\x09-\x0D]*$"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """conv, turn, role, text, m: rows damaged by crc32 of ``conv:turn`` modulo 20, m copies each.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    return (rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                        spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv", "turn",
                    F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "")
                    .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).alias("m")))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def marked_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: conv, turn, role, digest, m, blank, cut, repeated.

    ``repeated`` tells a row that an earlier turn has as well; of m equal rows of one turn all but
    the first are repeated in any case.
    """
    copies = (rows.select("conv", "turn", "role", digest(F.col("text")).alias("digest"),
                          F.col("text").rlike(BLANK).alias("blank"),
                          (~F.col("text").rlike(ENDED)).alias("cut"), "m")
              .groupBy("conv", "turn", "role", "digest", "blank", "cut")
              .agg(F.sum("m").alias("m")))
    copies = stored(copies, "conversation-rows")
    same = ["conv", "role", "digest"]
    firsts = copies.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"),
                                       F.count(F.lit(1)).alias("turns"))
    # only what several turns have needs a look at its first one
    seen = firsts.where("turns > 1").select(*(F.col(c).alias(f"f_{c}") for c in same), "first")
    join = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in same]
    return (copies.join(seen, join, "left")
            .select("conv", "turn", "role", "digest", "m", "blank", "cut",
                    (F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first")))
                    .alias("repeated")))


PIECES = ("conv long, piece long, signature binary, initials struct<first:string, last:string>,"
          " turns struct<first:long, last:long, distinct:long>, blank long, duplicate long,"
          " truncated long, illegal long")


class Piece:
    """Adjacent rows of one conversation, read one by one."""

    legal = frozenset(("su", "ua", "au"))

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.signature = bytearray()
        self.first = self.last = None
        self.turn_first = self.turn_last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, m, blank, cut, repeated) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in self.legal
        self.illegal += (m - 1) * (initial + initial not in self.legal)
        self.last = initial
        if turn is not None and turn != self.turn_last:
            self.turn_first = turn if self.turn_first is None else self.turn_first
            self.turn_last, self.turns = turn, self.turns + 1
        if blank or repeated:
            stays = 0
        else:
            stays = 1
            letter = initial if initial in ("s", "u", "a") else "o"
            self.truncated += cut
            self.signature += (letter.upper() if cut else letter).encode()
        self.signature += bytes([GONE]) * (m - stays)
        if blank:
            self.blank += m
        else:
            self.duplicate += m - stays

    def values(self) -> tuple:
        return (self.conv, bytes(self.signature), {"first": self.first, "last": self.last},
                {"first": self.turn_first, "last": self.turn_last, "distinct": self.turns},
                self.blank, self.duplicate, self.truncated, self.illegal)


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations of one sorted range of rows, numbered by the range."""
    from pyspark import TaskContext
    schema = pa.schema([
        ("conv", pa.int64()), ("piece", pa.int64()), ("signature", pa.binary()),
        ("initials", pa.struct([("first", pa.string()), ("last", pa.string())])),
        ("turns", pa.struct([("first", pa.int64()), ("last", pa.int64()),
                             ("distinct", pa.int64())])),
        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal"))])
    at, piece, done = TaskContext.get().partitionId(), None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        columns.insert(1, [at] * len(done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in (
                "conv", "turn", "role", "m", "blank", "cut", "repeated")), strict=True):
            if piece is None or conv != piece.conv:
                if piece:
                    done.append(piece.values())
                piece = Piece(conv)
            piece.add(*row)
        if done:
            yield flush()
    if piece:
        done.append(piece.values())
        yield flush()


def conversations_of(marked: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, signature of each conversation."""
    order = ["conv", "turn", "role", "digest"]
    pieces = (marked.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv", "turn", "role", "m", "blank", "cut", "repeated")
              .mapInArrow(cut_pieces, PIECES))
    pieces = stored(pieces, "conversation-pieces")
    sums = {c: F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")}
    whole = pieces.groupBy("conv").agg(
        *sums.values(), F.sum("illegal").alias("within"),
        F.min("turns.first").alias("low"), F.max("turns.last").alias("high"),
        F.sum("turns.distinct").alias("met"),
        F.array_sort(F.collect_list(F.struct("piece", "signature", "initials", "turns")))
        .alias("p"))
    # neighbouring pieces may share a turn and meet in an illegal pair of roles
    seams = F.expr("transform(sequence(1, size(p) - 1), i -> named_struct("
                   "'illegal', cast(concat(p[i - 1].initials.last, p[i].initials.first)"
                   " NOT IN ('su', 'ua', 'au') AS long),"
                   "'shared', cast(coalesce(p[i - 1].turns.last = p[i].turns.first, false) AS long)))")
    seams = F.when(F.size("p") > 1, seams)
    total = lambda part: F.coalesce(F.aggregate(
        "seams", F.lit(0).cast("long"), lambda n, s: n + s[part]), F.lit(0).cast("long"))
    return (whole.withColumn("seams", seams)
            .select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("met")
                                       + total("shared"), F.lit(0).cast("long")).alias("gaps"),
                    *sums, (F.col("within") + total("illegal")).alias("illegal"),
                    F.concat_ws("", F.transform("p", lambda x: x["signature"].cast("string")))
                    .alias("signature")))


class Node:
    """Per grammar state: cost to go above the least, first edit, state behind it, audit's rank."""

    __slots__ = ("before", "cost", "edit", "rank", "to")

    def __init__(self, cost: tuple, edit: tuple, to: tuple, rank: tuple) -> None:
        self.cost, self.edit, self.to, self.rank = cost, edit, to, rank
        self.before: dict[int, tuple[Node, int]] = {}  # by symbol: the node in front, cost added


NODES: dict[tuple, Node] = {}  # equal nodes are one, so a worker's automaton is minimal


def ranks(ways: list[tuple]) -> tuple:
    """Order of the ways' audits. Those that begin with an insert go on in the same node."""
    def audit(s: int) -> tuple:
        edits = []
        while ways[s][1] == INSERT:
            edits.append(INSERT)
            s = ways[s][3]
        return (*edits, *ways[s][1:3])
    audits = [audit(s) for s in STATES]
    order = sorted(set(audits))
    return tuple(order.index(a) for a in audits)


def node_of(ways: list[tuple]) -> tuple[Node, int]:
    """The node of each state's best way (cost, edit, rank behind, next state), and its least cost.

    Inserts lead to another state of the same node; a third in a row would lead back.
    """
    for _ in range(2):
        better = list(ways)
        for s in STATES:
            to = STATE_AFTER[s]
            way = (ways[to][0] + INSERT_COST, INSERT, 0, to)
            if way[0] < NO_WAY and way[:2] < better[s][:2]:
                better[s] = way
        ways = better
    least = min(w[0] for w in ways)
    cost, edit, _, to = zip(*ways, strict=True)
    key = (tuple(c - least for c in cost), edit, to, ranks(ways))
    return NODES.setdefault(key, Node(*key)), least


END, _ = node_of([(0 if s in MAY_END else NO_WAY, 0, 0, s) for s in STATES])


def node_before(symbol: int, child: Node) -> tuple[Node, int]:
    """The node of a row ``symbol`` in front of ``child``, and what it adds to the cost."""
    if symbol not in child.before:
        ways = []
        for s in STATES:
            found = [(child.cost[s] + DELETE_COST, DELETE, child.rank[s], s)]
            if symbol != GONE:
                initial, extra = LETTERS[symbol]
                to = STATE_AFTER[s]
                found.append((child.cost[to] + REROLE_COST + extra, REROLE, child.rank[to], to))
                to = TAKES[s].get(initial)
                if to is not None:
                    found.append((child.cost[to] + extra, KEEP, child.rank[to], to))
            ways.append(min(found))
        child.before[symbol] = node_of(ways)
    return child.before[symbol]


def best_audit(nodes: list[Node]) -> str:
    """Least of the cheapest audits from the last node, which stands for a whole signature."""
    state, audit, at = BEGIN, bytearray(), len(nodes) - 1
    while edit := nodes[at].edit[state]:
        audit.append(edit)
        state = nodes[at].to[state]
        at -= edit != INSERT
    return audit.decode()


def repair_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures sorted from their ends; a common suffix keeps its nodes."""
    nodes, costs, before = [END], [0], ""
    for batch in batches:
        cost, audit = [], []
        signatures = batch.column("signature").to_pylist()
        for signature in signatures:
            backward = signature[::-1]
            shared = common_prefix(before, backward)
            del nodes[shared + 1:], costs[shared + 1:]
            for symbol in backward[shared:].encode():
                node, more = node_before(symbol, nodes[-1])
                nodes.append(node)
                costs.append(costs[-1] + more)
            before = backward
            cost.append(costs[-1] + nodes[-1].cost[BEGIN])
            audit.append(best_audit(nodes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures, pa.string()), pa.array(cost, pa.int64()),
             pa.array(audit, pa.string())], ["signature", "cost", "audit"])


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def repairs(conversations: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""
    backward = F.reverse("signature")
    return (conversations.select("signature").distinct().repartitionByRange(backward)
            .sortWithinPartitions(backward)
            .mapInArrow(repair_signatures, "signature string, cost long, audit string"))


class RepairedDigest:
    """Hash of one conversation's repaired rows, fed with its rows in order."""

    def __init__(self, conv: int | None, audit: str) -> None:
        self.conv, self.audit, self.at = conv, audit.encode(), 0
        self.state, self.lines, self.hash = BEGIN, 0, hashlib.sha256()

    def line(self, role: str, text: str, to: int) -> None:
        self.hash.update(f"\n{role}:{text}".encode() if self.lines else f"{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, to

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == b"I":
            self.line(ROLE_AFTER[self.state], "", STATE_AFTER[self.state])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.line(role, text, TAKES[self.state][ord(role[0])])
        elif edit == REROLE:
            self.line(ROLE_AFTER[self.state], text, STATE_AFTER[self.state])

    def value(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def hash_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit comes first, then its rows in order."""
    current, done = None, []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()),
                                          pa.array([d for _, d in done], pa.string())],
                                         ["conv", "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        for conv, audit, role, text, m in zip(*(batch.column(c).to_pylist() for c in (
                "conv", "audit", "role", "text", "m")), strict=True):
            if audit is not None:
                if current:
                    done.append((current.conv, current.value()))
                current = RepairedDigest(conv, audit)
            else:
                for _ in range(m):
                    current.row(role, text)
        if done:
            yield flush()
    if current:
        done.append((current.conv, current.value()))
        yield flush()


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256. Texts are shuffled once, by conversation, and read in order."""
    heads = audits.select("conv", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))),
        F.lit(0).cast("long").alias("m"))
    lines = rows.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role",
                        digest(F.col("text")).alias("digest"), "text",
                        F.col("m").cast("long").alias("m"))
    # heads have an audit and come first
    return (heads.unionByName(lines).repartition("conv")
            .sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "role", "digest")
            .select("conv", "audit", "role", "text", "m")
            .mapInArrow(hash_repaired, "conv long, repaired_sha256 string"))


def repair(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Report of each conversation of ``rows`` (conv, turn, role, text, m as ``damage`` returns).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, signature.
    ``original`` (conv) adds conversations without rows.
    """
    found = stored(conversations_of(marked_rows(rows)), "conversation-signatures")
    found = stored(found.join(repairs(found), "signature"), "conversation-audits")
    report = found.join(repaired_digests(rows, found).withColumnRenamed("conv", "r_conv"),
                        F.col("conv").eqNullSafe(F.col("r_conv")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    columns = ["conv", *counts, "audit", "repaired_sha256", "signature"]
    report = report.select(*columns)
    if original is not None:
        lost = (original.select(F.col("conv").alias("o_conv")).distinct()
                .join(found, F.col("o_conv").eqNullSafe(F.col("conv")), "left_anti"))
        report = report.unionByName(lost.select(
            F.col("o_conv").alias("conv"), *(F.lit(0).cast("long").alias(c) for c in counts),
            F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"),
            F.lit("").alias("signature")))
    return report.withColumnRenamed("conv", "conv_id")


def repair_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Damage a conversations table and report the repair of each original conversation."""
    damaged = damage(rows, conv, turn, role, text)
    return repair(damaged, rows.select(F.col(conv).cast("long").alias("conv")))
