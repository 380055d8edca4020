"""Exact top-k by inner product, with lower bounds of distances from segment statistics.

A vector is summed up at several resolutions: it is cut into segments, and each segment keeps its
mean and deviation. For two vectors these bound the distance from below,
``d^2 >= sum len ((m - m')^2 + (s - s')^2)``, and as ``d^2 = |q|^2 + |x|^2 - 2 qx``, the inner
product from above, ``qx <= sum len (m m' + s s')``. A query first scores, exactly, the candidates
with its best coarse bounds; the worst of its k best scores so far then drops candidates by the
coarse bound, the next drops more by the finer one, and what survives is scored exactly in
integers. Bounds are widened by more than their rounding error, so nothing is lost.

Every query meets every candidate, so the work is queries x candidates by definition. Both are
dealt evenly by row to blocks of at most ``block`` rows; a task takes one block of each, walks
through it in small tiles and hands on k rows a query, of which the best k are kept in the end.
No task, and no broadcast, holds more than two blocks, whatever the table's size, and equal
vectors lie in different blocks.

Components become ``floor(256 x)``. Null vectors and vectors with a null or non-finite component
take no part; an empty vector has score 0 with any other, and a shorter vector counts as if it
ended in zeros. A query is compared with every row but its own, so other rows of its id are
candidates, and repeated query rows give repeated results. Null ids are no queries; as candidates
they come last among equal scores. Scores beyond 64 bits are cut to the least or largest long. An
empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.scratch import stored

K = 5
EVERY = 50
BLOCK = 32_768
TILE = 2048
SEGMENTS = (16, 4, 2)  # components of a segment, coarse to fine
PAIRS = 50_000  # scored at once
WIDEN = 1e-9  # of the norms' product; far above the rounding error of a bound
ALL_SHARE = 8  # a tile of which more than 1 / 8 survives gets its next bounds by one product


def quantized(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, mark (a number of the row), x (floor of 256 times each component)."""
    value = F.col(vector)
    usable = value.isNotNull() & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v)
                                          & (F.abs(v) < float("inf")))
    return (rows.where(usable)
            .select(F.col(key).cast("long").alias("vec_id"),
                    F.monotonically_increasing_id().alias("mark"),
                    F.transform(value, lambda v: F.floor(v.cast("double") * 256)).alias("x")))


class Vectors:
    """Vectors of one block with their statistics at each resolution."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = table.column("vec_id").combine_chunks()
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.marks = table.column("mark").to_numpy()
        lists = table.column("x").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        self.x = np.zeros((len(lists), width), np.int64)
        self.x[np.arange(width) < length[:, None]] = lists.values.to_numpy(
            zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        real = self.x.astype(np.float64)
        self.norm = np.sqrt((real * real).sum(axis=1))
        self.stats = [statistics(real, n) for n in SEGMENTS]

    def tile(self, rows: slice | np.ndarray) -> Vectors:
        part = object.__new__(Vectors)
        for name in ("none", "ids", "marks", "x", "norm"):
            setattr(part, name, getattr(self, name)[rows])
        part.stats = [s[rows] for s in self.stats]
        return part

    def tiles(self, n: int) -> list[Vectors]:
        return [self.tile(slice(i, i + n)) for i in range(0, len(self.ids), n)]


def statistics(real: np.ndarray, segment: int) -> np.ndarray:
    """Mean and deviation of each segment, weighted so that a product of two rows is the bound."""
    rows, width = real.shape
    many = -(-width // segment)
    cut = np.zeros((rows, many * segment))
    cut[:, :width] = real
    cut = cut.reshape(rows, many, segment)
    return math.sqrt(segment) * np.concatenate([cut.mean(axis=2), cut.std(axis=2)], axis=1)


LARGEST = (1 << 63) - 1


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of a with rows ``j`` of b, some at a time."""
    parts = [np.einsum("nd,nd->n", a[i[n:n + PAIRS]], b[j[n:n + PAIRS]])
             for n in range(0, len(i), PAIRS)]
    return np.concatenate([*parts, np.zeros(0, a.dtype)])


def scores(q: Vectors, c: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, as 64-bit integers."""
    if not len(i) or float(q.norm.max()) * float(c.norm.max()) < 2.0 ** 62:
        return pair_products(q.x, c.x, i, j)
    wide = [sum(map(int.__mul__, q.x[m].tolist(), c.x[n].tolist()))
            for m, n in zip(i.tolist(), j.tolist(), strict=True)]
    return np.array([max(-LARGEST - 1, min(LARGEST, s)) for s in wide], np.int64)


class Best:
    """The k best candidates so far of each query of a tile."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.least = np.full(queries, -np.inf)  # the k-th best score of each query
        self.q, self.j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, c: Vectors) -> None:
        """Scored candidates ``j`` (rows of the whole block ``c``) of queries ``i``."""
        q, j = np.concatenate([self.q, i]), np.concatenate([self.j, j])
        score = np.concatenate([self.score, score])
        order = np.lexsort((c.ids[j], c.none[j], ~score, q))  # ~s falls as s rises, without overflow
        q, j, score = q[order], j[order], score[order]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - first
        kept = rank < self.k
        self.q, self.j, self.score = q[kept], j[kept], score[kept]
        full = rank == self.k - 1
        self.least[q[full]] = score[full]


def survivors(q: Vectors, t: Vectors, bound: np.ndarray, least: np.ndarray,
              slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may reach the query's least score at every resolution, coarse to fine."""
    alive = (bound >= least[:, None]) & (bound > -np.inf)
    for fine_q, fine_t in zip(q.stats[1:], t.stats[1:], strict=True):
        if ALL_SHARE * np.count_nonzero(alive) > alive.size:
            alive &= fine_q @ fine_t.T + slack[:, None] >= least[:, None]
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = pair_products(fine_q, fine_t, i, j) + slack[i] >= least[i]
    return np.nonzero(alive)


def search(q: Vectors, c: Vectors, k: int) -> Best:
    """The k best of block ``c`` for each query of a tile."""
    best = Best(len(q.ids), k)
    for start in range(0, len(c.ids), TILE):
        t = c.tile(slice(start, start + TILE))
        slack = WIDEN * q.norm * t.norm.max() + 1e-6
        bound = q.stats[0] @ t.stats[0].T + slack[:, None]
        _, own_q, own_t = np.intersect1d(q.marks, t.marks, return_indices=True)
        bound[own_q, own_t] = -np.inf
        # candidates with the best coarse bounds first: their scores raise what others must reach
        ahead = min(k, len(t.ids))
        j = np.argpartition(bound, len(t.ids) - ahead, axis=1)[:, len(t.ids) - ahead:].ravel()
        i = np.repeat(np.arange(len(q.ids)), ahead)
        other = bound[i, j] > -np.inf
        i, j = i[other], j[other]
        best.add(i, start + j, scores(q, t, i, j), c)
        bound[i, j] = -np.inf
        i, j = survivors(q, t, bound, best.least, slack)
        best.add(i, start + j, scores(q, t, i, j), c)
    return best


def search_blocks(table: pa.Table, k: int) -> pa.Table:
    """The k best of one block of candidates for each query of one block of queries."""
    width = pc.max(pc.list_value_length(table.column("x"))).as_py()
    queries = Vectors(table.filter(pc.field("is_query")), width)
    rows = Vectors(table.filter(~pc.field("is_query")), width)
    out = []
    for q in queries.tiles(TILE):
        best = search(q, rows, k)
        out.append(pa.table({
            "mark": pa.array(q.marks[best.q], pa.int64()),
            "query_id": pa.array(q.ids[best.q], pa.int64()),
            "vec_id": pa.array(rows.ids[best.j], pa.int64(), mask=rows.none[best.j]),
            "score": pa.array(best.score, pa.int64())}))
    return pa.concat_tables(out) if out else FOUND.empty_table()


FOUND = pa.schema([(c, pa.int64()) for c in ("mark", "query_id", "vec_id", "score")])


def blocks(rows: int, block: int, least: int = 1) -> int:
    return max(-(-rows // block), least)


def top_k(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", every: int = EVERY,
          k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each row whose key is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = stored(quantized(rows, vector, key), "topk-vectors")
    asks = F.col("vec_id") % every == 0
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(asks)).first()
    # at least enough blocks of candidates to keep the cores busy
    of_rows = blocks(n, block, 2 * spark.sparkContext.defaultParallelism)
    of_queries = blocks(n_queries, block)
    own = lambda many: F.pmod(F.xxhash64("mark"), F.lit(many))
    every_one = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>"))
    candidates = vectors.select(F.lit(False).alias("is_query"), "vec_id", "mark", "x",
                                own(of_rows).alias("rows_block"),
                                every_one(of_queries).alias("query_block"))
    queries = vectors.where(asks).select(F.lit(True).alias("is_query"), "vec_id", "mark", "x",
                                         every_one(of_rows).alias("rows_block"),
                                         own(of_queries).alias("query_block"))
    found = (candidates.unionByName(queries).groupBy("query_block", "rows_block")
             .applyInArrow(lambda t: search_blocks(t, k),
                           "mark long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
