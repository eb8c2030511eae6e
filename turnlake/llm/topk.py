"""Exact top-k by inner product without random access (NRA).

Candidates fall into blocks of about BLOCK rows. A block sorts one list per dimension. A query reads every list from its better end, all
down to one level of contribution, and level by level on. Of a row it knows the contributions read: a lower bound of its score takes the
others as the lists' worst, an upper bound as the level or, if that is less, the list's best. It stops when only few rows, and none that no list has shown, can reach the
k-th best lower bound; these rows' scores are then resolved exactly. A block in which none of the first PROBES queries stops early reads
the lists of all others to their ends at once. The best of all blocks meet per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import prepare, scratch, tidy

BLOCK, QUERIES = 4096, 1024
#: Levels that lists are read down to, as shares of the best contribution, the share of rows at which a query stops, and the queries that
#: show whether a block's queries stop.
LEVELS, FEW, PROBES = (0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005, 0.0), 1 / 32, 8
#: Queries are sent to all tasks if their components take no more than so many bytes.
SENT_BYTES = 32 << 20
_LONG = (1 << 63) - 1


class Lists:
    """A block's rows, as a sorted list for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.d) = x.astype(np.float64), x.shape
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.x, self.order.T, axis=0).T.copy()
        self.read = self.stopped = self.asked = 0

    def candidates(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best of the query, without its own; read counts the entries read."""
        n, d = self.n, self.d
        self.asked += 1
        if n >= 8 * k and (self.asked <= PROBES or self.stopped):
            best = np.where(q > 0, self.values[:, -1] * q, self.values[:, 0] * q)
            worst = np.where(q > 0, self.values[:, 0] * q, self.values[:, -1] * q)
            done = np.zeros(d, np.int64)
            total, seen, low = np.zeros(n), np.zeros(n), np.full(n, worst.sum())
            for share in LEVELS:
                level = np.floor(share * best.max())
                rows, parts, worsts = [], [], []
                for i in np.flatnonzero(q):
                    v = self.values[i]
                    depth = n - np.searchsorted(v, level / q[i], "left") if q[i] > 0 else np.searchsorted(v, level / q[i], "right")
                    if depth > done[i]:
                        at = slice(n - depth, n - done[i]) if q[i] > 0 else slice(done[i], depth)
                        rows.append(self.order[i, at])
                        parts.append(v[at] * q[i])
                        worsts.append(np.full(depth - done[i], worst[i]))
                        self.read += int(depth - done[i])
                        done[i] = depth
                if rows:
                    at, part, bad = np.concatenate(rows), np.concatenate(parts), np.concatenate(worsts)
                    total += np.bincount(at, part, n)
                    seen += np.bincount(at, minlength=n)
                    low += np.bincount(at, part - bad, n)
                # What is unread of a list adds no more than the level, nor than the list's best entry.
                high = total + np.minimum(best, level).sum() - seen * level
                bar = np.partition(np.where(own, -np.inf, low), n - k)[n - k]
                stay = (high >= bar) & ~own
                if stay.sum() <= max(4 * k, FEW * n):
                    self.stopped += 1
                    return np.flatnonzero(stay)
            self.read -= int(done.sum())
        self.read += n * int(np.count_nonzero(q))
        return np.flatnonzero(~own)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, lists: Lists | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of each query's k best of the rows x, ties to smaller ids; rows with the query's id don't count."""
    n, d = x.shape
    if not n or not len(q):
        return (np.zeros(0, np.int64),) * 3
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(d, 1) >= 2.0**52:
        own = q_ids[:, None] == ids[None, :]
        exact = np.clip(q.astype(object) @ x.T.astype(object), -_LONG - 1, _LONG).astype(np.int64) if d else np.zeros((len(q), n), np.int64)
        pairs = np.nonzero(~own)
        return _first(pairs[0], pairs[1], exact[pairs], ids, q_ids, k)
    lists = lists or Lists(x)
    found = []
    for i, one in enumerate(q.astype(np.float64)):
        rows = lists.candidates(one, ids == q_ids[i], k) if d else np.flatnonzero(ids != q_ids[i])
        score = (lists.x[rows] if len(rows) < n - 1 else lists.x) @ one  # whole numbers below 2 ** 52: exact
        score = score if len(score) == len(rows) else score[rows]
        if len(rows) > 4 * k:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= bar], score[score >= bar]
        found.append((np.full(len(rows), i), rows, score.astype(np.int64)))
    return _first(*(np.concatenate([f[i] for f in found]) for i in range(3)), ids, q_ids, k)


def _first(which: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int):
    order = np.lexsort((ids[row], -score, which))
    which, row, score = which[order], row[order], score[order]
    start = np.searchsorted(which, which)
    keep = np.arange(len(which)) - start < k
    return q_ids[which[keep]], ids[row[keep]], score[keep]


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def dense(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as rows of one width, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where is_query holds, of all rows but those with its id.

    Ties go to the smaller id; fewer rows give fewer ranks. Null ids and vectors, and vectors with null or non-finite components,
    take no part; shorter vectors count as filled up with zeros, of any length; repeated candidates count as often, a repeated query id
    once (its least vector). Scores beyond a long are its limits. Queries of sent_bytes or less go to all tasks, which read their rows
    block by block; more queries meet the rows in parts, block by block. An empty table gives none.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"), is_query.alias("q")).filter("id is not null and v is not null")
    rows = scratch(rows, "vectors")
    n, n_queries, width = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    width = width or 0
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    kind = "query_id bigint, vec_id bigint, score bigint"

    def answers(x, ids, q, q_ids) -> pa.RecordBatch:
        found = best(x, ids, q, q_ids, k)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in found], names=["query_id", "vec_id", "score"])

    if n_queries * (width + 1) * 8 <= sent_bytes:
        table = asked.toArrow()  # at most sent_bytes
        shared = rows.sparkSession.sparkContext.broadcast((dense(table.column("v"), width), table.column("id").to_numpy()))

        def scan(batches):
            held, size = [], 0
            for batch in batches:
                held.append((dense(batch.column("v"), width), batch.column("id").to_numpy()))
                size += batch.num_rows
                if size >= block:
                    yield answers(*(np.concatenate([h[i] for h in held]) for i in range(2)), *shared.value)
                    held, size = [], 0
            if size:
                yield answers(*(np.concatenate([h[i] for h in held]) for i in range(2)), *shared.value)

        met = rows.select("id", "v").mapInArrow(tidy(scan), kind)
    else:
        blocks, parts = max(1, -(-n // block)), max(1, -(-n_queries // QUERIES))
        spread = lambda m: F.array(*[F.lit(i) for i in range(m)]) if m < 64 else F.sequence(F.lit(0), F.lit(m - 1))
        left = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(spread(parts)).alias("part"))
        right = asked.select("id", "v", F.explode(spread(blocks)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.Table.from_batches([answers(*(y for t in (a, b) for y in (dense(t.column("v"), width), t.column("id").to_numpy())))])

        met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
