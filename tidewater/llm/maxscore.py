"""Exact top-k inner products by MaxScore (operator 6).

Components are terms; a shard's postings are its vectors' components, sorted by id.  Every block of a shard bounds each
term's contribution to a query (from the block's largest and smallest component).  Each query orders the terms by these
bounds, widest first, and splits them: essential terms are the fewest without which no vector of the block can pass the
k-th best score so far.  Their postings are traversed for all vectors, and further ones while many vectors are
competitive: their partial score plus a bound of the terms to come passes that score.  The other terms are probed in
steps, only for vectors that are still competitive.  Terms to come are bounded by the sum of their own bounds and by the product of the query's norm over them and the vector's norm,
whichever is less.  A query skips blocks that cannot pass at all.  Shards are merged by a ranked window.

A first shard is searched alone; the k-th best score that a query finds there is its threshold in all other shards.
The query set is stated (ids divisible by ``query_mod``).  Vectors and queries are dealt by hash into shards and query
blocks of a bounded size, and each (shard, block) pair is one task's group; nothing is gathered beyond that.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; neither do rows without an
id.  Shorter vectors count as padded with zeros.  Rows equal in id and vector are one; other rows with a query's id are
not its candidates.  Scores are exact while the sum of products stays below 2^53 (beyond: 64-bit integer arithmetic).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import saved

K = 20
QUERY_MOD = 20
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
POSTINGS_BLOCK = 4096
#: Terms probed between two looks at the bounds; one of so many vectors competitive: the block is read on as a whole.
PROBE_TERMS = 8
DENSE_SHARE = 6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which every partial inner product of the rows is exact."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float32 if peak < 2 ** 24 else np.float64 if peak < 2 ** 53 else np.int64


def _merge(top_s: np.ndarray, top_i: np.ndarray, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
    """Add scores ``s`` of ids ``i`` for queries ``q`` to the k best of each."""
    k = top_s.shape[1]
    at = np.unique(q)
    rows = np.concatenate([np.repeat(at, k), q])
    scores, ids = np.concatenate([top_s[at].ravel(), s]), np.concatenate([top_i[at].ravel(), i])
    order = np.lexsort((ids, -scores, rows))
    rows, first = rows[order], np.searchsorted(rows[order], at)
    best = order[(first[:, None] + np.arange(k)).ravel()]
    top_s[at], top_i[at] = scores[best].reshape(-1, k), ids[best].reshape(-1, k)


def _bounds(q: np.ndarray, block: np.ndarray, norm: float) -> tuple[np.ndarray, ...]:
    """Per query: its order of the terms, its components' norm and the bound of the terms from each place on, and what
    the terms before each place give at least."""
    high, low = q * block.max(0), q * block.min(0)
    high, low = np.maximum(high, low).astype(np.float64), np.minimum(high, low).astype(np.float64)
    order = np.argsort(low - high, axis=1, kind="stable")
    high, low, sorted_q = (np.take_along_axis(x, order, 1) for x in (high, low, q.astype(np.float64)))
    over = np.zeros((len(q), q.shape[1] + 1))
    over[:, :-1] = np.sqrt((sorted_q ** 2)[:, ::-1].cumsum(1)[:, ::-1])
    rest, least = np.zeros_like(over), np.zeros_like(over)
    rest[:, :-1] = high[:, ::-1].cumsum(1)[:, ::-1]
    least[:, 1:] = low.cumsum(1)
    return order, over, np.minimum(rest, over * norm), least


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K,
           step: int = POSTINGS_BLOCK, theta: np.ndarray | None = None,
           work: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best vectors of a shard for each query; empty places have score -inf.

    ``theta``: scores that are known to be reached k times elsewhere; lower ones need not be found.  ``work`` counts
    ``pairs``, those ``scored`` over all terms, and ``terms`` that were multiplied."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    kind = _exact(vectors, queries)
    order = np.argsort(ids, kind="stable")
    ids, d, q = ids[order], vectors[order].astype(kind), queries.astype(kind)
    # a little more than the norm, so that rounding never makes a bound too small
    norms = np.sqrt((d.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9) + 1e-9
    top_s = np.full((len(q), k), -np.inf)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    # scores are whole numbers: an equal score of another shard may still win by its id
    floor = np.full(len(q), -np.inf) if theta is None else theta - 1
    work = Counter() if work is None else work
    at, size = 0, min(step, 4 * k)  # small first blocks set the thresholds
    while at < len(ids):
        block, names, norm = d[at:at + size], ids[at:at + size], norms[at:at + size]
        postings = np.ascontiguousarray(block.T)
        terms, over, rest, least = _bounds(q, block, float(norm.max()))
        limit = np.maximum(top_s[:, -1], floor)
        work["pairs"] += len(q) * len(block)
        dead = rest + least <= limit[:, None]
        split = np.where(dead.any(1), dead.argmax(1), width)
        found = []
        for i in np.flatnonzero(rest[:, 0] > limit):  # else: no vector of the block can pass
            n, own = int(split[i]), terms[i]
            # ids ascend, so an equal score further on never displaces one: only larger ones are competitive
            partial = q[i, own[:n]] @ postings[own[:n]]
            work["terms"] += n * len(block)
            # while many vectors are competitive, reading on costs less than picking them
            passes = partial + np.minimum(over[i, n] * norm, rest[i, n]) > limit[i]
            while n < width and DENSE_SHARE * np.count_nonzero(passes) > len(block):
                probe = own[n:n + PROBE_TERMS]
                partial += q[i, probe] @ postings[probe]
                n += len(probe)
                work["terms"] += len(probe) * len(block)
                passes = partial + np.minimum(over[i, n] * norm, rest[i, n]) > limit[i]
            alive = np.flatnonzero(passes)
            if n == width:
                work["scored"] += len(block)
            partial = partial[alive]
            while n < width and len(alive):
                probe = own[n:n + PROBE_TERMS]
                partial += q[i, probe] @ postings[probe[:, None], alive]
                n += len(probe)
                work["terms"] += len(probe) * len(alive)
                work["scored"] += len(alive) * (n == width)
                passes = partial + np.minimum(over[i, n] * norm[alive], rest[i, n]) > limit[i]
                alive, partial = alive[passes], partial[passes]
            other = names[alive] != query_ids[i]
            if other.any():
                found.append((np.full(int(other.sum()), i), partial[other].astype(np.float64), names[alive[other]]))
        if found:
            _merge(top_s, top_i, *(np.concatenate(x) for x in zip(*found, strict=True)))
        at, size = at + size, min(step, 4 * size)
    return top_s, top_i


def top_k(embeddings: DataFrame, k: int = K, query_mod: int = QUERY_MOD, scale: int = 64,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and v is not null and "
                       "forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('Infinity'))")
    rows = saved(rows.selectExpr("vec_id", f"transform(v, x -> floor({scale} * x)) v").distinct(), "vectors")
    n = rows.agg(F.count("*"), F.count(F.expr(f"case when vec_id % {query_mod} = 0 then 1 end"))).first()
    shards, blocks = max(1, -(-n[0] // shard_rows)), max(1, -(-n[1] // block_queries))

    def deal(df: DataFrame, own: str, parts: int) -> DataFrame:
        return df.withColumn(own, F.expr(f"cast(pmod(xxhash64(vec_id, v), {parts}) as int)"))

    def copies(name: str, first: int, last: int) -> Column:
        return F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name)

    vectors = deal(rows, "shard", shards)
    queries = deal(rows.filter(f"vec_id % {query_mod} = 0"), "block", blocks).withColumn("theta", F.lit(None).cast("double"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            query_ids = right.column("vec_id").to_numpy()
            theta = np.asarray(right.column("theta").fill_null(-np.inf).to_numpy(), np.float64)
            s, i = search(left.column("vec_id").to_numpy(), _matrix(left.column("v")), query_ids,
                          _matrix(right.column("v")), k, theta=theta)
            full = np.isfinite(s)
            out = [np.repeat(query_ids, k).reshape(s.shape)[full], i[full], s[full].astype(np.int64)]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], out, strict=True)))

    keys = ["shard", "block"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The k best of each query and shard from ``first`` to ``last``."""
        left = vectors.filter(F.col("shard").between(first, last)).select("*", copies("block", 0, blocks - 1))
        right = asked.toDF(*asked.columns).select("*", copies("shard", first, last))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            run, "query_id long, vec_id long, score long")

    found = best(queries, 0, 0)
    if shards > 1:
        found = saved(found, "first-shard")
        theta = (found.withColumn("rank", rank).filter(F.col("rank") == k)
                 .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("theta")))
        found = found.union(best(queries.drop("theta").join(theta, "vec_id", "left"), 1, shards - 1))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same result as DuckDB SQL (brute force).
ORACLE_SQL = f"""
WITH e AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor({64} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {QUERY_MOD} = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= {K}
"""
