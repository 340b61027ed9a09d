"""Exact top-k inner products by tiled matrix products.

Queries are dealt out in blocks of about BLOCK, candidates in shards of about SHARD
vectors, and each block meets each shard in one group of a shuffle: a group's candidates go
in tiles of TILE vectors, the best of each tile are selected, and a running list is kept for each
query.  The shards' lists are merged in levels of FAN lists.  Only counts come to the driver.
Components are integers; products are exact: doubles where sums stay below 2**53, 64-bit
integers below 2**63, else Python integers, whose results are cut to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

BLOCK = 8192
SHARD = 50_000
TILE = 1024
FAN = 16


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles if they are below 2**53, else Python integers."""
    v = np.floor(scale * x.astype(np.float64))
    return v if not v.size or np.abs(v).max() < 2**53 else np.vectorize(int, otypes=[object])(v)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows as 64-bit integers; what is beyond them counts as the nearest one."""
    most = lambda a: int(abs(a).max()) if a.size else 0
    bound = q.shape[1] * most(q) * most(c)
    if bound < 2**53 and q.dtype != object and c.dtype != object:
        return (q @ c.T).astype(np.int64)
    whole = lambda a: a if a.dtype == object else a.astype(np.int64)
    if bound < 2**63:
        return whole(q).astype(np.int64) @ whole(c).astype(np.int64).T
    exact = whole(q).astype(object) @ whole(c).astype(object).T
    return np.vectorize(lambda v: max(-(2**63), min(2**63 - 1, v)), otypes=[np.int64])(exact)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """row, column of the k best of each row; ties go to the left."""
    k = min(k, scores.shape[1])
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above, equal = scores > kth, scores == kth
    need = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= need)))


_TOP = pa.schema([("query_id", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_()), ("part", pa.int32())])


def _against(k: int, scale: float):
    """Over rows of a group (block, shard, length): its queries, then its candidates by vec_id.  own: the candidate looks like the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, q, top = None, [], None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if top is not None:
                row, score, vec, own = top
                yield C.record(_TOP, query_id=q[0][row], nth=q[1][row], vec_id=vec, score=score, own=own, part=np.full(len(row), key[1], np.int32))

        for b in batches:
            names = np.stack([C.column(b, c).to_numpy().astype(np.int64) for c in ("block", "shard", "d", "kind")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                *now, d, kind = names[:, lo].tolist()
                if (*now, d) != key:
                    yield from closed()
                    key, held, q, top = (*now, d), [], None, None
                part = b.slice(lo, hi - lo)
                ids, x = C.column(part, "vec_id").to_numpy(), integers(C.column(part, "embedding").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, d), scale)
                if kind == 0:
                    held.append((ids, C.column(part, "nth").to_numpy(), x))
                    continue
                if q is None and held:
                    q = [np.concatenate(c) for c in zip(*held)]
                for a in range(0, len(ids), TILE) if q else ():
                    scores = products(q[2], x[a : a + TILE])
                    row, col = best(scores, k)
                    vec = ids[a : a + TILE][col]
                    own = vec == q[0][row]
                    own[own] = (q[2][row[own]] == x[a : a + TILE][col[own]]).all(axis=1)
                    found = row, scores[row, col], vec, own
                    if top is not None:
                        found = tuple(np.concatenate(p) for p in zip(top, found))
                        order = np.lexsort((found[2], ~found[1], found[0]))
                        found = tuple(v[order] for v in found)
                        keep = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
                        found = tuple(v[keep] for v in found)
                    top = found
        yield from closed()

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query.

    Queries: rows whose vec_id is divisible by `every`; candidates: all rows but the query's own, so a row
    with the same vec_id is one.  Components are floor(scale * x); a score beyond 64 bits counts as the
    nearest 64-bit integer.  A null vec_id, a null vector or one with null or non-finite
    components takes no part.  Vectors of different lengths aren't compared; empty ones score 0.  Ties go to the
    smaller vec_id, repeated rows are queries and candidates as often as they occur.  No rows give no rows.
    """
    spark = vectors.sparkSession
    C.small_batches(spark)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    valid = valid.withColumn("d", F.size("embedding"))
    asked = valid.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding", "d").agg(F.count("*").alias("times"))
    asked = C.materialise(asked.withColumn("nth", F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))), "queries")
    blocks, shards = (max(1, -(-n // size)) for n, size in ((asked.count(), BLOCK), (valid.count(), SHARD)))
    deal = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select(deal(1, blocks).alias("block"), every_of(shards).alias("shard"), "d", F.lit(0).alias("kind"), "vec_id", "nth", "embedding")
    rows = valid.select(every_of(blocks).alias("block"), deal(2, shards).alias("shard"), "d", F.lit(1).alias("kind"), "vec_id", F.lit(0).alias("nth"), "embedding")
    met = queries.unionByName(rows).repartition(C.buckets_of(spark), "block", "shard").sortWithinPartitions("block", "shard", "d", "kind", "vec_id")
    lists = C.map_arrow(met, _against(k + 1, scale), "query_id long, nth int, vec_id long, score long, own boolean, part int")  # one more: the query's own row may be among them
    order = [F.desc("score"), F.asc("vec_id"), F.desc("own")]
    level = lists.withColumn("part", F.col("part") % FAN)
    for keys in (["query_id", "nth", "part"], ["query_id", "nth"]):
        level = level.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k + 1)
    first = F.row_number().over(Window.partitionBy("query_id", "nth", "own").orderBy(*order))
    level = level.withColumn("copy", first).where(~(F.col("own") & (F.col("copy") == 1)))  # one of the rows that look like the query is the query
    level = level.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(*order))).where(F.col("rank") <= k)
    level = level.join(asked.select(F.col("vec_id").alias("query_id"), "nth", "times").hint("merge"), ["query_id", "nth"])
    return level.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_")).drop("_")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
