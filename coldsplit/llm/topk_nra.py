"""Exact top-k search by inner product: no-random-access aggregation (NRA).

Components become integers floor(scale * x). Candidates are dealt into blocks
of bounded size by a hash; in a block each dimension is a list sorted by its
value, which a query reads from the end that its own component prefers. After
each round of sequential reads a candidate has a lower bound (what was read of
it, and the worst value of each list not read) and an upper bound (the value
where each list now stands instead). Reading stops for a query when no
candidate outside its survivors can reach the k-th best lower bound, and the
survivors are few (8 k, or a 32nd of the block: how many are resolved changes the
work, never the result); their scores are then resolved. A block of 4 k rows or
fewer is read to the end at once. A list read to its end makes both bounds the
score itself, so every query ends with exact scores. Bounds of a block of queries are matrix products, exact in doubles while they
stay under 2**53 (checked; beyond that the arithmetic is in int64).

Every query meets every block of candidates, in blocks of both: a task holds
one pair of blocks. Each gives at most k rows a query, and a window over those
takes the k best, ties to the smaller id.

Defined results: vectors that are null, empty, or hold a null or a non-finite
component, and rows without id, take no part; only vectors of a query's own dimension are its
candidates; a repeated candidate row is a row of its own; repeated query rows
(same id and vector) answer once; rows with the query's id are not its
candidates; fewer than k candidates give all; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldsplit.llm.common import parallel, table
from coldsplit.session import write_table

K = 5
SCALE = 256
BLOCK = 4096  # candidates in a block
QUERY_BLOCK = 1024
# Depth after each round of reads, as a share of the lists. Vectors without heavy
# candidates (hundreds of like components) are decided late, skewed ones early.
ROUNDS = (0.25, 0.8, 0.9, 0.95)


def _vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * float(scale)).cast("long"))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"), F.size(vector).alias("dim"))


def nra_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, stops: dict | None = None) -> list[tuple[int, int, int]]:
    """(query row, candidate row, score): for each query its k best of the block,
    ties to smaller ids, rows with the query's id left out. ``stops`` collects for
    each query the depth its reads stopped at and the number of survivors."""
    n, m, d = len(x), len(q), x.shape[1]
    most = float(np.abs(x).max()) * float(np.abs(q).max()) * d
    kind = np.float64 if most < 2**53 else np.int64
    xs, qs = x.astype(kind), q.astype(kind)
    signed = np.concatenate([np.maximum(qs, 0), np.minimum(qs, 0)], axis=1)  # lists read from the top, from the bottom
    order = np.argsort(x, axis=0, kind="stable")  # the sorted lists
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    low, high = xs[order[0], np.arange(d)], xs[order[-1], np.arange(d)]
    own = qids[:, None] == ids[None, :]
    kth = min(k, n)
    out: list[tuple[int, int, int]] = []
    todo = np.arange(m)

    def resolve(rows: np.ndarray, alive: np.ndarray, share: float) -> None:
        """Final scores of the survivors."""
        for i, keep in zip(rows, alive, strict=True):
            c = np.flatnonzero(keep)
            if stops is not None:
                stops[int(i)] = (share, len(c))
            scores = x[c] @ q[i] if kind is np.int64 else (xs[c] @ qs[i]).astype(np.int64)
            best = np.lexsort((ids[c], -scores))[:k]
            out.extend((int(i), int(c[b]), int(scores[b])) for b in best)

    for share in ROUNDS:
        depth = int(n * share)
        if not len(todo) or depth < k or n <= 4 * k:
            break
        from_top, from_bottom = rank >= n - depth, rank < depth
        at_top, at_bottom = xs[order[n - depth], np.arange(d)], xs[order[depth - 1], np.arange(d)]
        # a value not read is at least the list's worst and at most where the list stands
        least = np.concatenate([np.where(from_top, xs, low), np.where(from_bottom, xs, high)], axis=1)
        best = np.concatenate([np.where(from_top, xs, at_top), np.where(from_bottom, xs, at_bottom)], axis=1)
        lower, upper = signed[todo] @ least.T, signed[todo] @ best.T
        lower = np.where(own[todo], -np.inf, lower) if kind is np.float64 else np.where(own[todo], np.iinfo(np.int64).min, lower)
        bar = np.partition(lower, n - kth, axis=1)[:, n - kth]
        alive = (upper >= bar[:, None]) & ~own[todo]
        done = alive.sum(axis=1) <= max(8 * k, n // 32)
        resolve(todo[done], alive[done], share)
        todo = todo[~done]
    if len(todo):  # read to the end: both bounds are the score
        resolve(todo, ~own[todo], 1.0)
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query."""
    spark = candidates.sparkSession
    c = write_table(_vectors(candidates, id_col, vector, scale), "nra-candidates")
    q = write_table(_vectors(queries, id_col, vector, scale).dropDuplicates(["id", "v"]), "nra-queries")
    blocks, qblocks = (max(1, -(-t.count() // size)) for t, size in ((c, BLOCK), (q, QUERY_BLOCK)))
    c = c.select("dim", "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qb"), F.lit(0).alias("side"))
    q = q.select("dim", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"), F.pmod(F.xxhash64("id", "v"), F.lit(qblocks)).cast("int").alias("qb"), F.lit(1).alias("side"))
    keys = ["dim", "cb", "qb"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        side = pdf["side"].to_numpy()
        mine, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "query": [], "id": [], "score": []})
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        rows = nra_block(ids[mine], v[mine], ids[asked], v[asked], k)
        a = np.array(rows, np.int64).reshape(-1, 3)
        return pd.DataFrame({"query_id": ids[asked][a[:, 0]], "query": [v[asked[i]].tobytes() for i in a[:, 0]], "id": ids[mine][a[:, 1]], "score": a[:, 2]})

    pairs = c.unionByName(q).repartition(parallel(spark), *keys)
    found = pairs.groupBy(*keys).applyInPandas(search, "query_id long, query binary, id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id"), "score")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.filter("vec_id % 50 = 0"), rows).withColumnRenamed("id", "vec_id")


OP2_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
