"""Plain ALS baseline on real users, its RMSE, and top-k recommendations by exact
pruned inner-product search."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldsplit.operators.factors import factorize
from coldsplit.operators.prepare import random_split
from coldsplit.session import Scratch, write_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the search travels with its job


def als_baseline(
    ratings: DataFrame,
    weights=(0.8, 0.2),
    seed: int = 42,
    max_iter: int = 5,
    reg: float = 0.01,
    rank: int = 10,
    num_blocks: int | None = None,
):
    """Split by a hash of the cell, ALS with cold-start 'drop'; returns (model, predictions)."""
    train, test = random_split(ratings, weights, seed)
    model, _, _ = factorize(train, rank, max_iter, reg, seed, num_blocks=num_blocks, cold_start="drop")
    return model, model.transform(test)


def regression_rmse(predictions: DataFrame, label: str = "rating", pred: str = "prediction") -> float:
    ev = RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol=pred)
    return ev.evaluate(predictions)


def recommend_items(model, n: int = 10, users: DataFrame | None = None) -> DataFrame:
    """(user_id, rank, item_id, score): the n best items for each row of ``users``
    (user_id), or for every user."""
    asked = _factors(model.userFactors, "user_id")
    if users is not None:
        asked = asked.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return top_products(asked, _factors(model.itemFactors, "item_id"), n)


def recommend_users(model, n: int = 10, items: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, user_id, score): the n best users for each row of ``items``
    (item_id), or for every item."""
    asked = _factors(model.itemFactors, "item_id")
    if items is not None:
        asked = asked.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return top_products(asked, _factors(model.userFactors, "user_id"), n)


def _factors(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.col("id").alias(name), "features")


# ------------------------------------------------ exact pruned inner products
GROUP_BYTES = 64 << 20  # candidate vectors sent to the executors at a time
BLOCK = 64  # candidates met first; blocks double from there
WIDEST = 4096  # candidates of a block, at most
QUERIES = 1024  # queries answered at a time: one bound for each of them and each block
OPEN_PAIRS = 1 << 18  # pairs scored at a time; a block that leaves more open is halved
TASK_PAIRS = 1 << 33  # pairs a task meets, about: some seconds each 2^30
SLACK = 1e-9  # relative: bounds and scores are rounded sums of doubles


def top_products(queries: DataFrame, candidates: DataFrame, n: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The n candidates of greatest inner product for each query, without scoring
    all pairs: (query id, rank, candidate id, score), ties to the smaller id.

    Both frames are (id, features). Candidates are put in the order of falling
    norm and go out in groups of ``group_bytes``, a broadcast each. A query of norm q
    that knows n scores is done when q times the norm of the next group is under
    the n-th of them: no later candidate can reach it (Cauchy-Schwarz). Between
    groups the queries are written with what they have found, so neither side is
    ever whole in one place, and most queries never meet the later groups.

    Inside a group the candidates come in blocks. The products of a block in single
    precision, on vectors scaled to length 1 and less, are wrong by no more than a
    known rounding error; pairs under the n-th score by more than it are left there,
    the rest are scored in doubles. Queries are dealt to tasks by the number of
    pairs, whatever the bytes of their table. Rows without id or vector take no part;
    vectors of all rows have one length.
    """
    found, _ = search_products(queries, candidates, n, group_bytes)
    return found


def search_products(queries: DataFrame, candidates: DataFrame, n: int = 10, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """As :func:`top_products`, and (query id, n_scored): candidates scored for each."""
    spark = queries.sparkSession
    (q_id, _), (c_id, _) = queries.columns, candidates.columns
    with Scratch(spark) as tmp:
        norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        vec = F.transform("features", lambda x: x.cast("double"))
        ordered = candidates.filter(F.col(c_id).isNotNull() & F.col("features").isNotNull()).select(F.col(c_id).cast("long").alias("c"), vec.alias("v"), norm.alias("norm"))
        # falling norm: ranges of it are the groups, one file or more each
        ordered = tmp.write(ordered.orderBy(F.desc("norm"), "c"), "product-candidates")
        rank = ordered.selectExpr("size(v) AS r").first()
        total = ordered.count()
        per_group = max(1, group_bytes // (8 * ((rank["r"] if rank else 0) + 2)))
        parts = _norm_parts(ordered, total, per_group)
        state = queries.filter(F.col(q_id).isNotNull() & F.col("features").isNotNull()).select(
            F.col(q_id).cast("long").alias("q"), vec.alias("u"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("scores"), F.lit(0).cast("long").alias("n_scored"), F.lit(False).alias("done")
        )
        state = tmp.write(state, "product-queries")
        n_left, finished = state.count(), None
        for group, below in parts:
            if not n_left:
                break
            before, state = state, tmp.write(_search_group(spark, state.filter("not done"), n_left, group, n, below), "product-state")
            tmp.drop(before)
            n_done = state.filter("done").count()
            if n_done:
                part = tmp.write(state.filter("done").drop("u"), "product-done")
                finished = part if finished is None else finished.unionByName(part)
            n_left = n_left - n_done
        out = state.drop("u") if finished is None else finished
        out = write_table(out, "products")
    hits = out.select("q", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit"))
    kinds = dict(queries.dtypes)[q_id], dict(candidates.dtypes)[c_id]
    hits = hits.select(F.col("q").cast(kinds[0]).alias(q_id), (F.col("at") + 1).alias("rank"), F.col("hit.ids").cast(kinds[1]).alias(c_id), F.col("hit.scores").alias("score"))
    return hits, out.select(F.col("q").cast(kinds[0]).alias(q_id), "n_scored")


def _norm_parts(ordered: DataFrame, total: int, per_group: int) -> list[tuple[DataFrame, float]]:
    """(group, below): the candidates in ranges of falling norm of about ``per_group``
    rows, and the norm that no later one exceeds (negative: none is left). A range
    of equal norms that holds more is dealt by a hash of the id."""
    if total <= per_group:
        return [(ordered, -1.0)]
    shares = [1 - i * per_group / total for i in range(1, -(-total // per_group))]
    marks = sorted(set(ordered.approxQuantile("norm", shares, 0.1 * per_group / total)), reverse=True)
    at = F.lit(0)
    for mark in marks:  # ranges are (mark, next mark above]
        at = at + (F.col("norm") <= mark).cast("int")
    sizes = {r["part"]: r["count"] for r in ordered.groupBy(at.alias("part")).count().collect()}  # a row a range
    out = []
    for i, (low, high) in enumerate(zip([*marks, -1.0], [float("inf"), *marks], strict=True)):
        group = ordered.filter((F.col("norm") > low) & (F.col("norm") <= high))
        m = -(-sizes.get(i, 0) // (2 * per_group))
        out += [(group.filter(F.pmod(F.xxhash64("c"), F.lit(m)) == j) if m > 1 else group, low if j + 1 >= m else high) for j in range(m)]
    return out


def _task_count(spark, n_queries: int, n_candidates: int) -> int:
    """Tasks for queries that meet a group: two a core at least, more if each would
    meet over ``TASK_PAIRS`` pairs, never more than queries."""
    return max(1, min(n_queries, max(2 * spark.sparkContext.defaultParallelism, -(-n_queries * n_candidates // TASK_PAIRS))))


def _flat(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _search_group(spark, state: DataFrame, n_queries: int, group: DataFrame, n: int, below: float) -> DataFrame:
    rows = group.select("c", "v", "norm").toArrow().combine_chunks()  # bounded by the group's bytes
    c, norm = rows["c"].to_numpy(), rows["norm"].to_numpy().astype(np.float64, copy=False)
    order = np.lexsort((c, -norm))
    v = _flat(rows["v"].combine_chunks())[order] if len(c) else np.empty((0, 1))
    sent = spark.sparkContext.broadcast((c[order], v, norm[order]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                yield answers(batch.slice(at, QUERIES))

    def answers(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, v, norm = sent.value
        u = _flat(batch["u"])
        ids = np.full((len(u), n), NONE, np.int64)
        best = np.full((len(u), n), -np.inf)
        known = np.arange(n) < batch["ids"].value_lengths().to_numpy()[:, None]
        ids[known], best[known] = batch["ids"].flatten().to_numpy(), batch["scores"].flatten().to_numpy()
        scored = batch["n_scored"].to_numpy().copy()
        _best_of(u, c, v, norm, ids, best, scored)
        reach = np.sqrt((u * u).sum(axis=1)) * (1 + SLACK)
        found = best > -np.inf
        ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, x[found]) for x in (ids, best)]
        done = (reach * max(below, 0.0) < best[:, -1]) | (below < 0)
        return pa.RecordBatch.from_arrays([batch["q"], batch["u"], *lists, pa.array(scored), pa.array(done)], names=["q", "u", "ids", "scores", "n_scored", "done"])

    dealt = state.repartition(_task_count(spark, n_queries, len(c)), "q")
    return dealt.mapInArrow(search, "q long, u array<double>, ids array<long>, scores array<double>, n_scored long, done boolean")


def _best_of(u: np.ndarray, c: np.ndarray, v: np.ndarray, norm: np.ndarray, ids: np.ndarray, best: np.ndarray, scored: np.ndarray) -> None:
    """Puts the candidates (falling ``norm``) that belong there into ``ids`` and ``best``,
    the queries' best so far, and adds the pairs scored to ``scored``."""
    n = best.shape[1]
    long = np.sqrt((u * u).sum(axis=1))
    reach = long * (1 + SLACK)
    unit = (u / np.where(long > 0, long, 1.0)[:, None]).astype(np.float32)
    slack = (u.shape[1] + 8) * 2.0**-23  # twice the rounding error of a product of unit vectors, and more
    at, width = 0, BLOCK
    while at < len(c):
        live = np.flatnonzero(reach * norm[at] >= best[:, -1])
        if not len(live):
            break
        block, top = slice(at, at + width), norm[at] or 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            least = best[live, -1] / (long[live] * top) - slack
        least[long[live] == 0] = -np.inf  # all products are 0
        about = unit[live] @ (v[block] / top).astype(np.float32).T
        flat = np.flatnonzero(about >= least.astype(np.float32)[:, None])
        if len(flat) > OPEN_PAIRS and width > BLOCK:
            width = max(BLOCK, width // 4)
            continue
        i, j = np.divmod(flat, about.shape[1])
        i, j = live[i], j + at
        scored += np.bincount(i, minlength=len(scored))
        score = np.concatenate([np.einsum("ij,ij->i", u[i[k : k + OPEN_PAIRS]], v[j[k : k + OPEN_PAIRS]]) for k in range(0, len(i), OPEN_PAIRS)] or [np.empty(0)])
        better = score >= best[i, -1]
        i, j, score = i[better], j[better], score[better]
        who = np.unique(i)
        row = np.concatenate([np.repeat(who, n), i])
        names, scores = np.concatenate([ids[who].ravel(), c[j]]), np.concatenate([best[who].ravel(), score])
        order = np.lexsort((names, -scores, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < n]  # n of each row, at least, are there
        ids[who], best[who] = names[order].reshape(-1, n), scores[order].reshape(-1, n)
        at, width = at + width, min(2 * width, WIDEST)


NONE = np.iinfo(np.int64).max
