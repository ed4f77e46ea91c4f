"""Pseudo-user factorisation with Spark ML ALS.

All levels are fitted in ONE ALS run: node ids and item ids are made unique
per level, so the rating matrix is block diagonal and ALS (whose normal
equations for a row only involve the columns it rated) factorises every
level independently inside a single distributed job. A lambda grid costs one
fit per lambda, not one per (level, lambda).
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldsplit.functions import dot_product
from coldsplit.operators.prepare import index_codes
from coldsplit.operators.skew import salted_join
from coldsplit.session import Scratch, bounded_broadcast, write_table

INT_MAX = 2**31 - 1
NUM_BLOCKS = 10  # ALS blocks a side, at least; by default as many as the session has cores


def _node_key(level, node):
    # breadth-first index of (level, node) in a complete ternary tree
    return ((F.pow(F.lit(3), level).cast("long") - 1) / 2).cast("long") + node


def factorize(
    ratings: DataFrame,
    rank: int = 10,
    max_iter: int = 15,
    reg: float = 0.01,
    seed: int = 10,
    user_col: str = "user_id",
    item_col: str = "item_id",
    rating_col: str = "rating",
    num_blocks: int | None = None,
    cold_start: str = "nan",
):
    """Fit ALS; returns (model, user factors (id, features), item factors)."""
    num_blocks = num_blocks or max(NUM_BLOCKS, ratings.sparkSession.sparkContext.defaultParallelism)
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        seed=seed,
        userCol=user_col,
        itemCol=item_col,
        ratingCol=rating_col,
        coldStartStrategy=cold_start,
        numUserBlocks=num_blocks,
        numItemBlocks=num_blocks,
    )
    model = als.fit(ratings)
    return model, model.userFactors, model.itemFactors


def _node_of(key, levels: int):
    """(level, node) of a breadth-first key, by arithmetic."""
    level = F.lit(0)
    for lv in range(1, levels + 1):
        level = F.when(key >= (3**lv - 1) // 2, F.lit(lv)).otherwise(level)
    first = ((F.pow(F.lit(3), level).cast("long") - 1) / 2).cast("long")
    return level.cast("int").alias("level"), (key - first).cast("int").alias("node")


def index_pseudo_items(pseudo: DataFrame) -> DataFrame:
    """(item_id, idx): dense numbers of the rated items, so that ids of any size fit."""
    return write_table(index_codes(pseudo.select("item_id"), "item_id"), "als-items")


def fit_levels(
    pseudo: DataFrame,
    levels: int,
    rank: int = 10,
    max_iter: int = 15,
    reg: float | dict = 0.01,
    seed: int = 10,
    num_blocks: int | None = None,
    items: DataFrame | None = None,
):
    """Factorise the pseudo-user ratings of every level in one stacked fit (one
    per distinct value, if ``reg`` is a dict level -> value).

    pseudo: (level, node, item_id, rating). Returns
    (node_factors(level, node, features), item_factors(level, item_id, features)).
    """
    if isinstance(reg, dict):
        items = index_pseudo_items(pseudo) if items is None else items
        nf = itf = None
        for value in sorted({float(v) for v in reg.values()}):
            own = [lv for lv, v in reg.items() if float(v) == value]
            a, b = fit_levels(pseudo.filter(F.col("level").isin(own)), levels, rank, max_iter, value, seed, num_blocks, items)
            nf, itf = (a, b) if nf is None else (nf.unionByName(a), itf.unionByName(b))
        return nf, itf
    items = index_pseudo_items(pseudo) if items is None else items
    n_items = items.count()
    if (levels + 1) * n_items > INT_MAX or 3 ** (levels + 1) // 2 > INT_MAX:
        raise ValueError(f"{levels + 1} levels of {n_items} items do not fit the 32-bit ids of ALS")
    stacked = salted_join(pseudo, items, ["item_id"], ["level", "node"]).select(
        _node_key(F.col("level"), F.col("node")).cast("int").alias("u"),
        (F.col("level") * F.lit(n_items) + F.col("idx")).cast("int").alias("i"),
        F.col("rating").cast("float").alias("r"),
    )
    _, uf, itf = factorize(stacked, rank, max_iter, reg, seed, "u", "i", "r", num_blocks)
    node_factors = uf.select(*_node_of(F.col("id"), levels), "features")
    item_factors = (
        itf.select(F.floor(F.col("id") / F.lit(n_items)).cast("int").alias("level"), (F.col("id") % n_items).cast("int").alias("idx"), "features")
        .join(items, "idx")
        .select("level", "item_id", "features")
    )
    return node_factors, item_factors


def grid_rmse(
    validation: DataFrame, assignment: DataFrame, node_factors: DataFrame, item_factors: DataFrame, node_bound: int, rank: int = 10, grid: int = 1, tmp: Scratch | None = None
) -> DataFrame:
    """(level, lambda, rmse, n): micro RMSE of validation cells of training users, each
    scored at the user's own node of that level by every fit of a grid.

    The factors carry a column ``lambda``, at most ``grid`` values a level. The cells meet
    the assignment once, however many values there are: a node's and an item's
    vectors of all fits travel as one map. Node vectors (``node_bound`` rows at most)
    are broadcast if they fit; a heavy user is spread by item and a hot item by user."""
    write = tmp.write if tmp else write_table

    def vectors(factors: DataFrame, keys: list[str], name: str) -> DataFrame:  # at most `grid` vectors a row
        return factors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lambda", "features"))).alias(name))

    wide = max(rank, grid)
    # a user has one assignment row a level
    cells = salted_join(validation, assignment.select("level", "node", "user_id"), ["user_id"], ["item_id"], tmp=tmp)
    cells = write(cells.select("level", "node", "user_id", "item_id", "rating"), "validation-cells")
    scored = salted_join(cells, vectors(item_factors, ["level", "item_id"], "v"), ["level", "item_id"], ["user_id"], array_items=wide, tmp=tmp)
    scored = scored.join(bounded_broadcast(vectors(node_factors, ["level", "node"], "u"), node_bound, wide), ["level", "node"])
    each = scored.select("level", "rating", "v", F.explode("u").alias("lambda", "a")).withColumn("b", F.col("v")[F.col("lambda")])
    return each.filter("b is not null").groupBy("level", "lambda").agg(
        F.sqrt(F.avg(F.pow(F.col("rating") - dot_product("a", "b"), 2))).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def validation_rmse(
    validation: DataFrame, assignment: DataFrame, node_factors: DataFrame, item_factors: DataFrame, node_bound: int, rank: int = 10
) -> DataFrame:
    """(level, rmse, n): :func:`grid_rmse` of one fit."""
    one = F.lit(0.0).alias("lambda")
    return grid_rmse(validation, assignment, node_factors.select("*", one), item_factors.select("*", one), node_bound, rank).drop("lambda")


def best_of_grid(curves: DataFrame, grids: dict) -> DataFrame:
    """(level, lambda, rmse, n, best): marks the least error of each level, the first in
    grid order on ties."""
    place = F.coalesce(*[F.when((F.col("level") == lv) & (F.col("lambda") == lam), n) for lv, g in grids.items() for n, lam in enumerate(g)])
    w = Window.partitionBy("level").orderBy(F.col("rmse").asc(), place.asc())  # one row a lambda
    return curves.withColumn("best", F.row_number().over(w) == 1).select("level", "lambda", "rmse", "n", "best")


def tune_levels(
    pseudo: DataFrame,
    levels: int,
    validation: DataFrame,
    assignment: DataFrame,
    node_bound: int,
    lambdas=(0.005, 0.01, 0.02, 0.05, 0.1),
    rank: int = 10,
    max_iter: int = 15,
    seed: int = 10,
    num_blocks: int | None = None,
):
    """Grid over lambda, the same for all levels or a dict level -> grid; per level
    keep the lambda with the least validation RMSE (first in grid order on ties).
    ``validation`` must not be in the training cells behind ``pseudo``. Returns
    (level_lambda, node_factors, item_factors) where the factors are those of
    each level's best lambda."""
    grids = {lv: [float(x) for x in (lambdas[lv] if isinstance(lambdas, dict) else lambdas)] for lv in range(levels + 1)}
    items = index_pseudo_items(pseudo)
    nfs = ifs = None
    with Scratch(pseudo.sparkSession) as tmp:
        for lam in sorted({x for g in grids.values() for x in g}):
            own = [lv for lv, g in grids.items() if lam in g]
            nf, itf = fit_levels(pseudo.filter(F.col("level").isin(own)), levels, rank, max_iter, lam, seed, num_blocks, items)
            nf, itf = tmp.write(nf, "tune-nodes").withColumn("lambda", F.lit(lam)), tmp.write(itf, "tune-items").withColumn("lambda", F.lit(lam))
            nfs = nf if nfs is None else nfs.unionByName(nf)
            ifs = itf if ifs is None else ifs.unionByName(itf)
        grid = max(len(set(g)) for g in grids.values())
        curves = grid_rmse(validation, assignment, nfs, ifs, node_bound, rank, grid, tmp)
        table = write_table(best_of_grid(curves, grids), "level-lambda")
        best = table.filter("best").select("level", "lambda")  # <= one row per level
        node_f, item_f = (f.join(F.broadcast(best), ["level", "lambda"]).drop("lambda") for f in (nfs, ifs))
        return table, write_table(node_f, "best-nodes"), write_table(item_f, "best-items")
