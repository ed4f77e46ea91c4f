"""End-to-end cold-start evaluation: tree -> pseudo-users -> factors ->
routing -> per-user RMSE. Only scalars reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit import sources
from coldsplit.operators import prepare, stats
from coldsplit.operators.factors import fit_levels, tune_levels
from coldsplit.operators.route import (
    evaluation_pairs,
    predict_node_mean,
    predict_pairs,
    route_users,
)
from coldsplit.operators.tree import InterviewTree, build_tree, rating_rows
from coldsplit.session import materialize, write_table


@dataclass
class ColdStartModel:
    tree: InterviewTree
    pseudo: DataFrame  # level, node, item_id, rating
    node_factors: DataFrame | None = None
    item_factors: DataFrame | None = None
    level_lambda: DataFrame | None = None


def pseudo_users(tree: InterviewTree) -> DataFrame:
    """Mean raw rating per (level, node, item). The ratings are scanned once: sums
    by each user's deepest node, on the salted layout so that a heavy user's rows
    are spread, then rolled up the tree on that small table (the ancestor of node
    n, d levels up, is floor(n / 3^d)). The user rows stay in their buckets; only
    the nodes are dealt to them, before the ratings are unpacked."""
    keys = ["user_id", "salt"]
    nodes = tree.salted_assignment.repartition(tree.buckets, *keys) if tree.buckets else tree.salted_assignment
    deep = nodes.groupBy(*keys).agg(F.max(F.struct("level", "node")).alias("d")).select(*keys, "d.level", "d.node")
    sums = (
        rating_rows(tree.user_rows.join(deep.hint("shuffle_hash"), keys))
        .groupBy("level", "node", "item_id")
        .agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    up = sums.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("level"))))
    up = up.withColumn("node", F.floor(F.col("node") / F.pow(F.lit(3.0), F.col("level") - F.col("l"))).cast("int"))
    rolled = up.groupBy(F.col("l").alias("level"), "node", "item_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return rolled.select("level", "node", "item_id", (F.col("s") / F.col("n")).alias("rating"))


def fit(
    train: DataFrame,
    depth: int = 3,
    k: int = 200,
    order: str = "most",
    lam: float = 7.0,
    predictor: str = "als",
    rank: int = 10,
    max_iter: int = 15,
    reg: float | dict = 0.01,
    seed: int = 10,
    validation: DataFrame | None = None,
    lambdas=None,
    num_blocks: int | None = None,
) -> ColdStartModel:
    """Tree, pseudo-users and factors. ``validation`` cells (user_id, item_id, rating)
    are taken out of ``train`` before the tree is built; ``lambdas`` is one grid,
    or one per level."""
    if validation is not None:
        train = write_table(prepare.probe_remove(train, validation), "fit-train")
    tree = build_tree(train, depth=depth, lam=lam, k=k, order=order)
    pseudo = materialize(pseudo_users(tree))
    model = ColdStartModel(tree, pseudo)
    if predictor == "als":
        if validation is not None and lambdas:
            model.level_lambda, model.node_factors, model.item_factors = tune_levels(
                pseudo, tree.levels, validation, tree.assignment, tree.node_bound(), lambdas, rank, max_iter, seed, num_blocks
            )
        else:
            nf, itf = fit_levels(pseudo, tree.levels, rank, max_iter, reg, seed, num_blocks)
            model.node_factors, model.item_factors = materialize(nf), materialize(itf)
    return model


def known_items(model: ColdStartModel) -> DataFrame:
    """Items with a training rating: those of the root's pseudo-user."""
    return model.pseudo.filter("level = 0").select("item_id")


def score(model: ColdStartModel, test: DataFrame, train: DataFrame | None = None, max_questions: int | None = None, routed: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, rating, level, node, prediction) for the test cells
    on known, not-asked items. Known: rated in ``train``, or in what the model was
    fitted on."""
    if routed is None:
        routed = route_users(model.tree, test, max_questions)
    # counted and joined by every step below: written once
    pairs = write_table(evaluation_pairs(routed, test, known_items(model) if train is None else prepare.rated_items(train)), "eval-pairs")
    if model.node_factors is None:
        return predict_node_mean(pairs, model.pseudo)
    n_nodes = model.tree.node_bound()
    return predict_pairs(pairs, model.node_factors, model.item_factors, n_nodes)


def summary(preds: DataFrame, test: DataFrame) -> DataFrame:
    """rmse_macro, n_users, n_pairs, n_skipped (test users with nothing to score)."""
    per_user = stats.rmse_per_user(preds)
    n_test_users = test.select("user_id").distinct().count()
    return per_user.agg(
        F.avg("rmse").alias("rmse_macro"),
        F.count(F.lit(1)).alias("n_users"),
        F.sum("n").alias("n_pairs"),
    ).withColumn("n_skipped", F.lit(n_test_users) - F.col("n_users"))


def evaluate_model(model: ColdStartModel, test: DataFrame, train: DataFrame | None = None, max_questions: int | None = None) -> DataFrame:
    """Macro RMSE of unseen users (or items, if the model was fitted on swapped
    roles). Users whose every test item was asked are skipped and counted."""
    return summary(score(model, test, train, max_questions), test)


def evaluate_new_users(
    ratings: DataFrame,
    frac: float = 0.7,
    mode: str = "new_user",
    max_questions: int | None = None,
    **fit_args,
) -> DataFrame:
    """Split by id, fit, evaluate. mode='new_item' swaps the roles of users and
    items first."""
    r = prepare.swap_roles(ratings) if mode == "new_item" else ratings
    # read by every stage below: write once, then scan with pushed filters
    r = write_table(prepare.drop_unrated(r), "eval-ratings")
    train, test = prepare.prefix_split(r, frac)
    return evaluate_model(fit(train, **fit_args), test, None, max_questions)


def interview_length_eval(model: ColdStartModel, test: DataFrame, train: DataFrame | None, lengths) -> DataFrame:
    """Macro RMSE when only the first q questions are asked, for each q. Users walk
    once: their state after q questions is the start of the full walk."""
    lengths = list(lengths)
    routed = write_table(route_users(model.tree, test, max(lengths, default=0)), "routed")
    out = None
    for q in lengths:
        # the child a question led to: 3 * node + 0, 1 or 2 (like, dislike, unknown)
        node = F.aggregate(
            F.slice("asked", 1, q) if q else F.slice("asked", 1, 0),
            F.lit(0),
            lambda n, a: n * 3 + F.when(a["attitude"] == "L", 0).when(a["attitude"] == "D", 1).otherwise(2),
        )
        cut = routed.select("user_id", F.least(F.col("level"), F.lit(q)).alias("level"), node.cast("int").alias("node"), F.slice("asked", 1, q).alias("asked"))
        per_user = stats.rmse_per_user(score(model, test, train, routed=cut))
        row = per_user.agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_users")).select(
            F.lit(q).alias("questions"), "rmse", "n_users"
        )
        out = row if out is None else out.unionByName(row)
    return out


def save_model(model: ColdStartModel, path: str) -> None:
    """Everything routing, scoring and further fitting need, as Parquet tables."""
    sources.save_tree(model.tree, f"{path}/tree")
    tables = {"pseudo": model.pseudo, "node_factors": model.node_factors, "item_factors": model.item_factors, "level_lambda": model.level_lambda}
    sources.save_tables({k: v for k, v in tables.items() if v is not None}, path)


def load_model(spark: SparkSession, path: str) -> ColdStartModel:
    names = sources.table_names(spark, path)
    got = {k: sources.load_table(spark, path, k) for k in ("pseudo", "node_factors", "item_factors", "level_lambda") if k in names}
    return ColdStartModel(tree=sources.load_tree(spark, f"{path}/tree"), **got)
