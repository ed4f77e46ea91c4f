"""Aggregations over COO rating tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldsplit.functions import histogram_bin
from coldsplit.operators.skew import salted_join

EPS = 1e-9  # fixed value: denominator guard of the split error


def global_mean(ratings: DataFrame) -> float:
    return ratings.agg(F.avg("rating")).first()[0]


def user_bias(ratings: DataFrame, lam: float = 7.0, mean: float | None = None) -> DataFrame:
    """(user_id, bias, n): (sum r + lam * mean) / (lam + n)."""
    if mean is None:
        mean = global_mean(ratings)
    return ratings.groupBy("user_id").agg(
        ((F.sum("rating") + F.lit(lam * mean)) / (F.lit(lam) + F.count(F.lit(1)))).alias("bias"),
        F.count(F.lit(1)).alias("n"),
    )


def residuals(ratings: DataFrame, bias: DataFrame) -> DataFrame:
    """rating - bias of the user; a heavy user's rows are spread by item."""
    return salted_join(ratings, bias.select("user_id", "bias"), ["user_id"], ["item_id"]).withColumn(
        "e", F.col("rating") - F.col("bias")
    )


def item_stats(ratings: DataFrame, bias: DataFrame) -> DataFrame:
    """Root-node sums per item of e = r - bias: s, s2, n."""
    e = residuals(ratings, bias)
    return e.groupBy("item_id").agg(
        F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("s2"), F.count(F.lit(1)).alias("n")
    )


def node_item_stats(ratings: DataFrame, bias: DataFrame, assignment: DataFrame) -> DataFrame:
    """(level, node, item_id, s, s2, n) of residuals for every node of the tree."""
    e = residuals(ratings, bias)
    return (
        salted_join(e, assignment.select("level", "node", "user_id"), ["user_id"], ["item_id"])
        .groupBy("level", "node", "item_id")
        .agg(
            F.sum("e").alias("s"),
            F.sum(F.col("e") * F.col("e")).alias("s2"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def node_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("level", "node").agg(F.count(F.lit(1)).alias("n_users"))


def pseudo_user_ratings(
    ratings: DataFrame, assignment: DataFrame, variant: str = "mean"
) -> DataFrame:
    """Mean raw rating per (level, node, item) over the users of the node.

    ``variant="eps"`` divides by ``n + 1e-9`` and drops exact zeros, as the
    large-matrix scripts do.
    """
    j = salted_join(ratings, assignment.select("level", "node", "user_id"), ["user_id"], ["item_id"])
    g = j.groupBy("level", "node", "item_id")
    if variant == "eps":
        out = g.agg((F.sum("rating") / (F.count(F.lit(1)) + F.lit(EPS))).alias("rating"))
        return out.filter(F.col("rating") != 0)
    return g.agg(F.avg("rating").alias("rating"))


def dataset_stats(ratings: DataFrame) -> DataFrame:
    """Users/items as reported (max id) and as counted, ratings, density."""
    return ratings.agg(
        F.max("user_id").alias("max_user_id"),
        F.max("item_id").alias("max_item_id"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_ratings"),
    ).withColumn(
        "density",
        F.col("n_ratings") / F.col("max_user_id").cast("double") / F.col("max_item_id").cast("double"),
    )


def entity_counts(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return ratings.agg(
            F.approx_count_distinct("item_id").alias("item_size"),
            F.approx_count_distinct("user_id").alias("user_size"),
        )
    return ratings.agg(
        F.countDistinct("item_id").alias("item_size"), F.countDistinct("user_id").alias("user_size")
    )


def ratings_per_user(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings"))


def rating_count_histogram(counts: DataFrame, col: str = "n_ratings", bins: int = 1000) -> DataFrame:
    """Equal-width histogram of a count column over [min, max] (two scalars
    reach the driver; the binning and counting stay distributed)."""
    lo, hi = counts.agg(F.min(col), F.max(col)).first()
    lo = 0 if lo is None else lo
    hi = 0 if hi is None else hi
    return (
        counts.select(histogram_bin(F.col(col), F.lit(lo), F.lit(hi), bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(float(lo)) + F.lit(float(hi - lo)) * F.col("bin") / F.lit(bins)).alias("bin_lo"),
            "n",
        )
    )


def histogram_view(counts: DataFrame, col: str = "n_ratings", bins: int = 1000, view: tuple[float, float] | None = None) -> DataFrame:
    """(bin, bin_lo, bin_hi, n) of every bin, empty ones too, that meets the window
    ``view`` of the counted values (both ends included). An empty table has no bins."""
    lo, hi = counts.agg(F.min(col), F.max(col)).first()
    found = rating_count_histogram(counts, col, bins).select("bin", "n")
    every = counts.sparkSession.range(bins if lo is not None else 0).select(F.col("id").cast("int").alias("bin"))
    low, span = float(lo or 0), float((hi or 0) - (lo or 0))
    out = every.join(F.broadcast(found), "bin", "left").select(  # a row a bin at most
        "bin",
        (F.lit(low) + F.lit(span) * F.col("bin") / F.lit(bins)).alias("bin_lo"),
        (F.lit(low) + F.lit(span) * (F.col("bin") + 1) / F.lit(bins)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
    return out if view is None else out.filter((F.col("bin_hi") >= view[0]) & (F.col("bin_lo") <= view[1]))


def smallest_n(counts: DataFrame, col: str = "n_ratings", n: int = 10) -> DataFrame:
    """The n smallest values of a count column (a top-k report)."""
    return counts.select(col).orderBy(F.col(col)).limit(n)


def rmse_micro(pairs: DataFrame, label: str = "rating", pred: str = "prediction") -> DataFrame:
    return pairs.agg(
        F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def rmse_per_user(pairs: DataFrame, label: str = "rating", pred: str = "prediction") -> DataFrame:
    return pairs.groupBy("user_id").agg(
        F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def rmse_macro(per_user: DataFrame) -> DataFrame:
    return per_user.agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_users"))
