"""Stand-in rating tables derived (by Spark) from the TPC-H-ish test tables.

Every fixture is a lazy DataFrame over the parquet files, so its work grows
with the tables. The same definitions, as SQL, live in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.functions import star_from_quantity
from coldsplit.session import bucket_count

TRAIN_FRACTION = 0.7
ROWS_PER_TASK = 1_000_000  # of lineitem, in the shuffles that build the ratings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Shuffle partitions that follow the rows, so that a task's memory does not grow
    with the tables."""
    return bucket_count(spark, table(spark, sf_dir, "lineitem").count(), ROWS_PER_TASK)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One star per lineitem: (user_id=customer, item_id=part, rating)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = _parts(spark, sf_dir)
    li, od = li.repartition(n, "l_orderkey"), od.repartition(n, "o_orderkey").hint("shuffle_hash")  # lines are not sorted
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        star_from_quantity(F.col("l_quantity")).cast("double").alias("rating"),
        F.col("l_suppkey").cast("int").alias("supp_id"),
    )


def ratings_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse customer x part ratings, duplicates resolved by max."""
    return (
        raw_cells(spark, sf_dir)
        .select("user_id", "item_id", "rating")
        .repartition(_parts(spark, sf_dir), "user_id", "item_id")
        .groupBy("user_id", "item_id")
        .agg(F.max("rating").alias("rating"))
    )


def ratings_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denser customer x supplier ratings, duplicates resolved by rounded mean."""
    return (
        raw_cells(spark, sf_dir)
        .select("user_id", F.col("supp_id").alias("item_id"), "rating")
        .repartition(_parts(spark, sf_dir), "user_id", "item_id")
        .groupBy("user_id", "item_id")
        .agg(F.round(F.avg("rating")).cast("double").alias("rating"))
    )


RATINGS = {"part": ratings_part, "supp": ratings_supp}


def ratings(spark: SparkSession, sf_dir: str, which: str = "supp") -> DataFrame:
    return RATINGS[which](spark, sf_dir)


def probe_pairs(spark: SparkSession, sf_dir: str, which: str = "supp") -> DataFrame:
    """(item_id, user_id) pairs: every tenth training cell by a fixed hash, plus
    pairs that have no rating at all (they must vanish in ``probe_extract``)."""
    r = ratings(spark, sf_dir, which)
    hit = r.filter(((F.col("user_id") * 31 + F.col("item_id") * 17) % 10) == 0).select(
        "item_id", "user_id"
    )
    # absent pairs: negative item ids never occur in the ratings
    absent = (
        r.filter((F.col("user_id") % 7) == 0)
        .select((F.lit(-1) - F.col("user_id") % 5).cast("int").alias("item_id"), "user_id")
        .distinct()
    )
    return hit.unionByName(absent)


def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> (asin, title, description, price)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").cast("double").alias("price"),
    )


def coded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-coded reviews: reviewerID 'A<cust>', asin codes of mixed shapes."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = F.col("l_partkey")
    code = (
        F.when(p % 3 == 0, F.lpad(p.cast("string"), 9, "0"))
        .when(p % 3 == 1, F.lpad(p.cast("string"), 10, "0"))
        .otherwise(F.concat(F.lit("B"), F.lpad(p.cast("string"), 9, "0")))
    )
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("reviewerID"),
        code.alias("asin"),
        star_from_quantity(F.col("l_quantity")).cast("double").alias("overall"),
    )


# the probe pairs in SQL, over a CTE named ratings
PROBE_SQL = (
    "probe AS (SELECT item_id, user_id FROM ratings WHERE (user_id * 31 + item_id * 17) % 10 = 0"
    " UNION SELECT CAST(-1 - user_id % 5 AS INT) AS item_id, user_id FROM ratings WHERE user_id % 7 = 0)"
)
