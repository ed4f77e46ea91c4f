"""Connected components as Spark jobs: alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each step is an aggregation (minimum neighbour, combined map-side) and a join,
so a node of any degree is never gathered in one place; edge tables are written
to the shared checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldsplit.session import write_table


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(low, "u")
        .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .filter("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str, write=write_table) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest
    node that can be reached. Null ends and self-links are ignored; an empty
    edge table gives an empty result. ``write`` writes the edge tables."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = write(e, "edges")
    seen = _signature(e)
    while seen[0]:
        e = write(_small_star(_large_star(e)), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
