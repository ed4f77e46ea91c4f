"""Structured Streaming: route users whose answers arrive as a stream.

Routing is stateless given a static tree, so a stream of one row per user
``(user_id, answers map<int,double>)`` is joined, level by level, with the
static split and node tables (stream-static broadcast joins). No watermark or
state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldsplit.operators.route import route_answers
from coldsplit.operators.tree import InterviewTree
from coldsplit.session import bounded_broadcast as _bcast

ANSWERS_SCHEMA = "user_id int, item_id int, rating double"


def answers_from_rows(tree: InterviewTree, rows: DataFrame) -> DataFrame:
    """(user_id, item_id, rating) rows of one micro-batch -> one row per user.

    Only answers to split items are kept (broadcast of the distinct split
    items, bounded by the node count), so each map is bounded by the tree
    size, not by how much a user rated."""
    items = tree.splits.select("item_id").distinct()
    kept = rows.join(_bcast(items, tree.split_bound()), "item_id")  # <= one row per split
    answers = kept.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "rating"))).alias("answers")
    )
    users = rows.select("user_id").distinct()
    return users.join(answers, "user_id", "left").select(
        "user_id", F.coalesce("answers", F.create_map().cast("map<int,double>")).alias("answers")
    )


def route_stream(tree: InterviewTree, answers: DataFrame, max_questions: int | None = None) -> DataFrame:
    """Streaming (or batch) DataFrame of (user_id, answers) -> routed users."""
    return route_answers(tree, answers, max_questions).select(
        "user_id",
        "level",
        "node",
        F.array_join(
            F.transform("asked", lambda x: F.concat(x.item_id.cast("string"), F.lit(":"), x.attitude)), ","
        ).alias("asked"),
        F.array_join("trace", "").alias("trace"),
    )


def start_routing(tree: InterviewTree, source_dir: str, sink, checkpoint_dir: str, max_questions=None):
    """Route each micro-batch of answer files found in ``source_dir`` and hand
    the routed rows to ``sink(batch_df, batch_id)`` (foreachBatch, so the sink
    decides idempotent writes). Answers of a user must arrive in one batch."""
    spark = tree.splits.sparkSession
    rows = spark.readStream.schema(ANSWERS_SCHEMA).parquet(source_dir)

    def _batch(df, batch_id):
        sink(route_stream(tree, answers_from_rows(tree, df), max_questions), batch_id)

    return (
        rows.writeStream.foreachBatch(_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
