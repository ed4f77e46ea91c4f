"""Small pieces shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = "[^ \\t\\n\\x0B\\f\\r]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII strings take Spark's fast ``lower``;
    others are translated letter by letter so that no other character moves."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RE)).cast("long")


def parallel(spark: SparkSession) -> int:
    """Partitions for a step whose cost is CPU, not bytes: as many as a shuffle
    of the session has, and two for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a partition that is sorted by ``keys``, one at a time; only the
    group at hand and one batch are held."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        cuts = [*change.nonzero()[0], len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[a:b]
            key = tuple(part[k].iat[0] for k in keys)
            if held and key != held_key:
                yield held_key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(part)
    if held:
        yield held_key, pd.concat(held) if len(held) > 1 else held[0]


def blocked_groups(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """Prepare all-against-all work inside groups so that no task gets more
    than two blocks of a group.

    ``rows`` has one row per group member (``keys``, ``item``). A group of more
    than ``block`` members is split by a hash of ``item`` into blocks; the row
    then goes to every pair of blocks that has its own. Adds ``_bi <= _bj`` (the
    pair) and ``_b`` (the row's own block). Groups of one member are left out:
    they have no partner. Nothing else is dropped."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        *keys, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_nb")
    )
    own = rows.join(counts, keys).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    return (
        own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("_bi", F.least("_b", "_o"))
        .withColumn("_bj", F.greatest("_b", "_o"))
        .drop("_o", "_nb")
    )
