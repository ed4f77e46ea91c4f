"""Many-to-one joins that stay balanced when one key holds a large share of
the rows (a heavy user, a hot item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldsplit.session import (
    ARRAY_ITEMS,
    BROADCAST_BYTE_LIMIT,
    BROADCAST_ROW_LIMIT,
    Scratch,
    bounded_broadcast,
    is_scan,
    row_bytes,
    write_table,
)

DEFAULT_KEY_ROWS = 200_000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    salt_by: list[str],
    how: str = "inner",
    key_rows: int = DEFAULT_KEY_ROWS,
    broadcast_rows: int | None = None,
    array_items: int = ARRAY_ITEMS,
    tmp: Scratch | None = None,
) -> DataFrame:
    """``big JOIN small ON keys`` where ``small`` has few rows per key.

    Keys with more than ``key_rows`` rows in ``big`` are split into
    ceil(n / key_rows) salt buckets by a hash of ``salt_by`` (deterministic,
    so retried tasks see the same rows); ``small`` is replicated over the
    buckets of those keys only. Heavy keys number at most rows / key_rows and
    are counted before their salt table is broadcast. Without heavy keys this
    is the plain join. When ``small`` itself is small by count, it is simply
    broadcast: a broadcast join does not move ``big`` and no key can skew it.
    ``small`` is written once unless it is a scan of files already; what is written
    belongs to ``tmp`` if given.
    """
    write = tmp.write if tmp else write_table
    if not is_scan(small):
        small = write(small, "join-small")  # counted and joined: computed once
    n_small = small.count()
    limit = BROADCAST_ROW_LIMIT if broadcast_rows is None else broadcast_rows
    fits = n_small <= limit and n_small * row_bytes(small, array_items) <= BROADCAST_BYTE_LIMIT
    if fits and how in ("inner", "left", "left_semi", "left_anti"):
        return big.join(F.broadcast(small), keys, how)  # n_small rows, counted above
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = write(
        counts.filter(F.col("_n") > key_rows).select(*keys, F.ceil(F.col("_n") / F.lit(key_rows)).cast("int").alias("_ns")),
        "join-heavy",
    )
    n_heavy = heavy.count()
    if n_heavy == 0:
        return big.join(small, keys, how)
    h = bounded_broadcast(heavy, n_heavy)
    b = big.join(h, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_by), F.coalesce(F.col("_ns"), F.lit(1))).cast("int")
    ).drop("_ns")
    s = small.join(h, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)) - 1))
    ).drop("_ns")
    return b.join(s, keys + ["_salt"], how).drop("_salt")
