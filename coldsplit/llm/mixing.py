"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (by a hash of the
row, so reruns agree) that may be read up to ``repeats`` times over. An item's
virtual finish time is the cumulative number of its source's tokens, itself
included, divided by the source's weight. Items are taken in order of finish
time over all sources until the budget is used: a source that runs dry leaves
its share to the others by weight, which is the target rule.

The global order is never gathered: finish times are cut into ranges by sampled
boundaries, ranges are summed, the range where the budget ends is known from
the sums, and only its rows are summed one by one. The running sums inside a
source work the same way, by ranges of the shuffle key. The cut is one (time,
key) pair; what a document contributes is then a comparison on its row.

Sources (one row each) are ranked and their targets solved in one small window.
Times are exact integers (cumulative tokens times lcm(weights) / weight).

Defined results: null or empty text has size 0 and contributes nothing; a null
source is a source, last in order; rows that tie in every field are taken
together or in order of doc_id, the same on each run; an empty table gives an
empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldsplit.llm.common import table, text_or_empty, word_count
from coldsplit.session import write_table

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
REPEATS = 3
ROWS_PER_RANGE = 20_000
BINS = 1024
SEED = "mix-1"


def _targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(src, source_size, weight, target): target = min(repeats * size, weight * v)
    with the v that spends the total. Sources in order of cap / weight fill up
    first; v is found at the first prefix whose rest does not fill."""
    by_name = Window.orderBy(F.col("src").isNull(), "src")  # one row a source
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), rank.cast("int"))).withColumn("cap", F.col("source_size") * repeats)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(full), F.lit(0))
    s = s.withColumn("v", left / weight_left)  # the level if those before are full and this one is not
    v = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("v"), F.col("v"))).over(everything)
    return s.select("src", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(v, F.lit(0.0))).alias("target"))


def _cut(queue: DataFrame, budget: int, lcm: int, repeats: int) -> tuple[int, str] | None:
    """(finish time, key) of the last item that the budget pays for; None if it
    pays for none. The range that holds it is narrowed by sums of up to BINS
    ranges until it has few enough rows to be summed one by one."""
    times = queue.filter("size > 0").select("key", F.col("load").alias("load"), F.explode(F.array(*[_finish(r, lcm) for r in range(repeats)])).alias("time"))
    r = times.agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n, used = r["lo"], r["hi"], r["n"], 0
    if not n:
        return None
    while n > ROWS_PER_RANGE and lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        here = times.filter(F.col("time").between(lo, hi)).groupBy(((F.col("time") - lo) / F.lit(width)).cast("long").alias("bin"))
        bins = here.agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi")).orderBy("bin").collect()
        for b in bins:  # BINS rows at most
            lo, hi, n = b["lo"], b["hi"], b["n"]
            if used + b["load"] > budget:
                break
            used += b["load"]
        else:
            return hi, "g"  # the budget pays for everything: after any hex key
    run = F.sum("load").over(Window.orderBy("time", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = times.filter(F.col("time").between(lo, hi)).withColumn("run", run + used).filter(F.col("run") <= budget)
    last = near.agg(F.max(F.struct("time", "key")).alias("x")).first()["x"]
    return (last["time"], last["key"]) if last else (lo, "")


def _finish(r: int, lcm: int):
    """Finish time of the r-th reading, in units of 1 / lcm."""
    return (F.col("cum") + r * F.col("source_size")) * (F.lit(lcm) / F.col("weight")).cast("long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, taken): the ``carry`` columns of each input
    row (all by default) as a struct, its tokens, its source's tokens and target,
    and the tokens the mix takes of it."""
    t, lcm = text_or_empty(text), math.lcm(*weights)
    key = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(source), F.lit("-")), t))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(source).alias("src"), key.alias("key"), word_count(t).alias("size"))
    # rows that are equal in doc_id, source and text are one item of the queue
    queue = src.groupBy("src", "key", "size").agg((F.col("size") * F.count(F.lit(1))).alias("load"))
    queue = write_table(queue, "mix-queue")
    n = max(1, -(-queue.count() // ROWS_PER_RANGE))
    sources = write_table(_targets(queue.groupBy("src").agg(F.sum("load").alias("source_size")), weights, repeats), "mix-sources")

    # running sums by ranges of the shuffle key: a hash, so equal ranges are even
    queue = queue.withColumn("part", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(2**32)).cast("int"))
    parts = queue.groupBy("src", "part").agg(F.sum("load").alias("part_size"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0))).select(F.col("src").alias("s1"), F.col("part").alias("p1"), "before")
    inside = Window.partitionBy("src", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = (
        queue.withColumn("inside", F.sum("load").over(inside))
        .join(parts, F.col("src").eqNullSafe(F.col("s1")) & (F.col("part") == F.col("p1")))
        .join(sources.withColumnRenamed("src", "s2"), F.col("src").eqNullSafe(F.col("s2")))
        .select("src", "key", "size", "load", "source_size", "weight", "target", (F.col("before") + F.col("inside")).alias("cum"))
    )
    queue = write_table(queue, "mix-times")
    budget = sources.agg(F.sum("source_size").alias("b")).first()["b"] or 0
    cut = _cut(queue, budget, lcm, repeats)
    readings = F.lit(0)
    if cut:
        for r in range(repeats):
            time = _finish(r, lcm)
            readings = readings + F.when((time < cut[0]) | ((time == cut[0]) & (F.col("key") <= cut[1])), 1).otherwise(0)
    shares = queue.select(F.col("src").alias("s1"), F.col("key").alias("k1"), "source_size", "target", (F.col("size") * readings).alias("taken"))
    out = src.join(shares, (F.col("key") == F.col("k1")) & F.col("src").eqNullSafe(F.col("s1")))
    return out.select("row", "size", "source_size", "target", "taken")


def take(docs: DataFrame, **columns) -> DataFrame:
    """The mix itself: each row as often as the mix reads it, columns as they came."""
    copies = mix(docs, **columns).filter("taken > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return copies.select("row.*")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS size,
           md5('mix-1' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce(source, '-') || chr(31) || coalesce(text, '')) AS key FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS v
       FROM s1 WINDOW w AS (ORDER BY cap / weight, src IS NULL, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(CAST(cap AS DOUBLE), weight * coalesce(max(CASE WHEN cap / weight >= v THEN v END) OVER (), 0.0)) AS target FROM s2),
q AS (SELECT src, key, size, size * count(*) AS load FROM d GROUP BY src, key, size),
c AS (SELECT q.*, sum(load) OVER (PARTITION BY src ORDER BY key ROWS UNBOUNDED PRECEDING) AS cum FROM q),
t AS (SELECT c.src, c.key, c.size, c.load, (c.cum + r.r * s3.source_size) * (10 // s3.weight) AS time
      FROM c JOIN s3 ON c.src IS NOT DISTINCT FROM s3.src, (SELECT unnest([0, 1, 2]) AS r) r WHERE c.size > 0),
u AS (SELECT *, sum(load) OVER (ORDER BY time, key ROWS UNBOUNDED PRECEDING) AS run FROM t),
k AS (SELECT src, key, sum(size) AS taken FROM u WHERE run <= (SELECT sum(source_size) FROM s0) GROUP BY src, key)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, s3.source_size, CAST(s3.target AS DOUBLE) AS target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN s3 ON d.src IS NOT DISTINCT FROM s3.src LEFT JOIN k ON d.key = k.key AND d.src IS NOT DISTINCT FROM k.src
"""
