"""K-d tree sharding: law `bytes`.

Documents are points (one coordinate per metadata column) with a weight, their
bytes. A node with several leaves left is split along the dimension that is
widest in it (spread of the coordinate against the spread over all documents),
at the weighted quantile that gives each side the bytes of its share of the
leaves (the median for an even number), until each leaf has about
total / shards bytes.

Quantiles are distributed: each round sums the bytes of at most BINS ranges of
every open node, keeps the range in which the quantile lies, and narrows it to
the values seen in it, until it holds one value or few bytes. A coordinate is
32 bits of the metadata, then 15 bits of a hash of the text and 16 bits of a
hash of text and doc_id: so documents of one metadata value can still be
divided, and copies of a text stay side by side. The tree (2 * shards numbers)
becomes array literals in the plan; only coordinates and bytes are rewritten, a
level at a time, while it grows.

Slots: rows of a shard are numbered by ranges of a hash, each range counted and
offset, so no shard is sorted in one task.

Only DataFrame functions. Defined results: null or empty text weighs 8 bytes;
null metadata is a value of its own (coordinate 0); rows equal in metadata, text and
doc_id stay together; an empty table gives an empty result; extra columns are
ignored unless asked for, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldsplit.llm.common import table, text_or_empty
from coldsplit.session import write_table

SHARDS = 24
BINS = 256
TOLERANCE = 0.001  # of a leaf's bytes, by which a quantile may be missed
ROWS_PER_RANGE = 20_000
TIE_BITS = 31


def _coordinates(dims: list[Column], text: Column, doc_id: Column) -> Column:
    tie = F.pmod(F.xxhash64(text), F.lit(1 << 15)) * (1 << 16) + F.pmod(F.xxhash64(text, doc_id), F.lit(1 << 16))
    return F.array(*[F.coalesce(d, F.lit(0)).cast("long") * (1 << TIE_BITS) + tie for d in dims])


def metadata_dims(docs: DataFrame) -> list[Column]:
    """Coordinates (0 to 2**32 - 1) of the documents' own metadata: the text's
    length on a log scale, and hashes of source and language."""
    size = F.octet_length(text_or_empty()).cast("double")
    dims = [(F.log2(size + 1) * (1 << 25)).cast("long")]
    return dims + [F.crc32(F.col(c).cast("string")) for c in ("source", "lang") if c in docs.columns]


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    dim: int = -1
    cut: int = 0  # larger coordinates go right
    left: int = -1  # the right child is the next one


def _lookup(nodes: list[Node], field: str, at: Column) -> Column:
    return F.get(F.array(*[F.lit(getattr(n, field)).cast("long") for n in nodes]), at.cast("int"))


def _step(points: DataFrame, nodes: list[Node]) -> DataFrame:
    """Moves ``node`` one split down; a leaf keeps its rows."""
    value = F.get("k", F.greatest(_lookup(nodes, "dim", F.col("node")), F.lit(0)).cast("int"))
    df = points.withColumns({"_v": value, "_cut": _lookup(nodes, "cut", F.col("node")), "_left": _lookup(nodes, "left", F.col("node"))})
    below = F.when(F.col("_left") < 0, F.col("node")).otherwise(F.col("_left") + (F.col("_v") > F.col("_cut")).cast("long"))
    return df.withColumn("node", below).drop("_v", "_cut", "_left")


def _quantiles(points: DataFrame, nodes: list[Node], jobs: dict[int, dict], tolerance: float) -> None:
    """Set dim and cut of the nodes in ``jobs`` (node -> want, lo, hi): the
    smallest coordinate with at least ``want`` bytes at or under it."""
    open_jobs = dict(jobs)
    while open_jobs:
        size = len(nodes)
        lo = F.get(F.array(*[F.lit(open_jobs[i]["lo"] if i in open_jobs else 0).cast("long") for i in range(size)]), F.col("node").cast("int"))
        hi = F.get(F.array(*[F.lit(open_jobs[i]["hi"] if i in open_jobs else -1).cast("long") for i in range(size)]), F.col("node").cast("int"))
        v = F.get("k", F.greatest(_lookup(nodes, "dim", F.col("node")), F.lit(0)).cast("int"))
        here = points.withColumns({"v": v, "lo": lo, "hi": hi}).filter("v between lo and hi")
        width = F.floor((F.col("hi") - F.col("lo")) / F.lit(BINS)).cast("long") + 1
        bins = here.groupBy("node", F.floor((F.col("v") - F.col("lo")) / width).cast("long").alias("bin"))
        got: dict[int, list] = {}
        for r in bins.agg(F.sum("bytes").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # BINS + 1 rows a node at most
            got.setdefault(r["node"], []).append((r["bin"], r["bytes"], r["lo"], r["hi"]))
        for i, job in list(open_jobs.items()):
            used = job["used"]
            for _, size_, lo_, hi_ in sorted(got.get(i, [])):
                if used + size_ >= job["want"]:
                    break
                used += size_
            job |= {"used": used, "lo": lo_, "hi": hi_}
            nodes[i].cut = hi_
            if lo_ == hi_ or size_ <= tolerance:
                if 0 < used and used + size_ - job["want"] > job["want"] - used:
                    nodes[i].cut = lo_ - 1  # nearer without the last range
                del open_jobs[i]


def build_tree(points: DataFrame, shards: int, dims: int) -> tuple[list[Node], DataFrame]:
    """The tree, and ``points`` (k: array of coordinates, bytes, others) with the
    leaf ``node`` of each. The points are rewritten a level at a time, so that no
    plan grows with the depth."""
    nodes = [Node(shards, 0)]
    at = points.withColumn("node", F.lit(0).cast("long"))
    total = points.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    whole: list[float] = []
    frontier = [0]
    while frontier and total:
        spread = [f(F.get("k", F.lit(d))).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        rows = {r["node"]: r for r in at.groupBy("node").agg(F.sum("bytes").alias("bytes"), *spread).collect()}  # one row a node
        jobs, after = {}, []
        for i in frontier:
            if nodes[i].leaves < 2 or i not in rows:
                continue
            r = rows[i]
            widths = [(r[f"hi{d}"] - r[f"lo{d}"]) >> TIE_BITS for d in range(dims)]
            whole = whole or [max(1, w) for w in widths]
            d = max(range(dims), key=lambda d: (widths[d] / whole[d], -d))
            half = nodes[i].leaves // 2
            nodes[i].dim = d
            jobs[i] = {"want": r["bytes"] * half / nodes[i].leaves, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "used": 0}
        _quantiles(at, nodes, jobs, TOLERANCE * total / shards)
        for i in jobs:
            half = nodes[i].leaves // 2
            nodes[i].left = len(nodes)
            nodes += [Node(half, nodes[i].first), Node(nodes[i].leaves - half, nodes[i].first + half)]
            after += [nodes[i].left, nodes[i].left + 1]
        frontier = after
        at = write_table(_step(at, nodes), "kd-level")
    return nodes, at


def shard(docs: DataFrame, dims: list[Column] | None = None, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (struct of the ``carry`` columns: small ones, as they are rewritten a
    level at a time), size, text_crc32, shard, slot."""
    dims = dims or metadata_dims(docs)
    t = text_or_empty(text)
    points = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), (F.octet_length(t) + 8).cast("long").alias("bytes"), F.crc32(t).alias("text_crc32"),
        F.xxhash64(t, F.col(doc_id)).alias("h"), _coordinates(dims, t, F.col(doc_id)).alias("k"),
    )
    points = write_table(points, "kd-points")
    nodes, placed = build_tree(points, shards, len(dims))
    placed = placed.withColumn("shard", _lookup(nodes, "first", F.col("node")).cast("int"))
    # slots: offsets of counted hash ranges, then numbers inside a range
    ranges = max(1, -(-points.count() // (ROWS_PER_RANGE * shards)))
    placed = placed.withColumn("part", F.pmod("h", F.lit(ranges)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "text_crc32"))
    out = placed.withColumn("inside", inside).join(offsets, ["shard", "part"])
    return out.select("row", F.col("bytes").alias("size"), "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
