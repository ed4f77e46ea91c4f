"""SimHash near-duplicates: fingerprints in numpy, BK-trees for the links,
connected components for the groups.

Links are exact. If two 64-bit fingerprints differ in at most r bits and the 64
bits are cut into b > r bands, at least b - r bands agree; so each fingerprint
goes to one shard per choice of b - r bands (its key: those bands' bits) and
any linked pair meets in a shard. A shard's tree is a BK-tree (children keyed by
their Hamming distance to the parent); a search follows only edges within the
radius of its own distance. Trees have no size bound that could be proven
before a broadcast, so they travel by shard key in a shuffle and their queries
with them. Shards of more than ``block`` fingerprints are split into blocks
and each pair of blocks is searched, so a task's tree is bounded. b grows with
the number of distinct fingerprints to keep shards small; every b is exact.

Only distinct fingerprints are linked: copies share one node. A shard emits
a spanning set of its links (those that join two groups), not all pairs.

Defined results: null text has no words; no words gives fingerprint zero, which
links like any other; fewer words than a shingle are one shingle; repeated rows
are separate rows with the same fingerprint; component ids are the smallest
doc_id reachable, nulls ignored (null if a group has no other); an empty table
gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import blocked_groups, parallel, table, whole_groups
from coldsplit.llm.components import connected_components
from coldsplit.session import write_table

SHINGLE_WORDS = 4
MAX_BITS = 4
TREE_BLOCK = 8192
SHARD_ROWS = 64
SLAB = 1 << 14


def fingerprint_of(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half the shingles' XXH64."""
    tokens = text.encode().lower().split() if text else []  # bytes: A-Z and [\x20\x09-\x0D] only
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes).tolist(), ends[words - 1 :].tolist() or [len(flat)]
    h64 = xxhash.xxh64_intdigest
    n, ones = len(stops), np.zeros(64, np.int64)
    for a in range(0, n, SLAB):
        h = np.array([h64(flat[s:e], 42) for s, e in zip(starts[a : a + SLAB], stops[a : a + SLAB], strict=False)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS):
    """A column with the fingerprint of ``text``."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return simhash(text)


class BKTree:
    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                break
            at = nxt
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits away; only edges that can hold one are followed."""
        found: list[int] = []
        stack = [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            stack += [c for k, c in children[at].items() if low <= k <= high]
        return found


def spanning_links(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join groups: within ``tree_side``, or if ``query_side`` is
    given between the two sides."""
    tree, links = BKTree(), []
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def link(x: int) -> None:
        for node in tree.within(x, radius):
            y = tree.values[node]
            a, b = root(x), root(y)
            if a != b:
                up[a] = b
                links.append((x, y))

    for x in tree_side:
        if query_side is None:
            link(x)
        tree.add(x)
    for x in query_side or ():
        link(x)
    return links


def band_count(n: int, radius: int) -> int:
    """Bands so that a shard of evenly spread fingerprints has few rows: keys
    have the bits of (bands - radius) bands."""
    b = radius + 1
    while b < 12 and n > SHARD_ROWS * 2 ** (64 * (b - radius) // b):
        b += 1
    return b


def _shard_keys(fp, bands: int, radius: int):
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(bands)]
    keys = []
    for k, chosen in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(masks[i] for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(k).alias("c"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("m")))
    return F.array(*keys)


def fingerprint_links(fps: DataFrame, radius: int = MAX_BITS, block: int = TREE_BLOCK) -> DataFrame:
    """(a, b) spanning links between the distinct fingerprints in ``fps.fp``."""
    spark = fps.sparkSession
    bands = band_count(fps.count(), radius)
    rows = fps.select("fp", F.explode(_shard_keys(F.col("fp"), bands, radius)).alias("k")).select("k.c", "k.m", "fp")
    keys = ["c", "m", "_bi", "_bj"]
    groups = blocked_groups(rows, ["c", "m"], "fp", block).select(*keys, "_b", "fp")
    groups = groups.repartition(parallel(spark), *keys).sortWithinPartitions(*keys)
    full = (1 << 64) - 1

    def search(batches):
        for (_, _, i, j), g in whole_groups(batches, keys):
            fp = [int(x) & full for x in g["fp"].to_numpy()]
            if i == j:
                links = spanning_links(fp, None, radius)
            else:
                own = (g["_b"] == i).to_numpy()
                links = spanning_links([x for x, o in zip(fp, own, strict=True) if o], [x for x, o in zip(fp, own, strict=True) if not o], radius)
            if links:
                yield pd.DataFrame(np.array(links, np.uint64).view(np.int64), columns=["a", "b"])

    return groups.mapInPandas(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), fp, group (a
    fingerprint that stands for the component), component_id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), fingerprints(docs, text, words).alias("fp"))
    rows = write_table(rows, "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = connected_components(fingerprint_links(fps, radius), "a", "b").withColumnsRenamed({"node": "fp", "component": "g"})
    fps = fps.join(linked, "fp", "left").select("fp", "low", F.coalesce("g", "fp").alias("group"))
    fps = fps.join(fps.groupBy("group").agg(F.min("low").alias("component_id")), "group").select("fp", "group", "component_id")
    return rows.join(fps, "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null last), then
    the smallest text hash, then the smallest row."""
    found = write_table(near_duplicates(docs, doc_id, text, **parameters), "neardup")
    found = found.groupBy("group", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "n")
    best = found.groupBy("group").agg(F.min(order).alias("o"))
    best = write_table(best.select(F.col("o.doc_id").alias("_i"), F.col("o.th").alias("_h"), F.col("o.n").alias("n")), "neardup-kept")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h"))
    kept = src.join(best.filter("n = 1"), same, "left_semi").select("row")
    repeated = best.filter("n > 1")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = src.join(repeated, same, "left_semi").groupBy("_id", "_th").agg(F.min("row").alias("row"))
    return kept.unionByName(once.select("row")).select("row.*")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
