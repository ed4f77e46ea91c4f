"""Incremental, reversible line dedup.

State: an exact reference-count table (line key digest -> number of documents
that hold it), and one cuckoo filter per shard of the keys that have reached
the threshold. Inserting a batch of documents adds to the counts, deleting it
subtracts; keys that cross the threshold enter or leave their shard's filter,
so deleting a batch brings back the state before it. When the keys outgrow their
shards, there are more shards, built from the exact counts. Each version of the
table is written to the shared checkpoint folder.

Dropping lines: the filters (broadcast only if their counted bytes are within
``probe_bytes``) name the few lines that may be frequent; those lines alone
are checked against the exact counts. Beyond that bound every line is checked
against the exact counts by a join. Filters never decide, so both ways give the
same rows.

A key is the line without white space at its ends, A-Z lower-cased; the digest
is the first 128 bits of its SHA-256. Defined results: a null or empty text is
one empty line; keys shorter than ``min_chars`` are never counted or dropped; a
row counts once per key, repeated rows count each; a null doc_id is a document
like any other; an empty table gives an empty result; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import SPACES, ascii_lower, text_or_empty
from coldsplit.llm.cuckoo import CuckooFilter
from coldsplit.session import write_table

KEYS_PER_SHARD = 100_000
PROBE_BYTES = 64 << 20


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _digests(text: Column, min_chars: int) -> Column:
    """One digest per line, null where the key is too short."""

    def one(line):
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))

    return F.transform(F.split(text, "\n"), one)


class LineDedupIndex:
    def __init__(self, spark: SparkSession, threshold: int = 10, min_chars: int = 1, probe_bytes: int = PROBE_BYTES):
        self.spark, self.threshold, self.min_chars, self.probe_bytes = spark, threshold, min_chars, probe_bytes
        self.refs: DataFrame | None = None  # digest, n
        self.filters: DataFrame | None = None  # shard, bits
        self.shards = 0

    def _counts(self, docs: DataFrame, text: str) -> DataFrame:
        keys = docs.select(F.explode(F.array_distinct(_digests(text_or_empty(text), self.min_chars))).alias("digest"))
        return keys.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))

    def insert(self, docs: DataFrame, text: str = "text") -> LineDedupIndex:
        return self._change(self._counts(docs, text), 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineDedupIndex:
        """Takes documents out again; they must have been inserted before."""
        return self._change(self._counts(docs, text), -1)

    def _change(self, counts: DataFrame, sign: int) -> LineDedupIndex:
        if self.refs is None:
            refs = counts.withColumn("was", F.lit(0).cast("long")).withColumn("n", F.col("n") * sign)
        else:
            refs = (
                self.refs.select("digest", "n", F.col("n").alias("was"))
                .unionByName(counts.select("digest", (F.col("n") * sign).alias("n"), F.lit(0).cast("long").alias("was")))
                .groupBy("digest")
                .agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
            )
        refs = write_table(refs.filter("n <> 0 or was <> 0"), "line-refs")
        keys = refs.count()
        if keys > 2 * self.shards * KEYS_PER_SHARD or not self.shards:  # outgrown: all filters are built anew
            self.shards, self.filters = max(1, -(-keys // KEYS_PER_SHARD)), None
        t = self.threshold
        crossed = refs.filter(f"(n >= {t}) <> (was >= {t})")
        changes = self._sharded(crossed).withColumn("sign", F.when(F.col("n") >= t, 1).otherwise(-1))
        hot = self._sharded(refs.filter(f"n >= {t}"))
        self.filters = write_table(self._filters(changes, hot), "line-filters")
        self.refs = refs.filter("n <> 0").select("digest", "n")
        return self

    def _sharded(self, refs: DataFrame) -> DataFrame:
        return refs.select(F.xxhash64("digest").alias("h"), "n").withColumn("shard", F.pmod("h", F.lit(self.shards)).cast("int"))

    def _filters(self, changes: DataFrame, hot: DataFrame) -> DataFrame:
        """Apply the crossings to each shard's filter. A filter that is new or
        has no place left is built from the shard's exact frequent keys."""
        old = self.filters
        if old is None:
            old = self.spark.createDataFrame([], "shard int, bits binary")
        # per shard: the old bits, then changes (sign +-1) and all frequent keys (sign 0)
        rows = (
            changes.select("shard", "h", "sign", F.lit(None).cast("binary").alias("bits"))
            .unionByName(hot.select("shard", "h", F.lit(0).alias("sign"), F.lit(None).cast("binary").alias("bits")))
            .unionByName(old.select("shard", F.lit(0).cast("long").alias("h"), F.lit(2).alias("sign"), "bits"))
        )

        def update(pdf: pd.DataFrame) -> pd.DataFrame:
            keys, sign = pdf["h"].to_numpy(np.int64), pdf["sign"].to_numpy()
            now = np.unique(keys[sign == 0])
            had = pdf["bits"][sign == 2]
            f = CuckooFilter.from_bytes(had.iat[0]) if len(had) else None
            if f is not None:
                for h in keys[sign == -1]:
                    f.delete(int(h))
                if not all(f.insert(int(h)) for h in keys[sign == 1]):
                    f = None
            if f is None:
                f = CuckooFilter.of(now)
            return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "bits": [f.to_bytes()]})

        return rows.groupBy("shard").applyInPandas(update, "shard int, bits binary")

    def _maybe(self, docs: DataFrame) -> DataFrame:
        """Adds _at: the lines (positions) that the filters let through."""
        size = self.filters.agg(F.sum(F.length("bits"))).first()[0] or 0
        if size > self.probe_bytes:
            return docs.withColumn("_at", F.sequence(F.lit(0), F.size("_d") - 1))
        shards = {r["shard"]: bytes(r["bits"]) for r in self.filters.collect()}  # size bytes, counted above
        sent, n = self.spark.sparkContext.broadcast(shards), self.shards

        @F.pandas_udf("array<int>")
        def probe(hashes: pd.Series) -> pd.Series:
            filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
            sizes = np.fromiter((len(x) for x in hashes), np.int64, len(hashes))
            flat = np.concatenate(list(hashes)).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
            shard, hit = flat % n, np.zeros(len(flat), bool)
            for k, f in filters.items():
                own = np.flatnonzero(shard == k) if n > 1 else slice(None)
                hit[own] = f.contains(flat[own])
            ends = np.cumsum(sizes)
            return pd.Series([np.flatnonzero(hit[e - s : e]).astype(np.int32) for s, e in zip(sizes, ends, strict=True)])

        return docs.withColumn("_at", probe(F.transform("_d", lambda d: F.xxhash64(d))))

    def drop_lines(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` as column ``row`` (a struct), with ``lines`` (all), ``dropped``
        (0-based positions of frequent lines) and ``kept`` (the new text)."""
        src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), text_or_empty(text).alias("_t"))
        src = src.withColumn("_h", F.xxhash64("_t"))
        if self.refs is None:
            src = src.withColumn("dropped", F.array().cast("array<int>"))
        else:
            seen = self._maybe(src.select("_id", "_h", _digests(F.col("_t"), self.min_chars).alias("_d")))
            seen = seen.select("_id", "_h", "_d", F.explode("_at").alias("_i")).select("_id", "_h", "_i", F.get("_d", F.col("_i")).alias("digest"))
            hot = self.refs.filter(F.col("n") >= self.threshold).select("digest")
            drops = (
                seen.filter("digest is not null").join(hot, "digest").groupBy("_id", "_h").agg(F.collect_set("_i").alias("dropped"))
                .select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "dropped")
            )
            src = src.join(drops, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
            src = src.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
        src = src.withColumn("lines", F.split("_t", "\n"))
        kept = F.when(F.size("dropped") == 0, F.col("_t")).otherwise(
            F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("dropped", i)), "\n")
        )
        return src.select("row", "lines", "dropped", kept.alias("kept"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from coldsplit.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = LineDedupIndex(spark).insert(docs).drop_lines(docs)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT rid, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM (SELECT DISTINCT rid, key FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
m AS (SELECT rid, i, line, key IN (SELECT key FROM hot) AS gone FROM k),
o AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM o JOIN d USING (rid)
"""
