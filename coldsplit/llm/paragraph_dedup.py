"""Substring dedup: paragraphs that repeat, nearly or verbatim, across documents.

Paragraphs are of two sorts:

* `line`: a line of ``min_words`` words or more. Near-duplicates are found by
  MinHash over 5-word shingles: rows a band and the number of bands are tuned
  so that a pair at the threshold collides with probability ``recall``;
  paragraphs that collide are joined, their exact Jaccard similarity is
  verified, and verified links become classes by connected components.
* `match`: a run of ``MATCH_WORDS`` words that stands verbatim in two documents,
  wherever it begins or ends. Every run of that length has one seed: the smallest
  hash of its ``SEED_WORDS``-word runs, so equal runs have equal seeds (winnowing).
  Runs that follow each other and have the same seed are a group. Where a seed
  stands in one group only, whatever the documents, the group's documents share
  all of its runs. The other seeds that two documents share name the runs to
  compare; those are counted by digest. The union of the shared runs is every
  common passage from its first word to its last. Shorter ones never count.

Texts are cut in numpy, many at a time, straight from the Arrow columns. Scratch
tables are deleted after their last reader.

A class is kept in its smallest doc_id and removed elsewhere. Copies share one
digest before anything is compared; a band's bucket is compared in pairs of
bounded blocks against pivots first, so that members of one class meet once and
no pair of different texts is left out.

Defined results: null and empty texts have no paragraphs; rows that share a
doc_id are one document, null being a document of its own; repeats inside one
document alone are no repeat; an empty table gives an empty result; texts are
cut whole, however long; extra columns are ignored (kept by ``remove_repeats``),
whatever their names.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldsplit.llm.common import blocked_groups, parallel, table
from coldsplit.llm.components import connected_components
from coldsplit.session import Scratch, write_table

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.98
ROWS = 2
MIN_WORDS = 50
MATCH_WORDS = 25
SEED_WORDS = 9
BLOCK = 2000
SLICE = 1 << 18  # bytes of text that are cut at once, or one text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands with which a pair at the threshold collides with
    probability ``recall``."""
    b = 1
    while 1 - (1 - threshold**rows) ** b < recall:
        b += 1
    return b


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


_RUN_FACTORS = _mix(np.arange(1, MATCH_WORDS + 1, dtype=np.uint64) * _FACTORS[1]) | np.uint64(1)


def _sums(words: np.ndarray, size: int, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """A hash of each run of ``size`` words (of all words, if they are fewer)."""
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * factors[k]
    return _mix(h)


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xxh64(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of many short pieces of ``b`` at once, as its definition has it;
    the library hashes those of 32 bytes or more one by one."""
    size, (p1, p2, p3, p4, p5) = end - begin, _XX
    h = p5 + size.astype(np.uint64)
    for k in range(0, 24, 8):
        some = np.flatnonzero(size >= k + 8)
        lane = b[begin[some, None] + np.arange(k, k + 8)].view("<u8")[:, 0]
        h[some] = _turned(h[some] ^ (_turned(lane * p2, 31) * p1), 27) * p1 + p4
    done = size & ~7
    some = np.flatnonzero(size - done >= 4)
    lane = b[(begin + done)[some, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint64)
    h[some] = _turned(h[some] ^ (lane * p1), 23) * p2 + p3
    done = size & ~3
    for k in range(3):
        some = np.flatnonzero(size - done > k)
        h[some] = _turned(h[some] ^ (b[(begin + done)[some] + k].astype(np.uint64) * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(b[begin[i] : end[i]].tobytes())
    return h


def _folded(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``values`` that begins at one of ``first``, in order."""
    size = np.diff(first, append=len(values))
    at = np.arange(len(values)) - np.repeat(first, size)
    factors = _mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * _FACTORS[3]) | np.uint64(1)
    return _mix(np.add.reduceat(values * factors[at], first))


def _slices(texts: pa.Array):
    """(first text, bytes, where each text begins and the last ends) for some texts
    that follow each other, about ``SLICE`` bytes at a time."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _cut(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of texts that stand behind each other: hash, first and end byte, text."""
    solid = _SOLID[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    begin = np.flatnonzero(solid & ~(before & ~edge[:-1]))
    end = np.flatnonzero(solid & ~(after & ~edge[1:])) + 1
    return _xxh64(b, begin, end), begin, end, np.searchsorted(at, begin, "right") - 1


def _chars(b: np.ndarray, at: np.ndarray, where: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Characters of the text before the byte ``where``."""
    if not len(b) or b.max() < 128:
        return where - at[doc]
    count = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return count[where] - count[at[doc]]


def _groups(w: np.ndarray, doc: np.ndarray):
    """Runs of ``MATCH_WORDS`` words inside a text, as (hash, first word), and their
    groups as (seed, hash of all runs, first run)."""
    none = np.zeros(0, np.int64)
    if len(w) < MATCH_WORDS:
        return none, none, none, none, none
    low = _sums(w, SEED_WORDS, _RUN_FACTORS)
    reach, size = MATCH_WORDS - SEED_WORDS + 1, 1
    while size < reach:  # the smallest of ever longer windows
        step = min(size, reach - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    begin = np.flatnonzero(doc[: len(low)] == doc[MATCH_WORDS - 1 :])
    if not len(begin):
        return none, none, none, none, none
    low, runs, own = low[begin], _sums(w, MATCH_WORDS, _RUN_FACTORS)[begin], doc[begin]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])]))
    return runs.view(np.int64), begin, low[first].view(np.int64), _folded(runs, first).view(np.int64), first


def _long_lines(b: np.ndarray, words: tuple, bands: int, rows: int, min_words: int):
    """(first word, word after the last, digest, keys of the bands) of the long lines."""
    w, begin, _, doc = words
    line = np.searchsorted(np.flatnonzero(b == 10), begin)
    change = np.flatnonzero((line[1:] != line[:-1]) | (doc[1:] != doc[:-1])) + 1
    s, t = np.concatenate([[0], change]), np.append(change, len(w))
    keep = t - s >= min_words
    s, t = s[keep], t[keep]
    if not len(s):
        return s, t, [], np.zeros((0, bands), np.int64)
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _FACTORS[0]) | np.uint64(1)
    size = np.minimum(SHINGLE, t - s)
    shingles = np.append(_sums(w, SHINGLE), np.zeros(SHINGLE, np.uint64))
    ends = np.stack([s, t - size + 1], axis=1).ravel()
    low = np.stack([np.minimum.reduceat(_mix(shingles * k), ends)[::2] for k in seeds], axis=1)
    for i in np.flatnonzero(size < SHINGLE).tolist():  # a line of fewer words is one shingle
        low[i] = [_mix(_sums(w[s[i] : t[i]], SHINGLE) * k)[0] for k in seeds]
    keys = _mix((low.reshape(-1, bands, rows) * _FACTORS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    digest = xxhash.xxh3_128_digest
    return s, t, [digest(w[x:y].tobytes()) for x, y in zip(s.tolist(), t.tolist(), strict=True)], keys.view(np.int64)


def _row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h (the text's hash; both name a row, equal rows being one), t."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ``schema``; columns that are not given are null."""

    def column(f):
        values = columns.get(f.name)
        if values is None:
            return pa.nulls(n, f.type)
        return values if isinstance(values, pa.Array) else pa.array(values, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _mapped(src: DataFrame, f, schema: str) -> DataFrame:
    """``f`` gives batches for each batch of ``src``, by a schema with doc_id in front,
    whose type stays (``doc`` in ``schema`` stands for it, too)."""
    kind = src.schema["doc_id"].dataType
    schema = T.StructType().fromDDL(schema.replace(" doc", f" {kind.simpleString()}"))

    def run(batches):
        for batch in batches:
            types = [pa.field("doc_id", batch.column("doc_id").type)]
            for field in schema.fields[1:]:
                simple = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
                types.append(pa.field(field.name, types[0].type if field.name == "low" else simple[field.dataType.simpleString()]))
            yield from f(batch, pa.schema(types))

    return src.mapInArrow(run, schema)


def _lists(values: np.ndarray) -> pa.Array:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(values.ravel()))


def paragraphs(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int, min_words: int) -> DataFrame:
    """One row per line, and one per group of runs of a text (seed, whole)."""

    def cut(batch, schema):
        ids, h = batch.column("doc_id"), batch.column("h")
        for i, b, at in _slices(batch.column("t")):
            words = w, begin, end, doc = _cut(b, at)
            if not len(w):
                continue
            s, t, digests, keys = _long_lines(b, words, bands, rows, min_words)
            if len(s):
                own = pa.array(i + doc[s])
                c0, c1 = _chars(b, at, begin[s], doc[s]), _chars(b, at, end[t - 1], doc[s])
                yield _batch(schema, len(s), doc_id=ids.take(own), h=h.take(own), kind=["line"] * len(s), c0=c0, c1=c1, key=digests, keys=_lists(keys))
            _, start, seed, whole, first = _groups(w, doc)
            if len(seed):
                own = doc[start[first]]
                order = np.lexsort((whole, seed, own))
                d, a, z = own[order], seed[order], whole[order]
                once = order[np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])])]
                own = pa.array(i + own[once])
                yield _batch(schema, len(once), doc_id=ids.take(own), h=h.take(own), kind=["seed"] * len(once), seed=seed[once], whole=whole[once])

    return _mapped(_row(docs, doc_id, text), cut, "doc_id doc, h bigint, kind string, c0 int, c1 int, key binary, keys array<bigint>, seed bigint, whole bigint")


def _shared(by: list[str], rows: DataFrame) -> DataFrame:
    """The rows of groups with two documents or more, null being one; low is the
    smallest doc_id of the group that is not null."""
    group = Window.partitionBy(*by)
    null = F.max(F.col("doc_id").isNull()).over(group)
    out = rows.withColumns({"low": F.min("doc_id").over(group), "_m": F.max("doc_id").over(group), "_null": null})
    return out.filter("low < _m or (_null and low is not null)").drop("_m", "_null")


def _wanted_seeds(units: DataFrame) -> DataFrame:
    """(doc_id, h, seeds): the seeds that another document has too; low is given with
    those that stand in one group of runs everywhere, and null with the others."""
    # h parts the rows of the null document; others share their doc_id's seeds
    h = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(0)
    seeds = units.filter("kind = 'seed'").select("doc_id", h.alias("h"), "seed", "whole")
    group = Window.partitionBy("seed")
    seeds = _shared(["seed"], seeds.withColumns({"_a": F.min("whole").over(group), "_z": F.max("whole").over(group)}))
    one = F.struct("seed", F.when(F.col("_a") == F.col("_z"), F.col("low")).alias("low"))
    return seeds.groupBy("doc_id", "h").agg(F.collect_list(one.alias("s")).alias("seeds"))


def _found_in(doc: np.ndarray, seed: np.ndarray, doc_of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each (doc, seed) its place among the wanted ones, or -1."""
    if not len(wanted):
        return np.full(len(seed), -1)
    name = _mix(wanted.view(np.uint64) + _mix(doc_of.astype(np.uint64)))
    order = np.argsort(name)
    own = _mix(seed.view(np.uint64) + _mix(doc.astype(np.uint64)))
    at = order[np.minimum(np.searchsorted(name[order], own), len(order) - 1)]
    return np.where((wanted[at] == seed) & (doc_of[at] == doc), at, -1)


def _reread(units: DataFrame, needed: DataFrame, docs: DataFrame, doc_id: str, text: str, write=write_table) -> DataFrame:
    """The texts again, once: the line texts of ``needed`` (key, t), the places of
    groups that are shared as a whole (low, c0, c1), and the runs of the other seeds
    that are shared (run, c0, c1)."""
    part = "struct<key:binary,h:bigint,c0:int,c1:int>"
    kind = units.schema["doc_id"].dataType.simpleString()
    row = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(0)
    seeds = _wanted_seeds(units).withColumn("lines", F.array().cast(f"array<{part}>"))
    lines = needed.groupBy("doc_id", row.alias("r")).agg(F.collect_list(F.struct("key", "h", "c0", "c1")).alias("lines"))
    lines = lines.select("doc_id", F.col("r").alias("h"), F.array().cast(f"array<struct<seed:bigint,low:{kind}>>").alias("seeds"), "lines")
    wanted = seeds.unionByName(lines).groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).agg(F.flatten(F.collect_list("seeds")).alias("seeds"), F.flatten(F.collect_list("lines")).alias("lines"))
    src = _row(docs, doc_id, text)
    src = src.join(wanted, F.col("doc_id").eqNullSafe(F.col("_i")) & (row == F.col("_h")))
    own = F.filter("lines", lambda x: x["h"] == F.col("h"))
    texts = F.transform(own, lambda x: F.expr("t").substr(x["c0"] + 1, x["c1"] - x["c0"]))
    src = src.select("doc_id", "t", F.transform("seeds", lambda x: x["seed"]).alias("seeds"), F.transform("seeds", lambda x: x["low"]).alias("lows"), F.transform(own, lambda x: x["key"]).alias("keys"), texts.alias("texts"))

    def cut(batch, schema):
        ids, texts = batch.column("doc_id"), batch.column("texts")
        if len(texts.flatten()):
            yield _batch(schema, len(texts.flatten()), doc_id=ids.take(texts.value_parent_indices()), key=batch.column("keys").flatten(), t=texts.flatten())
        wanted, lows = batch.column("seeds").flatten().to_numpy(zero_copy_only=False), batch.column("lows").flatten()
        doc_of = batch.column("seeds").value_parent_indices().to_numpy()
        settled = lows.is_valid().to_numpy(zero_copy_only=False)
        code = lows.dictionary_encode().indices.fill_null(-1).to_numpy()
        for i, b, at in _slices(batch.column("t")):
            a, z = np.searchsorted(doc_of, [i, i + len(at) - 1])
            if a == z:
                continue
            w, begin, end, doc = _cut(b, at)
            runs, start, seed, _, first = _groups(w, doc)
            place = _found_in(i + doc[start[first]], seed, doc_of[a:z], wanted[a:z]) + a
            last = np.append(first[1:], len(runs))
            begin, end = begin[start], end[start + MATCH_WORDS - 1] if len(start) else start
            hit = place >= a
            g = np.flatnonzero(hit & settled[place])
            if len(g):  # neighbours with the same low are one
                d, k, x, y = doc[start[first[g]]], code[place[g]], begin[first[g]], end[last[g] - 1]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (x[1:] > y[:-1])]))
                d, x, y = d[new], x[new], y[np.append(new[1:], len(g)) - 1]
                yield _batch(schema, len(new), doc_id=ids.take(pa.array(i + d)), low=lows.take(pa.array(place[g[new]])), c0=_chars(b, at, x, d), c1=_chars(b, at, y, d))
            g = np.flatnonzero(hit & ~settled[place])
            if len(g):
                r = np.repeat(first[g], last[g] - first[g])
                r = r + np.arange(len(r)) - np.repeat(np.cumsum(last[g] - first[g]) - (last[g] - first[g]), last[g] - first[g])
                d, run = doc[start[r]], runs[r]
                order = np.lexsort((r, run, d))
                d, run, x, y = d[order], run[order], begin[r[order]], end[r[order]]
                # equal runs of a text that overlap are one: a text with a short period
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (run[1:] != run[:-1]) | (x[1:] > y[:-1])]))
                d, run, x, y = d[new], run[new], x[new], y[np.append(new[1:], len(d)) - 1]
                yield _batch(schema, len(new), doc_id=ids.take(pa.array(i + d)), run=run, c0=_chars(b, at, x, d), c1=_chars(b, at, y, d))

    return write(_mapped(src, cut, "doc_id doc, low doc, run bigint, c0 int, c1 int, key binary, t string"), "paragraph-runs")


def _matches(found: DataFrame) -> DataFrame:
    """(doc_id, c0, c1, low): where runs stand that are in two documents or more, and
    the smallest doc_id of those."""
    whole = found.filter("low is not null").select("doc_id", "c0", "c1", "low")
    runs = _shared(["run"], found.filter("run is not null").select("doc_id", "run", "c0", "c1"))
    return whole.unionByName(runs.select("doc_id", "c0", "c1", "low"))


def verified_links(texts: list[str], other: list[str] | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs (numbers within ``texts`` + ``other``) at the threshold that join two
    groups: inside ``texts``, or between the two lists. Pairs of one group are not
    compared again."""
    sets = []
    for t in texts + (other or []):
        w = t.split()
        sets.append(set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)})
    n, m = len(texts), len(sets)
    group, links = list(range(m)), []

    def root(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i in range(n):
        for j in range(i + 1 if other is None else n, m):
            if root(i) != root(j):
                a, b = sets[i], sets[j]
                least = threshold * max(len(a), len(b))
                if min(len(a), len(b)) >= least:
                    both = len(a & b)
                    if both >= least and both >= threshold * (len(a) + len(b) - both):
                        group[root(i)] = root(j)
                        links.append((i, j))
    return links


def _line_buckets(lines: DataFrame, write=write_table) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines' texts by digest, their buckets, and where the texts that have a
    partner stand."""
    ids = [F.min("doc_id").alias("d"), F.max("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("null")]
    texts = write(lines.groupBy("key").agg(*ids, F.min(F.struct("doc_id", "c0", "c1", "h")).alias("at"), F.first("keys").alias("bands")), "line-texts")
    keyed = texts.select("key", F.posexplode("bands").alias("band", "bucket"))
    groups = write(blocked_groups(keyed, ["band", "bucket"], "key", BLOCK), "line-buckets")
    return texts, groups, groups.select("key").distinct().join(texts.select("key", "at.*"), "key")


def _line_classes(texts: DataFrame, groups: DataFrame, needed: DataFrame, threshold: float, write=write_table) -> DataFrame:
    """(key, low): for each line text that has a class of two documents or more,
    the smallest doc_id of the class."""
    spark = texts.sparkSession
    keys = ["band", "bucket", "_bi", "_bj"]
    rows = groups.join(needed, "key").select(*keys, "_b", "key", "t").repartition(parallel(spark), *keys).sortWithinPartitions(*keys)

    def verify(batches):
        each = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (*keys, "_b", "key", "t")), strict=True))
        for (_, _, i, j), group in groupby(each, lambda row: row[:4]):
            group = list(group)
            if i != j:
                one, two = [r for r in group if r[4] == i], [r for r in group if r[4] != i]
                group = one + two
                found = verified_links([r[6] for r in one], [r[6] for r in two], threshold)
            else:
                found = verified_links([r[6] for r in group], None, threshold)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [group[x][5] for x, _ in found], "b": [group[x][5] for _, x in found]})

    links = rows.mapInArrow(verify, "a binary, b binary")
    comps = connected_components(links, "a", "b", write).withColumnsRenamed({"node": "key", "component": "g"})
    linked = texts.select("key", "d", "m", "null").join(comps, "key", "left").withColumn("g", F.coalesce("g", "key"))
    # lines of one document that are near each other are no class; null is a document
    classes = linked.groupBy("g").agg(F.min("d").alias("low"), F.max("m").alias("high"), F.max("null").alias("no"))
    classes = classes.filter("low < high or (no and low is not null)")
    return linked.join(classes, "g").select("key", "low")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document that has a repeated paragraph: doc_id, spans and removed
    (character ranges, as arrays of (start, end)), first_docs (the smallest doc_id
    of each of its classes)."""
    with Scratch(docs.sparkSession) as tmp:
        units = tmp.write(paragraphs(docs, doc_id, text, band_count(threshold, rows, recall), rows, min_words), "paragraphs")
        lines = tmp.write(units.filter("kind = 'line'").select("doc_id", "h", "c0", "c1", "key", "keys"), "lines")
        texts, groups, needed = _line_buckets(lines, tmp.write)
        found = _reread(units, needed, docs, doc_id, text, tmp.write)
        tmp.drop(units)
        needed = found.filter("key is not null").groupBy("key").agg(F.min("t").alias("t"))
        classes = _line_classes(texts, groups, needed, threshold, tmp.write)
        flagged = _matches(found).unionByName(lines.join(classes, "key").select("doc_id", "c0", "c1", "low"))
        place = F.struct("c0", "c1", (~F.col("low").eqNullSafe(F.col("doc_id"))).alias("gone"))
        gathered = flagged.groupBy("doc_id").agg(F.collect_list(place).alias("u"), F.array_sort(F.collect_set("low")).alias("first_docs"))

        @F.pandas_udf("struct<spans:array<struct<start:int,end:int>>,removed:array<struct<start:int,end:int>>>")
        def merged(c0: pd.Series, c1: pd.Series, gone: pd.Series) -> pd.DataFrame:
            out = {"spans": [], "removed": []}
            for a, b, away in zip(c0, c1, gone, strict=True):
                away = np.asarray(away, bool)
                out["spans"].append(_merged(a, b))
                out["removed"].append(_merged(a[away], b[away]))
            return pd.DataFrame(out)

        return write_table(gathered.withColumn("r", merged("u.c0", "u.c1", "u.gone")).select("doc_id", "r.spans", "r.removed", "first_docs"), "repeats")


def _merged(a: np.ndarray, b: np.ndarray) -> list[dict]:
    """The union of the character ranges from ``a`` to ``b``."""
    if not len(a):
        return []
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    ends = b[np.append(new[1:], len(b)) - 1]
    return [{"start": x, "end": y} for x, y in zip(a[new].tolist(), ends.tolist(), strict=True)]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` with the removed ranges cut out of its texts. doc_id must be a key."""
    found = repeats(docs, doc_id, text, **parameters).select(F.col("doc_id").alias("_i"), F.col("removed").alias("_r"))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    joined = src.join(found, F.col("_id").eqNullSafe(F.col("_i")), "left")
    # what stands before each range, and what stands after the last
    parts = F.transform("_r", lambda r, i: F.substring(F.col("_t"), F.when(i > 0, F.get("_r", i - 1)["end"]).otherwise(0) + 1, r["start"] - F.when(i > 0, F.get("_r", i - 1)["end"]).otherwise(0)))
    rest = F.substring(F.col("_t"), F.element_at("_r", -1)["end"] + 1, F.length("_t"))
    cut = F.when(F.size("_r") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("_t"))
    return joined.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select("doc_id", F.size("spans").alias("n_spans"), joined("spans").alias("spans"), joined("removed").alias("removed"), "first_docs")
