"""Ranked lexical search with a document FP-tree and branch and bound.

The queries' terms are a closed vocabulary. One pass over the texts keeps of
each document its length and its restricted term vector: the terms of that
vocabulary with their counts. Vectors are ordered by falling document frequency
and put into a trie block by block (a block holds at most ``BLOCK`` documents),
so documents with equal frequent terms share a path; paths without a branch are
one node. A node keeps the largest count of each term and the smallest length
norm of the documents below it. The score of a term grows with its count and
falls with the norm, so a node's score by these is an upper bound for all its
documents. For each item a depth-first search opens the best child first and
leaves out every subtree whose bound is under the item's k-th best score so far.

Each block gives at most k rows an item; a window takes the k best of those.
All of it is 64-bit integer arithmetic but for the logarithm of a weight.

Queries are searched in groups of bounded vocabulary (``GROUP_TERMS``); a group
reads the texts once. What is broadcast is one group's terms and items.

Defined results: a null or empty text has no term and is never a result, nor
counted in N; items without terms have no rows; repeated item rows (same id and
text) answer once, items with one id and several texts are several queries, told
apart by ``query``; repeated document rows are documents of their own; equal
scores are ordered by doc_id, null first; texts of any length are read whole;
empty tables give an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldsplit.llm.common import parallel, table
from coldsplit.session import Scratch, write_table

K = 10
BLOCK = 8192  # documents of one trie at most
CELLS = 32 << 20  # documents x vocabulary of one trie at most
BUCKET = 16  # a subtree of fewer documents is not divided further
GROUP_TERMS = 1 << 18  # terms of one group of items, about
NO_ID = -(2**63)
# Fixed value: bytes that end a term become spaces, A-Z become a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased, in order."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Trie:
    """Restricted vectors of some documents as a path-compressed trie.

    Its rows are first the documents, then the inner nodes. ``tf[term, row]`` is a
    count of the document, or the largest below the node; ``norm[row]`` a length
    norm, or the smallest below. ``kids[i]`` are the rows under inner node i; the
    last node is the root."""

    def __init__(self, order: list[np.ndarray], counts: list[np.ndarray], norm: np.ndarray, ids: np.ndarray, width: int):
        """``order[d]`` has document d's terms, most frequent term first."""
        paths = [o.astype(">u4").tobytes() for o in order]
        at = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids, self.size = ids[at], len(at)
        shared = [self._shared(paths[a], paths[b]) for a, b in zip(at, at[1:], strict=False)]
        self.kids = self._nodes(shared)
        rows = self.size + len(self.kids)
        most = max((int(c.max()) for c in counts if len(c)), default=0)
        tf = np.zeros((rows, width), np.uint16 if most < 2**16 else np.int32)
        self.norm = np.empty(rows, np.int64)
        self.norm[: self.size] = norm[at]
        for row, d in enumerate(at):
            tf[row, order[d]] = counts[d]
        for i, kids in enumerate(self.kids):
            tf[self.size + i] = tf[kids].max(axis=0)
            self.norm[self.size + i] = self.norm[kids].min()
        self.tf = np.ascontiguousarray(tf.T)  # a line for each term

    @staticmethod
    def _shared(a: bytes, b: bytes) -> int:
        """Terms at the start of both paths."""
        n = min(len(a), len(b)) // 4
        differ = np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n)
        return int(differ.argmax()) if differ.any() else n

    def _nodes(self, shared: list[int]) -> list[np.ndarray]:
        """Rows under each inner node, children before their parent. ``shared[i]``
        is the depth at which the paths of rows i and i + 1 part."""
        done: list[np.ndarray] = []
        below = [1] * self.size  # documents under a row

        def close(rows: list[int]) -> list[int]:
            docs = sum(below[r] for r in rows)
            if docs < BUCKET:
                return rows
            done.append(np.array(rows))
            below.append(docs)
            return [self.size + len(done) - 1]

        open_: list[tuple[int, list[int]]] = [(0, [])]  # (depth, rows) of the nodes on the last path
        last = [0]  # the subtree that has no parent yet
        for row, depth in enumerate(shared, 1):
            while open_[-1][0] > depth:
                last = close(open_.pop()[1] + last)
            if open_[-1][0] == depth:
                open_[-1][1].extend(last)
            else:
                open_.append((depth, last))
            last = [row]
        while len(open_) > 1:
            last = close(open_.pop()[1] + last)
        done.append(np.array(open_[0][1] + last))
        return done

    def best(self, query: np.ndarray, gain: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """((score, row) of the k best documents, nodes opened). ``query`` are the
        item's distinct terms, ``gain`` their weight times repeats."""
        tf, norm = self.tf[query], 8 * self.norm
        top_score, top_row = np.empty(0, np.int64), np.empty(0, np.int64)
        bar, opened = 1, 0
        stack = [(2**62, len(norm) - 1)]
        while stack:
            bound, node = stack.pop()
            if bound < bar:
                continue
            opened += 1
            kids = self.kids[node - self.size]
            t = tf[:, kids].astype(np.int64)
            score = gain @ ((10**9 * t) // (1000 * t + norm[kids]))
            live = score >= bar
            kids, score = kids[live], score[live]
            docs = kids < self.size
            if docs.any():
                top_score, top_row = np.concatenate([top_score, score[docs]]), np.concatenate([top_row, kids[docs]])
                keep = np.lexsort((self.ids[top_row], -top_score))[:k]
                top_score, top_row = top_score[keep], top_row[keep]
                if len(keep) == k:
                    bar = max(bar, int(top_score[-1]))
            inner = np.flatnonzero(~docs)
            stack.extend((int(score[i]), int(kids[i])) for i in inner[np.argsort(score[inner], kind="stable")])
        return list(zip(top_score.tolist(), top_row.tolist(), strict=True)), opened


VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def restrict(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of each document: terms as places in ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one group of items

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        kind = pa.list_(pa.int32())
        for batch in batches:
            n, found, counts = [], [], []
            for value in batch.column(1):
                words = terms(value.as_buffer().to_pybytes() if value.is_valid else None)
                n.append(len(words))
                held = [(place[w], c) for w, c in Counter(words).items() if w in place]
                found.append([p for p, _ in held])
                counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(counts, kind)], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(count, VECTORS)


def _item_groups(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The distinct items as (query, item_id, text), in groups of bounded size."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text is not null").distinct()
    group, size = [], 0
    for i, r in enumerate(rows.orderBy("item_id", "text").toLocalIterator()):
        group.append((i, r["item_id"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= GROUP_TERMS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _search_group(tmp: Scratch, docs: DataFrame, group: list, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    asked = [(q, i, Counter(terms(t))) for q, i, t in group]
    vocabulary = sorted(set().union(*[c for _, _, c in asked]))
    vectors = tmp.write(restrict(docs, vocabulary, doc_id, text), "vectors")
    n_docs, length = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the group
    # terms are renumbered by falling frequency: the order of the trie's paths
    rank = {t: i for i, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    place = {t: i for i, t in enumerate(vocabulary)}
    renumber = np.full(len(vocabulary), -1, np.int64)
    weights = np.zeros(len(rank), np.int64)
    for t, i in rank.items():
        renumber[t], weights[i] = i, weight(n_docs, df[t])
    queries = []
    for q, item, c in asked:
        held = sorted((int(renumber[place[t]]), times) for t, times in c.items() if renumber[place[t]] >= 0)
        if held:
            at = np.array([p for p, _ in held])
            queries.append((q, item, at, weights[at] * np.array([times for _, times in held])))
    sent = spark.sparkContext.broadcast((renumber, queries))
    width = max(len(rank), 1)
    block = max(64, min(BLOCK, CELLS // width))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renumber, queries = sent.value
        held: list[tuple] = []

        def answers() -> pa.RecordBatch:
            order, counts = [], []
            for _, _, t, c in held:
                ranks = renumber[t]
                by = np.argsort(ranks)
                order.append(ranks[by])
                counts.append(c[by])
            ids = np.array([NO_ID if h[0] is None else h[0] for h in held], np.int64)
            trie = Trie(order, counts, np.array([h[1] for h in held], np.int64), ids, width)
            rows = [(q, item, int(trie.ids[row]), score) for q, item, at, gain in queries for score, row in trie.best(at, gain, k)[0]]
            held.clear()
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "item_id", "doc_id", "score"])

        for batch in batches:
            for d, m, t, c in zip(*[batch.column(i) for i in range(4)], strict=True):
                held.append((d.as_py(), m.as_py(), t.values.to_numpy(), c.values.to_numpy()))
                if len(held) == block:
                    yield answers()
        if held:
            yield answers()

    found = vectors.filter(F.size("terms") > 0).select(
        "doc_id", F.expr(f"100 - 75 + ((75L * n * {n_docs}L) div {max(length, 1)}L)").alias("m"), "terms", "counts"
    )
    found = found.repartition(parallel(spark), F.xxhash64("doc_id", "m", "terms")).mapInArrow(search, "query long, item_id long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(query, item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "query long, item_id long, doc_id long, score long, rank int")
    for group in _item_groups(items, item_id, item_text):
        with Scratch(spark) as tmp:
            out = out.unionByName(write_table(_search_group(tmp, docs, group, k, doc_id, text), "ranked"))
    return out.select("query", "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, d, len(w) AS n, w FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM g),
tf AS (SELECT doc_id, d, n, x AS term, count(*) AS tf FROM (SELECT doc_id, d, n, unnest(w) AS x FROM g) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, x AS term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
p AS (SELECT q.item_id, tf.doc_id, tf.d,
    sum(q.times * CAST(floor(1000 * ln((2 * s.N + 2)::DOUBLE / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * s.N) // s.L)))) AS score
    FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
