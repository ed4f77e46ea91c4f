import math
import re
from collections import Counter

import numpy as np
import pytest

from coldsplit.llm import fp_search as S

from .helpers import edge_docs, edge_rows, empty_docs, same_as_sql

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, k):
    vec = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    vec = [v for v in vec if v[2]]
    n_docs, length = len(vec), sum(v[2] for v in vec)
    df = Counter(t for _, c, _ in vec for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        scored = []
        for d, c, n in vec:
            m = 25 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if df[t])
            if s > 0:
                scored.append((-s, S.NO_ID if d is None else d))
        out += [(item, r + 1, None if d == S.NO_ID else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_query_matches_sql(spark, sf_small):
    same_as_sql(S.op12_query(spark, sf_small), S.OP12_SQL, sf_small, ("documents", "benchmark"))


def test_terms():
    text = "Ab-C1\x7fÉx_İ z\x00q{R}"
    assert [t.decode() for t in S.terms(text)] == words(text) == ["ab", "c1", "Éx", "İ z", "q", "r"]


def _random(seed, n, width):
    rng = np.random.default_rng(seed)
    order, counts = [], []
    for i in range(n):
        if i % 3 == 2:  # copies and common prefixes
            j = int(rng.integers(0, i))
            cut = int(rng.integers(1, len(order[j]) + 1)) if i % 2 else len(order[j])
            order.append(order[j][:cut])
            counts.append(counts[j][:cut])
        else:
            order.append(np.sort(rng.choice(width, int(rng.integers(1, width)), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2))))
            counts.append(rng.integers(1, 9, len(order[-1])))
    return order, counts, rng.integers(25, 900, n), rng.integers(0, n, n)


@pytest.mark.parametrize(("n", "bucket"), [(1, 16), (2, 1), (40, 1), (300, 4), (2000, 16)])
def test_trie_bounds_and_search(monkeypatch, n, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    order, counts, norm, ids = _random(n, n, 12)
    trie = S.Trie(order, counts, norm, ids, 12)
    assert sorted(r for kids in trie.kids for r in kids) == list(range(trie.size + len(trie.kids) - 1))  # a tree over all rows
    for i, kids in enumerate(trie.kids):
        row = trie.size + i
        assert (kids < row).all() and (trie.tf[:, row] == trie.tf[:, kids].max(axis=1)).all() and trie.norm[row] == trie.norm[kids].min()
    for query in (np.array([0]), np.array([3, 7, 11]), np.arange(12)):
        gain = (query + 1) * 100
        t = trie.tf[query][:, : trie.size].astype(np.int64)
        score = gain @ ((10**9 * t) // (1000 * t + 8 * trie.norm[: trie.size]))
        at = [r for r in np.lexsort((trie.ids, -score)) if score[r] > 0][:10]
        got, _ = trie.best(query, gain, 10)
        assert [(s, trie.ids[r]) for s, r in got] == [(score[r], trie.ids[r]) for r in at]


def test_bounds_leave_subtrees_out():
    """Documents about a rare term score high; the many others are never opened."""
    rng = np.random.default_rng(5)
    order = [np.concatenate([np.sort(rng.choice(20, 8, replace=False)), [20 + i % 40]]) for i in range(4000)] + [np.array([0, 60, 61])] * 20
    counts = [np.ones(len(o), int) for o in order]
    trie = S.Trie(order, counts, np.full(len(order), 100), np.arange(len(order)), 62)
    got, opened = trie.best(np.array([0, 60, 61]), np.array([1, 9000, 9000]), 10)
    assert [r for _, r in got] and {int(trie.ids[r]) for _, r in got} == set(range(4000, 4010))
    assert opened < len(trie.kids) / 10


@pytest.mark.parametrize("group", [S.GROUP_TERMS, 3])
def test_edge_rows(spark, monkeypatch, group):
    monkeypatch.setattr(S, "BLOCK", 5)
    monkeypatch.setattr(S, "GROUP_TERMS", group)
    docs = [(r[0], r[1]) for r in edge_rows()]
    items = [(1, "one line one LINE"), (1, "one line one LINE"), (2, "licence body x w7"), (3, None), (4, ""), (5, "absent"), (None, "Ünïcode naïve"), (7, "w1 w2 w3 w1 zzzz")]
    asked = spark.createDataFrame([(*i, 1, "q") for i in items], "item_id long, text string, doc_id int, query string")
    assert found(S.search(edge_docs(spark), asked, k=4)) == brute(docs, items, 4)
    assert S.search(empty_docs(spark), asked).collect() == [] and S.search(edge_docs(spark), asked.limit(0)).collect() == []
