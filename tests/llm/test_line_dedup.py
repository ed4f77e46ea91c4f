import hashlib

import numpy as np
import pytest

from coldsplit.llm import line_dedup as L
from coldsplit.llm.cuckoo import CuckooFilter

from .helpers import edge_docs, edge_rows, empty_docs, same_as_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, threshold):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    docs = [(t or "").split("\n") for t in texts]
    count = {}
    for d in docs:
        for k in {key(x) for x in d} - {""}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in d if count.get(key(x), 0) < threshold) for d in docs]


def kept(index, docs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in index.drop_lines(docs).selectExpr("row.doc_id", "kept").collect())


def test_query_matches_sql(spark, sf_small):
    same_as_sql(L.op3_query(spark, sf_small), L.OP3_SQL, sf_small)


@pytest.mark.parametrize("probe_bytes", [L.PROBE_BYTES, 0])
def test_edge_cases_match_brute_force(spark, probe_bytes):
    docs = edge_docs(spark)
    got = kept(L.LineDedupIndex(spark, threshold=2, probe_bytes=probe_bytes).insert(docs), docs)
    rows = edge_rows()
    want = sorted((r[0] is None, r[0] or 0, k) for r, k in zip(rows, brute([r[1] for r in rows], 2), strict=True))
    assert got == want


def test_deleting_a_batch_brings_back_the_state(spark):
    docs = edge_docs(spark)
    extra = spark.createDataFrame([(100 + i, f"body one\nnew {i}") for i in range(3)], "doc_id long, text string")
    plain = L.LineDedupIndex(spark, threshold=2).insert(docs)
    before = kept(plain, docs)
    plain.insert(extra)
    with_extra = kept(plain, docs)
    assert with_extra != before  # "body one" is frequent now
    plain.delete(extra)
    assert kept(plain, docs) == before
    assert plain.refs.filter("n <= 0").count() == 0


def test_empty_table(spark):
    docs = empty_docs(spark)
    assert L.LineDedupIndex(spark).insert(docs).drop_lines(docs).count() == 0


def test_sha_of_kept_text(spark, sf_small):
    row = L.op3_query(spark, sf_small).filter("n_dropped = n_lines").first()
    if row:
        assert row["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 20_000)
    assert f.contains(others).mean() < 0.01
    for k in keys[:2500]:
        assert f.delete(int(k))
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01
    assert (CuckooFilter.from_bytes(f.to_bytes()).cells == f.cells).all()
    assert CuckooFilter().contains(keys).sum() == 0


def test_shards_grow_with_the_keys(spark, monkeypatch):
    """A small first batch, a large second one and its deletion: shards stay bounded,
    and the rows are those of one whole insert."""
    monkeypatch.setattr(L, "KEYS_PER_SHARD", 20)
    small = spark.createDataFrame([(i, "x\ny") for i in range(3)], "doc_id long, text string")
    large = spark.createDataFrame([(100 + i, "\n".join(f"line {j}" for j in range(i % 4, 400))) for i in range(8)], "doc_id long, text string")
    index = L.LineDedupIndex(spark, threshold=2).insert(small)
    assert index.shards == 1
    index.insert(large)
    assert index.shards >= 20
    per_shard = [r["n"] for r in index._sharded(index.refs).groupBy("shard").agg({"h": "count"}).withColumnRenamed("count(h)", "n").collect()]
    assert max(per_shard) < 60
    both = small.unionByName(large)
    rows = {r["row"]["doc_id"]: (sorted(r["dropped"]), r["kept"]) for r in index.drop_lines(both).collect()}
    once = L.LineDedupIndex(spark, threshold=2).insert(both)
    assert rows == {r["row"]["doc_id"]: (sorted(r["dropped"]), r["kept"]) for r in once.drop_lines(both).collect()}
    assert all(kept == "" for _, kept in rows.values())
    index.delete(large)
    assert {r["row"]["doc_id"]: r["kept"] for r in index.drop_lines(large).collect()} == {r["doc_id"]: r["text"] for r in large.collect()}
