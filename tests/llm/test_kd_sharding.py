import zlib

from coldsplit.llm import kd_sharding as K

from .helpers import edge_docs, edge_rows, empty_docs


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {k: sum(r["size"] for r in own) for k, own in by.items()}


def test_query_is_balanced_and_gapless(spark):
    sf = "/root/testdata/sf0.01"
    rows = K.op8_query(spark, sf).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    sizes = check(rows, 24)
    mean = sum(sizes.values()) / 24
    biggest = max(r["size"] for r in rows)
    assert len(sizes) == 24 and all(abs(s - mean) <= max(biggest, 0.1 * mean) for s in sizes.values())


def test_a_hot_source_and_copies_are_divided(spark):
    rows = [(i, "the same copy of a text", "hot", "en") for i in range(3000)] + [(i, "x" * (i % 50), f"s{i % 7}", "de") for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    out = K.shard(docs).collect()
    sizes = check(out, 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - mean) < 0.06 * mean for s in sizes.values())
    assert {(r["row"]["doc_id"], r["shard"]) for r in out} == {(r["row"]["doc_id"], r["shard"]) for r in K.shard(docs.repartition(9)).collect()}


def test_edge_cases(spark):
    out = K.shard(edge_docs(spark), shards=5).collect()
    assert len(out) == len(edge_rows())
    check(out, 5)
    assert K.shard(empty_docs(spark)).count() == 0
    assert {r["shard"] for r in K.shard(edge_docs(spark), shards=1).collect()} == {0}


def test_only_sql_functions(spark, sf_small):
    plan = K.op8_query(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
