from coldsplit.llm import mixing as M

from .helpers import edge_docs, edge_rows, empty_docs, same_as_sql, words


def water_fill(sizes, weights, repeats):
    """Targets by resharing the excess until none is above its cap."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(repeats * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [repeats * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] > repeats * sizes[i]}
        if not over:
            return target
        full |= over


def test_query_matches_sql(spark, sf_small):
    same_as_sql(M.op10_query(spark, sf_small), M.OP10_SQL, sf_small)


def test_targets_and_budget(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 16)  # several ranges and narrowing rounds
    rows = M.mix(docs).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r["row"]["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    names = sorted(by)
    sizes = [by[n][0] for n in names]
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    biggest = max(r["size"] for r in rows)
    for n, w in zip(names, want, strict=True):
        assert abs(by[n][2] - w) < 1e-6 * max(1, w)
        assert abs(by[n][1] - w) <= 2 * biggest
    taken, budget = sum(r["taken"] for r in rows), sum(sizes)
    assert budget - biggest <= taken <= budget
    again = {(r["row"]["doc_id"], r["taken"]) for r in M.mix(docs.repartition(7)).collect()}
    assert again == {(r["row"]["doc_id"], r["taken"]) for r in rows}
    monkeypatch.undo()
    assert again == {(r["row"]["doc_id"], r["taken"]) for r in M.mix(docs).collect()}


def test_edge_cases(spark):
    got = M.mix(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert sorted(r["size"] for r in got) == sorted(len(words(t[1])) for t in edge_rows())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert M.mix(empty_docs(spark)).count() == 0


def test_take_repeats_rows(spark):
    docs = edge_docs(spark)
    out = M.take(docs)
    assert out.columns == docs.columns
    want = sum(r["taken"] // r["size"] for r in M.mix(docs).collect() if r["size"])
    assert out.count() == want
    assert M.take(empty_docs(spark)).count() == 0


def test_one_source_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in M.mix(docs).collect()] == [0, 0]
