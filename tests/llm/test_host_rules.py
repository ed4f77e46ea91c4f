from coldsplit.llm import host_rules as H

from .helpers import edge_docs, edge_rows, empty_docs, same_as_sql, words


def repeated(w):
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return len(covered)


def test_query_matches_sql(spark, sf_small):
    same_as_sql(H.op5_query(spark, sf_small), H.OP5_SQL, sf_small)


def test_measures_match_brute_force(spark):
    more = [(50 + i, t) for i, t in enumerate(["a b c a b c a", "x x x x x", "a b a b", "# $5 <b> a|b\n \n# $5 <b> a|b"])]
    rows = [(r[0], r[1]) for r in edge_rows()] + more
    docs = edge_docs(spark).select("doc_id", "text", "source", "n_chars").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True
    )
    got = sorted((r["row"]["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in H.judge(docs).collect())
    want = []
    for i, t in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        want.append((i or -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(w)))
    assert got == sorted(want)
    assert H.judge(empty_docs(spark)).count() == 0


def test_hosts_are_shrunk_towards_the_prior(spark):
    good, bad = "word " * 30 + " ".join(f"u{i}" for i in range(60)), "short"
    rows = [(f"h{h}", good) for h in range(20) for _ in range(10)]
    rows += [("spam", bad)] * 200 + [("spam", good + " z")] * 10 + [("tiny", bad), (None, good)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    out = H.judge(docs).select("host", "host_rate", "host_docs", "base_failed", "kept").collect()
    rate = {r["host"]: r["host_rate"] for r in out}
    assert rate["spam"] > 0.5 > rate["h0"] and rate["tiny"] < 1.0
    assert not any(r["kept"] for r in out if r["host"] == "spam")  # good pages of a bad host go
    assert all(r["kept"] for r in out if r["host"] is None or r["host"].startswith("h"))


def test_the_prior_decides_for_small_hosts(spark):
    """Where most hosts have three bad pages of ten, two of three are no verdict on a
    host; the same share of a large host is. Without the prior both hosts would go."""
    good, bad = " ".join(f"u{i}" for i in range(60)), "short"
    rows = [(f"h{h}", bad if i < 3 else good) for h in range(30) for i in range(10)]
    rows += [("small", bad), ("small", bad), ("small", good + " s")] + [("large", bad), ("large", bad), ("large", good + " l")] * 100
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    out = H.judge(docs).filter("not base_failed and host in ('small', 'large')").select("host", "kept").distinct().collect()
    assert {(r["host"], r["kept"]) for r in out} == {("small", True), ("large", False)}


def test_only_sql_functions(spark, sf_small):
    plan = H.op5_query(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
