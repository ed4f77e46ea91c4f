import random

import xxhash

from coldsplit.llm import simhash as S

from .helpers import edge_docs, edge_rows, empty_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, n=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    g = groups(fps, 4)
    low = {}
    for (i, _), k in zip(rows, g, strict=True):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return sorted(((i is None, i or 0, format(f, "016x"), low.get(k)) for (i, _), f, k in zip(rows, fps, g, strict=True)), key=repr)


def test_query_matches_brute_force(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in S.op9_query(spark, sf_small).collect()), key=repr)
    assert got == components(docs)


def test_edge_cases(spark):
    got = S.near_duplicates(edge_docs(spark)).collect()
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0, format(r["fp"] & (2**64 - 1), "016x"), r["component_id"]) for r in got), key=repr)
    assert have == components([(r[0], r[1]) for r in edge_rows()])
    assert S.near_duplicates(empty_docs(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, _, c in components([(r[0], r[1]) for r in edge_rows()])}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(w for w in want if w is not None)
    assert S.keep_one(empty_docs(spark)).count() == 0


def test_links_are_exact_for_any_bands_and_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:  # dense balls around some, pairs at exactly 4 and 5 bits
        for bits in (1, 2, 4, 5):
            x = b
            for k in rnd.sample(range(64), bits):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long").repartition(4)
    want = groups(fps, 4)
    same = {tuple(sorted(f for f, h in zip(fps, want, strict=True) if h == g)) for g in set(want)}
    for bands, block in ((5, 8192), (6, 8192), (7, 3)):
        monkeypatch.setattr(S, "band_count", lambda n, radius, bands=bands: bands)
        links = S.fingerprint_links(frame, 4, block).collect()
        pos = {f: i for i, f in enumerate(fps)}
        up = list(range(len(fps)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for r in links:
            a, b = r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)
            assert (a ^ b).bit_count() <= 4
            up[root(pos[a])] = root(pos[b])
        got = {}
        for f in fps:
            got.setdefault(root(pos[f]), []).append(f)
        assert {tuple(sorted(v)) for v in got.values()} == same


def test_bk_tree_follows_the_triangle():
    rnd = random.Random(5)
    values = [rnd.getrandbits(16) for _ in range(400)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)
