import os
import random

import numpy as np
import xxhash

from coldsplit.llm import paragraph_dedup as P

from .helpers import edge_docs, empty_docs

SYLLABLES = "ka to ri me su no la vi po du fe gi".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(2, 5))) for _ in range(n))


def corpus():
    rnd = random.Random(4)
    rows = [(i, "\n".join(prose(rnd, rnd.randint(5, 90)) for _ in range(4))) for i in range(40)]
    passages = [prose(rnd, 55 + 5 * k) for k in range(8)]
    planted = set()
    for k, p in enumerate(passages):
        for i in range(100 + 10 * k, 103 + 10 * k):  # inside a line, between other words
            rows.append((i, f"{prose(rnd, 20 + i % 7)} {p} {prose(rnd, 30)}\n{prose(rnd, 12)}"))
            planted.add(i)
    line = prose(rnd, 90)
    for i, word in ((300, 10), (301, 45), (302, 80)):  # near copies of a line: one word changed
        w = line.split()
        w[word] = "changed"
        rows.append((i, f"{prose(rnd, 8)}\n{' '.join(w)}\n{prose(rnd, 9)}"))
        planted.add(i)
    common = prose(rnd, 12)  # a short common line is no repeat
    rows = [(i, f"{t}\n{common}") for i, t in rows]
    rows += [(400, "go " * 200 + prose(rnd, 5)), (401, prose(rnd, 9) + " go" * 150)]  # a period of one word
    return rows, planted | {400, 401}


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rows, planted = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in P.repeats(docs).collect()}
    assert set(out) == planted
    for i, r in out.items():
        assert all(f <= i for f in r["first_docs"] if f == min(r["first_docs"]))
    assert not out[100]["removed"] and out[101]["removed"] and out[102]["removed"]
    assert list(out[101]["first_docs"]) == [100]
    text = dict(rows)
    cleaned = {r["doc_id"]: r["text"] for r in P.remove_repeats(docs).collect()}
    assert len(cleaned) == len(rows)
    for i, t in cleaned.items():
        gone = [text[i][s["start"] : s["end"]] for s in (out[i]["removed"] if i in out else [])]
        assert len(t) == len(text[i]) - sum(map(len, gone))
        if not gone:
            assert t == text[i]


def test_links_are_verified_by_exact_similarity():
    rnd = random.Random(6)
    base = prose(rnd, 60).split()
    texts = []
    for k in range(12):
        w = list(base)
        for at in rnd.sample(range(60), k % 5):
            w[at] = f"x{k}"
        texts.append(" ".join(w))

    def similar(a, b):
        s = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in (a, b)]
        return len(s[0] & s[1]) / len(s[0] | s[1])

    def classes(pairs):
        up = list(range(12))
        for a, b in pairs:
            old, new = up[a], up[b]
            up = [new if u == old else u for u in up]
        return {tuple(i for i in range(12) if up[i] == u) for u in set(up)}

    want = classes([(i, j) for i in range(12) for j in range(i) if similar(texts[i], texts[j]) >= 0.8])
    assert classes(P.verified_links(texts, None, 0.8)) == want
    links = P.verified_links(texts[:5], None, 0.8) + [(a + 5, b + 5) for a, b in P.verified_links(texts[5:], None, 0.8)] + P.verified_links(texts[:5], texts[5:], 0.8)
    assert classes(links) == want


def test_blocks_change_nothing(spark, monkeypatch):
    rows, planted = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(P, "BLOCK", 1)
    assert {r["doc_id"] for r in P.repeats(docs).collect()} == planted


def test_bands_reach_the_recall():
    for t, rows in ((0.8, 2), (0.8, 4), (0.6, 3)):
        b = P.band_count(t, rows, 0.98)
        assert 1 - (1 - t**rows) ** b >= 0.98 > (1 - (1 - t**rows) ** (b - 1) if b > 1 else 0)


def test_edge_cases(spark):
    out = {r["doc_id"]: r for r in P.repeats(edge_docs(spark)).collect()}
    assert set(out) == {6, 7, 8}  # the long texts; repeated rows of one doc_id are one document
    assert not out[6]["removed"] and out[7]["removed"]
    assert P.repeats(empty_docs(spark)).count() == 0
    assert P.remove_repeats(empty_docs(spark)).count() == 0
    assert P.remove_repeats(edge_docs(spark)).columns == edge_docs(spark).columns


def embedded(rnd, passages):
    """Each pair of passages inside longer lines of two documents, 2 k and 2 k + 1."""
    rows = []
    for k, pair in enumerate(passages):
        rows += [(2 * k + i, f"{prose(rnd, 100)} {p} {prose(rnd, 100)}") for i, p in enumerate(pair)]
    return rows


def test_every_verbatim_passage_inside_a_line_is_found(spark):
    rnd = random.Random(8)
    rows = embedded(rnd, [[prose(rnd, 51 + k % 5)] * 2 for k in range(100)])
    found = {r["doc_id"] for r in P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(200))


def shared_words(rows, size, removed=False):
    """For each document the words that lie in a run of ``size`` words which another
    (``removed``: a smaller one) has too."""
    where = {}
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - size + 1):
            where.setdefault(tuple(w[a : a + size]), set()).add(i)
    out = {}
    for i, t in rows:
        w = t.split()
        has = [where[tuple(w[a : a + size])] for a in range(len(w) - size + 1)]
        out[i] = sorted({a + k for a, ids in enumerate(has) if len(ids) > 1 and (min(ids) < i or not removed) for k in range(size)})
    return out


def in_spans(text, spans):
    at, out = 0, []
    for k, w in enumerate(text.split()):
        at = text.index(w, at)
        if any(s["start"] <= at and at + len(w) <= s["end"] for s in spans):
            out.append(k)
        at += len(w)
    return out


def test_spans_and_floor_are_those_of_brute_force(spark):
    rnd = random.Random(9)
    rows = embedded(rnd, [[prose(rnd, n)] * 2 for n in (20, 24, 25, 26, 30, 30, 40, 40, 49, 49, 51, 51, 55, 60, 80, 100)])
    rows += [(1000 + i, t.replace(" ", "\n", 40)) for i, t in rows[20:24]]  # wrapped
    rows += [(2000, rows[24][1][:300]), (2001, "go stop " * 60), (2002, "x " + "go stop " * 50), (2003, "\u00e4 \u4e2d " + rows[26][1])]
    rows += [(2010, line := prose(rnd, 49)), (2011, line), (2012, line := prose(rnd, 24)), (2013, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in P.repeats(docs, min_words=10**6).collect()}
    text = dict(rows)
    for spans, removed in (("spans", False), ("removed", True)):
        assert {i: in_spans(text[i], out[i][spans] if i in out else []) for i in text} == shared_words(rows, 25, removed)


def test_near_copies_inside_a_line_or_wrapped_are_found(spark):
    rnd = random.Random(10)
    pairs = []
    for n, changes in [(51, 1), (55, 1), (60, 1), (80, 1), (100, 2)] * 12:
        a = prose(rnd, n).split()
        b = list(a)
        for at in range(changes):
            b[(at + 1) * n // (changes + 1)] = "changed"
        pairs.append((" ".join(a), "\n".join(b) if n == 60 else " ".join(b)))
    rows = embedded(rnd, pairs)
    found = {r["doc_id"] for r in P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i for i, _ in rows}


def test_null_and_repeated_doc_ids_in_lines(spark):
    rnd = random.Random(11)

    def near(line, at):
        w = line.split()
        return " ".join([*w[:at], "changed", *w[at + 1 :]])

    one, two = prose(rnd, 90), prose(rnd, 90)
    many = [near(one, 20), near(near(one, 40), 41)]
    rows = [(None, one), (None, prose(rnd, 70)), (None, many[0]), (5, many[1]), (7, two), (7, prose(rnd, 95)), (8, near(two, 45)), (9, prose(rnd, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = P.paragraphs(docs, "doc_id", "text", 40, 1, 50).filter("kind = 'line'")
    texts, groups, needed = P._line_buckets(lines)
    needed = P._reread(P.paragraphs(docs, "doc_id", "text", 40, 1, 50), needed, docs, "doc_id", "text").filter("key is not null").select("key", "t")
    got = {r["doc_id"]: r["low"] for r in lines.join(P._line_classes(texts, groups, needed, 0.8), "key").collect()}
    assert got == {None: 5, 5: 5, 7: 7, 8: 7}


def test_words_are_cut_at_texts_and_spaces_and_have_their_xxh64():
    rnd = random.Random(12)
    words = [bytes(rnd.choice([*range(33, 256)]) for _ in range(n)) for n in [*range(1, 70)] * 2]
    raw, joint = b" \n\x0b".join(words), b"ab" + b"cd e"  # the second text ends without a space
    at = np.array([0, 0, len(raw), len(raw) + 2, len(raw) + 6])
    w, begin, end, doc = P._cut(np.frombuffer(raw + joint, np.uint8), at)
    assert w.tolist() == [xxhash.xxh64_intdigest(x) for x in [*words, b"ab", b"cd", b"e"]]
    assert [(raw + joint)[a:b] for a, b in zip(begin, end, strict=True)] == [*words, b"ab", b"cd", b"e"]
    assert doc.tolist() == [1] * len(words) + [2, 3, 3]


def test_slices_change_nothing(spark, monkeypatch):
    rows, planted = corpus()
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r for r in P.repeats(docs).collect()}
    assert set(want) == planted
    monkeypatch.setattr(P, "SLICE", 1)
    assert {r["doc_id"]: r for r in P.repeats(docs).collect()} == want


def test_runs_travel_only_for_seeds_that_stand_in_different_groups(spark):
    rnd = random.Random(13)
    copy, part = prose(rnd, 400), prose(rnd, 80)
    rows = [(i, copy) for i in range(20)] + [(20 + i, f"{prose(rnd, 60)} {part} {prose(rnd, 60)}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = P.paragraphs(docs, "doc_id", "text", 4, 2, 10**6)
    found = P._reread(units, units.filter("kind = 'line'"), docs, "doc_id", "text")
    assert found.filter("doc_id < 20 and run is not null").count() == 0  # one range a copy
    assert found.filter("doc_id < 20").select("c0", "c1", "low").distinct().collect() == [(0, len(copy), 0)]
    # at the edges of the passage, at most the groups that reach over them
    assert 0 < found.filter("run is not null").count() <= 5 * 4 * 17
    out = {r["doc_id"]: r for r in P.repeats(docs, min_words=10**6).collect()}
    text = dict(rows)
    assert {i: in_spans(text[i], out[i]["spans"]) for i in text} == shared_words(rows, 25)


def test_only_the_result_is_left_of_the_scratch_tables(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    P.repeats(spark.createDataFrame(corpus()[0], "doc_id long, text string")).collect()
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["repeats"]
