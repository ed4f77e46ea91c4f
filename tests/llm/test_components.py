import random

from coldsplit.llm.components import connected_components


def test_paths_stars_and_cycles(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
