import os
import tempfile

from pyspark.sql import functions as F

from coldsplit import sources
from coldsplit.session import session_conf


def _dir():
    return tempfile.mkdtemp(prefix="coldsplit-src-")


def test_reviews_json_single_quotes_and_malformed(spark):
    d = _dir()
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write("{'reviewerID': 'A1', 'asin': '0123', 'overall': 5.0, 'helpful': [0, 1]}\n")
        f.write('{"reviewerID": "A2", "asin": "B01", "overall": 3.0}\n')
        f.write("{'reviewerID': 'A3', 'asin': 'x', 'overall': None, 't': (1, 2)}\n")
    df = sources.read_reviews_json(spark, d)
    good = df.filter(F.col("_corrupt_record").isNull()).select("reviewerID", "asin", "overall").collect()
    assert sorted(tuple(x) for x in good) == [("A1", "0123", 5.0), ("A2", "B01", 3.0)]
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select("reviewerID", "_corrupt_record").collect()
    assert len(bad) == 1


def test_delimited(spark):
    d = _dir()
    with open(os.path.join(d, "ratings.dat"), "w") as f:
        f.write("1::1193::5::978300760\n1::661::3::978302109\n")
    rows = sources.read_ratings_delimited(spark, d).collect()
    assert [(r.user_id, r.item_id, r.rating, r.ts) for r in rows] == [(1, 1193, 5.0, 978300760), (1, 661, 3.0, 978302109)]


def test_sectioned_files_and_pairs(spark):
    d = _dir()
    for mv, lines in {7: ["1,5,2005-01-01", "3,2,2005-01-02"], 12: ["2,4,2005-02-02"]}.items():
        with open(os.path.join(d, f"mv_{mv:07d}.txt"), "w") as f:
            f.write(f"{mv}:\n" + "\n".join(lines) + "\n")
    got = sorted((r.user_id, r.item_id, r.rating) for r in sources.read_sectioned_ratings(spark, d).collect())
    assert got == [(1, 7, 5.0), (2, 12, 4.0), (3, 7, 2.0)]
    p = _dir()
    with open(os.path.join(p, "probe.txt"), "w") as f:
        f.write("1:\n30878\n2647871\n10:\n1952305\n")
    pairs = sorted((r.item_id, r.user_id) for r in sources.read_sectioned_pairs(spark, p).collect())
    assert pairs == [(1, 30878), (1, 2647871), (10, 1952305)]


def test_items_csv_multiline(spark):
    d = _dir()
    with open(os.path.join(d, "items.csv"), "w") as f:
        f.write('asin,description,title,price\n0,"two\nlines, ""quoted""",T0,1.5\n1,plain,T1,\n')
    rows = sources.read_items_csv(spark, d).orderBy("asin").collect()
    assert rows[0].description == 'two\nlines, "quoted"' and rows[0].price == 1.5
    assert rows[1].price is None


def test_rows_to_df_toy_als_input(spark):
    toy = [(0, 0, 2.99), (0, 1, 2.66), (0, 2, 2.99), (0, 3, 1.99), (0, 4, 3.33)]
    df = sources.rows_to_df(spark, toy)
    assert df.count() == 5 and df.schema.names == ["user_id", "item_id", "rating"]


def test_sectioned_pairs_in_one_file_of_several_blocks(spark, tmp_path):
    want, lines = [], []
    for item in range(1, 40):
        lines.append(f"{item}:")
        for user in range(item * 3 if item != 7 else 4000):  # one section longer than a block
            lines.append(f"{user},2005-01-0{user % 9 + 1}")
            want.append((item, user))
    (tmp_path / "probe.txt").write_text("\n".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = sources.read_sectioned_pairs(spark, str(tmp_path / "probe.txt"))
        assert sorted((r.item_id, r.user_id) for r in df.collect()) == sorted(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_items_csv_in_one_file_of_many_blocks(spark, tmp_path):
    import random

    rng = random.Random(5)
    bits = ["plain", "a, b", 'said ""so""', "\n", "\n\n", "line\nline", "ünï", '""', " ", "\r\n", "x" * 90]
    rows = ["asin,description,title,price"]
    for n in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 8])))
        if n == 200:
            text = "long\n" * 900  # several blocks inside one pair of quotes
        rows.append(f'{n},"{text}",{rng.choice(["", "T", chr(34) * 2, chr(34) + "q,t" + chr(34)])},{rng.choice(["", "1.5", "x"])}')
        if n % 50 == 7:
            rows.append("")  # an empty line is no record
    for name, end in (("a.csv", "\n"), ("b.csv", "")):
        (tmp_path / name).write_bytes(("\n".join(rows) + end).encode())
    with session_conf(spark, spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="0"):
        df = sources.read_items_csv(spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
    want = sources.read_items_csv(spark, str(tmp_path), stray_quotes=True).collect()
    assert got == sorted((tuple(r) for r in want), key=repr) and len(got) == 800


def test_items_csv_with_windows_line_ends_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'asin,description,title,price\r\n1,"two\r\nlines",T,2.5\r\n\r\n2,,"",\r\n')
    (tmp_path / "b.csv").write_bytes(b"asin,description,title,price\n")
    (tmp_path / "c.csv").write_bytes(b"")
    got = sorted(tuple(r) for r in sources.read_items_csv(spark, str(tmp_path)).collect())
    plain = sorted(tuple(r) for r in sources.read_items_csv(spark, str(tmp_path), stray_quotes=True).collect())
    assert plain == [(i, d and d.replace("\r\n", "\n"), *r) for i, d, *r in got]  # that reader rewrites them
    assert [r[0] for r in got] == [1, 2] and got[0][1:] == ("two\r\nlines", "T", 2.5)


def test_items_csv_moves_the_lines_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asin,description,title,price\n" + "".join(f'{n},"a\nb",T,1.0\n' for n in range(300)))
    with session_conf(spark, spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="0"):
        df = sources.read_items_csv(spark, str(tmp_path))
        assert len(df.collect()) == 300
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # pieces inside a block, and those that cross a border: one shuffle of the lines for both
    assert plan.count("collect_list(struct(at") >= 2 and "ReusedExchange" in plan


def test_user_shards_in_few_files_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "SHARDS_PER_FOLDER", 10)
    rows = [(u, i, 1.0) for u in range(1200) for i in range(1 + u % 3)] + [(600, i, 2.0) for i in range(10, 4000)]  # 50 shards of 24 users, one heavy
    df = spark.createDataFrame(rows, sources.RATINGS_SCHEMA)
    path = str(tmp_path / "shards")
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):  # tiny data would be one task
        sources.save_user_shards(df, path)
    back = sources.load_user_shards(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert len(back.inputFiles()) <= 5 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = sources.load_user_shards(spark, path, [0, 25, 49, 999])
    want = sorted(r for r in rows if r[0] // 24 in (0, 25, 49))
    assert sorted(map(tuple, some.collect())) == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(shard" in plan
    table = spark.createDataFrame([(0,), (25,), (49,), (49,)], "shard int")
    assert sorted(map(tuple, sources.load_user_shards(spark, path, table).collect())) == want
    heavy = {f.input_file for f in back.filter("user_id = 600").selectExpr("input_file_name() as input_file").distinct().collect()}
    assert len(heavy) > 1  # a third and more of the rows, not one task
