import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperweave.operators.compact import consolidate, document_groups, repeated_documents, swap_directory
from paperweave.operators.skew import attach_first, count_per_key, heavy_keys, parted, sketch_candidates, skew_join, spread_group
from tests.conftest import rows


def skewed(spark, n=6000, extra=""):
    rnd = random.Random(5)
    data = [(i, None if i % 50 == 7 else "hot" if i % 3 == 0 else f"k{rnd.randrange(800)}", rnd.randrange(30)) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, k string, v int"), data


def test_heavy_keys_exact(spark):
    df, data = skewed(spark)
    c = Counter(k for _, k, _ in data)
    for share in (0.02, 0.2, 0.9):
        want = sorted(((k, n, len(data)) for k, n in c.items() if k is not None and n >= share * len(data)), key=repr)
        assert rows(heavy_keys(df, F.col("k"), share)) == want


def test_threshold_tie_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 2 + [(f"x{i}",) for i in range(98)], "k string")
    assert [r.key for r in heavy_keys(df, F.col("k"), 0.02).collect()] == ["a"]
    assert heavy_keys(df.limit(0), F.col("k"), 0.02).count() == 0
    assert sketch_candidates(df.select(F.lit(None).cast("string").alias("k")), F.col("k"), 0.1).count() == 0
    with pytest.raises(ValueError):
        sketch_candidates(df, F.col("k"), 0)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("unique", [True, False])
def test_skew_join_is_a_join(spark, how, unique):
    df, _ = skewed(spark, 3000)
    keys = [("hot",), ("k1",), ("k2",), ("k3",), ("none",)] * (1 if unique else 2)
    small = spark.createDataFrame([(k, i, i) for i, (k,) in enumerate(keys)], "k string, w int, v int")
    got = skew_join(df, small, "k", how, share=0.05, unique=unique)
    want = df.join(small.withColumnRenamed("v", "v_small"), "k", how).select(*got.columns)
    assert rows(got) == rows(want)
    assert rows(skew_join(df.limit(0), small, "k", how, unique=unique)) == []
    assert skew_join(df, small.limit(0), "k", how, unique=unique).count() == (3000 if how == "left" else 0)


def test_skew_join_of_nothing_else(spark):
    with pytest.raises(ValueError):
        skew_join(spark.range(1), spark.range(1), "id", "full")


def test_attach_first_and_spread(spark):
    df, data = skewed(spark)
    low, n = {}, Counter(k for _, k, _ in data)
    for i, k, _ in data:
        low[k] = min(i, low.get(k, i))
    got = attach_first(df.select("id", "k"), "k", "id", "first")
    assert rows(got.select("id", "first")) == sorted(((i, low[k]) for i, k, _ in data if k is not None and n[k] > 1), key=repr)
    want = sorted(((k, c, len({v for _, x, v in data if x == k})) for k, c in n.items() if k is not None), key=repr)
    assert rows(spread_group(df, "k", "v")) == want


def test_counts_of_every_key(spark):
    df, data = skewed(spark)
    c = Counter(k for _, k, _ in data if k is not None)
    got = rows(count_per_key(df, "k", 0.2).select("k", "n_rows", "heavy"))
    assert got == sorted(((k, n, n >= 0.2 * len(data)) for k, n in c.items()), key=repr)
    hot, light = parted(df, "k", 0.2)
    assert hot.count() + light.count() == sum(c.values()) and not hot.select("k").distinct().join(light, "k").count()
    assert count_per_key(df.limit(0), "k", 0.2).count() == 0


def test_skew_join_where_both_sides_repeat_a_hot_key(spark):
    """The salts follow the key's share; every pair comes out once."""
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(9).select((F.col("id") % 3).alias("k"), F.col("id").alias("w"))
    got = skew_join(big, small, "k", share=0.01)
    assert rows(got) == rows(big.join(small, "k").select(*got.columns))


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from paperweave import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda self, k, d: None})()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError):
        session.shared_dir(type("Spark", (), {"sparkContext": Context()})())


DOCS = [
    (1, "paper", "A", "p1", "x"), (2, "paper", "a", "p2", "x"), (3, "paper", "a", "p3", "y"), (4, "refs", "a", "p4", "x"), (5, "paper", "a", "p5", None), (6, "paper", "a", "p6", None),
    (7, "paper", None, "p7", "x"), (8, "paper", None, "p8", "x"), (9, "paper", "", "p9", "x"), (10, "paper", "a1", "p", ":x"), (11, "paper", "a", "p", "1:x"), (12, None, "a", "p", ""), (13, None, "A", "p", ""),
]


def docs(spark):
    return spark.createDataFrame([(*d, 1, "c") for d in DOCS], "raw_id bigint, endpoint string, key_id string, path string, body string, doc int, keep_id string")


def test_repeated_documents(spark):
    assert rows(repeated_documents(docs(spark)).select("raw_id", "keep_id")) == [(13, 12), (2, 1), (8, 7)]
    assert repeated_documents(docs(spark).limit(0)).count() == 0
    assert document_groups(docs(spark)).where("doc is null").count() == 2


def test_consolidate_whole_table(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/raw_doc.parquet")
    path = str(tmp_path / "out")
    done = consolidate(raw, path, target_bytes=4_000)
    kept = spark.read.parquet(path)
    gone = {r.raw_id for r in repeated_documents(raw).collect()}
    assert rows(kept.select(*raw.columns)) == rows(raw.where(~F.col("raw_id").isin(*gone)))
    files = done.files.collect()
    assert done.rows_out + done.rows_repeated == done.rows_in == raw.count() and 2 < len(files) < 12
    spans = sorted((f["first"], f["last"]) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {r.raw_id for r in done.left_out.collect()} == gone and len(gone) > 0
    # again, from the folder itself: nothing more to drop
    again = consolidate(spark.read.parquet(path), path, target_bytes=1 << 20)
    assert again.rows_repeated == 0 and again.rows_out == done.rows_out and again.files.count() == 1


def test_consolidate_hot_key_spreads(spark, tmp_path):
    hot = spark.range(2000).select(F.col("id").alias("raw_id"), F.lit("paper").alias("endpoint"), F.lit("same").alias("key_id"), F.concat(F.lit("body"), F.col("id")).alias("body"))
    done = consolidate(hot, str(tmp_path / "hot"), target_bytes=4000)
    sizes = [f.n_rows for f in done.files.collect()]
    assert sum(sizes) == 2000 and len(sizes) > 4 and max(sizes) < 1000
    empty = consolidate(hot.limit(0), str(tmp_path / "none"))
    assert empty.rows_out == 0
    with pytest.raises(ValueError):
        consolidate(hot.unionByName(hot), str(tmp_path / "dup"))


def test_swap_recovers(spark, tmp_path):
    def put(name, n):
        spark.range(n).write.parquet(str(tmp_path / name))

    put("new", 3)
    put("final.old", 2)  # broken off between the two renames
    swap_directory(spark, str(tmp_path / "new"), str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 3 and not (tmp_path / "final.old").exists()
