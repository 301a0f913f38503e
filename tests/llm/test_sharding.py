import zlib
from collections import Counter

from pyspark.sql import functions as F

from regiometra.llm import ranks, sharding
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_hash_tree_sharding"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert 0.5 * len(rows) / 17 < sum(r.grown_shard == 16 for r in rows) < 1.6 * len(rows) / 17


def test_moves_stay_in_subtrees_whose_weights_change(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = sharding.even_tree(16)
    heavier = {**tree, "region1": {**tree["region1"], "rack3": {**tree["region1"]["rack3"], 12: 4.0}}}
    both = sharding.assign(sharding.assign(keys, "k", tree, "a"), "k", heavier, "b")
    moved = both.where("a <> b").select("a", "b").collect()
    assert moved and all(r.b // 8 == 1 for r in moved)
    assert all(r.b // 4 == 3 for r in moved if r.a // 8 == 1)
    assert all(r.b == 12 for r in moved if r.a // 4 == 3)
    counts = Counter(r.b for r in both.collect())
    assert counts[12] > 2.5 * counts[0]


def test_weights_set_the_shares(spark):
    tree = {"r": {"x": {0: 1.0, 1: 3.0}, "y": {2: 4.0}, "z": {3: 0.0}}, "dead": {"d": {4: 0.0}}}
    n = Counter(r.shard for r in sharding.assign(spark.range(20_000), "id", tree).collect())
    assert set(n) == {0, 1, 2} and abs(n[1] / 20_000 - 3 / 8) < 0.02 and abs(n[2] / 20_000 - 0.5) < 0.02


def test_edges(spark):
    rows = [(1, None), (1, None), (None, "x"), (2, "")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, shard int").drop("shard").withColumn("slots", F.lit(1))
    placed = sharding.place(sharding.assign(docs, "doc_id", sharding.even_tree(3)), order=("doc_id", "text")).collect()
    assert len(placed) == 4 and all(r.shard in (0, 1, 2) for r in placed)
    assert sharding.place(sharding.assign(docs.limit(0), "doc_id", sharding.even_tree(3))).count() == 0


def test_gapless_ranks_of_a_hot_group(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    per = df.groupBy("k").agg(F.count("*").alias("n"))
    got = {}
    for r in ranks.gapless_rank(df, ["k"], ["id"], "r", per).collect():
        got.setdefault(r.k, []).append(r.r)
        assert r.n > r.r
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
