import random

import pytest
from pyspark.sql import functions as F

from plyforge.llm import sample


def rows(n=4000, seed=1):
    rng = random.Random(seed)
    return [(i, f"key{rng.randrange(n)}" if rng.random() > 0.02 else None, rng.choice(["train", "train", "train", "val", "fresh", None]), rng.choice([*range(1, 13), None])) for i in range(n)]


def chosen(spark, data, parts=3, **kw):
    df = spark.createDataFrame(data, "id bigint, k string, s string, t int").repartition(parts)
    out = sample.nested_sample(df, F.col("k"), F.col("s"), F.col("t"), **{"share": 0.1, **kw})
    return {r.id for r in out.collect()}


def test_place_is_a_permutation(spark):
    n = sample.BUCKETS
    got = spark.range(n).select(sample.place_of(F.col("id")).alias("p")).collect()
    assert {r.p for r in got} == set(range(n))


def test_same_for_any_partitioning_and_order(spark):
    data = rows()
    a = chosen(spark, data, 1)
    random.Random(5).shuffle(data)
    assert a == chosen(spark, data, 9) and len(a) > 300


def test_what_is_chosen_stays_chosen_as_data_grows(spark):
    data, before = rows(), set()
    for upto in (1, 4, 8, 12):
        now = chosen(spark, [r for r in data if (r[3] or 0) <= upto])
        assert before <= now
        before = now


def test_larger_shares_contain_smaller_ones(spark):
    data = rows()
    assert chosen(spark, data, share=0.05) <= chosen(spark, data, share=0.1) <= chosen(spark, data, share=0.3)


def test_equal_keys_are_treated_alike_and_shares_are_met(spark):
    data = rows()
    got = chosen(spark, data)
    by = {}
    for i, k, *_ in data:
        by.setdefault(k, set()).add(i in got)
    assert by.pop(None) == {False}
    assert all(len(v) == 1 for v in by.values())
    for s in ("train", "val", "fresh", None):
        keys = {k for _, k, x, _ in data if x == s and k}
        hit = {k for i, k, x, _ in data if x == s and k and i in got}
        assert abs(len(hit) - 0.1 * len(keys)) < 4 * (0.1 * len(keys)) ** 0.5


def test_list_grows_where_a_split_falls_short(spark):
    """Keys picked to lie behind the first buckets: only a longer list reaches them."""
    placed = spark.range(20000).select(F.col("id").cast("string").alias("k")).withColumn("p", sample.place_of(sample.bucket_of(F.col("k"), "sample-v1"))).collect()
    late = [r.k for r in placed if r.p >= 2000][:1000]
    data = [(i, r.k, "train", 1) for i, r in enumerate(placed)] + [(10**6 + i, k, "val", 2 + i % 3) for i, k in enumerate(late)]
    before = chosen(spark, [r for r in data if r[3] == 1])
    now = chosen(spark, data)
    assert before < now
    assert 1000 * 0.1 - 31 <= len({i for i in now if i >= 10**6}) < 1000 * 0.15


def test_hot_key_and_empty(spark):
    data = [(i, "hot" if i % 3 else f"k{i}", "train", 1) for i in range(3000)]
    got = chosen(spark, data)
    assert 50 < len({i for i in got if i % 3 == 0}) < 250
    assert len({i for i in got if i % 3}) in (0, 2000)
    assert chosen(spark, []) == set()


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        chosen(spark, [], buckets=1000)
    with pytest.raises(ValueError):
        chosen(spark, [], share=0)


def test_clashing_columns_pass_through(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("k"), F.lit(1).alias("place"), F.lit("x").alias("split"), F.lit(2).alias("length"))
    out = sample.nested_sample(df, F.col("k"), F.lit("train"), F.lit(1), 0.5)
    assert {"place", "split", "length"} <= set(out.columns) and 20 < out.count() < 90


def test_a_manifest_keeps_every_key_whatever_arrives_or_goes(spark, tmp_path):
    """Rows under intakes already seen or null, and removals: without the kept list they would shift its length."""
    placed = spark.range(20000).select(F.col("id").cast("string").alias("k")).withColumn("p", sample.place_of(sample.bucket_of(F.col("k"), "sample-v1"))).collect()
    late = [r.k for r in placed if r.p >= 2000][:600]
    first = [(i, k, "val", 3) for i, k in enumerate(late)]
    base = [(10_000 + i, r.k, "train", 1) for i, r in enumerate(placed[:3000])]
    at = f"file://{tmp_path}/list"
    held = chosen(spark, base + first, manifest=at)
    early = [(50_000 + i, r.k, "val", 3 if i % 2 else None) for i, r in enumerate(r for r in placed if r.p < 400)]
    more = chosen(spark, base + first + early, manifest=at)
    assert held <= more
    assert not held <= chosen(spark, base + first + early)
    fewer = base[:1000] + first[::2]
    assert {i for i in more if i in {r[0] for r in fewer}} == chosen(spark, fewer, manifest=at)
    assert sample.kept_length(spark, at, "sample-v1", sample.BUCKETS, 0.1) > 409
    assert sample.kept_length(spark, at, "other", sample.BUCKETS, 0.1) == 0


def test_growth_tells_lost_keys(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "id bigint, k string, s string, t int")
    data = rows(2000)
    states = [make(data[:500]), make(data[400:]), make(data)]
    got = sample.growth(states, F.col("k"), F.col("s"), F.col("t"), f"file://{tmp_path}/grow", share=0.1).collect()
    assert [(r.step, r.lost) for r in got] == [(1, 0), (2, 0), (3, 0)] and got[2].chosen >= got[0].chosen > 0
