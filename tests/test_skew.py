import pytest
from pyspark.sql import functions as F

from plyforge import session
from plyforge.operators import skew
from plyforge.operators.skew import with_group_min, with_previous


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_group_minima(spark, hot_rows):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(700, None), (701, None), (None, "k1")]
    df = spark.createDataFrame(rows, "id bigint, k string").repartition(7)
    got = {r.id: (r.m, r.n) for r in with_group_min(df, ["k"], "id", "m", "n", hot_rows=hot_rows, salts=5).collect()}
    by = {}
    for i, k in rows:
        by.setdefault(k, []).append(i)
    for i, k in rows:
        want = (i, 1) if k is None else (min(x for x in by[k] if x is not None), len(by[k]))
        assert got[i] == want


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, k string")
    assert with_group_min(df, ["k"], "id", "m", "n").collect() == []


def test_extra_columns_pass_through(spark):
    df = spark.range(5).select("id", F.lit("a").alias("k"), F.lit(1).alias("value"))
    out = with_group_min(df, ["k"], "id", "m", hot_rows=2)
    assert set(out.columns) == {"id", "k", "value", "m"} and out.count() == 5


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_predecessors(spark, hot_rows):
    import random

    rng = random.Random(0)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), i // 2, i, rng.choice([i, None])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, i int, v int").repartition(5)
    got = {r.i: (r.before, r.first) for r in with_previous(df, ["g"], ["t", "i"], {"v": "before"}, "first", hot_rows).collect()}
    last = {}
    for g, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == (last.get(g), g not in last)
        last[g] = v


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_lookups_with_hot_keys(spark, hot_rows):
    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), (None, 2), ("zz", 3)], "k string, n int").repartition(3)
    facts = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "k string, v int")
    hot = skew.hot_hashes(rows, ["k"], hot_rows)
    assert (hot is None) == (hot_rows > 100)
    for how, n in (("inner", 41), ("left", 43)):
        got = skew.looked_up(rows, facts, ["k"], how, hot).collect()
        assert len(got) == n and all(r.v == {"a": 10, "b": 20}.get(r.k) for r in got)


def test_numbers_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("item"), (F.col("id") % 100).alias("s")).repartition(6)
    got = {r.item: r.no for r in skew.numbered(df, [F.desc("s"), F.asc("item")], "no").collect()}
    order = sorted(range(3000), key=lambda i: (-(i % 100), str(i)))
    assert got == {str(i): k for k, i in enumerate(order, 1)}
    assert skew.numbered(df.limit(0), ["item"], "no").collect() == []


def test_scratch_tables_are_dropped_but_for_those_kept(spark):
    with session.scratch() as keep:
        a = session.cut(spark.range(3), "gone")
        b = keep(session.cut(a, "kept"))
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found|FileNotFound"):
        a.count()
