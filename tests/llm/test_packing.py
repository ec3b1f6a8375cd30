import random

import pytest
from pyspark.sql import functions as F

from plyforge.llm import packing


def sizes(n, seed=0, top=8192):
    rng = random.Random(seed)
    return [min(top, int(rng.lognormvariate(6, 1.2))) for _ in range(n)]


def test_stream_obeys_its_bounds():
    still, items = {}, list(enumerate(sizes(3000)))
    out = list(packing.pack_stream(iter(items), 8192, 8, still))
    assert [(i, s) for i, _, s in out] == items
    held = {}
    for _, w, s in out:
        held[w] = held.get(w, 0) + s
    assert max(held.values()) <= 8192 and len(still) <= 8
    assert all(8192 - held[w] == room for w, room in still.items())
    last = {}
    for k, (_, w, _) in enumerate(out):
        last[w] = k
    opened = {}
    for k, (_, w, _) in enumerate(out):
        opened.setdefault(w, k)
    for k in range(len(out)):
        assert sum(opened[w] <= k < last[w] for w in opened) <= 8


@pytest.mark.parametrize("per_partition", [10_000, 150])
def test_everything_is_packed_once(spark, per_partition):
    data = list(enumerate(sizes(4000)))
    df = spark.createDataFrame(data, "item bigint, size bigint").repartition(5)
    got = packing.pack(df, 8192, per_partition=per_partition).collect()
    assert sorted((r["item"], r["size"]) for r in got) == sorted(data)
    held = {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r["size"]
    assert max(held.values()) <= 8192
    least = sum(s for _, s in data) / 8192
    assert len(held) <= 1.05 * least + 2


def test_result_does_not_depend_on_partitioning(spark):
    data = list(enumerate(sizes(1000)))
    a = packing.pack(spark.createDataFrame(data, "item bigint, size bigint").repartition(1), 8192, per_partition=200)
    b = packing.pack(spark.createDataFrame(data[::-1], "item bigint, size bigint").repartition(7), 8192, per_partition=200)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_documents(spark):
    word = " chess"
    texts = [(1, word * 100), (2, word * 8192), (3, word * 8193), (4, word * 20000), (5, ""), (6, None), (7, word * 16384), (8, word * 100)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("size", F.lit("x")).withColumn("container", F.lit(1))
    out = packing.pack_documents(df)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.token_start, r.token_end, r.piece))
    assert set(by) == set(range(1, 9))
    for i, t in texts:
        want = len(t) // 6 if t else 0
        spans = sorted(by[i])
        assert spans[0][0] == 0 and spans[-1][1] == want
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert [s[2] for s in spans] == list(range(len(spans)))
        assert len(spans) == max(1, -(-want // 8192))
    assert {r.doc_id for r in packing.divided(out).collect()} == {3, 4, 7}
    fill = packing.container_fill(out).collect()
    assert max(r.tokens for r in fill) <= 8192 and sum(r.tokens for r in fill) == sum(len(t) // 6 for _, t in texts if t)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(df).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(1, 100), (1, 100), (1, 9000), (1, 9000), (None, 300), (None, 300), (None, 8500), (2, 50)]
    df = spark.createDataFrame([(i, " chess" * n) for i, n in rows], "doc_id bigint, text string")
    out = packing.pack_documents(df)
    tokens = {}
    for r in out.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.token_end - r.token_start
    assert tokens == {1: 18200, None: 9100, 2: 50}
    fill = packing.container_fill(out).collect()
    assert max(r.tokens for r in fill) <= 8192


def test_rules_tell_what_is_broken(spark):
    docs = spark.createDataFrame([(i, " chess" * (200 + 37 * i % 900)) for i in range(60)] + [(99, " chess" * 20_000), (100, "")], "doc_id bigint, text string")
    contents = packing.pack_documents(docs)
    broken = lambda c: {r.rule: r.violations for r in packing.broken_rules(docs, c, windows=4).collect()}
    assert set(broken(contents).values()) == {0}
    assert broken(contents.filter("doc_id <> 7"))["cover"] == 1
    assert broken(contents.unionByName(contents.filter("doc_id = 7")))["cover"] == 1
    assert broken(contents.withColumn("container", F.lit("one")))["capacity"] == 1
    assert broken(contents.withColumn("container", F.col("doc_id").cast("string")))["containers"] > 0
