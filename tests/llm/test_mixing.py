import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, doc_kind string"
TARGETS = "source string, target_share double, max_repeats int"


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 1000, (6, 4, 3)).astype(float)
    tokens[2, 1] = 0
    share = np.array([0.3, 0.25, 0.2, 0.1, 0.1, 0.05])
    total = tokens.sum()
    lang, topic = tokens.sum((0, 2)) / total, tokens.sum((0, 1)) / total
    fit = mixing.rake(tokens, share * total, np.full(6, 50.0), lang, topic)
    got = fit.rate * tokens
    assert np.allclose(got.sum((1, 2)) / total, share, atol=1e-9)
    assert np.allclose(got.sum((0, 2)) / total, lang, atol=2e-3)
    assert np.allclose(got.sum((0, 1)) / total, topic, atol=2e-3)


def test_rake_respects_caps():
    tokens = np.array([[[100.0, 50.0]], [[1000.0, 1000.0]]])
    fit = mixing.rake(tokens, np.array([500.0, 900.0]), np.array([2.0, 3.0]), np.array([1.0]), np.array([0.5, 0.5]))
    assert fit.rate[0].max() <= 2 + 1e-9
    assert (fit.rate * tokens).sum((1, 2)) == pytest.approx([300, 900])


def corpus(spark, n=3000):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        s = rng.choice(["Match Bulletin", "match-bulletin", "match_bulletin ", "notes", "logs", None, "unknown"], p=[0.2, 0.1, 0.1, 0.4, 0.1, 0.05, 0.05])
        rows.append((i, " chess" * int(rng.lognormal(4, 0.8)), str(rng.choice(["en", "de", "xx"])) if i % 50 else None, s and str(s), str(rng.choice(["prose", "log", "odd"]))))
    return spark.createDataFrame(rows + [(n, None, "en", "notes", None), (n + 1, "", "en", "notes", "prose")], DOCS)


def test_shares_and_caps(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("match_bulletin", 0.3, 4), ("notes", 0.4, 4), ("logs", 0.25, 2), ("absent", 0.05, 3)], TARGETS)
    out = mixing.mix(docs, targets)
    report = {r.source: r for r in out.report.collect()}
    total = sum(r.tokens for r in report.values())
    assert set(report) == {"match_bulletin", "notes", "logs", "absent"}
    assert not report["absent"].reachable and report["absent"].drawn_tokens == 0
    for s, r in report.items():
        assert r.reachable == (r.tokens * r.max_repeats >= r.target_share * total)
        assert r.most_times <= r.max_repeats
        if r.reachable:
            assert r.drawn_tokens == pytest.approx(r.target_share * total, rel=0.02)
        else:
            assert r.drawn_tokens == r.tokens * r.max_repeats
    assert sum(r.share_reached for r in report.values()) == pytest.approx(1)
    drawn = out.drawn.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn)
    assert {r.source for r in drawn} == {"match_bulletin", "notes", "logs"}


def test_drawing_is_reproducible(spark):
    docs = corpus(spark, 600)
    targets = spark.createDataFrame([("match bulletin", 0.5, 2), ("NOTES", 0.5, 2)], TARGETS)
    a = sorted(map(tuple, mixing.mix(docs.repartition(1), targets).drawn.collect()))
    b = sorted(map(tuple, mixing.mix(docs.repartition(6), targets).drawn.collect()))
    assert a == b and a


def test_a_small_budget_samples(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("match_bulletin", 0.5, 1), ("notes", 0.5, 1)], TARGETS)
    r = {x.source: x for x in mixing.mix(docs, targets, budget=20_000).report.collect()}
    assert all(abs(x.drawn_tokens - 10_000) < 600 for x in r.values())


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("notes", 1.0, 2), (None, 0.5, 1)], TARGETS)
    out = mixing.mix(none, targets)
    assert out.drawn.collect() == [] and [r.source for r in out.report.collect()] == ["notes"]
    out = mixing.mix(corpus(spark, 50).withColumn("key", F.lit(1)).withColumn("times", F.lit(2)).withColumn("z", F.lit(3)), spark.createDataFrame([], TARGETS))
    assert out.drawn.collect() == [] and out.report.collect() == []


def test_many_sources_are_fitted_where_they_lie(spark):
    docs = corpus(spark, 800)
    targets = spark.createDataFrame([("match_bulletin", 0.3, 4), ("notes", 0.4, 4), ("logs", 0.25, 2), ("absent", 0.05, 3)], TARGETS)
    rows = lambda m: (sorted(map(tuple, m.drawn.collect())), sorted(map(tuple, m.report.collect())))
    assert rows(mixing.mix(docs, targets)) == rows(mixing.mix(docs, targets, most_sources=0))


def test_more_sources_than_the_driver_holds(spark):
    n = mixing.MOST_SOURCES + 50
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(" chess move").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"), F.lit("log").alias("doc_kind"))
    targets = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1.0 / n).alias("target_share"), F.lit(2).alias("max_repeats"))
    out = mixing.mix(docs, targets)
    assert out.drawn.count() == n and out.report.filter("reachable").count() == n


def test_reachable_is_a_matter_of_the_budget(spark):
    docs = corpus(spark, 600)
    targets = spark.createDataFrame([("match_bulletin", 0.5, 1), ("notes", 0.5, 1)], TARGETS)
    assert {r.reachable for r in mixing.mix(docs, targets, budget=2_000).report.collect()} == {True}
    assert {r.reachable for r in mixing.mix(docs, targets, budget=10**9).report.collect()} == {False}


def test_margins_are_reported(spark):
    docs = corpus(spark, 3000)
    targets = spark.createDataFrame([("match_bulletin", 0.5, 3), ("notes", 0.5, 3)], TARGETS)
    out = mixing.mix(docs, targets, language_shares={"en": 0.5, "de": 0.5})
    got = {(r.dimension, r.name): r for r in out.margins.collect()}
    assert got["language", "en"].share_wanted == 0.5 and abs(got["language", "en"].share_reached - 0.5) < 0.03
    assert sum(r.share_reached for r in got.values()) == pytest.approx(2)
    assert set(out.error) == {"language", "topic"}
