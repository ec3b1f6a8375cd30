import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import ranking

SCHEMA = "record_id string, run_id string, recorded_at string, candidate_sha256 string, opponent_sha256 string, wins bigint, losses bigint, draws bigint"


def league(n=12, records=400, seed=1, noise=0):
    rng = np.random.default_rng(seed)
    s = np.sort(rng.normal(0, 0.8, n))[::-1]
    rows = []
    for k in range(records):
        i = min(n - 1, int(rng.exponential(3)))
        j = int(rng.integers(n))
        if i == j:
            continue
        games = int(rng.integers(20, 400))
        p = 1 / (1 + np.exp(s[j] - s[i]))
        w = int(rng.binomial(games, p))
        rows.append((f"r{k}", f"run{k}", "t", f"N{i:02d}" if k % 5 else f" n{i:02d} ", f"n{j:02d}", w, games - w, 7))
    for k in range(noise):
        rows.append((f"x{k}", "x", "t", f"n{n - 1 - k:02d}", f"n{k:02d}", 400, 1, 0))
    return rows, s


def ranks(spark, rows, **kw):
    out = ranking.rank_items(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    assert [r.rank_no for r in sorted(out, key=lambda r: r.rank_no)] == list(range(1, len(out) + 1))
    return {r.network_sha256: (r.rank_no, r.strength) for r in out}


def exact_loss(rows, strengths):
    """The loss that the ranking minimises."""
    pairs = {}
    for _, _, _, a, b, w, l, _ in {r[0]: r for r in rows}.values():  # noqa: E741
        a, b = a.strip().lower(), b.strip().lower()
        if a > b:
            a, b, w, l = b, a, l, w  # noqa: E741
        x = pairs.setdefault((a, b), [0.5, 0.5])
        x[0] += w
        x[1] += l
    return sum((1 / (1 / w + 1 / l)) ** 0.5 * abs(strengths[a] - strengths[b] - np.log(w / l)) for (a, b), (w, l) in pairs.items())


def test_true_order_is_found(spark):
    rows, s = league()
    got = ranks(spark, rows)
    assert len(got) == 12
    order = sorted(got, key=lambda x: got[x][0])
    true = [f"n{i:02d}" for i in range(12)]
    assert np.corrcoef([order.index(t) for t in true], range(12))[0, 1] > 0.97
    est = np.array([got[t][1] for t in true])
    assert np.abs((est - est.mean()) - (s - s.mean())).max() < 0.35


def test_loss_is_minimal(spark):
    rows, _ = league(8, 150, 3)
    got = {k: v[1] for k, v in ranks(spark, rows).items()}
    best = exact_loss(rows, got)
    rng = np.random.default_rng(0)
    for _ in range(300):
        other = {k: v + rng.normal(0, rng.choice([0.003, 0.03, 0.3])) * (rng.random() < 0.3) for k, v in got.items()}
        assert exact_loss(rows, other) >= best - 0.02


def test_contradictory_edges_are_outvoted(spark):
    clean = ranks(spark, league(12, 600, 5)[0])
    dirty = ranks(spark, league(12, 600, 5, noise=2)[0])
    assert np.corrcoef([clean[k][0] for k in clean], [dirty[k][0] for k in clean])[0, 1] > 0.9


def test_repeats_draws_self_matches_nulls_and_islands(spark):
    rows = [
        ("1", "a", "t", "A", "b", 10, 2, 5), ("1", "a", "t", "a", "B", 10, 2, 5), ("2", "b", "t", "sha256:b", "c", 30, 1, 0), ("3", "c", "t", "c", "c", 99, 0, 0),
        ("4", "d", "t", "d", "e", 0, 0, 50), ("5", "e", "t", "x", "y", 3, 2, 0), ("6", "f", "t", None, "z", 9, 9, 0), ("7", "g", "t", "a", "b", None, None, None),
    ]
    got = ranks(spark, rows)
    assert set(got) == set("abcdexyz")
    assert got["a"][0] < got["b"][0] < got["c"][0] and got["x"][0] < got["y"][0]
    assert got["d"][1] == got["e"][1] == got["z"][1] == 0 and got["d"][0] + 1 == got["e"][0]
    once = ranks(spark, [r for r in rows if r[3] != "a" or r[0] != "1"])
    assert once["a"][1] == pytest.approx(got["a"][1])


def test_empty(spark):
    assert ranking.rank_items(spark.createDataFrame([], SCHEMA)).collect() == []


def graph(kind, n, seed=7):
    """Pairs of numbers with random results: (i, j, wins, losses)."""
    rng = np.random.default_rng(seed)
    ends = {
        "chain": [(k, k + 1) for k in range(n - 1)],
        "ladder": [(k, k + d) for d in (1, 2) for k in range(n - d)],
        "hub": [(0, k) for k in range(1, n)] + [(k, k + 1) for k in range(1, n - 1, 3)],
        "islands": [(k, k + d) for d in (1, 2) for k in range(n - d) if k // 5 == (k + d) // 5],
        "mesh": sorted({tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(4 * n)} - {(k, k) for k in range(n)}),
    }[kind]
    strength = rng.normal(0, 1, n)
    out = []
    for i, j in ends:
        games = int(rng.integers(2, 60))
        wins = int(rng.binomial(games, 1 / (1 + np.exp(strength[j] - strength[i]))))
        out.append((i, j, wins, games - wins))
    return out


def held(pairs, n):
    i, j, w, l = map(np.array, zip(*pairs, strict=True))  # noqa: E741
    w, l = w + 0.5, l + 0.5  # noqa: E741
    return ranking.Held(i, j, np.log(w / l), (1 / (1 / w + 1 / l)) ** 0.5, n)


@pytest.mark.parametrize(("kind", "n"), [("chain", 60), ("chain", 400), ("ladder", 300), ("hub", 400), ("islands", 100), ("mesh", 2000)])
def test_rounds_settle_at_the_one_best_answer(kind, n):
    pairs = graph(kind, n)
    a = held(pairs, n)
    ranking.settle(a)
    assert a.slope(ranking.EPS) < 1e-7
    # the same answer, and the same order, from another beginning and another order of pairs
    b = held(pairs[::-1], n)
    b.s = np.random.default_rng(1).normal(0, 3, n)
    ranking.settle(b)
    assert np.abs(a.s - b.s).max() < 1e-7
    order = lambda s: sorted(range(n), key=lambda k: (-round(s[k], 6), k))
    assert order(a.s) == order(b.s)


def test_unsettled_rounds_are_an_error():
    with pytest.raises(ranking.NotSettled):
        ranking.settle(held(graph("ladder", 40), 40), rounds=2)


def tables(spark, h, **kw):
    rows = [(int(a), int(b), float(m), float(w)) for a, b, m, w in zip(h.i, h.j, h.margin, h.weight, strict=True)]
    pairs = spark.createDataFrame(rows, "i bigint, j bigint, margin double, weight double").coalesce(1)
    return ranking.Spread(pairs, spark.range(h.n).withColumnRenamed("id", "i").coalesce(1), h.n, **kw)


@pytest.mark.parametrize(("kind", "n", "kw"), [("chain", 8, {}), ("ladder", 8, {}), ("islands", 10, {}), ("hub", 10, {}), ("hub", 10, {"broadcast": 0, "hot_rows": 3})])
def test_a_round_on_tables_is_one_on_arrays(spark, kind, n, kw):
    a = held(graph(kind, n), n)
    b = tables(spark, a, **kw)
    for curved in (False, True):
        assert b.slope(0.3) == pytest.approx(a.slope(0.3), rel=1e-4)
        for g in (a, b):
            g.direct(0.3, curved, 1e-20)
        change = a.changes(0.3)
        assert b.changes(0.3) == pytest.approx(change, rel=1e-5, abs=1e-7)
        for g in (a, b):
            g.move(ranking.LENGTHS[int(np.argmin(change))])
        found = {r.i: r.s for r in b.v.select("i", "s").collect()}
        assert max(abs(found[k] - a.s[k]) for k in range(n)) < 1e-5


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="minutes of small jobs; set SLOW_TESTS to run it")
def test_tables_give_the_rank_of_every_item(spark):
    rows = [(f"r{i}-{j}", "run", "t", f"n{i:03d}", f"n{j:03d}", w, l, 0) for i, j, w, l in graph("ladder", 5)]
    a, b = ranks(spark, rows), ranks(spark, rows, driver_pairs=0)
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert max(abs(a[k][1] - b[k][1]) for k in a) < 1e-7


def test_slopes_tell_the_best_answer(spark):
    rows, _ = league(8, 150, 3)
    got = {r.network_sha256: r.slope for r in ranking.slopes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 8 and max(got.values()) < 1e-6
