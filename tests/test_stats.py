import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.functions import stats
from plyforge.operators import matches

CELLS = list(matches.CELLS)


def table(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in CELLS))


# Published results of two matches of 200 pairs.
GOLDEN = [((2, 28, 149, 21, 0), -9.5551, -22.3555, 3.2453), ((0, 27, 144, 28, 1), 2.6041, -10.4746, 15.6828)]


@pytest.mark.parametrize("cells,elo,low,high", GOLDEN)
def test_published_estimates(spark, cells, elo, low, high):
    r = matches.with_elo(table(spark, [cells])).first()
    assert (r.elo, r.elo_ci_low, r.elo_ci_high) == (pytest.approx(elo, abs=1e-4), pytest.approx(low, abs=1e-4), pytest.approx(high, abs=1e-4))


def test_no_pairs_give_nulls(spark):
    r = matches.with_gsprt(matches.with_elo(table(spark, [(0, 0, 0, 0, 0)])), 0, 5).first()
    assert r.elo is None and r.llr is None and r.state is None


def llr(cells, elo0, elo1):
    """The same quantity by a plain search."""
    reg = np.array([c or 0.001 for c in cells], float)
    p, a = reg / reg.sum(), np.arange(5) / 4

    def tilted(elo):
        t = stats.expected_score(elo)
        lo, hi = -1 / (1 - t) + 1e-9, 1 / t - 1e-9
        for _ in range(200):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if (p * (a - t) / (1 + x * (a - t))).sum() > 0 else (lo, x)
        return p / (1 + x * (a - t))

    return reg.sum() * (p * (np.log(tilted(elo1)) - np.log(tilted(elo0)))).sum()


@pytest.mark.parametrize("cells", [(2, 28, 149, 21, 0), (0, 27, 144, 28, 1), (1, 1, 1, 1, 1), (0, 0, 10, 0, 0), (300, 0, 0, 0, 2), (0, 5, 400, 90, 40)])
def test_llr(spark, cells):
    r = matches.with_gsprt(table(spark, [cells]), -2.0, 6.0).first()
    assert r.llr == pytest.approx(llr(cells, -2, 6), rel=1e-9, abs=1e-9)


def test_states_and_verdicts(spark):
    rows = [(0, 0, 0, 50, 200), (200, 50, 0, 0, 0), (1, 2, 195, 2, 0), (0, 1, 8, 1, 0)]
    got = matches.with_verdict(matches.with_gsprt(matches.with_elo(table(spark, rows)), 0, 5, max_games=400), -3.0).orderBy("games_played", "ww").collect()
    state = {tuple(r[c] for c in CELLS): (r.state, r.verdict) for r in got}
    assert state[rows[0]] == ("H1_ACCEPTED", "SUPPORTED_PROGRESS")
    assert state[rows[1]] == ("H0_ACCEPTED", "PROGRESS_NOT_SUPPORTED")
    assert state[rows[2]] == ("CAP_REACHED", "INCONCLUSIVE")
    assert state[rows[3]] == ("CONTINUE", None)


def test_small_formulas(spark):
    r = spark.range(1).select(
        stats.score_from_wdl(F.lit(2), F.lit(2), F.lit(0)).alias("s"), stats.score_from_wdl(F.lit(0), F.lit(0), F.lit(0)).alias("z"), stats.collision_probability(F.lit(200), F.lit(150932)).alias("c"), stats.interval_side(F.lit(-1.0), F.lit(1.0)).alias("i")
    ).first()
    assert (r.s, r.z, r.i) == (0.75, None, "CROSSES_ZERO") and r.c == pytest.approx(0.12, abs=0.005)
    assert stats.wald_bounds(0.05, 0.05) == (pytest.approx(-math.log(19)), pytest.approx(math.log(19)))
    for bad in ((0, 0.5), (0.5, 1)):
        with pytest.raises(ValueError):
            stats.wald_bounds(*bad)


def test_wdl_against_cells(spark):
    cases = [((4, 2, 0), (1, 1, 1, 0, 0), "net"), ((1, 1, 2), (0, 0, 2, 0, 0), None), ((0, 0, 2), (0, 0, 2, 0, 0), "games"), ((1, 0, 3), (0, 0, 1, 1, 0), None), ((2, 1, 1), (0, 0, 1, 1, 0), None), ((0, 0, 4), (0, 0, 1, 1, 0), "net"), ((0, 1, 3), (0, 1, 1, 0, 0), None)]
    df = spark.createDataFrame([(i, *w, *c) for i, (w, c, _) in enumerate(cases)], "i int, w bigint, l bigint, d bigint, " + ", ".join(f"{c} bigint" for c in CELLS))
    got = {r.i: r.p for r in df.select("i", stats.wdl_problem(F.col("w"), F.col("d"), F.col("l"), [F.col(c) for c in CELLS]).alias("p")).collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(cases)}


def test_pairs(spark):
    g = "run_id string, game_index bigint, opening_ref string, candidate_role string, candidate_outcome string"
    rows = [("a", 1, "o1", "white", "win"), ("a", 2, "o1", "black", "loss"), ("a", 3, "o2", "white", "win"), ("a", 4, "o2", "black", "win"), ("a", 5, "o3", "white", "draw"), ("b", 1, "o1", "white", "win"), ("b", 2, "o1", "white", "win"), ("b", 3, None, "white", "win"), ("b", 4, "o9", "white", None), ("b", 5, "o9", "black", "win")]
    pairs = matches.opening_pairs(spark.createDataFrame(rows, g), ["run_id"])
    got = {r.run_id: r for r in matches.pentanomial(pairs, ["run_id"]).collect()}
    assert [got["a"][c] for c in CELLS] == [0, 0, 1, 0, 1] and (got["a"].pairs, got["a"].broken_pairs, got["a"].first_offence) == (2, 1, "incomplete")
    assert (got["b"].pairs, got["b"].broken_pairs, got["b"].first_offence) == (0, 3, "malformed")
