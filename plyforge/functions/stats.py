"""Match statistics as columns: scores, Elo with interval, sequential test.

Cells are five counts of opening pairs by the points the candidate took from
both games: 0, 1/2, 1, 1 1/2, 2. Everything is arithmetic on columns, so any
number of runs is evaluated in one plan.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.guards import between, finite, whole
from plyforge.functions.vocabulary import INTERVAL_SIDES, TEST_STATES, VERDICTS

#: What an empty cell counts as, and the furthest a score may be from 0 and 1.
EMPTY_CELL, CLIP = 0.001, 0.001
#: Halvings of the bracket around the constrained estimate's multiplier.
HALVINGS = 80


def score_from_wdl(w: Column, d: Column, l: Column) -> Column:  # noqa: E741
    """(w + d/2) / n; null when nothing was played or a count is null."""
    n = w + d + l
    return F.when(n > 0, (w + d * 0.5) / n)


def logistic_elo(score: Column) -> Column:
    s = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), score))
    return F.lit(-400.0) * F.log10(F.lit(1.0) / s - F.lit(1.0))


def expected_score(elo: float) -> float:
    return 1 / (1 + 10 ** (-elo / 400))


def filled(cells: list[Column]) -> list[Column]:
    return [F.when(c == 0, F.lit(EMPTY_CELL)).otherwise(c.cast("double")) for c in cells]


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def with_pentanomial_elo(df: DataFrame, cells: list[str], confidence: float = 0.95) -> DataFrame:
    """Adds score, score_ci_low, score_ci_high, elo, elo_ci_low, elo_ci_high; null where there are no pairs.

    The variance is that of pair scores over effective games; the Elo interval
    is centred on the estimate and as wide as the score interval is in Elo.
    Steps are columns of their own, so each is computed once.
    """
    between("confidence", confidence, 0, 1)
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    r = [F.col(f"__r{i}") for i in range(5)]
    df = df.withColumns({f"__r{i}": f for i, f in enumerate(filled([F.col(c) for c in cells]))} | {"__played": _sum([F.col(c) for c in cells]) > 0})
    df = df.withColumn("__games", _sum(r) * 2.0)
    df = df.withColumn("score", F.when(F.col("__played"), _sum([x * (i / 2) for i, x in enumerate(r)]) / F.col("__games")))
    off = [F.lit(i / 2) - F.col("score") * 2.0 for i in range(5)]
    df = df.withColumn("__error", F.lit(z) * F.sqrt(_sum([x * o * o for x, o in zip(r, off, strict=True)]) / F.col("__games")) / F.sqrt("__games"))
    df = df.withColumns(
        {
            "score_ci_low": F.col("score") - F.col("__error"), "score_ci_high": F.col("score") + F.col("__error"),
            "elo": F.when(F.col("__played"), logistic_elo(F.col("score")))
        }
    )
    df = df.withColumn("__half", F.when(F.col("__played"), (logistic_elo(F.col("score_ci_high")) - logistic_elo(F.col("score_ci_low"))) / 2.0))
    df = df.withColumns({"elo_ci_low": F.col("elo") - F.col("__half"), "elo_ci_high": F.col("elo") + F.col("__half")})
    return df.drop(*[f"__r{i}" for i in range(5)], "__played", "__games", "__error", "__half")


def wald_bounds(alpha: float, beta: float) -> tuple[float, float]:
    between("alpha", alpha, 0, 1), between("beta", beta, 0, 1)
    return math.log(beta / (1 - alpha)), math.log((1 - beta) / alpha)


def _constrained(p: list[Column], target: float) -> Column:
    """The multiplier x with sum p_i a_i / (1 + x a_i) = 0, a_i = i/4 - target, by halving its bracket."""
    a = [i / 4 - target for i in range(5)]
    left, right = -1 / max(a) + 1e-9, -1 / min(a) - 1e-9
    probs = F.array(*p)

    def halve(state: Column, _: Column) -> Column:
        mid = (state["l"] + state["r"]) / 2.0
        f = _sum([state["p"][i] * a[i] / (F.lit(1.0) + mid * a[i]) for i in range(5)])
        return F.struct(
            F.when(f > 0, mid).otherwise(state["l"]).alias("l"), F.when(f > 0, state["r"]).otherwise(mid).alias("r"), state["p"].alias("p")
        )

    start = F.struct(F.lit(left).alias("l"), F.lit(right).alias("r"), probs.alias("p"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["l"] + s["r"]) / 2.0)


def with_gsprt_llr(df: DataFrame, cells: list[str], elo0: float, elo1: float) -> DataFrame:
    """Adds ``llr``, the log-likelihood ratio of the pair counts under two strengths; null where there are no pairs."""
    if not finite("elo0", elo0) < finite("elo1", elo1):
        raise ValueError("elo0 must be less than elo1")
    targets = [expected_score(e) for e in (elo0, elo1)]
    df = df.withColumns({f"__r{i}": f for i, f in enumerate(filled([F.col(c) for c in cells]))})
    df = df.withColumn("__n", _sum([F.col(f"__r{i}") for i in range(5)]))
    p = [F.col(f"__r{i}") / F.col("__n") for i in range(5)]
    df = df.withColumns({f"__x{k}": _constrained(p, t) for k, t in enumerate(targets)})
    tilt = lambda i, k: F.log(F.lit(1.0) + F.col(f"__x{k}") * (i / 4 - targets[k]))
    llr = F.col("__n") * _sum([p[i] * (tilt(i, 0) - tilt(i, 1)) for i in range(5)])
    return df.withColumn("llr", F.when(_sum([F.col(c) for c in cells]) > 0, llr)).drop("__n", "__x0", "__x1", *[f"__r{i}" for i in range(5)])


def gsprt_state(llr: Column, games: Column, alpha: float, beta: float, max_games: int) -> Column:
    low, high = wald_bounds(alpha, beta)
    whole("max_games", max_games, 1)
    h0, h1, cap, going = TEST_STATES
    return F.when(llr < low, h0).when(llr > high, h1).when(games >= max_games, cap).when(llr.isNotNull(), going)


def verdict(state: Column, flagged: Column, strict: bool = False) -> Column:
    """Null while the test goes on, and where an accepted gain contradicts a flagged regression, which with ``strict`` is an error."""
    (h0, h1, cap, _), (gain, none, open_) = TEST_STATES, VERDICTS
    found = F.when((state == h1) & ~flagged, gain).when((state == h0) | ((state == cap) & flagged), none).when(state == cap, open_)
    return F.when((state == h1) & flagged, F.raise_error(F.lit("an accepted gain contradicts a flagged regression"))).otherwise(found) if strict else found


def wdl_problem(w: Column, d: Column, l: Column, cells: list[Column]) -> Column:  # noqa: E741
    """Why win/draw/loss counts and pair counts can't be of one run; null if they can."""
    p = cells
    net = 2 * p[4] + p[3] - p[1] - 2 * p[0]
    return F.when(w + d + l != 2 * _sum(p), "games").when(w - l != net, "net").when(~d.between(p[3] + p[1], p[3] + 2 * p[2] + p[1]), "draws")


def wdl_expectation(w: Column, d: Column, l: Column) -> Column:  # noqa: E741
    return score_from_wdl(w, d, l)


def collision_probability(pairs: Column, distinct: Column) -> Column:
    """Chance that drawing ``pairs`` of ``distinct`` items with replacement repeats one."""
    return F.when(distinct > 0, F.lit(1.0) - F.exp(-(pairs * (pairs - 1)) / (distinct * 2.0)))


def interval_side(low: Column, high: Column) -> Column:
    above, below, across = INTERVAL_SIDES
    return F.when(low > 0, above).when(high < 0, below).when(low.isNotNull() & high.isNotNull(), across)
