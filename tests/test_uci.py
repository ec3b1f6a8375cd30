import random

import pytest
from pyspark.sql import functions as F

from plyforge.functions import uci
from plyforge.operators import snapshots
from plyforge.sources import files

FULL = "info depth 12 seldepth 20 multipv 2 score cp -15 lowerbound wdl 100 800 100 nodes 5000 nps 90 time 7 pv e2e4 e7e5"


def one(spark, f, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.x for r in df.select("i", f(F.col("line")).alias("x")).orderBy("i").collect()]


def test_mining_info(spark):
    a, b, c = one(spark, uci.mining_info, FULL, "  info score mate 3 multipv 0 pv a2a4", "info depth 1 score cp 5 pv")
    assert (a.rank, a.score_type, a.score_value, a.bound, a.wdl_w, a.wdl_d, a.depth, a.time_ms, a.move, a.pv) == (2, "cp", -15, "lowerbound", 100, 800, 12, 7, "e2e4", "e2e4 e7e5")
    assert (b.rank, b.score_type, b.depth, b.bound) == (1, "mate", None, "exact")
    assert c.move is None and c.pv == ""
    bad = ["info string score cp 1", "info depth 3 pv e2e4", "info score cp x pv e2e4", "info score cp 1", "info score eval 1 pv e2e4", "info score cp 1 wdl 1 2 pv e2e4", "bestmove e2e4", "", None, "score cp 1 pv"]
    assert one(spark, uci.mining_info, *bad) == [None] * len(bad)


def test_rescore_info(spark):
    a, b = one(spark, uci.rescore_info, FULL, "info score cp 007 wdl 1 2")
    assert (a.sf_score, a.sf_bound, a.sf_wdl_l, a.sf_pv, a.sf_nodes) == ("-15", "lowerbound", "100", "e2e4 e7e5", "5000")
    assert (b.sf_score, b.sf_wdl_w, b.sf_pv, b.sf_depth) == ("007", "", "", "")
    bad = ["  info score cp 1", "info string x score cp 1", "info depth 5", "info score cp", "info score cp 1 depth", "infos score cp 1", None]
    assert one(spark, uci.rescore_info, *bad) == [None] * len(bad)


def test_long_lines_are_read_to_the_end(spark):
    pv = " ".join(["e2e4"] * 12_000)
    (a,) = one(spark, uci.mining_info, f"info score cp 1 pv {pv} upperbound")
    (b,) = one(spark, uci.rescore_info, f"info score cp 1 pv {pv} upperbound")
    assert (a.bound, a.pv) == (b.sf_bound, b.sf_pv) == ("upperbound", f"{pv} upperbound")


def test_best_move(spark):
    got = one(spark, uci.best_move, "bestmove e2e4 ponder e7e5", "bestmove (none)", "bestmove 0000 ponder (none)", "bestmove", "bestmove a b c", "info")
    assert [(x.bestmove, x.ponder) if x else None for x in got] == [("e2e4", "e7e5"), (None, None), (None, None), (None, None), ("a", None), None]


def test_static_and_display(spark):
    lines = [(1, 1, "NNUE evaluation -12 (side to move, internal units)"), (1, 2, "NNUE evaluation +34 (side to move, internal units)"), (1, 3, "Fen: a b c"), (1, 4, " Fen: d"), (2, 1, "NNUE evaluation 3 (side to move, internal units)"), (2, 2, "Final evaluation: none (in check)"), (3, 1, "NNUE evaluation 3 (white side)")]
    df = spark.createDataFrame(lines, "job int, ln int, line string")
    assert {r.job: (r.status, r.score_raw_stm) for r in files.static_results(df, ["job"]).collect()} == {1: ("ok", 34), 2: ("in_check", None), 3: ("parse_error", None)}
    assert {r.job: r.fen for r in files.displayed_positions(df, ["job"]).collect()} == {1: "a b c", 2: None, 3: None}


def test_root_score(spark):
    df = spark.createDataFrame([(5, "w", "w"), (5, "b", "w"), (None, "b", "w"), (5, None, "w")], "s int, a string, b string")
    assert [r[0] for r in df.select(uci.root_score(F.col("s"), F.col("a"), F.col("b"))).collect()] == [5, -5, None, None]


def machine(lines, n):
    """The coherent result by reading line after line: rank to line number."""
    rounds, snap, depth, last, exact = {}, None, None, {}, {}
    for ln, rank, d, bound in lines:
        last[rank] = ln
        if bound == "exact":
            exact[rank] = ln
        if n == 1:
            if rank == 1 and bound == "exact":
                snap = {1: ln}
            continue
        if rank == 1:
            depth, rounds = d, {}
        if bound == "exact" and (rank == 1 or (depth is not None and d == depth)):
            rounds[rank] = ln
        if set(rounds) == set(range(1, n + 1)) and depth is not None:
            snap = dict(rounds)
    return snap or {r: exact.get(r, ln) for r, ln in last.items()}


@pytest.mark.parametrize("seed", range(3))
def test_coherent_snapshot_equals_a_state_machine(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for job in range(250):
        n = rng.choice([1, 2, 3])
        lines = []
        for ln in range(rng.randrange(1, 14)):
            rank = rng.choice([1, 2, 3, 1 + ln % n, 1 + ln % n])
            lines.append((ln, rank, rng.choice([5, 5, 5, 6, None]), rng.choice(["exact", "exact", "exact", "lowerbound"])))
        rows += [(job, *x, n) for x in lines]
        want[job] = machine(lines, n)
    df = spark.createDataFrame(rows, "job int, ln int, rank bigint, depth bigint, bound string, expected int").repartition(3)
    got = {}
    for r in snapshots.coherent_snapshot(df, ["job"]).collect():
        got.setdefault(r.job, {})[r.rank] = r.ln
    assert got == want


def test_picked_result(spark):
    infos = spark.createDataFrame([(1, 1, "exact", "e2e4 e7e5"), (1, 2, "lowerbound", "d2d4"), (2, 1, "exact", "")], "job int, ln int, sf_bound string, sf_pv string")
    ends = spark.createDataFrame([(1, 9, "d2d4", None), (2, 9, "g1f3", "g8f6"), (3, 1, None, None)], "job int, ln int, bestmove string, ponder string")
    got = {r.job: (r.sf_bestmove, r.sf_ponder, r.sf_bound) for r in snapshots.picked_result(infos, ends, ["job"]).collect()}
    assert got == {1: ("e2e4", "e7e5", "exact"), 2: ("g1f3", "g8f6", "exact"), 3: ("", "", None)}
