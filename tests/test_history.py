import json

from plyforge.operators import history

S = "run_id string, recorded_at string, record_id string, opponent_id string, experiment_id string, arm_id string, verdict string, regression_flagged int, elo_value double, elo_ci_low double, elo_ci_high double"


def record(i, elo, verdict="INCONCLUSIVE", at=None, flagged=0, arm=None, opponent="o", experiment="e"):
    return (f"run{i:03d}", at or f"2031-01-{i:02d}T00:00:00Z", f"id{i}", opponent, experiment, arm, verdict, flagged, float(elo), elo - 1.0, elo + 1.0)


def summary(spark, rows):
    return history.summarize_series(spark.createDataFrame(rows, S).repartition(3), ["opponent_id"]).first()


def test_directions(spark):
    for elos, want in (([1], "INSUFFICIENT_POINTS"), ([1, 2, 2], "NONDECREASING"), ([3, 2, 1], "NONINCREASING"), ([2, 2], "FLAT"), ([1, 3, 2], "MIXED"), ([1, 1 + 1e-13], "FLAT")):
        assert summary(spark, [record(i + 1, e) for i, e in enumerate(elos)]).direction == want


def test_evidence(spark):
    a, b, c = history.VERDICTS
    cases = [([(a, 0)], "SUPPORTED_PROGRESS_ONLY"), ([(b, 0)] * 2, "PROGRESS_NOT_SUPPORTED_ONLY"), ([(c, 0)], "INCONCLUSIVE_ONLY"), ([(a, 0), (c, 0)], "MIXED_EVIDENCE"), ([(b, 1), (b, 1)], "REGRESSION_EVIDENCE_ONLY"), ([(b, 1), (c, 0)], "MIXED_EVIDENCE_WITH_REGRESSION"), ([(a, 1)], "MIXED_EVIDENCE_WITH_REGRESSION")]
    for verdicts, want in cases:
        assert summary(spark, [record(i + 1, 0, v, flagged=f) for i, (v, f) in enumerate(verdicts)]).evidence_state == want


def test_ends_are_ordered_as_text(spark):
    r = summary(spark, [record(1, 5, at="2031-01-01T00:00:00Z"), record(2, 7, at="2031-01-01T00:00:00.5Z"), record(3, 9, at="2031-01-01T00:00:00Z")])
    assert (r.first_run, r.latest_run, r.delta, r.latest_interval) == ("run002", "run003", 2.0, "ENTIRELY_ABOVE_ZERO")


def test_arms(spark):
    rows = [record(1, 1, arm="a"), record(2, 2, arm="b"), record(3, 2, arm=None), record(4, 1, arm="a", experiment="f"), record(5, 1, experiment=None, arm="a")]
    got = {(r.experiment_id, r.arm_id): (r.records, r.arms, r.unassigned, r.comparison) for r in history.compare_arms(spark.createDataFrame(rows, S)).collect()}
    assert got == {("e", "a"): (1, 2, 1, "DESCRIPTIVE_ONLY"), ("e", "b"): (1, 2, 1, "DESCRIPTIVE_ONLY"), ("f", "a"): (1, 1, 0, "INSUFFICIENT_ARMS")}


def test_filters(spark):
    df = spark.createDataFrame([record(1, 1, arm="a"), record(2, 1, arm="b")], S)
    assert history.matching(df, arm_id="a", opponent_id=None).count() == 1
    assert history.matching(df, arm_id="a", opponent_id="zzz").count() == 0


def test_flatten(spark):
    doc = {"run_id": "r", "record_id": "i", "recorded_at": "t", "analysis_result": {"verdict": "INCONCLUSIVE", "recomputed_wdl": {"wins": 3, "losses": 1, "draws": 2}, "sprt_result": {"games_played": 6, "outcome": "CAP_REACHED"}, "elo_estimate": {"value": 1.5, "ci_low": -1, "ci_high": 4}, "regression_subtest": {"tested": True, "flagged": False}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("not json",), (None,)], "line string")
    a, b, c = history.flatten(df).collect()
    assert (a.run_id, a.wins, a.games_played, a.sprt_outcome, a.elo_value, a.elo_ci_low, a.regression_tested, a.regression_flagged) == ("r", 3, 6, "CAP_REACHED", 1.5, -1.0, 1, 0)
    assert len(a) == 23 and b.run_id is None and b.record_json == "not json" and c.record_json is None


def test_transitions(spark):
    rows = [("a", 1, "R"), ("a", 2, "A"), ("a", 3, "D"), ("b", 1, "A"), ("c", 1, "R"), ("c", 2, "R"), ("d", 1, None), ("e", 1, "Q"), ("e", 2, "A")]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    bad = history.bad_transitions(df, ["k"], "s", ["n"], ["R", "Q"], {"R": ["A", "Q"], "A": ["D"]})
    assert sorted((r.k, r.n, r.previous) for r in bad.collect()) == [("b", 1, None), ("c", 2, "R"), ("d", 1, None), ("e", 2, "Q")]


def test_sequences_and_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", None)], "k string, n int")
    got = {r.k: (r.sequential, r.repeats, r.missing) for r in history.sequence_gaps(df, ["k"], "n").collect()}
    assert got["a"] == (True, 0, 0) and got["b"] == (False, 0, 1) and got["c"] == (False, 1, 0) and got["d"][0] is False
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "n int, p string").selectExpr("'x' AS g", "*")
    assert [r.n for r in history.out_of_order(rows, ["g"], ["n"], "p").collect()] == [2]


def test_sequences_in_list_order(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("b", 2, 1), ("c", 1, 2), ("c", 2, 3), ("d", 1, None), ("e", 5, 1)], "k string, at int, n int").repartition(3)
    got = {r.k: r.in_order for r in history.sequence_in_order(df, ["k"], ["at"], "n").collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}


def test_points_of_series(spark):
    rows = [record(3, 5), record(1, 7), record(2, 1, opponent=None), record(4, 2)]
    got = [(r.opponent_id, r.place, r.run_id) for r in history.series_points(spark.createDataFrame(rows, S).repartition(3), ["opponent_id"]).collect()]
    assert sorted(got, key=str) == sorted([("o", 1, "run001"), ("o", 2, "run003"), ("o", 3, "run004"), (None, 1, "run002")], key=str)


def test_index_metadata(spark):
    df = spark.range(3)
    meta = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert tuple(history.index_agrees(df, meta(("record_count", "3"), ("ledger_schema_version", "v1")), "v1").first()) == (3, True, True)
    assert tuple(history.index_agrees(df, meta(("record_count", "4"), ("ledger_schema_version", "v2")), "v1").first()) == (3, False, False)
    assert tuple(history.index_agrees(df, meta(), "v1").first()) == (3, False, False)


def test_repeats(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), (None, "z")], "run_id string, record_id string")
    assert sorted(map(tuple, history.repeated(df, ["run_id", "record_id"]).collect())) == [("record_id", "z", 2), ("run_id", "a", 2)]
