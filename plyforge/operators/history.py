"""Append-only result histories: filters, series, arms, transitions, ordered checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.stats import interval_side
from plyforge.functions.vocabulary import DIRECTIONS, VERDICTS
from plyforge.operators.skew import HOT_ROWS, numbered, with_previous

#: Changes below this don't count as movement.
TOLERANCE = 1e-12
#: What the ledger line holds of a result.
RESULT = (
    "struct<recomputed_wdl:struct<wins:bigint,losses:bigint,draws:bigint,decisive_games:bigint,score:double>,"
    "sprt_result:struct<elo0:double,elo1:double,alpha:double,beta:double,max_games:bigint,games_played:bigint,outcome:string>,"
    "elo_estimate:struct<value:double,ci_low:double,ci_high:double>,verdict:string,"
    "regression_subtest:struct<tested:boolean,flagged:boolean,ci_low:double,ci_high:double>,analyzed_at:string,analyzer_version:string,run_id:string>"
)
LEDGER = "schema_version string, source_state string, recorded_at string, run_id string, config_identity_sha256 string, candidate_sha256 string, opponent_sha256 string, opponent_id string, experiment_id string, arm_id string, record_id string, analysis_result " + RESULT


def flatten(lines: DataFrame, line: str = "line") -> DataFrame:
    """Ledger lines to the flat index: 22 columns and the line itself as ``record_json``. Unreadable lines give null fields."""
    r = lines.select(F.from_json(F.col(line), LEDGER).alias("r"), F.col(line).alias("record_json"))
    a = "r.analysis_result."
    flag = lambda c: F.col(a + c).cast("int")
    return r.select(
        *[F.col(f"r.{c}").alias(c) for c in ("record_id", "run_id", "recorded_at")],
        *[F.col(a + c).alias(c) for c in ("analyzed_at", "analyzer_version")],
        *[F.col(f"r.{c}").alias(c) for c in ("config_identity_sha256", "candidate_sha256", "opponent_sha256", "opponent_id", "experiment_id", "arm_id")],
        *[F.col(f"{a}recomputed_wdl.{c}").alias(c) for c in ("wins", "losses", "draws")],
        F.col(a + "sprt_result.games_played").alias("games_played"),
        F.col(a + "sprt_result.outcome").alias("sprt_outcome"),
        F.col(a + "verdict").alias("verdict"),
        F.col(a + "elo_estimate.value").alias("elo_value"),
        F.col(a + "elo_estimate.ci_low").alias("elo_ci_low"),
        F.col(a + "elo_estimate.ci_high").alias("elo_ci_high"),
        flag("regression_subtest.tested").alias("regression_tested"),
        flag("regression_subtest.flagged").alias("regression_flagged"),
        "record_json",
    )


def matching(records: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on each given column; None puts no condition."""
    for column, value in wanted.items():
        if value is not None:
            records = records.filter(F.col(column) == value)
    return records


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(``what``, ``value``, ``times``) of every value that occurs more than once in one of the key columns; nulls don't."""
    each = df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    ).select("x.*")
    return each.filter(F.col("value").isNotNull()).groupBy("what", "value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def index_agrees(records: DataFrame, metadata: DataFrame, expected_version: str) -> DataFrame:
    """One row telling whether an index holds as many records as its stored ``metadata`` (key, value) says, under the version expected.

    Missing metadata agree with nothing.
    """
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    said = metadata.agg(value("record_count").try_cast("bigint").alias("said"), value("ledger_schema_version").alias("version")).first()
    n = F.count(F.lit(1))
    agree = F.coalesce(n == F.lit(said.said).cast("bigint"), F.lit(False))
    return records.agg(n.alias("records"), agree.alias("count_agrees")).withColumn("version_agrees", F.lit(said.version == expected_version))


def _evidence_state() -> Column:
    n, flagged = F.col("records"), F.col("regressions")
    s, u, i = (F.col(v.lower()) for v in VERDICTS)
    return (
        F.when(n == 0, "NO_DATA")
        .when((flagged > 0) & (flagged == n) & (s == 0) & (i == 0), "REGRESSION_EVIDENCE_ONLY")
        .when(flagged > 0, "MIXED_EVIDENCE_WITH_REGRESSION")
        .when(s == n, "SUPPORTED_PROGRESS_ONLY")
        .when(u == n, "PROGRESS_NOT_SUPPORTED_ONLY")
        .when(i == n, "INCONCLUSIVE_ONLY")
        .otherwise("MIXED_EVIDENCE")
    )


def with_steps(
    records: DataFrame, by: list[str], value: str = "elo_value", order: tuple[str, ...] = ("recorded_at", "run_id", "record_id"),
    hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``step``: the value less that of the record before, in the order of the columns as text."""
    return with_previous(
        records, by, [*order], {value: "__before"}, hot_rows=hot_rows
    ).withColumn("step", F.col(value) - F.col("__before")).drop("__before")


def direction(up: Column, down: Column, n: Column) -> Column:
    few, rising, falling, flat, mixed = DIRECTIONS
    return F.when(n < 2, few).when(up & ~down, rising).when(down & ~up, falling).when(~up & ~down, flat).otherwise(mixed)


def summarize_series(records: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per series: verdict counts, evidence state, direction, first and latest record, the change between them.

    Time is ordered as text, then by run, as records spell it. Movement needs
    the record before (:func:`with_previous`); everything else is one
    aggregation, without a list of records.
    """
    r = with_steps(records, by, hot_rows=hot_rows)
    at = F.struct("recorded_at", "run_id", "record_id")
    point = F.struct("run_id", "recorded_at", "elo_value", "elo_ci_low", "elo_ci_high", "verdict")
    s = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS],
        F.coalesce(F.sum("regression_flagged"), F.lit(0)).alias("regressions"),
        F.coalesce(F.bool_or(F.col("step") > TOLERANCE), F.lit(False)).alias("__up"),
        F.coalesce(F.bool_or(F.col("step") < -TOLERANCE), F.lit(False)).alias("__down"),
        F.min_by(point, at).alias("__a"),
        F.max_by(point, at).alias("__z"),
    )
    s = s.withColumns({"evidence_state": _evidence_state(), "direction": direction(F.col("__up"), F.col("__down"), F.col("records"))})
    return s.select(
        *by, "records", *[v.lower() for v in VERDICTS], "regressions", "evidence_state", "direction",
        F.col("__a.run_id").alias("first_run"), F.col("__a.elo_value").alias("first_elo"), F.col("__z.run_id").alias("latest_run"), F.col("__z.elo_value").alias("latest_elo"),
        (F.col("__z.elo_value") - F.col("__a.elo_value")).alias("delta"), interval_side(
            F.col("__z.elo_ci_low"), F.col("__z.elo_ci_high")
        ).alias("latest_interval"),
    )


def series_points(records: DataFrame, by: list[str], order: tuple[str, ...] = ("recorded_at", "run_id", "record_id")) -> DataFrame:
    """(``by``, ``place`` from 1, run, time, estimate, interval, verdict) of every record of a series, in its order.

    Rows instead of a list, so that a series may have any number. Places come
    from one numbering of all rows, less where a series begins.
    """
    point = ["run_id", "recorded_at", "elo_value", "elo_ci_low", "elo_ci_high", "verdict"]
    n = numbered(records.select(*by, *dict.fromkeys([*point, *order])), [*by, *order], "__no")
    first = n.groupBy(*by).agg(F.min("__no").alias("__first"))
    same = [F.col(f"n.{b}").eqNullSafe(F.col(f"f.{b}")) for b in by]
    j = n.alias("n").join(first.alias("f"), same)
    return j.select(
        *[F.col(f"n.{b}").alias(b) for b in by], (F.col("__no") - F.col("__first") + 1).alias("place"),
        *[F.col(f"n.{c}").alias(c) for c in point]
    )


def compare_arms(records: DataFrame) -> DataFrame:
    """The series summary of every arm of every experiment in one aggregation, without ranking them.

    ``unassigned`` counts the experiment's records without arm; ``arms`` its arms.
    """
    known = records.filter("experiment_id is not null")
    arms = summarize_series(known.filter("arm_id is not null"), ["experiment_id", "arm_id"])
    per = known.groupBy("experiment_id").agg(F.count_if(F.col("arm_id").isNull()).alias("unassigned"), F.countDistinct("arm_id").alias("arms"))
    return arms.join(per, "experiment_id").withColumn("comparison", F.when(F.col("arms") < 2, "INSUFFICIENT_ARMS").otherwise("DESCRIPTIVE_ONLY"))


def bad_transitions(
    events: DataFrame, key: list[str], state: str, order: list[str], first: list[str], allowed: dict[str, list[str]],
    hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events whose state can't begin a history or can't follow the state before; adds ``previous``.

    A null state breaks the rule wherever it stands.
    """
    e = with_previous(events, key, order, {state: "previous"}, "__first", hot_rows)
    may = F.lit(False)
    for before, after in allowed.items():
        may = may | ((F.col("previous") == before) & F.col(state).isin(*after))
    fine = F.when(F.col("__first"), F.col(state).isin(*first)).otherwise(may)
    return e.filter(~F.coalesce(fine, F.lit(False))).drop("__first")


def sequence_gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Per group whether the numbers are exactly 1..n, each once, from aggregates alone."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.countDistinct(number).alias("__k"), F.min(number).alias("__lo"), F.max(number).alias("__hi")
    )
    n, k, hi = F.col("__n"), F.col("__k"), F.col("__hi")
    sequential = (n == k) & (F.col("__lo") == 1) & (hi == n)
    return g.select(
        *by, n.alias("rows_seen"), (n - k).alias("repeats"), (hi - k).alias("missing"),
        F.coalesce(sequential, F.lit(False)).alias("sequential")
    )


def sequence_in_order(df: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """(``by``, ``rows_seen``, ``in_order``): whether the numbers are 1, 2, ... n as the rows stand in ``order``."""
    n = numbered(df.select(*by, *dict.fromkeys([*order, number])), [*by, *order], "__no")
    g = n.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_seen"), F.min("__no").alias("__first"), F.min(F.col("__no") - F.col(number)).alias("__lo"),
        F.max(F.col("__no") - F.col(number)).alias("__hi"), F.count(number).alias("__k")
    )
    kept = (F.col("__k") == F.col("rows_seen")) & (F.col("__lo") == F.col("__hi")) & (F.col("__lo") == F.col("__first") - 1)
    return g.select(*by, "rows_seen", F.coalesce(kept, F.lit(False)).alias("in_order"))


def out_of_order(df: DataFrame, by: list[str], order: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose value is less than that of the row before them."""
    return with_previous(df, by, order, {value: "before"}, hot_rows=hot_rows).filter(F.col(value) < F.col("before"))
