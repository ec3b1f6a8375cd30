"""Queries over the ledger index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import ids
from plyforge.functions.hashing import document_identity
from plyforge.operators import history, reconcile
from plyforge.operators.sampling import first_seen
from plyforge.plans.queries import query
from plyforge.session import table

#: Records sent again count once: the row of the smallest spelling.
_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY recorded_at, run_id, candidate_sha256, opponent_sha256) AS n FROM records) WHERE n = 1"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(
        table(spark, d, "records"), F.col("record_id"), ["recorded_at", "run_id", "candidate_sha256", "opponent_sha256"], "record_key"
    ).drop("record_key")


def _summary(by: str, where: str) -> str:
    part = f"PARTITION BY {by}"
    counts = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in history.VERDICTS)
    return f"""SELECT {by}, records, {', '.join(v.lower() for v in history.VERDICTS)}, regressions,
  CASE WHEN regressions > 0 AND regressions = records AND supported_progress = 0 AND inconclusive = 0 THEN 'REGRESSION_EVIDENCE_ONLY' WHEN regressions > 0 THEN 'MIXED_EVIDENCE_WITH_REGRESSION'
    WHEN supported_progress = records THEN 'SUPPORTED_PROGRESS_ONLY' WHEN progress_not_supported = records THEN 'PROGRESS_NOT_SUPPORTED_ONLY' WHEN inconclusive = records THEN 'INCONCLUSIVE_ONLY' ELSE 'MIXED_EVIDENCE' END AS evidence_state,
  CASE WHEN records < 2 THEN 'INSUFFICIENT_POINTS' WHEN up AND NOT down THEN 'NONDECREASING' WHEN down AND NOT up THEN 'NONINCREASING' WHEN NOT up AND NOT down THEN 'FLAT' ELSE 'MIXED' END AS direction,
  first_run, first_elo, latest_run, latest_elo, latest_elo - first_elo AS delta,
  CASE WHEN z_low > 0 THEN 'ENTIRELY_ABOVE_ZERO' WHEN z_high < 0 THEN 'ENTIRELY_BELOW_ZERO' WHEN z_low IS NOT NULL AND z_high IS NOT NULL THEN 'CROSSES_ZERO' END AS latest_interval
FROM (SELECT {by}, count(*) AS records, {counts}, CAST(coalesce(sum(regression_flagged), 0) AS BIGINT) AS regressions, coalesce(bool_or(step > 1e-12), false) AS up, coalesce(bool_or(step < -1e-12), false) AS down,
    max(run_id) FILTER (WHERE a = 1) AS first_run, max(elo_value) FILTER (WHERE a = 1) AS first_elo, max(run_id) FILTER (WHERE z = 1) AS latest_run, max(elo_value) FILTER (WHERE z = 1) AS latest_elo,
    max(elo_ci_low) FILTER (WHERE z = 1) AS z_low, max(elo_ci_high) FILTER (WHERE z = 1) AS z_high
  FROM (SELECT *, elo_value - lag(elo_value) OVER ({part} ORDER BY recorded_at, run_id) AS step, row_number() OVER ({part} ORDER BY recorded_at, run_id, record_id) AS a, row_number() OVER ({part} ORDER BY recorded_at DESC, run_id DESC, record_id DESC) AS z
    FROM ({_ONCE}) WHERE {where}) GROUP BY {by})"""


@query(_summary("opponent_id", "true"))
def series_by_opponent(spark: SparkSession, d: str) -> DataFrame:
    return history.summarize_series(_records(spark, d), ["opponent_id"])


@query(f"""SELECT s.*, u.unassigned, u.arms, CASE WHEN u.arms < 2 THEN 'INSUFFICIENT_ARMS' ELSE 'DESCRIPTIVE_ONLY' END AS comparison
FROM ({_summary('experiment_id, arm_id', 'experiment_id IS NOT NULL AND arm_id IS NOT NULL')}) s
JOIN (SELECT experiment_id, count(*) FILTER (WHERE arm_id IS NULL) AS unassigned, count(DISTINCT arm_id) AS arms FROM ({_ONCE}) WHERE experiment_id IS NOT NULL GROUP BY 1) u ON s.experiment_id = u.experiment_id""")
def arms_compared(spark: SparkSession, d: str) -> DataFrame:
    return history.compare_arms(_records(spark, d))


@query(f"SELECT record_id, run_id, opponent_id, arm_id, elo_value FROM ({_ONCE}) WHERE experiment_id = 'exp_giuoco_a' AND arm_id = 'm0'")
def records_of_arm(spark: SparkSession, d: str) -> DataFrame:
    return history.matching(
        _records(spark, d), experiment_id="exp_giuoco_a", arm_id="m0", opponent_id=None
    ).select("record_id", "run_id", "opponent_id", "arm_id", "elo_value")


@query("""SELECT 'record_id' AS what, record_id AS value, count(*) AS times FROM records WHERE record_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'run_id', run_id, count(*) FROM records WHERE run_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1""")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated(table(spark, d, "records"), ["record_id", "run_id"])


#: Columns of the flat index, where each lies in the document, and its kind.
_INDEX = {
    **{c: (f"$.{c}", "VARCHAR") for c in ("record_id", "run_id", "recorded_at")},
    **{c: (f"$.analysis_result.{c}", "VARCHAR") for c in ("analyzed_at", "analyzer_version")},
    **{c: (f"$.{c}", "VARCHAR") for c in ("config_identity_sha256", "candidate_sha256", "opponent_sha256", "opponent_id", "experiment_id", "arm_id")},
    **{c: (f"$.analysis_result.recomputed_wdl.{c}", "BIGINT") for c in ("wins", "losses", "draws")},
    "games_played": ("$.analysis_result.sprt_result.games_played", "BIGINT"),
    "sprt_outcome": ("$.analysis_result.sprt_result.outcome", "VARCHAR"),
    "verdict": ("$.analysis_result.verdict", "VARCHAR"),
    "elo_value": ("$.analysis_result.elo_estimate.value", "DOUBLE"),
    "elo_ci_low": ("$.analysis_result.elo_estimate.ci_low", "DOUBLE"),
    "elo_ci_high": ("$.analysis_result.elo_estimate.ci_high", "DOUBLE"),
    **{f"regression_{c}": (f"$.analysis_result.regression_subtest.{c}", "BOOLEAN::INTEGER") for c in ("tested", "flagged")},
}


@query("SELECT " + ", ".join(f"(record_json ->> '{path}')::{kind} AS {c}" for c, (path, kind) in _INDEX.items()) + ", record_json FROM records")
def ledger_flattened(spark: SparkSession, d: str) -> DataFrame:
    return history.flatten(table(spark, d, "records"), "record_json")


@query("SELECT record_id, run_id, sha256(record_json || chr(10)) AS identity FROM records")
def canonical_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities of the ledger's documents, which are canonical as they stand."""
    return table(spark, d, "records").select("record_id", "run_id", document_identity(F.col("record_json")).alias("identity"))


_RUN = "regexp_extract(run_id, '^([A-Za-z0-9_-]+)__run([0-9]{{3,}})$', {})"


@query(f"""SELECT DISTINCT run_id, key, attempt, key || '__run' || lpad(CAST(attempt AS VARCHAR), greatest(3, length(CAST(attempt AS VARCHAR)))::INTEGER, '0') AS spelled, 'AUDIT_V' || lpad(CAST(attempt AS VARCHAR), greatest(4, length(CAST(attempt AS VARCHAR)))::INTEGER, '0') AS audit
FROM (SELECT run_id, {_RUN.format(1)} AS key, TRY_CAST({_RUN.format(2)} AS BIGINT) AS attempt FROM records) WHERE attempt >= 1""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    """Runs taken apart and put together again, and audits of the same numbers."""
    r = table(spark, d, "records").select("run_id", ids.run_parts(F.col("run_id")).alias("p")).filter("p is not null").distinct()
    return r.select(
        "run_id", "p.key", "p.attempt", ids.run_id(F.col("p.key"), F.col("p.attempt")).alias("spelled"),
        ids.audit_id(F.col("p.attempt")).alias("audit")
    )


@query("SELECT line_id, TRY_CAST(nullif(trim(split_part(line, ',', 1)), '') AS BIGINT) AS number FROM game_lines WHERE regexp_full_match(trim(split_part(line, ',', 1)), '[+-]?[0-9]*')")
def tolerant_numbers(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the first comma of a line, as a number if it is one."""
    first = F.split_part(F.col("line"), F.lit(","), F.lit(1))
    g = table(spark, d, "game_lines").filter(F.trim(first).rlike(r"\A[+-]?[0-9]*\z"))
    return g.select("line_id", ids.int_or_null(first).alias("number"))


@query("""SELECT user_id, event_id, event_type, previous FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE NOT CASE WHEN n = 1 THEN event_type IN ('view', 'click') ELSE coalesce((previous = 'view' AND event_type IN ('view', 'click')) OR (previous = 'click' AND event_type IN ('view', 'purchase')), false) END""")
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    bad = history.bad_transitions(
        e, ["user_id"], "event_type", ["ts", "event_id"], ["view", "click"], {"view": ["view", "click"], "click": ["view", "purchase"]}
    )
    return bad.select("user_id", "event_id", "event_type", "previous")


_PAIRED = ("run_id", "wins", "losses", "draws", "verdict", "elo_value")


@query(f"""SELECT record_id, list_filter([{', '.join(f"CASE WHEN r.{c} IS NOT DISTINCT FROM j.{c} THEN '{c}' END" for c in _PAIRED)}], lambda x: x IS NOT NULL) AS verified,
  list_filter([{', '.join(f"CASE WHEN r.{c} IS DISTINCT FROM j.{c} THEN '{c}' END" for c in _PAIRED)}], lambda x: x IS NOT NULL) AS mismatched
FROM (SELECT *, CAST(record_json ->> '$.analysis_result.recomputed_wdl.losses' AS BIGINT) AS jl FROM ({_ONCE})) r,
LATERAL (SELECT record_json ->> '$.run_id' AS run_id, CAST(record_json ->> '$.analysis_result.recomputed_wdl.wins' AS BIGINT) AS wins, jl AS losses, CAST(record_json ->> '$.analysis_result.recomputed_wdl.draws' AS BIGINT) AS draws,
  record_json ->> '$.analysis_result.verdict' AS verdict, CAST(record_json ->> '$.analysis_result.elo_estimate.value' AS DOUBLE) AS elo_value) j""")
def index_against_ledger(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    stored = r.select("record_id", *_PAIRED)
    ledger = history.flatten(r, "record_json").select("record_id", *_PAIRED)
    return reconcile.field_mismatches(stored, ledger, "record_id", {c: c for c in _PAIRED})
