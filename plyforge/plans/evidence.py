"""Queries that hold expected against observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.boards import sha_label
from plyforge.functions.hashing import sha256_text
from plyforge.operators import reconcile
from plyforge.plans.history import _ONCE, _records
from plyforge.plans.positions import sql_label
from plyforge.plans.queries import query
from plyforge.session import table


def _sql_sha(c: str) -> str:
    return f"nullif(regexp_replace({sql_label(c)}, '^sha-?256[:=]\\s*', ''), '')"


@query(f"""SELECT path, CASE WHEN expected_sha256 IS NULL THEN 'extra' ELSE 'sha256' END AS status, expected_sha256, actual_sha256
FROM (SELECT CAST(position_id AS VARCHAR) AS path, lower(fen_sha256) AS expected_sha256, sha256(fen) AS actual_sha256 FROM positions) WHERE expected_sha256 IS DISTINCT FROM actual_sha256""")
def stated_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes that positions state, as they are written, against hashes of their texts."""
    p = table(spark, d, "positions")
    path = F.col("position_id").cast("string").alias("path")
    none = F.lit(None).cast("bigint").alias("size_bytes")
    expected = p.filter("fen_sha256 is not null").select(path, F.lower("fen_sha256").alias("sha256"), none)
    return reconcile.file_diff(expected, p.select(path, sha256_text(F.col("fen")).alias("sha256"), none))


@query(f"""SELECT DISTINCT network_sha256 FROM (SELECT {_sql_sha('candidate_sha256')} AS network_sha256 FROM records UNION ALL SELECT {_sql_sha('opponent_sha256')} FROM records)
WHERE network_sha256 IS NOT NULL AND network_sha256 NOT IN (SELECT {_sql_sha('sha256')} FROM networks WHERE {_sql_sha('sha256')} IS NOT NULL)""")
def unknown_networks(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "records"), table(spark, d, "networks")
    met = r.select(F.explode(F.array(sha_label(F.col("candidate_sha256")), sha_label(F.col("opponent_sha256")))).alias("network_sha256")).distinct()
    return reconcile.unresolved(met, n.select(sha_label(F.col("sha256")).alias("path")), "network_sha256")


@query(f"""WITH l AS (SELECT DISTINCT {_sql_sha('sha256')} AS path FROM networks WHERE {_sql_sha('sha256')} IS NOT NULL), p AS (SELECT DISTINCT {_sql_sha('opponent_sha256')} AS path FROM records), q AS (SELECT DISTINCT {_sql_sha('candidate_sha256')} AS path FROM records)
SELECT 'listed_but_absent' AS problem, path FROM l WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT 'present_but_unlisted', path FROM p WHERE path NOT IN (SELECT path FROM l)
UNION ALL SELECT 'required_but_unlisted', path FROM q WHERE path NOT IN (SELECT path FROM l)""")
def transport_check(spark: SparkSession, d: str) -> DataFrame:
    """The list of networks against those met as opponents; candidates are required."""
    sha = lambda df, c: df.select(sha_label(F.col(c)).alias("path")).filter("path is not null").distinct().withColumn("sha256", F.col("path"))
    r = table(spark, d, "records")
    return reconcile.transport_problems(sha(table(spark, d, "networks"), "sha256"), sha(r, "opponent_sha256"), sha(r, "candidate_sha256"))


@query(f"""WITH e AS ({_ONCE}), a AS (SELECT DISTINCT {_sql_sha('sha256')} AS artifact_sha256 FROM networks),
c AS (SELECT artifact_sha256, CASE sprt_outcome WHEN 'H1_ACCEPTED' THEN 'stronger' WHEN 'H0_ACCEPTED' THEN 'not_stronger' END AS claim FROM a LEFT JOIN e ON {_sql_sha('e.candidate_sha256')} = artifact_sha256 AND regression_flagged IS NOT DISTINCT FROM 0),
g AS (SELECT artifact_sha256, list_sort(list(DISTINCT claim) FILTER (WHERE claim IS NOT NULL)) AS l FROM c GROUP BY 1)
SELECT artifact_sha256, array_to_string(list_filter(coalesce(l, []), lambda c: c <> 'not_stronger' OR list_contains(l, 'stronger')), ',') AS claims FROM g""")
def network_claims(spark: SparkSession, d: str) -> DataFrame:
    """What unflagged results establish about each listed network; one claim counts only beside the other."""
    e = _records(spark, d).select(
        F.col("sprt_outcome").alias("kind"), sha_label(F.col("candidate_sha256")).alias("subject_sha256"),
        F.col("regression_flagged").alias("result"), F.lit(0).alias("expected")
    )
    artifacts = table(spark, d, "networks").select(sha_label(F.col("sha256")).alias("sha256"))
    claims = spark.createDataFrame([("H1_ACCEPTED", "stronger"), ("H0_ACCEPTED", "not_stronger")], "kind string, claim string")
    out = reconcile.bound_claims(e, artifacts, claims, withheld="not_stronger", needs="stronger")
    return out.withColumn("claims", F.array_join("claims", ","))


@query(f"""SELECT experiment_id, count(*) AS distinct_values, string_agg(value || '=' || members, ';' ORDER BY value) AS holders FROM (
  SELECT experiment_id, coalesce(analyzer_version, '') AS value, array_to_string(list_sort(list(DISTINCT arm_id) FILTER (WHERE arm_id IS NOT NULL)), ',') AS members FROM ({_ONCE}) WHERE experiment_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def shared_analyzers(spark: SparkSession, d: str) -> DataFrame:
    """Whether the arms of an experiment were analysed by one version, and who by which."""
    s = reconcile.shared_values(_records(spark, d).filter("experiment_id is not null"), ["experiment_id"], "arm_id", "analyzer_version")
    return s.select(
        "experiment_id", "distinct_values",
        F.array_join(F.transform("holders", lambda h: F.concat(h["value"], F.lit("="), F.array_join(h["members"], ","))), ";").alias("holders")
    )


@query(f"""SELECT experiment_id, count(*) FILTER (WHERE role = 'control') AS ones, count(*) FILTER (WHERE role = 'treatment') AS others, count(*) FILTER (WHERE role = 'control') = 1 AND count(*) FILTER (WHERE role = 'treatment') >= 1 AS sound
FROM (SELECT DISTINCT experiment_id, arm_id, CASE WHEN arm_id = 'm0' THEN 'control' ELSE 'treatment' END AS role FROM ({_ONCE}) WHERE experiment_id IS NOT NULL AND arm_id IS NOT NULL) GROUP BY 1""")
def arm_roles(spark: SparkSession, d: str) -> DataFrame:
    arms = _records(spark, d).filter("experiment_id is not null and arm_id is not null").select("experiment_id", "arm_id").distinct()
    return reconcile.role_counts(
        arms.withColumn("role", F.when(F.col("arm_id") == "m0", "control").otherwise("treatment")), ["experiment_id"], "role", "control",
        "treatment"
    )


#: The closed shape of the JSON that an index row carries, on purpose too narrow in places.
RECORD_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["record_id", "run_id", "analysis_result"],
    "properties": {
        "record_id": {"type": "string", "format": "sha256-hex"},
        "run_id": {"type": "string", "minLength": 30, "pattern": "^[A-Za-z0-9_-]+$"},
        "analysis_result": {
            "type": "object",
            "required": ["verdict", "elo_estimate", "recomputed_wdl"],
            "properties": {
                "verdict": {"type": "string", "enum": ["SUPPORTED_PROGRESS", "PROGRESS_NOT_SUPPORTED"]},
                "elo_estimate": {"type": "object", "required": ["value", "ci_low"], "properties": {"value": {"type": "number", "minimum": -50}}},
                "recomputed_wdl": {
                    "type": "object", "required": ["wins"], "additionalProperties": False,
                    "properties": {"wins": {"type": "integer", "minimum": 10}, "losses": {"type": ["string", "null"]}}
                },
            },
        },
    },
}


@query("""WITH r AS (SELECT run_id || '/' || recorded_at AS k, record_json AS j FROM records)
SELECT k, '$.analysis_result.verdict' AS path, 'enum' AS rule FROM r WHERE j ->> '$.analysis_result.verdict' NOT IN ('SUPPORTED_PROGRESS', 'PROGRESS_NOT_SUPPORTED')
UNION ALL SELECT k, '$.analysis_result.elo_estimate.value', 'minimum' FROM r WHERE CAST(j ->> '$.analysis_result.elo_estimate.value' AS DOUBLE) < -50
UNION ALL SELECT k, '$.analysis_result.recomputed_wdl.wins', 'minimum' FROM r WHERE CAST(j ->> '$.analysis_result.recomputed_wdl.wins' AS BIGINT) < 10
UNION ALL SELECT k, '$.analysis_result.elo_estimate.ci_low', 'required' FROM r WHERE (j -> '$.analysis_result.elo_estimate.ci_low') IS NULL
UNION ALL SELECT k, '$.analysis_result.recomputed_wdl', 'additionalProperties' FROM r WHERE (j -> '$.analysis_result.recomputed_wdl.draws') IS NOT NULL
UNION ALL SELECT k, '$.analysis_result.recomputed_wdl.losses', 'type' FROM r WHERE json_type(j, '$.analysis_result.recomputed_wdl.losses') NOT IN ('VARCHAR', 'NULL')
UNION ALL SELECT k, '$.run_id', 'minLength' FROM r WHERE length(j ->> '$.run_id') < 30
UNION ALL SELECT k, '$.record_id', 'format' FROM r WHERE NOT regexp_full_match(j ->> '$.record_id', '[0-9a-f]{64}')
UNION ALL SELECT k, '$.run_id', 'pattern' FROM r WHERE NOT regexp_full_match(j ->> '$.run_id', '[A-Za-z0-9_-]+')""")
def document_violations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").select(F.concat_ws("/", "run_id", "recorded_at").alias("k"), "record_json")
    return reconcile.schema_violations(r, "k", "record_json", RECORD_SCHEMA)


@query(f"""SELECT coalesce(role_hint, '') AS role_hint, string_agg({_sql_sha('sha256')} || '  ' || path || chr(10), '' ORDER BY path) AS text FROM networks WHERE path IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1""")
def checksum_lists(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "networks").filter("path is not null and sha256 is not null").select(
        F.coalesce("role_hint", F.lit("")).alias("role_hint"), "path", sha_label(F.col("sha256")).alias("sha256")
    )
    return reconcile.checksum_text(n, ["role_hint"])
