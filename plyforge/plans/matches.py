"""Queries from games to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import stats
from plyforge.operators import history, matches, rules
from plyforge.plans.positions import sql_key
from plyforge.plans.queries import query
from plyforge.session import table

_KEPT = "SELECT DISTINCT * FROM parsed_games WHERE exclusion_reason IS NULL"
_LABELS = """SELECT run_id, min(CASE candidate_role WHEN 'white' THEN white WHEN 'black' THEN black END) AS candidate, min(CASE candidate_role WHEN 'white' THEN black WHEN 'black' THEN white END) AS opponent
FROM parsed_games GROUP BY run_id"""
_PAIRS = f"""SELECT run_id, opening_ref, count(*) AS games, count(*) FILTER (WHERE candidate_role = 'white') AS as_white, count(*) FILTER (WHERE candidate_role = 'black') AS as_black,
  count(*) FILTER (WHERE candidate_outcome IN ('win', 'draw', 'loss')) AS decided,
  CAST(sum(CASE candidate_outcome WHEN 'win' THEN 2 WHEN 'draw' THEN 1 ELSE 0 END) AS BIGINT) AS points2, min(game_index) AS first_game FROM ({_KEPT}) GROUP BY 1, 2"""
_STATUS = f"""SELECT *, CASE WHEN opening_ref <> '' AND games = 2 AND as_white = 1 AND as_black = 1 AND decided = 2 THEN 'complete' WHEN opening_ref <> '' AND games = 1 THEN 'incomplete' ELSE 'malformed' END AS status FROM ({_PAIRS})"""
_CELLS = f"""SELECT run_id, {', '.join(f"count(*) FILTER (WHERE status = 'complete' AND points2 = {i}) AS {c}" for i, c in enumerate(matches.CELLS))},
  count(*) FILTER (WHERE status = 'complete') AS pairs, count(*) FILTER (WHERE status <> 'complete') AS broken_pairs,
  arg_min(status, first_game) FILTER (WHERE status <> 'complete') AS first_offence FROM ({_STATUS}) GROUP BY run_id"""


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """Games that can be paired; games that were sent again count once."""
    return table(spark, d, "parsed_games").filter("exclusion_reason is null").distinct()


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return matches.pentanomial(matches.opening_pairs(_kept(spark, d), ["run_id"]), ["run_id"])


@query(f"""SELECT run_id, game_index, opening_ref, role AS candidate_role, CASE WHEN role IS NULL OR result IS NULL OR result NOT IN ('1-0', '0-1', '1/2-1/2') THEN NULL WHEN result = '1/2-1/2' THEN 'draw'
    WHEN (role = 'white') = (result = '1-0') THEN 'win' ELSE 'loss' END AS candidate_outcome,
  CASE WHEN white IS NULL OR black IS NULL THEN 'missing_white_or_black_header' WHEN result IS NULL THEN 'missing_result_header' WHEN result NOT IN ('1-0', '0-1', '1/2-1/2') THEN 'unresolved_or_invalid_result'
    WHEN role IS NULL THEN 'unrecognized_engine_labels' WHEN opening_ref IS NULL THEN 'missing_or_invalid_fen_for_opening_ref' END AS exclusion_code
FROM (SELECT g.run_id, game_index, white, black, result, {sql_key('fen')} AS opening_ref,
    CASE WHEN white = candidate AND black = opponent THEN 'white' WHEN white = opponent AND black = candidate THEN 'black' END AS role
  FROM parsed_games g JOIN ({_LABELS}) l ON g.run_id = l.run_id)""")
def classified_games(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "parsed_games")
    role = F.col("candidate_role")
    of = lambda a, b: F.min(F.when(role == "white", F.col(a)).when(role == "black", F.col(b)))
    labels = g.groupBy("run_id").agg(of("white", "black").alias("candidate"), of("black", "white").alias("opponent"))
    out = matches.classify_games(
        g.select("run_id", "game_index", "white", "black", "result", "fen").join(labels, "run_id"), F.col("candidate"), F.col("opponent")
    )
    return out.select("run_id", "game_index", "opening_ref", "candidate_role", "candidate_outcome", "exclusion_code")


@query("""SELECT run_id, game_index, CASE WHEN candidate_role = 'white' THEN 'candidate' ELSE 'opponent' END AS white_role, CASE WHEN candidate_role = 'black' THEN 'candidate' ELSE 'opponent' END AS black_role, result, opening_ref, termination
FROM parsed_games WHERE exclusion_reason IS NULL""")
def raw_games_kept(spark: SparkSession, d: str) -> DataFrame:
    return matches.raw_games(table(spark, d, "parsed_games"))[0]


@query("SELECT run_id, game_index, exclusion_reason AS reason FROM parsed_games WHERE exclusion_reason IS NOT NULL")
def raw_games_excluded(spark: SparkSession, d: str) -> DataFrame:
    return matches.raw_games(table(spark, d, "parsed_games"))[1]


@query("""SELECT run_id, count(*) FILTER (WHERE candidate_outcome = 'win') AS wins, count(*) FILTER (WHERE candidate_outcome = 'loss') AS losses, count(*) FILTER (WHERE candidate_outcome = 'draw') AS draws,
  count(*) FILTER (WHERE candidate_outcome IS NULL OR candidate_outcome NOT IN ('win', 'loss', 'draw')) AS unresolved, count(*) AS total_games FROM parsed_games GROUP BY run_id""")
def wdl_tally(spark: SparkSession, d: str) -> DataFrame:
    return matches.tally(table(spark, d, "parsed_games"), ["run_id"])


@query(_STATUS)
def opening_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matches.opening_pairs(_kept(spark, d), ["run_id"])


@query(_CELLS)
def pentanomial_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


_REG = f"SELECT run_id, pairs, {', '.join(f'CASE WHEN {c} = 0 THEN 0.001 ELSE {c}::DOUBLE END AS r{i}' for i, c in enumerate(matches.CELLS))} FROM ({_CELLS}) WHERE pairs > 0"
_SCORE = f"SELECT *, 2 * (r0 + r1 + r2 + r3 + r4) AS g, (r1 * 0.5 + r2 + r3 * 1.5 + r4 * 2) / (2 * (r0 + r1 + r2 + r3 + r4)) AS score FROM ({_REG})"
_ELO = "(-400.0 * log10(1.0 / greatest(0.001, least(0.999, {})) - 1.0))"
_ERROR = f"""SELECT *, 1.959963984540054 * sqrt((r0 * (0 - 2 * score) ** 2 + r1 * (0.5 - 2 * score) ** 2 + r2 * (1 - 2 * score) ** 2 + r3 * (1.5 - 2 * score) ** 2 + r4 * (2 - 2 * score) ** 2) / g) / sqrt(g) AS err FROM ({_SCORE})"""


@query(f"""SELECT run_id, pairs, round(score, 7) AS score, round({_ELO.format('score')}, 5) AS elo,
  round({_ELO.format('score')} - ({_ELO.format('score + err')} - {_ELO.format('score - err')}) / 2, 5) AS elo_ci_low, round({_ELO.format('score')} + ({_ELO.format('score + err')} - {_ELO.format('score - err')}) / 2, 5) AS elo_ci_high FROM ({_ERROR})""")
def elo_by_run(spark: SparkSession, d: str) -> DataFrame:
    e = matches.with_elo(_cells(spark, d)).filter("pairs > 0")
    return e.select("run_id", "pairs", F.round("score", 7).alias("score"), *[F.round(c, 5).alias(c) for c in ("elo", "elo_ci_low", "elo_ci_high")])


def _root(target: str, name: str) -> str:
    f = " + ".join(f"p{i} * ({i / 4} - {target}) / (1 + (l + r) / 2 * ({i / 4} - {target}))" for i in range(5))
    return f"""{name} AS (
  SELECT 0 AS step, run_id, p0, p1, p2, p3, p4, -1 / (1 - {target}) + 1e-9 AS l, 1 / {target} - 1e-9 AS r FROM pdf
  UNION ALL SELECT step + 1, run_id, p0, p1, p2, p3, p4, CASE WHEN {f} > 0 THEN (l + r) / 2 ELSE l END, CASE WHEN {f} > 0 THEN r ELSE (l + r) / 2 END FROM {name} WHERE step < 80)"""


_T0, _T1 = stats.expected_score(0.0), stats.expected_score(5.0)
_LLR = f"""WITH RECURSIVE pdf AS (SELECT run_id, pairs, r0 + r1 + r2 + r3 + r4 AS n, {', '.join(f'r{i} / (r0 + r1 + r2 + r3 + r4) AS p{i}' for i in range(5))} FROM ({_REG})),
{_root(repr(_T0), 'a')}, {_root(repr(_T1), 'b')}
SELECT pdf.run_id, 2 * pairs AS games_played, n * ({' + '.join(f'pdf.p{i} * (ln(1 + (a.l + a.r) / 2 * ({i / 4} - {_T0!r})) - ln(1 + (b.l + b.r) / 2 * ({i / 4} - {_T1!r})))' for i in range(5))}) AS llr
FROM pdf JOIN a ON a.run_id = pdf.run_id AND a.step = 80 JOIN b ON b.run_id = pdf.run_id AND b.step = 80"""
_LOW, _HIGH = stats.wald_bounds(0.05, 0.05)
_STATE = f"CASE WHEN llr < {_LOW!r} THEN 'H0_ACCEPTED' WHEN llr > {_HIGH!r} THEN 'H1_ACCEPTED' WHEN games_played >= 40 THEN 'CAP_REACHED' ELSE 'CONTINUE' END"


@query(f"SELECT run_id, games_played, round(llr, 6) AS llr, {_STATE} AS state FROM ({_LLR})")
def gsprt_by_run(spark: SparkSession, d: str) -> DataFrame:
    g = matches.with_gsprt(_cells(spark, d).filter("pairs > 0"), 0.0, 5.0, max_games=40)
    return g.select("run_id", "games_played", F.round("llr", 6).alias("llr"), "state")


_HALF = f"({_ELO.format('score + err')} - {_ELO.format('score - err')}) / 2"
_VERDICT = f"""SELECT l.run_id, pairs, elo, elo_ci_low, elo_ci_high, l.llr, state, elo_ci_high < -20 AS flagged FROM (SELECT run_id, llr, {_STATE} AS state FROM ({_LLR})) l
JOIN (SELECT run_id, pairs, {_ELO.format('score')} AS elo, {_ELO.format('score')} - {_HALF} AS elo_ci_low, {_ELO.format('score')} + {_HALF} AS elo_ci_high FROM ({_ERROR})) e ON l.run_id = e.run_id"""


@query(f"""SELECT run_id, pairs, round(elo, 5) AS elo, round(elo_ci_low, 5) AS elo_ci_low, round(elo_ci_high, 5) AS elo_ci_high, round(llr, 6) AS llr, state, flagged,
  CASE WHEN state = 'H1_ACCEPTED' AND NOT flagged THEN 'SUPPORTED_PROGRESS' WHEN state = 'H0_ACCEPTED' OR (state = 'CAP_REACHED' AND flagged) THEN 'PROGRESS_NOT_SUPPORTED' WHEN state = 'CAP_REACHED' THEN 'INCONCLUSIVE' END AS verdict FROM ({_VERDICT})""")
def verdict_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Elo, test state and verdict of every run; where the test goes on there is no verdict."""
    g = matches.with_verdict(matches.with_gsprt(matches.with_elo(_cells(spark, d).filter("pairs > 0")), 0.0, 5.0, max_games=40), -20.0)
    return g.select(
        "run_id", "pairs", *[F.round(c, 5).alias(c) for c in ("elo", "elo_ci_low", "elo_ci_high")], F.round("llr", 6).alias("llr"), "state",
        "flagged", "verdict"
    )


@query(f"""SELECT t.run_id, CASE WHEN wins + draws + losses <> 2 * (ll + ld + dd + wd + ww) THEN 'games' WHEN wins - losses <> 2 * ww + wd - ld - 2 * ll THEN 'net'
  WHEN draws NOT BETWEEN wd + ld AND wd + 2 * dd + ld THEN 'draws' END AS problem
FROM (SELECT run_id, count(*) FILTER (WHERE candidate_outcome = 'win') AS wins, count(*) FILTER (WHERE candidate_outcome = 'loss') AS losses, count(*) FILTER (WHERE candidate_outcome = 'draw') AS draws FROM ({_KEPT}) GROUP BY 1) t
JOIN ({_CELLS}) c ON t.run_id = c.run_id""")
def wdl_against_pairs(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d)
    both = matches.tally(kept, ["run_id"]).join(_cells(spark, d), "run_id")
    return both.select(
        "run_id", stats.wdl_problem(F.col("wins"), F.col("draws"), F.col("losses"), [F.col(c) for c in matches.CELLS]).alias("problem")
    )


@query("""SELECT run_id, count(*) AS rows_seen, count(*) - count(DISTINCT game_index) AS repeats, max(game_index) - count(DISTINCT game_index) AS missing,
  count(*) = count(DISTINCT game_index) AND min(game_index) = 1 AND max(game_index) = count(*) AS sequential FROM parsed_games GROUP BY run_id""")
def game_sequence(spark: SparkSession, d: str) -> DataFrame:
    return history.sequence_gaps(table(spark, d, "parsed_games"), ["run_id"], "game_index")


@query(f"""SELECT run_id, games, pairs, CASE {' '.join(f"WHEN {c} THEN '{k}'" for c, k in (('NOT seq', 'indices_not_sequential'), ('games % 2 = 1', 'odd_game_count'), ("first_offence = 'incomplete'", 'incomplete_opening_pair'), ("first_offence = 'malformed'", 'malformed_opening_pair'), ('scored <> 0', 'pair_accounting_mismatch')))} END AS reason
FROM (SELECT g.run_id, g.games, c.pairs, seq, first_offence, points - (ld + dd * 2 + wd * 3 + ww * 4) AS scored FROM (
  SELECT run_id, count(*) AS games, count(*) = count(DISTINCT game_index) AND min(game_index) = 1 AND max(game_index) = count(*) AS seq, sum(CASE candidate_outcome WHEN 'win' THEN 2 WHEN 'draw' THEN 1 ELSE 0 END) AS points FROM ({_KEPT}) GROUP BY 1) g
  JOIN ({_CELLS}) c ON g.run_id = c.run_id)""")
def run_soundness(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_soundness(_kept(spark, d), ["run_id"]).drop("findings")


@query("""WITH g AS (SELECT run_id, count(*) FILTER (WHERE exclusion_reason IS NULL) AS kept, count(*) FILTER (WHERE exclusion_reason IS NOT NULL) AS excluded FROM parsed_games GROUP BY 1),
c AS (SELECT run_id, min(wins) AS w FROM records WHERE run_id IS NOT NULL GROUP BY 1)
SELECT g.run_id, kept, excluded, w AS claimed_wins, CASE WHEN w IS NULL THEN 'no_claims' WHEN kept = 0 THEN 'no_games' END AS problem FROM g LEFT JOIN c ON g.run_id = c.run_id WHERE g.run_id IS NOT NULL""")
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """The result document of every run, read back."""
    games = table(spark, d, "parsed_games").filter("run_id is not null")
    fewest = lambda c: F.min(c).alias(f"claimed_{c}")
    claims = table(spark, d, "records").groupBy("run_id").agg(
        *map(fewest, ("wins", "losses", "draws")), F.lit("log").alias("engine_stdout_log_ref"), F.lit("pgn").alias("pgn_ref")
    )
    doc = F.from_json("document", "struct<claimed_wins:bigint,games:array<struct<game_index:bigint>>,excluded_games:array<struct<reason:string>>>")
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("bigint")
    out = matches.result_documents(games, ["run_id"], claims).select("run_id", doc.alias("d"), "problem")
    return out.select(
        "run_id", size(F.coalesce("d.games", F.array())).alias("kept"), size(F.coalesce("d.excluded_games", F.array())).alias("excluded"),
        "d.claimed_wins", "problem"
    )
