"""From games to paired results: roles, outcomes, tallies, five-cell counts, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions import stats
from plyforge.functions.boards import fen_key
from plyforge.functions.vocabulary import EXCLUSION_CODES, RESULTS

CELLS = ("ll", "ld", "dd", "wd", "ww")


def candidate_role(white: Column, black: Column, candidate: Column, opponent: Column) -> Column:
    return F.when((white == candidate) & (black == opponent), "white").when((white == opponent) & (black == candidate), "black")


def candidate_outcome(role: Column, result: Column) -> Column:
    known = role.isNotNull() & result.isin(*RESULTS)
    won = ((role == "white") & (result == "1-0")) | ((role == "black") & (result == "0-1"))
    return F.when(known & (result == "1/2-1/2"), "draw").when(known & won, "win").when(known, "loss")


def exclusion_code(white: Column, black: Column, result: Column, role: Column, opening: Column) -> Column:
    """The first reason why a game can't be paired; null for a good one."""
    no_player, no_result, odd_result, odd_labels, no_opening = EXCLUSION_CODES
    found = F.when(white.isNull() | black.isNull(), no_player).when(result.isNull(), no_result).when(~result.isin(*RESULTS), odd_result)
    return found.when(role.isNull(), odd_labels).when(opening.isNull(), no_opening)


def classify_games(games: DataFrame, candidate: Column, opponent: Column) -> DataFrame:
    """Games (``white``, ``black``, ``result``, ``fen``) with role, outcome, opening and exclusion code derived anew."""
    out = games.withColumns(
        {"opening_ref": fen_key(F.col("fen")), "candidate_role": candidate_role(F.col("white"), F.col("black"), candidate, opponent)}
    )
    out = out.withColumn("candidate_outcome", candidate_outcome(F.col("candidate_role"), F.col("result")))
    return out.withColumn(
        "exclusion_code", exclusion_code(F.col("white"), F.col("black"), F.col("result"), F.col("candidate_role"), F.col("opening_ref"))
    )


def raw_games(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): kept games with colours as roles, and the others with their reason."""
    good = F.col("exclusion_reason").isNull()
    of = lambda colour: F.when(F.col("candidate_role") == colour, "candidate").otherwise("opponent")
    kept = games.filter(good).select(
        "run_id", "game_index", of("white").alias("white_role"), of("black").alias("black_role"), "result", "opening_ref", "termination"
    )
    return kept, games.filter(~good).select("run_id", "game_index", F.col("exclusion_reason").alias("reason"))


def tally(games: DataFrame, by: list[str]) -> DataFrame:
    """Wins, losses, draws, unresolved and total from the outcomes alone; claimed counts can't enter."""
    o = F.col("candidate_outcome")
    return games.groupBy(*by).agg(
        F.count_if(o == "win").alias("wins"), F.count_if(o == "loss").alias("losses"), F.count_if(o == "draw").alias("draws"), F.count_if(
            o.isNull() | ~o.isin("win", "loss", "draw")
        ).alias("unresolved"), F.count(F.lit(1)).alias("total_games")
    )


def opening_pairs(games: DataFrame, by: list[str], opening: str = "opening_ref", order: str = "game_index") -> DataFrame:
    """One row per opening of a run with its games, colours and doubled points, and ``status``.

    ``complete`` needs two games, one of each colour, both decided; one game is
    ``incomplete``; all else ``malformed``. Aggregated before the shuffle: no
    list of games is ever built, so an opening met far more often than others
    is no hot group.
    """
    role, o = F.col("candidate_role"), F.col("candidate_outcome")
    pairs = games.groupBy(*by, opening).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(role == "white").alias("as_white"), F.count_if(role == "black").alias("as_black"), F.count_if(o.isin("win", "draw", "loss")).alias("decided"), F.sum(
            F.when(o == "win", 2).when(o == "draw", 1).otherwise(0)
        ).alias("points2"), F.min(order).alias("first_game")
    )
    sound = F.col(opening).isNotNull() & (F.col(opening) != "")
    status = F.when(
        sound & (F.col("games") == 2) & (F.col("as_white") == 1) & (F.col("as_black") == 1) & (F.col("decided") == 2), "complete"
    ).when(sound & (F.col("games") == 1), "incomplete").otherwise("malformed")
    return pairs.withColumn("status", status)


def pentanomial(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Five counts of complete pairs by points, the pairs left out, and the status of the offender met first."""
    complete = F.col("status") == "complete"
    cells = [F.count_if(complete & (F.col("points2") == i)).alias(c) for i, c in enumerate(CELLS)]
    # by position first, then by opening: one answer for any partitioning
    first = F.min(F.when(~complete, F.struct(F.col("first_game"), F.col("status"))))
    return pairs.groupBy(*by).agg(
        *cells, F.count_if(complete).alias("pairs"), F.count_if(~complete).alias("broken_pairs"), first["status"].alias("first_offence")
    )


def with_elo(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    return stats.with_pentanomial_elo(df, list(CELLS), confidence)


def with_gsprt(df: DataFrame, elo0: float, elo1: float, alpha: float = 0.05, beta: float = 0.05, max_games: int = 400) -> DataFrame:
    games = (F.col("ll") + F.col("ld") + F.col("dd") + F.col("wd") + F.col("ww")) * 2
    out = stats.with_gsprt_llr(df.withColumn("games_played", games), list(CELLS), elo0, elo1)
    return out.withColumn("state", stats.gsprt_state(F.col("llr"), F.col("games_played"), alpha, beta, max_games))


def with_verdict(df: DataFrame, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """Adds ``flagged`` (interval below the threshold; never without one) and ``verdict``; ``strict`` as in :func:`stats.verdict`."""
    flagged = F.lit(False) if threshold is None else F.coalesce(F.col("elo_ci_high") < threshold, F.lit(False))
    return df.withColumn("flagged", flagged).withColumn("verdict", stats.verdict(F.col("state"), F.col("flagged"), strict))


def result_documents(games: DataFrame, by: list[str], claims: DataFrame | None = None) -> DataFrame:
    """(``by``, ``document``, ``problem``): per run one JSON text of its paired games in order, and of what was left out with the reason.

    ``claims`` (``by``, ``claimed_wins``, ``claimed_losses``, ``claimed_draws``,
    ``engine_stdout_log_ref``, ``pgn_ref``) pass through as they are and never
    enter a count. ``problem`` is the first of ``no_claims``, ``negative_claim``,
    ``no_games`` that fits, null for a sound document. A run's games are
    bounded by its match.
    """
    kept, left = raw_games(games)
    game = F.struct("game_index", "white_role", "black_role", "result", "opening_ref", "termination")
    docs = kept.groupBy(*by).agg(F.array_sort(F.collect_list(game)).alias("games"))
    out = left.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("game_index", "reason"))).alias("excluded_games"))
    docs = docs.join(out, by, "full")
    fields = ["claimed_wins", "claimed_losses", "claimed_draws", "engine_stdout_log_ref", "pgn_ref"] if claims is not None else []
    if claims is not None:
        docs = docs.join(claims.select(*by, *fields), by, "left")
    claimed = [F.col(c) for c in fields[:3]]
    missing, negative = F.lit(False), F.lit(False)
    for c in claimed:
        missing, negative = missing | c.isNull(), negative | (c < 0)
    problem = F.when(missing, "no_claims").when(negative, "negative_claim").when(F.col("games").isNull(), "no_games")
    return docs.select(*by, F.to_json(F.struct(*by, *fields, "games", "excluded_games")).alias("document"), problem.alias("problem"))
