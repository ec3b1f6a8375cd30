"""Ordered rule chains: the first rule that fits names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators import matches


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Code of the first condition that holds (null counts as false); null if none does."""
    out = None
    for condition, code in rules:
        fits = F.coalesce(condition, F.lit(False))
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return F.lit(None).cast("string") if out is None else out


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """Codes of every condition that holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]))


def run_soundness(games: DataFrame, by: list[str]) -> DataFrame:
    """Per run why its games can't be evaluated as pairs: ``reason``, the first that fits, and all ``findings``.

    Indices that aren't 1..n; an odd number of games; a broken pair, told by
    the pair met first; counts of results that contradict the pairs.
    """
    g = games.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"), F.countDistinct("game_index").alias("__k"), F.min("game_index").alias("__lo"),
        F.max("game_index").alias("__hi")
    )
    pairs = matches.pentanomial(matches.opening_pairs(games, by), by)
    j = g.join(pairs, by).join(matches.tally(games, by).drop("total_games"), by)
    scored = (F.col("wins") * 2 + F.col("draws")) - (F.col("ld") + F.col("dd") * 2 + F.col("wd") * 3 + F.col("ww") * 4)
    rules = [
        ((F.col("games") != F.col("__k")) | (F.col("__lo") != 1) | (F.col("__hi") != F.col("games")), "indices_not_sequential"),
        (F.col("games") % 2 == 1, "odd_game_count"),
        (F.col("first_offence") == "incomplete", "incomplete_opening_pair"),
        (F.col("first_offence") == "malformed", "malformed_opening_pair"),
        (scored != 0, "pair_accounting_mismatch"),
    ]
    return j.select(*by, "games", "pairs", first_reason(rules).alias("reason"), all_reasons(rules).alias("findings"))


#: Texts that say there is no move.
NO_MOVE = ("", "(none)", "0000")


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rescored rows fit for a corpus: an exact centipawn score, no error, a best move. A missing column or value is the empty text."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return rows.filter(
        (text("sf_score_type") == "cp") & (text("sf_bound") == "exact") & (text("sf_error") == "") & ~text("sf_bestmove").isin(*NO_MOVE)
    )
