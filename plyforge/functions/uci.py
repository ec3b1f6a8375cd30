"""Engine protocol lines as columns: search info, best moves, static evaluations, displayed positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge.functions.boards import words

_NO_MOVE = ("(none)", "0000")
#: Numbers of an info line: output name and the token they follow.
NUMBERS = {"depth": "depth", "seldepth": "seldepth", "nodes": "nodes", "time_ms": "time", "nps": "nps"}


def _at(t: Column, name: str, plus: int = 1) -> Column:
    """The token ``plus`` places behind the first ``name``; null if either is missing."""
    i = F.array_position(t, name)
    return F.when(i > 0, F.get(t, (i + F.lit(plus - 1)).cast("int")))


def _has(t: Column, name: str) -> Column:
    return F.array_contains(t, name)


def _bound(t: Column) -> Column:
    tail = F.slice(t, F.array_position(t, "score").cast("int") + 3, F.size(t))
    return F.when(_has(tail, "lowerbound"), "lowerbound").when(_has(tail, "upperbound"), "upperbound").otherwise("exact")


def _pv(t: Column) -> Column:
    return F.slice(t, F.array_position(t, "pv").cast("int") + 1, F.size(t))


def mining_info(line: Column) -> Column:
    """Strict reading of a search line, as a struct of typed fields; null for any other line.

    It must begin with ``info`` (leading blanks don't matter) and have a cp or
    mate score with a whole number and a pv; a broken wdl spoils the line. No
    or zero ``multipv`` is rank 1.
    """
    t = words(line)
    number = lambda name, plus=1: _at(t, name, plus).try_cast("bigint")
    kind, value = _at(t, "score"), number("score", 2)
    wdl = [number("wdl", k) for k in (1, 2, 3)]
    whole = ~_has(t, "wdl") | (wdl[0].isNotNull() & wdl[1].isNotNull() & wdl[2].isNotNull())
    rank = number("multipv")
    fields = F.struct(
        F.when(rank.isNull() | (rank == 0), F.lit(1)).otherwise(rank).cast("bigint").alias("rank"),
        kind.alias("score_type"),
        value.alias("score_value"),
        _bound(t).alias("bound"),
        *[w.alias(f"wdl_{k}") for k, w in zip("wdl", wdl, strict=True)],
        *[number(token).alias(name) for name, token in NUMBERS.items()],
        F.get(_pv(t), F.lit(0)).alias("move"),
        F.array_join(_pv(t), " ").alias("pv"),
    )
    good = (F.get(t, F.lit(0)) == "info") & _has(t, "score") & _has(t, "pv") & kind.isin("cp", "mate") & value.isNotNull() & whole
    return F.when(F.coalesce(good, F.lit(False)), fields)


def rescore_info(line: Column) -> Column:
    """Lenient reading of a search line, as a struct of texts; null for any other line.

    It must begin with ``info `` at once and not be ``info string``; only a cp
    or mate score is required. What is missing is the empty text; a wdl of
    fewer than three numbers is left out; a field name at the very end spoils
    the line.
    """
    t = words(line)
    text = lambda c: F.coalesce(c, F.lit(""))
    kind, value = _at(t, "score"), _at(t, "score", 2)
    complete = F.lit(True)
    for token in NUMBERS.values():
        complete = complete & (~_has(t, token) | _at(t, token).isNotNull())
    wdl = _at(t, "wdl", 3).isNotNull()
    fields = F.struct(
        kind.alias("sf_score_type"),
        value.alias("sf_score"),
        _bound(t).alias("sf_bound"),
        *[text(_at(t, token)).alias(f"sf_{name}") for name, token in NUMBERS.items()],
        *[text(F.when(wdl, _at(t, "wdl", k + 1))).alias(f"sf_wdl_{x}") for k, x in enumerate("wdl")],
        text(F.when(_has(t, "pv"), F.array_join(_pv(t), " "))).alias("sf_pv"),
    )
    good = line.startswith("info ") & ~line.startswith("info string") & kind.isin("cp", "mate") & value.isNotNull() & complete
    return F.when(F.coalesce(good, F.lit(False)), fields)


def best_move(line: Column) -> Column:
    """struct(bestmove, ponder) of a ``bestmove`` line, else null; ``(none)`` and ``0000`` are no moves."""
    t = words(line)
    move = lambda c: F.when(~c.isin(*_NO_MOVE), c)
    ponder = F.when(F.get(t, F.lit(2)) == "ponder", move(F.get(t, F.lit(3))))
    return F.when(F.get(t, F.lit(0)) == "bestmove", F.struct(move(F.get(t, F.lit(1))).alias("bestmove"), ponder.alias("ponder")))


def static_score(line: Column) -> Column:
    """The number of an ``NNUE evaluation`` line seen from the side to move; null for any other line."""
    return F.regexp_extract(line, r"\A\s*NNUE evaluation\s+([+-]?\d+)\s+\(side to move, internal units\)\s*\z", 1).try_cast("bigint")


def in_check(line: Column) -> Column:
    return F.coalesce(F.ltrim(line).startswith("Final evaluation: none"), F.lit(False))


def displayed_fen(line: Column) -> Column:
    bare = F.trim(line)
    return F.when(bare.startswith("Fen: "), F.trim(F.substr(bare, F.lit(6))))


def root_score(score: Column, side: Column, root_side: Column) -> Column:
    """A score of the side to move seen from the root's side; null if anything is."""
    return F.when(side == root_side, score).when(side.isNotNull() & root_side.isNotNull(), -score)
