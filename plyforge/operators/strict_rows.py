"""Problem 4: delimited lines loaded strictly, the rest set apart with a reason.

Lines keep their record number. Only lines that conform to the grammar and to
every column's type are loaded; subtracting the loaded numbers from all numbers
leaves the bad lines, and only those are diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.boards import computed_once, strip, words
from plyforge.functions.vocabulary import EXCLUSION_CODES, RESULTS, UNRESOLVED

# The columns of a parsed-game line.
COLUMNS = ("game_index", "white", "black", "result", "termination", "fen", "opening_ref", "candidate_role", "candidate_outcome", "exclusion_reason")

#: A column: quoted from its first character on, with doubled quotes inside, or free of quotes and commas.
_COLUMN = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_LINE = rf"\A{_COLUMN}(?:,{_COLUMN})*+\z"


def sound_quoting(line: Column) -> Column:
    return line.rlike(_LINE)


def raw_columns(line: Column) -> Column:
    """The columns of a soundly quoted line as they stand; a leading comma makes every match non-empty."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_COLUMN})"), F.lit(1))


def column_value(raw: Column) -> Column:
    """Unquoted, without outer blanks; empty is missing."""
    bare = F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
    return F.nullif(strip(bare), F.lit(""))


def sound_board(board: Column) -> Column:
    """Eight ranks of eight squares."""
    for n in range(2, 9):
        board = F.replace(board, F.lit(str(n)), F.lit("1" * n))
    return board.rlike(r"\A[1KQRBNPkqrbnp]{8}(?:/[1KQRBNPkqrbnp]{8}){7}\z")


def _value_checks(c: dict[str, Column]) -> Column:
    """True when every value conforms; a missing value other than game_index does."""
    parts = words(c["fen"])
    fen = c["fen"].isNull() | ((F.size(parts) >= 4) & sound_board(F.get(parts, F.lit(0))) & F.get(parts, F.lit(1)).isin("w", "b"))
    code = F.trim(F.substring_index(c["exclusion_reason"], ":", 1))
    return (
        F.coalesce(c["game_index"].rlike(r"\A0*[1-9][0-9]*\z") & c["game_index"].try_cast("bigint").isNotNull(), F.lit(False))
        & (c["result"].isNull() | c["result"].isin(*RESULTS, UNRESOLVED))
        & F.coalesce(fen, F.lit(False))
        & (c["exclusion_reason"].isNull() | code.isin(*EXCLUSION_CODES))
    )


def load_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """The valid lines, typed: ``line_id`` and the ten columns, ``game_index`` as bigint.

    Null and blank lines have no ten columns and aren't loaded. Repeated lines
    are loaded each under its number. A game index beyond 64 bits isn't loaded.
    Other columns of the input are dropped, so their names can't clash.
    """
    return _loaded(lines, line_id, line).select("line_id", *COLUMNS)


def _loaded(lines: DataFrame, line_id: str, line: str) -> DataFrame:
    """The valid lines with a hash of their text, ``__text``."""
    src = lines.select(F.col(line_id).alias("line_id"), F.col(line).alias("__line")).filter(sound_quoting(F.col("__line")))
    # fenced, so that the filters below don't split and unquote every line once more
    raw = {"__raw": raw_columns(F.col("__line")), "__text": F.xxhash64("__line")}
    src = computed_once(src.select("line_id", "__line"), raw).filter(F.size("__raw") == len(COLUMNS)).drop("__line")
    src = computed_once(src, {c: column_value(F.get("__raw", F.lit(i))) for i, c in enumerate(COLUMNS)}).select("line_id", "__text", *COLUMNS)
    good = src.filter(_value_checks({c: F.col(c) for c in COLUMNS}))
    return good.withColumn("game_index", F.col("game_index").cast("bigint"))


def bad_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(``line_id``, ``reason``, ``line``) of every line that isn't loaded, with the first reason that fits.

    ``quoting``, then ``columns``, then ``value``. The bad lines are all lines
    less the loaded ones, told apart by number and a hash of their text, so that
    a bad line stays one when a good line has its number. A line without number
    can't be subtracted; it is tested by itself.
    """
    every = lines.select(F.col(line_id).alias("line_id"), F.col(line).alias("line"), F.xxhash64(line).alias("__text"))
    rest = every.join(_loaded(lines, line_id, line).select("line_id", "__text"), ["line_id", "__text"], "left_anti")
    text = F.coalesce(F.col("line"), F.lit(""))
    fits = _value_checks({c: column_value(F.get(raw_columns(text), F.lit(i))) for i, c in enumerate(COLUMNS)})
    rest = rest.filter(F.col("line_id").isNotNull() | ~(sound_quoting(text) & (F.size(raw_columns(text)) == len(COLUMNS)) & fits))
    reason = F.when(~sound_quoting(text), "quoting").when(F.size(raw_columns(text)) != len(COLUMNS), "columns").otherwise("value")
    return rest.select("line_id", reason.alias("reason"), "line")
