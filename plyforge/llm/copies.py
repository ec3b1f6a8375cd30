"""Problem 3: records that differ only in how they are spelled.

Hot canonical keys are found exactly from partial counts and go through a
salted two-level aggregation; all others take one shuffle. The row of the
smallest identifier represents its record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.boards import WS_CLASS, record_text, with_record
from plyforge.operators.skew import HOT_ROWS, with_group_min
from plyforge.session import cut


def _keyed(df: DataFrame, id_col: str, fen: str, half: str, full: str) -> DataFrame:
    tidy = F.regexp_replace(F.col(fen), f"{WS_CLASS}+", " ")
    clocks = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in (half, full)]
    unread = F.when(F.trim(tidy) != "", F.concat_ws(" ", F.lit("text"), F.trim(tidy), *clocks))
    return with_record(df, fen, half, full, "__r_").select(id_col, F.coalesce(record_text("__r_"), unread).alias("__key"))


def _with_copies(df: DataFrame, id_col: str, fen: str, half: str, full: str, hot_rows: int) -> DataFrame:
    # read twice (hot keys, then rows), so what was parsed is written down
    return with_group_min(cut(_keyed(df, id_col, fen, half, full), "keyed"), ["__key"], id_col, "keep_id", "copies", hot_rows)


def with_copies(
    df: DataFrame, id_col: str = "position_id", fen: str = "fen", half: str = "halfmove_clock", full: str = "fullmove_number",
    hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(id, ``keep_id``, ``copies``): of every row, the smallest id of its record and how many rows spell it.

    Texts from which no record can be read are equal when they agree up to
    white space and in both clock columns; a null or blank text is a record of
    its own. Rows of a null id are kept but never represent others; a record of
    null ids alone has a null ``keep_id``.
    """
    return _with_copies(df, id_col, fen, half, full, hot_rows).drop("__key")


def records(
    df: DataFrame, id_col: str = "position_id", fen: str = "fen", half: str = "halfmove_clock", full: str = "fullmove_number",
    hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per record: (``keep_id``, ``copies``). A row repeated under its own id is a copy without a link.

    Records of null ids alone are told apart by what they spell, and without
    text every row is one.
    """
    w = _with_copies(df, id_col, fen, half, full, hot_rows)
    copies = F.max("copies").alias("copies")
    named = w.filter(F.col(id_col) == F.col("keep_id")).groupBy("keep_id").agg(copies)
    nameless = w.filter("keep_id is null")
    spelled = nameless.filter("__key is not null").groupBy("__key").agg(copies).select(
        F.lit(None).cast(w.schema["keep_id"].dataType).alias("keep_id"), "copies"
    )
    return named.unionByName(spelled).unionByName(nameless.filter("__key is null").select("keep_id", "copies"))


def copy_links(df: DataFrame, id_col: str = "position_id", **kw) -> DataFrame:
    """(``keep_id``, ``copy_id``) of every row that repeats the record of a smaller id."""
    w = with_copies(df, id_col, **kw)
    return w.filter(F.col(id_col) > F.col("keep_id")).select("keep_id", F.col(id_col).alias("copy_id"))
