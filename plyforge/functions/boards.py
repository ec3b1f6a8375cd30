"""Chess records as Spark columns: strict keys and spelling-tolerant parsing.

Everything here is built from Catalyst expressions, so it runs inside
whole-stage code generation and is pruned and pushed like any projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points that Python's str.split() and str.strip() take as white space.
WS_CLASS = r"[\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: The same, as characters to trim.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_RANK = "[1-8KQRBNPkqrbnp]{1,8}"
_BOARD = rf"(?<![A-Za-z0-9/])({_RANK}(?:/{_RANK}){{7}})(?![A-Za-z0-9/])"
_PLAIN = rf"\A{_RANK}(?:/{_RANK}){{7}} [wb] (?:-|[KQkq]{{1,4}}) (?:-|[a-h][1-8]) [0-9]{{1,9}} [0-9]{{1,9}}\z"
_SINGLE_BLANKS = r"\A[!-~]+(?: [!-~]+){3,}+\z"
_FULL_RANKS = r"\A[.KQRBNPkqrbnp]{8}(?:/[.KQRBNPkqrbnp]{8}){7}\z"


def words(text: Column) -> Column:
    """The words of a text, split at any white space; empty array for blank, null for null."""
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def fen_key(fen: Column) -> Column:
    """First four fields joined by one space; null when there are fewer."""
    parts = words(fen)
    slow = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), " "))
    # nearly all texts separate their fields by single blanks; those need no list of words
    return F.when(fen.rlike(_SINGLE_BLANKS), F.substring_index(fen, " ", 4)).otherwise(slow)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def label(text: Column) -> Column:
    """Labels and hashes are compared without regard to case and outer blanks; blank is null."""
    return F.nullif(F.lower(strip(text)), F.lit(""))


def sha_label(text: Column) -> Column:
    """A hash label, without the scheme prefix some writers put before it."""
    plain = label(text)
    return F.when(plain.startswith("sha"), F.nullif(F.regexp_replace(plain, r"\Asha-?256[:=]\s*", ""), F.lit(""))).otherwise(plain)


def _expand(board: Column) -> Column:
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return board


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-element generator.

    The optimizer copies the expression of a column into every filter and join
    condition on it, so that a costly one runs once for the filter and again
    for its value. It doesn't look through a generator.
    """
    others = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*others, F.explode(F.array(row)).alias("__once")).select(*others, "__once.*")


#: What a record is made of.
FIELDS = ("board", "side", "castling", "ep", "half", "full")


def with_record(
    df: DataFrame, fen: str, half: str | None = None, full: str | None = None, prefix: str = "r_", fields: tuple[str, ...] = FIELDS
) -> DataFrame:
    """Add the record that ``fen`` spells, however it is spelled.

    Added: ``{prefix}board`` (64 characters, rank 8 first, ``.`` is empty),
    ``{prefix}side``, ``{prefix}castling`` (subset of KQkq in that order or
    ``-``), ``{prefix}ep``, ``{prefix}half``, ``{prefix}full``.

    Fields are told apart by shape or by name, so order, separators, letter
    case of anything but pieces and castling rights, brackets, quotes and
    named fields don't matter. Clocks come from the text; where the text lacks
    one, from the column given. A text without a sound board and a side gives
    null in all of the first four columns. Existing columns of the added names
    are overwritten; no other column is touched. ``fields`` says which to add.
    Filters on the added columns repeat the parsing: write the rows down first,
    or put :func:`computed_once` between.
    """
    t, b, r = f"__{prefix}t", f"__{prefix}b", f"__{prefix}r"
    plain = F.col(t).rlike(_PLAIN)
    alone = lambda body: rf"(?<![A-Za-z0-9])({body})(?![A-Za-z0-9])"
    extract = lambda pattern, group=1: F.regexp_extract(F.col(r), pattern, group)
    df = df.withColumn(t, F.col(fen))
    df = df.withColumn(b, F.when(plain, F.substring_index(F.col(t), " ", 1)).otherwise(F.regexp_extract(F.col(t), _BOARD, 1)))
    # what is left of an oddly spelled text; a plain one needs no further search
    df = df.withColumn(r, F.when(plain, F.lit(None)).when(F.col(b) != "", F.replace(F.col(t), F.col(b), F.lit(" "))))
    parts = F.split(F.col(t), " ")
    take = lambda i, odd: F.when(F.col(r).isNull(), F.get(parts, F.lit(i))).otherwise(odd)
    named = lambda name: extract(rf"(?i)(?:{name})[^A-Za-z0-9]*([0-9]{{1,9}})")
    half_named, full_named = named("halfmove(?:[ _]?clock)?|hmvc"), named("fullmove(?:[ _]?number)?|fmvn")
    pair = r"(?<![A-Za-z0-9])([0-9]{1,9})(?:[^A-Za-z0-9]+([0-9]{1,9}))?(?![A-Za-z0-9])"
    unnamed = (half_named == "") & (full_named == "")
    clock = lambda n, i: F.when(unnamed, extract(pair, i)).otherwise(n)
    raw = {
        "side": take(1, F.lower(extract(alone("[wWbB]")))),
        "rights": take(2, extract(alone("[KQkq]{1,4}"))),
        "ep": take(3, F.lower(extract(alone("[a-hA-H][1-8]")))),
        "half": take(4, clock(half_named, 1)),
        "full": take(5, clock(full_named, 2)),
    }
    df = df.withColumns({f"__{prefix}{k}": v for k, v in raw.items()} | {f"__{prefix}x": _expand(F.col(b))})
    raw = {k: F.col(f"__{prefix}{k}") for k in raw}
    sound = F.col(f"__{prefix}x").rlike(_FULL_RANKS) & raw["side"].isin("w", "b")
    rights = F.concat(*[F.when(raw["rights"].contains(x), F.lit(x)).otherwise(F.lit("")) for x in "KQkq"])
    number = lambda k, other: F.coalesce(
        F.when(sound, raw[k].try_cast("int")), F.col(other).cast("int") if other else F.lit(None).cast("int")
    )
    found = {
        "board": F.when(sound, F.replace(F.col(f"__{prefix}x"), F.lit("/"), F.lit(""))),
        "side": F.when(sound, raw["side"]),
        "castling": F.when(sound, F.when(rights == "", F.lit("-")).otherwise(rights)),
        "ep": F.when(sound, F.when(raw["ep"].rlike("[a-h][1-8]"), raw["ep"]).otherwise(F.lit("-"))),
        "half": number("half", half),
        "full": number("full", full),
    }
    return df.withColumns({prefix + k: found[k] for k in fields}).drop(t, b, r, f"__{prefix}x", *[f"__{prefix}{k}" for k in raw])


def position_text(prefix: str = "r_") -> Column:
    """The position alone: board, side, rights, en-passant square; null without a sound record."""
    c = lambda k: F.col(prefix + k)
    return F.when(c("board").isNotNull(), F.concat_ws(" ", c("board"), c("side"), c("castling"), c("ep")))


def record_text(prefix: str = "r_") -> Column:
    """Position and clocks, where an unknown clock is ``?``; null without a sound record."""
    c = lambda k: F.coalesce(F.col(prefix + k).cast("string"), F.lit("?"))
    return F.when(F.col(prefix + "board").isNotNull(), F.concat_ws(" ", position_text(prefix), c("half"), c("full")))
