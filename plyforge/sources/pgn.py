"""Game collections in PGN: headers, moves, and positions played.

Texts in a column are scanned whole, in Arrow batches (:func:`scan_games`).
Files may be of any size and are read in splits (:func:`read_games`): what the
scanner keeps in mind from line to line is carried from split to split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions.boards import strip
from plyforge.functions.chess import START, IllegalMove, Position
from plyforge.session import cut, map_arrow
from plyforge.sources.files import block_lines

GAME = "game_index bigint, white string, black string, result string, termination string, fen string, headers map<string,string>"
_TAG = re.compile(r'\[\s*([A-Za-z0-9][A-Za-z0-9_+#=:-]*)\s+"(.*)"\s*\]\s*\Z')
_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|[()]|\$\d+|\d+\.+|[^\s{}();]+")
_ENDS = ("1-0", "0-1", "1/2-1/2", "*")


def scan_games(text: str) -> Iterator[tuple[dict[str, str], str]]:
    """(headers, movetext) of every game.

    A game is a run of tag lines with the text after it, up to an empty line
    or the next tag line, neither inside a brace comment. The ``Event`` tag has
    no special meaning. Text without tags is a game without headers; a broken
    tag line (cut off, say) is text. Nothing raises.
    """
    headers: dict[str, str] = {}
    moves: list[str] = []
    inside, seen = False, False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = line.strip()
        tag = None if inside else _TAG.match(bare)
        if tag:
            if moves:
                yield headers, "\n".join(moves)
                headers, moves = {}, []
            headers.setdefault(tag[1], tag[2].replace('\\"', '"').replace("\\\\", "\\"))
            seen = True
        elif not bare and not inside:
            if moves:
                yield headers, "\n".join(moves)
                headers, moves, seen = {}, [], False
        elif inside or not line.startswith("%"):
            moves.append(line)
            seen = True
            for x in line if inside or "{" in line else "":
                inside = x == "{" or (inside and x != "}")
    if seen:
        yield headers, "\n".join(moves)


def main_line(movetext: str) -> Iterator[str]:
    """Moves in order, without numbers, comments, annotations, variations and the result."""
    depth = 0
    for t in _TOKEN.findall(movetext):
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth or t[0] in "{;$" or re.fullmatch(r"\d+\.+|[!?]+", t):
            continue
        elif t in _ENDS:
            return
        else:
            # a number may be glued to its move
            yield re.sub(r"\A\d+\.+", "", t)


def _game_row(k: int, h: dict[str, str]) -> tuple:
    return (k, h.get("White"), h.get("Black"), h.get("Result"), h.get("Termination"), h.get("FEN"), h)


def replay(headers: dict[str, str], movetext: str) -> tuple[list[str], str | None]:
    """Positions after every ply, and the first text that is no legal move (positions before it are kept)."""
    fens: list[str] = []
    try:
        p = Position.from_fen(headers.get("FEN") or START)
    except ValueError:
        return fens, headers.get("FEN")
    for san in main_line(movetext):
        try:
            p = p.push(p.move_of(san))
        except (IllegalMove, ValueError, IndexError):
            return fens, san
        fens.append(p.fen())
    return fens, None


def is_game(headers: dict[str, str], movetext: str) -> bool:
    """Whether a section of a text that isn't known to be of games is one: it has tags or begins with a legal move."""
    first = None if headers else next(main_line(movetext), None)
    try:
        return bool(headers) or (first is not None and bool(Position.from_fen(START).move_of(first)))
    except (IllegalMove, ValueError, IndexError):
        return False


def numbered_games(text: str | None, every: bool) -> Iterator[tuple[int, dict[str, str], str]]:
    """(number from 1, headers, movetext) of the games of a text: every section, or those that are games by themselves."""
    games = (g for g in scan_games(text) if every or is_game(*g)) if text else ()
    for k, (headers, moves) in enumerate(games, 1):
        yield k, headers, moves


def _before(lines: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add of each column the last value that isn't null on the lines before, in the same file.

    Within a split by a window; from one split to the next by what each split
    ends with (one row for each split).
    """
    marked = cut(lines.withColumns({f"__{c}": v for c, v in columns.items()}), "marked")
    inside = Window.partitionBy("file", "block").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("file", "block").agg(
        *[F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col("ln"))).alias(f"__end_{c}") for c in columns]
    )
    ends = ends.select("file", "block", *[F.last(f"__end_{c}", ignorenulls=True).over(splits).alias(f"__from_{c}") for c in columns])
    near = marked.withColumns({c: F.last(f"__{c}", ignorenulls=True).over(inside) for c in columns}).join(ends, ["file", "block"])
    return near.select(*lines.columns, *[F.coalesce(c, f"__from_{c}").alias(c) for c in columns])


#: A tag line, without outer blanks.
_TAG_LINE = r"(?s)\A\[\s*([A-Za-z0-9][A-Za-z0-9_+#=:-]*)\s+\"(.*)\"\s*\]\z"


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``game_index`` from 1 in each file, white, black, result, termination, fen, ``headers``, ``movetext``) of every game of PGN files.

    The games are those of :func:`scan_games` over the whole file; a test holds
    them against each other. A line's brace state is that of the last line
    before that leaves no choice: a last ``}`` always closes, a last ``{`` opens
    but on tag and ``%`` lines, which only are such outside a comment. A game
    begins at a tag or text line that is the first, or whose predecessor is
    text with an empty line between, or is text where this is a tag.
    """
    lines = block_lines(spark, path).select("file", "block", "ln", "line")
    bare = strip(F.col("line"))
    # patterns only where a character tells that they may fit
    tag = bare.startswith("[") & bare.rlike(_TAG_LINE)
    behind = lambda x: F.when(F.col("line").contains(x), F.length(F.substring_index("line", x, -1)))
    opens, closes = behind("{"), behind("}")
    comment = F.when(closes.isNotNull() & (opens.isNull() | (closes < opens)), 0).when(opens.isNotNull() & ~tag & ~F.col("line").startswith("%"), 1)
    lines = _before(lines, {"inside": comment})
    kind = F.when(
        F.coalesce("inside", F.lit(0)) == 1, "text"
    ).when(tag, "tag").when(bare == "", "blank").when(F.col("line").startswith("%"), "skipped").otherwise("text")
    lines = lines.select("file", "block", "ln", "line", kind.alias("kind"))
    solid = F.col("kind").isin("tag", "text")
    lines = _before(
        lines,
        {
            "kind_before": F.when(solid, F.col("kind")), "ln_before": F.when(solid, F.col("ln")),
            "blank_before": F.when(F.col("kind") == "blank", F.col("ln"))
        }
    )
    apart = (F.col("kind") == "tag") | F.coalesce(F.col("blank_before") > F.col("ln_before"), F.lit(False))
    starts = solid & (F.col("kind_before").isNull() | ((F.col("kind_before") == "text") & apart))
    # a game is named by the line it starts at
    lines = lines.select("file", "block", "ln", "line", "kind", F.when(starts, F.col("ln")).alias("own"))
    lines = _before(lines, {"start": F.col("own")}).withColumn("start", F.coalesce("own", "start")).filter(solid)

    word = lambda i: F.regexp_extract(bare, _TAG_LINE, i)
    plain = F.replace(F.replace(word(2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    entry = F.when(F.col("kind") == "tag", F.struct(F.col("ln"), word(1).alias("key"), plain.alias("value")))
    moves = F.when(F.col("kind") == "text", F.struct("ln", "line"))
    # the lines of one game
    games = lines.groupBy("file", "start").agg(F.array_sort(F.collect_list(entry)).alias("tags"), F.array_sort(F.collect_list(moves)).alias("moves"))
    names = F.transform("tags", lambda e: e["key"])
    first = F.filter("tags", lambda e, i: F.array_position(names, e["key"]) == i + 1)
    games = games.select(
        "file", "start", F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"]))).alias("headers"),
        F.array_join(F.transform("moves", lambda m: m["line"]), "\n").alias("movetext")
    )
    games = with_place(games)
    tagged = [
        F.col("headers")[n].alias(c) for c,
        n in (("white", "White"), ("black", "Black"), ("result", "Result"), ("termination", "Termination"), ("fen", "FEN"))
    ]
    return games.select("file", "game_index", *tagged, "headers", "movetext")


def with_place(games: DataFrame) -> DataFrame:
    """Adds ``game_index``: the place of a game in its file, by ranges of (file, start) and what each range holds of a file."""
    spread = cut(games.repartitionByRange("file", "start").withColumn("__part", F.spark_partition_id()), "games")
    held = spread.groupBy("file", "__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("file", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("__part", "file").orderBy("start"))
    return spread.join(held, ["file", "__part"]).withColumn("game_index", inside.cast("bigint") + F.col("__shift")).drop("__part", "__shift")


def positions_in(games: DataFrame, keys: list[str], skip_first_n_plies: int = 0) -> tuple[DataFrame, DataFrame]:
    """(positions, failures), as :func:`positions_of`, of games with ``fen`` and ``movetext``, named by ``keys``."""
    named = games.select(*keys, "fen", "movetext")
    schema = games.select(*keys).schema.add("ply", "long").add("fen", "string").add("token", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, plies, fens, tokens = [], [], [], []
            for i, (fen, moves) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                played, bad = replay({"FEN": fen} if fen else {}, moves)
                rows = [
                    (ply, f, None) for ply, f in enumerate(played, 1) if ply > skip_first_n_plies
                ] if bad is None else [(len(played) + 1, None, bad)]
                at += [i] * len(rows)
                for ply, f, token in rows:
                    plies.append(ply), fens.append(f), tokens.append(token)
            cols = [c.take(pa.array(at, pa.int64())) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(plies, pa.int64()), pa.array(fens, pa.string()), pa.array(tokens, pa.string())], schema.names
            )

    out = map_arrow(named, run, schema)
    return out.filter("token is null").drop("token"), out.filter("token is not null").drop("fen")


def _with_every(docs: DataFrame, key: str, text: str, every: Column | None) -> DataFrame:
    return docs.select(key, text, (F.lit(True) if every is None else every).alias("every_section"))


def games_of(docs: DataFrame, key: str, text: str = "text", every: Column | None = None) -> DataFrame:
    """(key, game columns) of every game in a text column; null and empty texts hold none.

    Where ``every`` is false, sections without tags and legal first move are no
    games and aren't numbered.
    """
    names = [key, "game_index", "white", "black", "result", "termination", "fen", "headers"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string())]
        for b in batches:
            rows = [
                (i, *_game_row(k, h)[:-1], list(h.items())) for i, t, e in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, h,
                _ in numbered_games(t, e)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t or b.schema.field(0).type) for c, t in zip(cols, types, strict=True)], names)

    return map_arrow(_with_every(docs, key, text, every), run, f"{key} {kind}, {GAME}")


def positions_of(
    docs: DataFrame, key: str, text: str = "text", skip_first_n_plies: int = 0, every: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(positions, failures) of every game in a text column.

    Positions: (key, ``game_index``, ``ply`` from 1, ``fen``) beyond the first
    ``skip_first_n_plies`` of a game. A game with a text that names no legal
    move gives no position at all but a failure (key, ``game_index``, ``ply``,
    ``token``): a shortened game would pass for a whole one. ``every`` as in
    :func:`games_of`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for i, t, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for k, h, moves in numbered_games(t, e):
                    fens, bad = replay(h, moves)
                    if bad is not None:
                        rows.append((i, k, len(fens) + 1, None, bad))
                    else:
                        rows += [(i, k, ply, fen, None) for ply, fen in enumerate(fens, 1) if ply > skip_first_n_plies]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t2 or b.schema.field(0).type) for c, t2 in zip(zip(*rows, strict=True), types, strict=True)],
                        [key, "game_index", "ply", "fen", "token"]
                    )

    out = map_arrow(_with_every(docs, key, text, every), run, f"{key} {kind}, game_index bigint, ply bigint, fen string, token string")
    return out.filter("token is null").drop("token"), out.filter("token is not null").drop("fen")


def replays_of(docs: DataFrame, key: str, text: str = "text", every: Column | None = None) -> DataFrame:
    """(key, ``game_index``, ``positions``, ``failed_ply``, ``token``): one row for every game of a text column.

    ``positions`` is how many :func:`positions_of` gives without skipping; where
    a text names no legal move it is 0, and ``failed_ply`` and ``token`` say
    where and what.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for i, t, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, h, moves in numbered_games(t, e):
                    fens, bad = replay(h, moves)
                    rows.append((i, k, len(fens), None, None) if bad is None else (i, k, 0, len(fens) + 1, bad))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t2 or b.schema.field(0).type) for c, t2 in zip(zip(*rows, strict=True), types, strict=True)],
                    [key, "game_index", "positions", "failed_ply", "token"]
                )

    return map_arrow(_with_every(docs, key, text, every), run, f"{key} {kind}, game_index bigint, positions bigint, failed_ply bigint, token string")


def leaf_positions(spark: SparkSession, plies: int, start: str = START) -> DataFrame:
    """(``fen``) of every sequence of ``plies`` legal moves: a bag, transpositions repeat.

    The frontier is a DataFrame expanded once a ply, in parallel over its rows.
    """
    if plies < 1:
        raise ValueError("plies must be at least 1")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [p.push(m).fen() for f in b.column(0).to_pylist() for p in [Position.from_fen(f)] for m in p.legal_moves()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["fen"])

    frontier = spark.createDataFrame([(start,)], "fen string")
    for k in range(plies):
        frontier = map_arrow(frontier, expand, "fen string")
        if k == 1:
            frontier = frontier.repartition(spark.sparkContext.defaultParallelism)
    return frontier


def clean_openings(spark: SparkSession, namespace: str, plies: int, count: int) -> DataFrame:
    """The ``count`` opening keys of the smallest seeded digests among all positions ``plies`` moves from the start."""
    from plyforge.functions.boards import fen_key
    from plyforge.operators.sampling import draw_distinct

    return draw_distinct(leaf_positions(spark, plies), fen_key(F.col("fen")), namespace, count, strict=True)
