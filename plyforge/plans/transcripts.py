"""Queries over engine transcripts, rescored listings and game texts inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions import uci
from plyforge.operators import snapshots
from plyforge.plans.positions import WS, sql_words
from plyforge.plans.queries import query
from plyforge.session import table
from plyforge.sources import files, pgn

_LINES = r"""SELECT doc_id, ln, lines[ln] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS ln FROM
  (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS lines FROM documents WHERE text <> ''))"""
_TOKENS = f"SELECT doc_id, ln, line, {sql_words('line')} AS t FROM ({_LINES})"


def _after(name: str, plus: int = 1) -> str:
    return f"CASE WHEN list_contains(t, '{name}') THEN t[list_position(t, '{name}') + {plus}] END"


def _long(name: str, plus: int = 1) -> str:
    return f"TRY_CAST({_after(name, plus)} AS BIGINT)"


_TAIL = "list_slice(t, list_position(t, 'score') + 3, len(t))"
_BOUND = f"CASE WHEN list_contains({_TAIL}, 'lowerbound') THEN 'lowerbound' WHEN list_contains({_TAIL}, 'upperbound') THEN 'upperbound' ELSE 'exact' END"
_PV = "list_slice(t, list_position(t, 'pv') + 1, len(t))"
_INFO = f"""SELECT doc_id, ln, CASE WHEN {_long('multipv')} IS NULL OR {_long('multipv')} = 0 THEN 1 ELSE {_long('multipv')} END AS rank, {_after('score')} AS score_type, {_long('score', 2)} AS score_value, {_BOUND} AS bound,
  {_long('wdl')} AS wdl_w, {_long('wdl', 2)} AS wdl_d, {_long('wdl', 3)} AS wdl_l, {', '.join(f'{_long(token)} AS {name}' for name, token in uci.NUMBERS.items())}, ({_PV})[1] AS move, array_to_string({_PV}, ' ') AS pv
FROM ({_TOKENS}) WHERE t[1] = 'info' AND list_contains(t, 'score') AND list_contains(t, 'pv') AND {_after('score')} IN ('cp', 'mate') AND {_long('score', 2)} IS NOT NULL
  AND (NOT list_contains(t, 'wdl') OR ({_long('wdl')} IS NOT NULL AND {_long('wdl', 2)} IS NOT NULL AND {_long('wdl', 3)} IS NOT NULL))"""


def _lines(spark: SparkSession, d: str, word: str) -> DataFrame:
    """Lines of every text that hold what a reader can't do without: transcripts also stand in mixed notes, and the readers decide by line."""
    return files.lines_with(table(spark, d, "documents"), "doc_id", word)


def _infos(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "ln", uci.mining_info(F.col("line")).alias("i")).filter("i is not null").select("doc_id", "ln", "i.*")


@query(_INFO)
def search_infos(spark: SparkSession, d: str) -> DataFrame:
    return _infos(_lines(spark, d, "info"))


_TEXT = lambda x: f"coalesce({x}, '')"


_RESCORE = f"""SELECT doc_id, ln, {_after('score')} AS sf_score_type, {_after('score', 2)} AS sf_score, {_BOUND} AS sf_bound, {', '.join(f'{_TEXT(_after(token))} AS sf_{name}' for name, token in uci.NUMBERS.items())},
  {', '.join(f"coalesce(CASE WHEN {_after('wdl', 3)} IS NOT NULL THEN {_after('wdl', k + 1)} END, '') AS sf_wdl_{x}" for k, x in enumerate('wdl'))}, coalesce(CASE WHEN list_contains(t, 'pv') THEN array_to_string({_PV}, ' ') END, '') AS sf_pv
FROM ({_TOKENS}) WHERE line LIKE 'info %' AND line NOT LIKE 'info string%' AND {_after('score')} IN ('cp', 'mate') AND {_after('score', 2)} IS NOT NULL
  AND {' AND '.join(f"(NOT list_contains(t, '{token}') OR {_after(token)} IS NOT NULL)" for token in uci.NUMBERS.values())}"""


def _rescored(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "ln", uci.rescore_info(F.col("line")).alias("i")).filter("i is not null").select("doc_id", "ln", "i.*")


@query(_RESCORE)
def rescore_infos(spark: SparkSession, d: str) -> DataFrame:
    return _rescored(_lines(spark, d, "info"))


_ENDS = f"""SELECT doc_id, ln, CASE WHEN t[2] NOT IN ('(none)', '0000') THEN t[2] END AS bestmove, CASE WHEN t[3] = 'ponder' AND t[4] NOT IN ('(none)', '0000') THEN t[4] END AS ponder FROM ({_TOKENS}) WHERE t[1] = 'bestmove'"""


def _ends(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "ln", uci.best_move(F.col("line")).alias("b")).filter("b is not null").select("doc_id", "ln", "b.*")


@query(_ENDS)
def best_moves(spark: SparkSession, d: str) -> DataFrame:
    return _ends(_lines(spark, d, "bestmove"))


_LAST = f"""SELECT doc_id, rank, coalesce(arg_max(ln, ln) FILTER (WHERE bound = 'exact'), max(ln)) AS ln, coalesce(arg_max(score_value, ln) FILTER (WHERE bound = 'exact'), arg_max(score_value, ln)) AS score_value,
  coalesce(arg_max(move, ln) FILTER (WHERE bound = 'exact'), arg_max(move, ln)) AS move FROM ({_INFO}) GROUP BY doc_id, rank"""


@query(_LAST)
def last_exact_infos(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.last_exact(search_infos(spark, d), ["doc_id", "rank"]).select("doc_id", "rank", "ln", "score_value", "move")


_PICKED = f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN sf_bound = 'exact' THEN 0 ELSE 1 END, ln DESC) AS k FROM ({_RESCORE})), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln DESC) AS k FROM ({_ENDS}))
SELECT coalesce(i.doc_id, e.doc_id) AS doc_id, i.* EXCLUDE (doc_id, ln, k, pv), coalesce(pv[1], CASE WHEN coalesce(len(pv), 0) = 0 THEN e.bestmove END, '') AS sf_bestmove, coalesce(pv[2], CASE WHEN coalesce(len(pv), 0) = 0 THEN e.ponder END, '') AS sf_ponder
FROM (SELECT *, list_filter(string_split(sf_pv, ' '), lambda m: m <> '') AS pv FROM i WHERE k = 1) i FULL JOIN (SELECT * FROM e WHERE k = 1) e ON i.doc_id = e.doc_id"""


@query(_PICKED)
def picked_results(spark: SparkSession, d: str) -> DataFrame:
    """What a rescoring of each text with a transcript would report."""
    return snapshots.picked_result(rescore_infos(spark, d), best_moves(spark, d), ["doc_id"])


_JOBS = """SELECT l_orderkey AS job, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ln, 1 + l_linenumber % 2 AS rank, CAST(floor(l_quantity / 26) AS BIGINT) AS depth,
  CASE l_returnflag WHEN 'R' THEN 'lowerbound' ELSE 'exact' END AS bound, l_partkey AS move, CAST(2 AS BIGINT) AS expected FROM lineitem"""


def transcripts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Order lines read as search output: two ranks, two depths, some bounds."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.row_number().over(w).cast("bigint").alias("ln"), (1 + F.col("l_linenumber") % 2).cast("bigint").alias("rank"), F.floor(F.col("l_quantity") / 26).alias("depth"),
        F.when(
            F.col("l_returnflag") == "R", "lowerbound"
        ).otherwise("exact").alias("bound"), F.col("l_partkey").alias("move"), F.lit(2).cast("bigint").alias("expected"),
    )


@query(f"""WITH i AS ({_JOBS}), r AS (SELECT *, sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ln) AS rd FROM i),
h AS (SELECT *, first_value(depth) OVER w AS d1, first_value(bound) OVER w AS b1 FROM r WINDOW w AS (PARTITION BY job, rd ORDER BY ln)),
q AS (SELECT job, rd, rank, max(ln) AS ln, arg_max(move, ln) AS move FROM h WHERE rd > 0 AND bound = 'exact' AND b1 = 'exact' AND depth = d1 GROUP BY 1, 2, 3),
c AS (SELECT job, max(rd) AS rd FROM (SELECT job, rd FROM q GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1)
SELECT q.job, q.rank, q.ln, q.move, CAST(q.rd AS BIGINT) AS round FROM q JOIN c ON q.job = c.job AND q.rd = c.rd
UNION ALL SELECT job, rank, coalesce(max(ln) FILTER (WHERE bound = 'exact'), max(ln)), coalesce(arg_max(move, ln) FILTER (WHERE bound = 'exact'), arg_max(move, ln)), NULL FROM i WHERE job NOT IN (SELECT job FROM c) GROUP BY 1, 2""")
def coherent_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.coherent_snapshot(transcripts_of_orders(spark, d), ["job"]).select("job", "rank", "ln", "move", "round")


_ROWS = r"""SELECT doc_id, ln, r[1] AS fen, r[2] AS sf_score_type, r[3] AS sf_score, r[4] AS sf_bound, r[5] AS sf_bestmove, r[6] AS sf_depth FROM (
  SELECT doc_id, ln, string_split(lines[ln], chr(9)) AS r FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS ln FROM
  (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS lines FROM documents WHERE text <> ''))) WHERE len(r) = 6 AND r[2] IN ('cp', 'mate')"""


def _rows(docs: DataFrame) -> DataFrame:
    lines = files.lines_with(docs, "doc_id", "\t").withColumn("r", F.split("line", "\t"))
    names = ("fen", "sf_score_type", "sf_score", "sf_bound", "sf_bestmove", "sf_depth")
    return lines.filter((F.size("r") == 6) & F.get("r", F.lit(1)).isin("cp", "mate")).select(
        "doc_id", "ln", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


@query(_ROWS)
def rescored_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "documents"))


_BARE = f"regexp_replace(regexp_replace(line, '^{WS}', ''), '{WS}$', '')"
_TAG = r"(?s)\[\s*([A-Za-z0-9][A-Za-z0-9_+#=:-]*)\s+\"(.*)\"\s*\]"
_FIRST = "|".join([*(f"{c}?2?[x-]?{c}[34]" for c in "abcdefgh"), "Nb?1?[x-]?[ac]3", "Ng?1?[x-]?[fh]3"])
_VALUE = "replace(replace(regexp_extract(bare, '{tag}', 2), chr(92) || '\"', '\"'), chr(92) || chr(92), chr(92))".replace("{tag}", _TAG)
_HEADER = lambda name, column: f"arg_min(value, ln) FILTER (WHERE kind = 'tag' AND name = '{name}') AS {column}"
#: Games of ``src`` (doc_id, every, text), by what each line is and what stood before it.
GAMES_SQL = rf"""gl AS (SELECT doc_id, every, ln, lines[ln] AS line FROM (SELECT doc_id, every, lines, unnest(range(1, len(lines) + 1)) AS ln FROM (SELECT doc_id, every, regexp_split_to_array(text, '\r\n|\n|\r') AS lines FROM src WHERE text <> ''))),
ga AS (SELECT *, regexp_extract(line, '(?s).*([{{}}])', 1) AS brace, regexp_full_match(bare, '{_TAG}') AS tagged FROM (SELECT *, {_BARE} AS bare FROM gl)),
gb AS (SELECT *, coalesce(last_value(CASE WHEN brace = '}}' THEN 0 WHEN brace = '{{' AND NOT tagged AND NOT starts_with(line, '%') THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM ga),
gc AS (SELECT *, CASE WHEN inside = 1 THEN 'text' WHEN tagged THEN 'tag' WHEN bare = '' THEN 'blank' WHEN starts_with(line, '%') THEN 'skipped' ELSE 'text' END AS kind FROM gb),
gd AS (SELECT *, count(*) FILTER (WHERE kind = 'blank') OVER (PARTITION BY doc_id ORDER BY ln) AS blanks FROM gc),
ge AS (SELECT *, lag(kind) OVER w AS kb, lag(blanks) OVER w AS bb FROM gd WHERE kind IN ('tag', 'text') WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
gf AS (SELECT *, sum(CASE WHEN kb IS NULL OR (kb = 'text' AND (kind = 'tag' OR blanks > bb)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS g, CASE WHEN kind = 'tag' THEN regexp_extract(bare, '{_TAG}', 1) END AS name, CASE WHEN kind = 'tag' THEN {_VALUE} END AS value FROM ge),
gg AS (SELECT doc_id, every, g, bool_or(kind = 'tag') AS tags, {', '.join(_HEADER(n, c) for n, c in (('White', 'white'), ('Black', 'black'), ('Result', 'result'), ('Termination', 'termination'), ('FEN', 'fen')))}, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE kind = 'text') AS movetext FROM gf GROUP BY 1, 2, 3),
gh AS (SELECT *, regexp_extract_all(coalesce(movetext, ''), '\{{[^}}]*\}}?|;[^\n]*|[()]|\$[0-9]+|[0-9]+\.+|[^\s{{}}();]+') AS tok FROM gg),
gi AS (SELECT *, list_filter(range(1, len(tok) + 1), lambda i: NOT regexp_matches(tok[i], '^[{{;$()]') AND NOT regexp_full_match(tok[i], '[0-9]+\.+|[!?]+') AND len(list_filter(tok[:i], lambda x: x = '(')) <= len(list_filter(tok[:i], lambda x: x = ')')))[1] AS head FROM gh WHERE every OR tags OR len(tok) < 40000),
games AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS game_index FROM gi WHERE every OR tags OR regexp_full_match(regexp_replace(tok[head], '[+#!?]+$', ''), '{_FIRST}'))"""
_PGN = f"WITH src AS (SELECT doc_id, coalesce(doc_kind = 'pgn', false) AS every, text FROM documents), {GAMES_SQL}"


def _every() -> Column:
    """In game texts every section counts as a game, in others one with tags or a legal first move."""
    return F.coalesce(F.col("doc_kind") == "pgn", F.lit(False))


@query(f"{_PGN} SELECT doc_id, game_index, white, black, result, termination, fen FROM games")
def pgn_headers(spark: SparkSession, d: str) -> DataFrame:
    """Every game in the texts with its headers."""
    return pgn.games_of(table(spark, d, "documents"), "doc_id", every=_every()).drop("headers")


@query()
def pgn_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every position played in the games of the texts, from the first ply; games that can't be replayed are told in ``pgn_replays``."""
    return pgn.positions_of(table(spark, d, "documents"), "doc_id", skip_first_n_plies=0, every=_every())[0]


@query()
def pgn_replays(spark: SparkSession, d: str) -> DataFrame:
    """Of every game in the texts: how many positions it gives, or at which ply and text its replay fails."""
    return pgn.replays_of(table(spark, d, "documents"), "doc_id", every=_every())


@query("SELECT 'told' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'plies', 0 UNION ALL SELECT 'games', 0")
def pgn_check(spark: SparkSession, d: str) -> DataFrame:
    """How often games are told wrongly: replays that don't agree with the positions, plies that don't run from 1 on, headers without replay."""
    docs = table(spark, d, "documents")
    good, bad = pgn.positions_of(docs, "doc_id", every=_every())
    replays = pgn.replays_of(docs, "doc_id", every=_every())
    games = pgn.games_of(docs, "doc_id", every=_every()).select("doc_id", "game_index")
    by = ["doc_id", "game_index"]
    seen = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ply").alias("lo"), F.max("ply").alias("hi"), F.countDistinct("ply").alias("k"))
    told = replays.join(seen, by, "full").join(bad.groupBy(*by).agg(F.count(F.lit(1)).alias("failures")), by, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wrong = F.col("positions").isNull() | (F.col("positions") != zero("n")) | (zero("failures") != F.when(F.col("token").isNull(), 0).otherwise(1))
    rule = lambda df, name, c: df.agg(F.lit(name).alias("rule"), F.count_if(c).alias("violations"))
    plies = rule(seen, "plies", (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("k") != F.col("n")))
    lost = games.select(*by, F.lit(1).alias("g")).join(replays.select(*by, F.lit(1).alias("r")), by, "full")
    return rule(told, "told", wrong).unionByName(plies).unionByName(rule(lost, "games", F.col("g").isNull() | F.col("r").isNull()))


@query()
def leaf_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings drawn from all positions three moves from the start."""
    return pgn.clean_openings(spark, "openings-v1", 3, 500)
