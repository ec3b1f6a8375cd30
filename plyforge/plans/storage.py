"""Queries that write, read back and must find what was written; and those of whole files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import uci
from plyforge.functions.boards import sha_label
from plyforge.operators import history, mining, reconcile, rules, sampling
from plyforge.plans.positions import sql_key, sql_words
from plyforge.plans.queries import query
from plyforge.plans.transcripts import GAMES_SQL, _rows
from plyforge.session import shared_dir, table
from plyforge.sources import files, pgn, sinks


def _place(spark: SparkSession, name: str) -> str:
    """A new place for a table or file in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A text on one line.
_FLAT = "regexp_replace(coalesce({}, ''), '[\\t\\n\\r]', ' ', 'g')"


def _flat(c: str):
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\t\n\r]", " ")


@query(f"SELECT row_number() OVER (ORDER BY position_id) + 1 AS row_number, CAST(position_id AS VARCHAR) AS position_id, {_FLAT.format('fen')} AS fen, {_FLAT.format('source')} AS source FROM positions")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Positions written as one tab-separated table and read back with the numbers of its rows."""
    at = _place(spark, "positions-tsv")
    sinks.write_tsv(
        table(spark, d, "positions").select("position_id", _flat("fen").alias("fen"), _flat("source").alias("source")), at, ["position_id"],
        ["position_id"]
    )
    return files.read_tsv_numbered(spark, at, ("position_id", "fen")).drop("file")


@query(f"SELECT CAST(position_id AS VARCHAR) AS position_id, {_FLAT.format('fen')} AS fen FROM positions")
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same as a manifest of many files, in no order."""
    at = _place(spark, "manifest-tsv")
    sinks.write_tsv(table(spark, d, "positions").select("position_id", _flat("fen").alias("fen")), at)
    return files.read_manifest(spark, at, ("position_id", "fen")).drop("file")


@query(f"SELECT position_id, {_FLAT.format('fen')} AS fen FROM positions ORDER BY position_id LIMIT 1")
def first_position(spark: SparkSession, d: str) -> DataFrame:
    return files.first_row(table(spark, d, "positions").select("position_id", _flat("fen").alias("fen")), ["position_id"])


_LINE = f"trim({_FLAT.format('fen')})"


@query(f"SELECT ln, line, {sql_key('line')} AS key FROM (SELECT row_number() OVER (ORDER BY position_id) AS ln, {_LINE} AS line FROM positions) WHERE line <> ''")
def epd_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Positions written as an opening list and read back with their keys."""
    at = _place(spark, "positions-epd")
    fen = F.regexp_replace(_flat("fen"), files.UNICODE_LINES, " ")
    sinks.write_lines(table(spark, d, "positions").select("position_id", F.trim(fen).alias("line")), at, "line", ["position_id"])
    return files.read_epd(spark, at).select("ln", "line", "key")


_LEDGER = "SELECT row_number() OVER (ORDER BY run_id, recorded_at, record_json) AS ln, record_json ->> '$.record_id' AS record_id, record_json ->> '$.run_id' AS run_id FROM records"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "ledger")
    sinks.write_lines(
        table(spark, d, "records").select("run_id", "recorded_at", "record_json"), at, "record_json",
        ["run_id", "recorded_at", "record_json"]
    )
    return files.read_jsonl(spark, at, history.LEDGER)


@query(_LEDGER)
def ledger_lines(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's lines written to a file and read back with their numbers."""
    return _ledger(spark, d).select("ln", "record.record_id", "record.run_id")


@query(f"""WITH l AS ({_LEDGER}) SELECT ln, 'repeated ' || what AS problem FROM (SELECT ln, 'run_id' AS what, row_number() OVER (PARTITION BY run_id ORDER BY ln) AS n FROM l WHERE run_id IS NOT NULL
UNION ALL SELECT ln, 'record_id', row_number() OVER (PARTITION BY record_id ORDER BY ln) FROM l WHERE record_id IS NOT NULL) WHERE n > 1 UNION ALL SELECT ln, 'missing recorded_at' FROM l""")
def ledger_faults(spark: SparkSession, d: str) -> DataFrame:
    """Why that file is no ledger: records sent twice, and a field that none of its lines has."""
    return files.ledger_problems(_ledger(spark, d), ("record_id", "run_id", "recorded_at")).drop("file")


@query("SELECT count(*) AS documents, 0::BIGINT AS problems FROM networks")
def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Every network as a JSON document in a file of its own, read whole and checked."""
    at = _place(spark, "documents")
    docs = table(spark, d, "networks").select(F.col("network_id").alias("name"), F.to_json(F.struct("*")).alias("document"))
    docs.repartition("name").write.partitionBy("name").text(at)
    read = files.read_documents(spark, at, "*.txt")
    return read.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("problem").isNotNull()).alias("problems"))


@query("""SELECT 'nets/part.txt' AS path, sha256(text) AS sha256, strlen(text) AS size_bytes FROM (SELECT string_agg(line, '' ORDER BY position_id) AS text FROM (SELECT position_id, trim(regexp_replace(coalesce(fen, ''), '[\t\n\r]', ' ', 'g')) || chr(10) AS line FROM positions))""")
def inventory_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Path, digest and size of a file that holds every position."""
    at = _place(spark, "tree")
    sinks.write_lines(table(spark, d, "positions").select("position_id", F.trim(_flat("fen")).alias("line")), f"{at}/nets", "line", ["position_id"])
    found = files.file_inventory(spark, at)
    return found.filter("path like '%.txt'").select(F.lit("nets/part.txt").alias("path"), "sha256", "size_bytes")


_STATES = ("win", "draw", "loss")


@query("""SELECT run_id, ln, CASE WHEN candidate_outcome IS NULL OR candidate_outcome NOT IN ('win', 'draw', 'loss') THEN 'unknown state' END AS problem FROM (
  SELECT run_id, candidate_outcome, row_number() OVER (PARTITION BY run_id ORDER BY game_index, candidate_outcome NULLS FIRST) AS ln FROM parsed_games) WHERE problem IS NOT NULL""")
def state_history_faults(spark: SparkSession, d: str) -> DataFrame:
    """Histories of outcomes, a file for each run, with states that aren't known."""
    at = _place(spark, "states")
    line = F.to_json(F.struct("run_id", F.col("candidate_outcome").alias("state")))
    g = table(spark, d, "parsed_games").select(F.col("run_id").alias("file_run"), "game_index", "candidate_outcome", line.alias("line"))
    g.repartition("file_run").sortWithinPartitions(
        "file_run", "game_index", "candidate_outcome"
    ).select("file_run", "line").write.partitionBy("file_run").text(at)
    lines = files.read_jsonl(spark, at, "run_id string, state string")
    run = F.regexp_extract("file", "file_run=([^/]*)/", 1)
    # the folder names the run here
    named = lines.withColumn("folder", F.concat(F.lit("/"), run, F.lit(".jsonl"))).select(F.col("folder").alias("file"), "ln", "record", "problem")
    return files.state_problems(named, _STATES).select(F.regexp_extract("file", "/(.*)[.]jsonl", 1).alias("run_id"), "ln", "problem")


_TWICE = "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY intake_no {0}, position_id {0}) AS n FROM positions WHERE source IS NOT NULL AND intake_no IS NOT NULL)"


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positions").filter("source is not null and intake_no is not null").select("source", "intake_no", "position_id")


@query(f"SELECT source, intake_no, position_id FROM {_TWICE.format('')} WHERE n = 1")
def inserted_once(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries inserted by source: what is stored stays."""
    at, p = _place(spark, "inserted"), _by_source(spark, d)
    for part in ("intake_no <= 6", "intake_no > 3"):
        sinks.insert_new(p.filter(part), at, ["source"], ["intake_no", "position_id"])
    return sinks.stored(spark, at)


@query(f"SELECT source, intake_no, position_id FROM {_TWICE.format('DESC')} WHERE n = 1")
def upserted_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries upserted by source, the later first: the latest stays."""
    at, p = _place(spark, "upserted"), _by_source(spark, d)
    for part in ("intake_no > 3", "intake_no <= 6"):
        sinks.upsert_latest(p.filter(part), at, ["source"], ["intake_no", "position_id"])
    return sinks.stored(spark, at)


@query("SELECT e.extract_id FROM extracted_positions e WHERE e.source IN (SELECT source FROM positions WHERE split = 'train')")
def surviving_children(spark: SparkSession, d: str) -> DataFrame:
    """Rows of games whose source is still stored."""
    kept = table(spark, d, "positions").filter("split = 'train'").select("source").distinct()
    return sinks.surviving_children(table(spark, d, "extracted_positions"), kept, ["source"]).select("extract_id")


@query("SELECT position_id, intake_no, CASE WHEN intake_no >= 7 THEN 2 ELSE 1 END AS version FROM positions WHERE intake_no IS NOT NULL")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of the later intakes written again; the others stay."""
    at = _place(spark, "partitions")
    p = table(spark, d, "positions").filter("intake_no is not null").select("position_id", "intake_no")
    sinks.replace_partitions(p.withColumn("version", F.lit(1)), at, ["intake_no"])
    sinks.replace_partitions(p.filter("intake_no >= 7").withColumn("version", F.lit(2)), at, ["intake_no"])
    return sinks.stored(spark, at).select("position_id", "intake_no", "version")


@query("SELECT record_id, min(run_id) AS run_id FROM records GROUP BY 1")
def appended_records(spark: SparkSession, d: str) -> DataFrame:
    """The ledger appended twice; no record is stored twice."""
    at = _place(spark, "appended")
    r = table(spark, d, "records").groupBy("record_id").agg(F.min("run_id").alias("run_id"))
    for _ in range(2):
        sinks.append_records(r, at)
    sinks.create_immutable(r, at, ["record_id"])
    return sinks.stored(spark, at)


@query("""SELECT 'whole' AS which, count(*) AS records, true AS count_agrees, true AS version_agrees FROM records
UNION ALL SELECT 'once', count(DISTINCT record_json ->> '$.record_id'), count(DISTINCT record_json ->> '$.record_id') = (SELECT count(*) FROM records), false FROM records""")
def index_self_check(spark: SparkSession, d: str) -> DataFrame:
    """An index rebuilt from the ledger against the metadata stored with it; and one without repeats, of another version."""
    at = _place(spark, "index")
    flat = history.flatten(table(spark, d, "records"), "record_json")
    sinks.rebuild_index(flat, at, "v1")
    meta = sinks.stored(spark, at + "_metadata")
    whole = history.index_agrees(sinks.stored(spark, at), meta, "v1").select(F.lit("whole").alias("which"), "*")
    once = history.index_agrees(flat.select("record_id").distinct(), meta, "v2").select(F.lit("once").alias("which"), "*")
    return whole.unionByName(once)


@query("""SELECT run_id, CASE WHEN candidate_outcome IS NULL THEN CASE WHEN result IS NULL THEN 'no_legal_moves' ELSE 'ok' END ELSE 'error' END AS status, count(*) AS n FROM parsed_games GROUP BY 1, 2""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Final states of jobs, on games: an outcome stands for an error text, a result for a best move."""
    jobs = table(spark, d, "parsed_games").select("run_id", F.col("candidate_outcome").alias("error_text"), F.col("result").alias("bestmove"))
    return sinks.finished_jobs(jobs).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH src AS (SELECT 1 AS doc_id, true AS every, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text <> ''), {GAMES_SQL}
SELECT CAST(game_index AS BIGINT) AS game_index, white, black, result, termination, fen, length(coalesce(movetext, '')) AS n_chars FROM games""")
def pgn_file_games(spark: SparkSession, d: str) -> DataFrame:
    """All texts written into one file and read as games, in splits."""
    at = _place(spark, "pgn")
    sinks.write_lines(table(spark, d, "documents").filter("text <> ''"), at, "text", ["doc_id"])
    games = pgn.read_games(spark, at)
    return games.select("game_index", "white", "black", "result", "termination", "fen", F.length("movetext").alias("n_chars"))


@query("SELECT * FROM (VALUES (1, 20::BIGINT), (2, 400), (3, 8902)) t(plies, leaves)")
def leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many sequences of legal moves there are from the start; the numbers are well known."""
    each = [pgn.leaf_positions(spark, k).agg(F.lit(k).alias("plies"), F.count(F.lit(1)).alias("leaves")) for k in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


_LINES = r"""(SELECT doc_id, ln, lines[ln] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS ln FROM
  (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS lines FROM documents WHERE text <> '')))"""
_SCORE = r"TRY_CAST(nullif(regexp_extract(line, '^[ \t\n\x0b\f\r]*NNUE evaluation[ \t\n\x0b\f\r]+([+-]?[0-9]+)[ \t\n\x0b\f\r]+\(side to move, internal units\)[ \t\n\x0b\f\r]*$', 1), '') AS BIGINT)"


@query(f"""SELECT doc_id, CASE WHEN c THEN 'in_check' WHEN s IS NULL THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN NOT c THEN s END AS score_raw_stm
FROM (SELECT doc_id, arg_max({_SCORE}, ln) FILTER (WHERE {_SCORE} IS NOT NULL) AS s, bool_or(starts_with(ltrim(line), 'Final evaluation: none')) AS c FROM {_LINES} GROUP BY 1)""")
def static_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """What each text says as the transcript of a static evaluation."""
    return files.static_results(files.lines_of(table(spark, d, "documents"), "doc_id"), ["doc_id"])


@query("SELECT position_id, nullif(trim(fen), '') AS fen FROM positions WHERE NOT regexp_matches(coalesce(fen, ''), '[\n\r\x0b\f]')")
def displayed_positions(spark: SparkSession, d: str) -> DataFrame:
    """The position that a display transcript shows, for transcripts made from positions."""
    p = table(spark, d, "positions").filter(~F.coalesce("fen", F.lit("")).rlike("[\n\r\u000b\f]"))
    text = F.concat(F.lit("+---+\nFen: "), F.coalesce("fen", F.lit("")), F.lit("\nKey: 1\nFen: later\n"))
    shown = files.displayed_positions(files.lines_of(p.select("position_id", text.alias("text")), "position_id"), ["position_id"])
    return shown.select("position_id", F.nullif("fen", F.lit("")).alias("fen"))


@query("SELECT position_id, CASE WHEN side_to_move = 'w' THEN original_score_value WHEN side_to_move IS NOT NULL THEN -original_score_value END AS score FROM positions")
def root_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores seen from White."""
    return table(spark, d, "positions").select(
        "position_id", uci.root_score(F.col("original_score_value"), F.col("side_to_move"), F.lit("w")).alias("score")
    )


@query("""SELECT doc_id, ln FROM (SELECT doc_id, ln, string_split(line, chr(9)) AS r FROM """ + _LINES + """) WHERE len(r) = 6 AND r[2] = 'cp' AND r[4] = 'exact' AND r[5] NOT IN ('', '(none)', '0000')""")
def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rescored rows in texts that are fit for a corpus."""
    return rules.usable_rows(_rows(table(spark, d, "documents"))).select("doc_id", "ln")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN coalesce(text, '') = '' THEN 'missing' WHEN lang IS NULL THEN 'extra' ELSE 'size' END AS status,
  CASE WHEN lang IS NOT NULL THEN sha256(text) END AS expected_sha256, CASE WHEN text <> '' THEN sha256(text) END AS actual_sha256
FROM documents WHERE NOT (coalesce(text, '') = '' AND lang IS NULL) AND (coalesce(text, '') = '' OR lang IS NULL OR n_chars <> strlen(text))""")
def manifest_against_disk(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files: those with a language are listed, by digest and number of characters; those with bytes are there."""
    docs = table(spark, d, "documents")
    named = docs.select(
        F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "lang", "n_chars",
        F.octet_length("text").cast("bigint").alias("bytes")
    )
    listed = named.filter("lang is not null").select("path", "sha256", F.col("n_chars").alias("size_bytes"))
    return reconcile.file_diff(listed, named.filter("bytes > 0").select("path", "sha256", F.col("bytes").alias("size_bytes")))


@query("SELECT 'sha256_mismatch' AS problem, CAST(doc_id AS VARCHAR) AS path FROM documents WHERE text IS NOT NULL AND trim(text, chr(9) || chr(10) || chr(13) || ' ') <> text")
def transport_bytes(spark: SparkSession, d: str) -> DataFrame:
    """A sound set of files, some of which lost blank bytes at their ends on the way."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    sent = docs.select("path", F.sha2("text", 256).alias("sha256"))
    got = docs.select("path", F.sha2(F.btrim("text", F.lit("\t\n\r ")), 256).alias("sha256"))
    return reconcile.transport_problems(sent, got, sent)


@query("""SELECT record_id, run_id, array_to_string(list_sort(list_filter(['record_id', 'run_id', 'arm_id'], lambda k: NOT list_contains(json_keys(record_json), k))), ',') AS missing,
  array_to_string(list_sort(list_filter(json_keys(record_json), lambda k: k NOT IN ('record_id', 'run_id', 'arm_id'))), ',') AS unexpected FROM records""")
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the index documents lack or have besides those asked for."""
    r = table(spark, d, "records").select(
        "record_id", "run_id", reconcile.key_set_problems(F.json_object_keys("record_json"), ["record_id", "run_id", "arm_id"]).alias("p")
    )
    return r.select("record_id", "run_id", F.array_join("p.missing", ",").alias("missing"), F.array_join("p.unexpected", ",").alias("unexpected"))


@query(f"SELECT source AS family, row_number() OVER (ORDER BY first, source) AS family_no, first AS extract_id FROM (SELECT source, min(extract_id) AS first FROM extracted_positions WHERE source IS NOT NULL GROUP BY 1)")
def families_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order in which their first row stands."""
    return sampling.families_in_order(table(spark, d, "extracted_positions"), F.col("source"), ["extract_id"])


@query("""SELECT run_id, count(*) AS rows_seen, count(*) = count(game_index) AND bool_and(game_index = n) AS in_order FROM (
  SELECT run_id, game_index, row_number() OVER (PARTITION BY run_id ORDER BY white NULLS FIRST, black NULLS FIRST, game_index NULLS FIRST) AS n FROM (SELECT DISTINCT run_id, white, black, game_index FROM parsed_games)) GROUP BY 1""")
def games_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether games listed by player stand in the order of their numbers."""
    g = table(spark, d, "parsed_games").select("run_id", "white", "black", "game_index").distinct()
    return history.sequence_in_order(g, ["run_id"], ["white", "black", "game_index"], "game_index")


@query("""SELECT opponent_id, row_number() OVER (PARTITION BY opponent_id ORDER BY recorded_at, run_id, record_id) AS place, run_id, recorded_at, elo_value, elo_ci_low, elo_ci_high, verdict FROM (
  SELECT DISTINCT opponent_id, recorded_at, run_id, record_id, elo_value, elo_ci_low, elo_ci_high, verdict FROM records)""")
def series_points(spark: SparkSession, d: str) -> DataFrame:
    """Every record of every series, in order."""
    r = table(spark, d, "records").select(
        "opponent_id", "recorded_at", "run_id", "record_id", "elo_value", "elo_ci_low", "elo_ci_high", "verdict"
    ).distinct()
    return history.series_points(r, ["opponent_id"])


_MOVES = "SELECT DISTINCT run_id, CASE WHEN candidate_role = 'white' THEN white ELSE black END AS a, CASE WHEN candidate_role = 'white' THEN black ELSE white END AS b FROM parsed_games"


@query(f"SELECT run_id, array_to_string(list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda m: m IS NOT NULL), ' | ') AS moves FROM ({_MOVES})")
def both_best_moves(spark: SparkSession, d: str) -> DataFrame:
    """The distinct ones of two choices, the candidate's first; players stand for moves."""
    white = F.col("candidate_role") == "white"
    g = table(spark, d, "parsed_games").select(
        "run_id", F.when(white, F.col("white")).otherwise(F.col("black")).alias("a"),
        F.when(white, F.col("black")).otherwise(F.col("white")).alias("b")
    ).distinct()
    return g.select("run_id", F.array_join(mining.probe_moves(F.col("a"), F.lit(None).cast("array<string>"), F.col("b")), " | ").alias("moves"))


def _sql_sha(c: str) -> str:
    from plyforge.plans.evidence import _sql_sha as sha

    return sha(c)


_ENTRIES = f"""SELECT coalesce(role_hint, '') AS file, row_number() OVER (PARTITION BY coalesce(role_hint, '') ORDER BY network_id) AS line_no, {_sql_sha('sha256')} AS sha256, path FROM networks WHERE path IS NOT NULL AND sha256 IS NOT NULL"""


@query(f"""WITH e AS ({_ENTRIES}), s AS (SELECT *, regexp_full_match(sha256, '[0-9a-f]{{64}}') AS fits FROM e),
w AS (SELECT file, line_no, CASE WHEN fits THEN sha256 END AS sha256, CASE WHEN fits THEN path END AS listed_path FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY file, listed_path ORDER BY line_no) AS n, max(listed_path) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT file, line_no, sha256, listed_path, CASE WHEN listed_path IS NULL THEN 'grammar' WHEN n > 1 THEN 'duplicate' WHEN listed_path < before THEN 'order' END AS problem FROM o""")
def checksum_entries(spark: SparkSession, d: str) -> DataFrame:
    """Checksum lists of each role's networks, in the order of their numbers, read and checked line by line."""
    n = table(spark, d, "networks").filter("path is not null and sha256 is not null").select(
        F.coalesce("role_hint", F.lit("")).alias("path"), "network_id",
        F.concat(sha_label(F.col("sha256")), F.lit("  "), "path").alias("line")
    )
    # a role's networks are few
    lists = n.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("network_id", "line"))), lambda x: x["line"]), "\n").alias("content")
    )
    return reconcile.checksum_lines(lists)
