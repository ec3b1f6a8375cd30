"""Queries of the strict loader (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyforge.functions.vocabulary import EXCLUSION_CODES, RESULTS, UNRESOLVED
from plyforge.operators.strict_rows import COLUMNS, bad_lines, load_lines
from plyforge.plans.queries import query
from plyforge.session import table


_COLUMN = '("([^"]|"")*"|[^",]*)'
_STRIP = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}]+"
_VALUE = f"""nullif(regexp_replace(regexp_replace(CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END, '^{_STRIP}', ''), '{_STRIP}$', ''), '')"""
_READ = f"""SELECT line_id, sound, len(raw) AS n, list_transform(raw, lambda c: {_VALUE}) AS v FROM (SELECT line_id, sound, list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)'), lambda m: substr(m, 2)) AS raw
  FROM (SELECT line_id, coalesce(line, '') AS line, regexp_full_match(coalesce(line, ''), '{_COLUMN}(,{_COLUMN})*') AS sound FROM game_lines))"""
_BOARD = "string_split(w[1], '/')"
_SQUARES = "list_sum(list_transform(regexp_extract_all(r, '.'), lambda x: CASE WHEN x BETWEEN '1' AND '8' THEN CAST(x AS INTEGER) ELSE 1 END))"
_FEN = f"""(v[6] IS NULL OR (len(w) >= 4 AND w[2] IN ('w', 'b') AND len({_BOARD}) = 8 AND len(list_filter({_BOARD}, lambda r: regexp_full_match(r, '[1-8KQRBNPkqrbnp]+') AND {_SQUARES} = 8)) = 8))"""
_LIST = lambda names: ", ".join(f"'{x}'" for x in names)
_GOOD = f"""(v[1] IS NOT NULL AND regexp_full_match(v[1], '0*[1-9][0-9]*') AND (v[4] IS NULL OR v[4] IN ({_LIST((*RESULTS, UNRESOLVED))})) AND {_FEN} AND (v[10] IS NULL OR trim(split_part(v[10], ':', 1)) IN ({_LIST(EXCLUSION_CODES)})))"""
_LINES = f"SELECT *, list_filter(regexp_split_to_array(coalesce(v[6], ''), '{_STRIP}'), lambda x: x <> '') AS w FROM ({_READ})"


@query(f"SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 10 THEN 'columns' ELSE 'value' END AS reason FROM ({_LINES}) WHERE NOT (sound AND n = 10 AND {_GOOD})")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_lines(table(spark, d, "game_lines")).select("line_id", "reason")


@query(f"SELECT line_id, CAST(v[1] AS BIGINT) AS game_index, {', '.join(f'v[{i}] AS {c}' for i, c in enumerate(COLUMNS, 1) if i > 1)} FROM ({_LINES}) WHERE sound AND n = 10 AND {_GOOD}")
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "game_lines"))
