"""SQL that must give the same rows as the queries it is named after; by other means where there are any."""

from __future__ import annotations

#: The white space of Python's str.strip() in DuckDB's pattern syntax.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_RANK = "[1-8KQRBNPkqrbnp]{1,8}"


def label(c: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace({c}, '^{WS}', ''), '{WS}$', '')), '')"


def _expanded(c: str) -> str:
    for n in range(8, 0, -1):
        c = f"replace({c}, '{n}', '{'.' * n}')"
    return c


def parsed(table: str, columns: str, half: str = "NULL", full: str = "NULL") -> str:
    """Rows with the record that ``fen`` spells, read word by word."""
    named = lambda a, b: f"coalesce(list_position(l, '{a}'), list_position(l, '{b}'), 0)"
    after = lambda p: f"CASE WHEN {p} > 0 THEN TRY_CAST(l[{p} + 1] AS INTEGER) END"
    ph, pf = named("halfmove", "hmvc"), named("fullmove", "fmvn")
    return f"""(SELECT {columns}, replace(x, '/', '') AS board, side, CASE WHEN r IS NULL THEN '-' ELSE concat(CASE WHEN contains(r, 'K') THEN 'K' END, CASE WHEN contains(r, 'Q') THEN 'Q' END, CASE WHEN contains(r, 'k') THEN 'k' END, CASE WHEN contains(r, 'q') THEN 'q' END) END AS rights,
  coalesce(ep, '-') AS ep, coalesce(CASE WHEN {ph} = 0 AND {pf} = 0 THEN TRY_CAST(n[1] AS INTEGER) ELSE {after(ph)} END, {half}) AS h, coalesce(CASE WHEN {ph} = 0 AND {pf} = 0 THEN TRY_CAST(n[2] AS INTEGER) ELSE {after(pf)} END, {full}) AS f
FROM (SELECT *, list_filter(l, lambda w: w IN ('w', 'b'))[1] AS side, list_filter(t, lambda w: regexp_full_match(w, '[KQkq]{{1,4}}'))[1] AS r, list_filter(l, lambda w: regexp_full_match(w, '[a-h][1-8]'))[1] AS ep, list_filter(t, lambda w: regexp_full_match(w, '[0-9]+')) AS n, {_expanded('b')} AS x
FROM (SELECT *, list_transform(t, lambda w: lower(w)) AS l FROM (SELECT *, regexp_extract_all(replace(fen, b, ' '), '[A-Za-z0-9]+') AS t
FROM (SELECT *, regexp_extract(fen, '(^|[^A-Za-z0-9/])({_RANK}(/{_RANK}){{7}})($|[^A-Za-z0-9/])', 2) AS b FROM {table}) WHERE b <> '')))
WHERE side IS NOT NULL AND regexp_full_match(x, '[.KQRBNPkqrbnp]{{8}}(/[.KQRBNPkqrbnp]{{8}}){{7}}'))"""


_SIDES = f"SELECT position_id, board, side, {label('split')} AS split FROM {parsed('positions', 'position_id, split')}"
P2_FOUND = f"""WITH r AS ({_SIDES}) SELECT least(a.position_id, b.position_id) AS position_id_a, greatest(a.position_id, b.position_id) AS position_id_b
FROM r a JOIN r b ON a.side = b.side AND a.split IN ('val', 'challenge', 'fresh') AND b.split = 'train' WHERE hamming(a.board, b.board) <= 2"""

P2_REPORT = f"""WITH r AS (SELECT position_id, board, side, {label('split')} AS split, coalesce({label('source')}, '') AS source FROM {parsed('positions', 'position_id, split, source')})
SELECT a.split, a.source, count(DISTINCT a.position_id) AS rows_hit, count(*) AS pairs, count(*) FILTER (WHERE a.board = b.board) AS exact_pairs
FROM r a JOIN r b ON a.side = b.side AND a.split IN ('val', 'challenge', 'fresh') AND b.split = 'train' WHERE hamming(a.board, b.board) <= 2 GROUP BY 1, 2"""

_KEY = "concat_ws(' ', board, side, rights, ep, coalesce(CAST(h AS VARCHAR), '?'), coalesce(CAST(f AS VARCHAR), '?'))"
_RECORDS = f"SELECT position_id, {_KEY} AS k FROM {parsed('positions', 'position_id', 'halfmove_clock', 'fullmove_number')}"
P3_FOUND = f"SELECT keep_id, position_id AS copy_id FROM (SELECT position_id, min(position_id) OVER (PARTITION BY k) AS keep_id FROM ({_RECORDS})) WHERE position_id > keep_id"
P3_RECORDS = f"SELECT min(position_id) AS keep_id, count(*) AS copies FROM ({_RECORDS}) GROUP BY k"

_PLACED = f"SELECT position_id, {label('source')} AS source, {label('split')} AS split, concat_ws(' ', board, side, rights, ep) AS k FROM {parsed('positions', 'position_id, source, split')}"
_REACHED = f"SELECT DISTINCT {label('source')} AS source, game_index, concat_ws(' ', board, side, rights, ep) AS k FROM {parsed('extracted_positions', 'source, game_index')} WHERE game_index IS NOT NULL"
_FAMILIES = f"""p AS ({_PLACED}), g AS ({_REACHED}), e AS (SELECT position_id AS a, min(position_id) OVER (PARTITION BY k) AS b FROM p
  UNION SELECT position_id, min(position_id) OVER (PARTITION BY g.source, game_index) FROM p JOIN g ON p.source = g.source AND p.k = g.k),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, b AS seen FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON r.seen = s.a),
f AS (SELECT p.position_id, p.split, least(p.position_id, coalesce(m, p.position_id)) AS family_id FROM p LEFT JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY 1) ON node = p.position_id)"""
P6_FOUND = f"WITH RECURSIVE {_FAMILIES} SELECT position_id, family_id FROM f WHERE family_id IN (SELECT family_id FROM f GROUP BY 1 HAVING count(DISTINCT split) > 1)"


_U = "CAST(('0x' || substr(sha256('families-v1' || chr(0) || family_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967296"
_NEW = f"CASE WHEN {_U} < 0.9 THEN 'train' WHEN {_U} < {0.9 + 0.05!r} THEN 'validation' ELSE 'test' END"
P6_ASSIGNMENT = f"WITH RECURSIVE {_FAMILIES} SELECT position_id, family_id, {_NEW} AS new_split FROM f"
P6_LARGE = f"WITH RECURSIVE {_FAMILIES} SELECT family_id, count(*) AS rows, {_NEW} AS new_split FROM f GROUP BY 1 HAVING count(*) > 0.001 * (SELECT count(*) FROM f)"

_SHA = f"nullif(regexp_replace({label('fen_sha256')}, '^sha-?256[:=]\\s*', ''), '')"
_BUCKET = "CAST(('0x' || substr(sha256('sample-v1' || chr(0) || key), 1, 8))::UBIGINT % 4096 AS BIGINT)"


def _marked(where: str = "true") -> str:
    """Rows with their key, bucket and place, and the length of the list that they need."""
    return f"""k AS (SELECT position_id, {label('split')} AS split, intake_no, coalesce({_SHA}, sha256(fen), 'row ' || position_id) AS key FROM positions WHERE {where}),
b AS (SELECT *, {_BUCKET} AS sample_bucket FROM k), m AS (SELECT *, CAST(xor(sample_bucket * 1637 % 4096, (sample_bucket * 1637 % 4096) >> 5) * 2741 % 4096 AS INTEGER) AS sample_place FROM b),
first AS (SELECT coalesce(split, '') AS split, key, sample_place, min(coalesce(intake_no, -4000000000)) AS intake FROM m GROUP BY 1, 2, 3), moments AS (SELECT DISTINCT split, intake AS i FROM first),
o AS (SELECT first.split, i, sample_place, row_number() OVER (PARTITION BY first.split, i ORDER BY sample_place) AS rn, count(*) OVER (PARTITION BY first.split, i) AS total FROM first JOIN moments ON first.split = moments.split AND intake <= i),
l AS (SELECT greatest(205, coalesce(max(sample_place) FILTER (WHERE rn = greatest(0, floor(0.05 * total - 3 * sqrt(0.05 * total)))), 0) + 1) AS longest FROM o)"""


P1_SAMPLE = f"WITH {_marked()} SELECT position_id, split, intake_no, sample_bucket, sample_place FROM m, l WHERE sample_place < longest"
P1_SHARES = f"""WITH {_marked()} SELECT coalesce(split, '') AS split, count(*) AS rows, count(DISTINCT key) AS keys, nullif(count(*) FILTER (WHERE sample_place < longest), 0) AS sample_rows,
  nullif(count(DISTINCT key) FILTER (WHERE sample_place < longest), 0) AS sample_keys, nullif(count(DISTINCT key) FILTER (WHERE sample_place < longest), 0) / count(DISTINCT key)::DOUBLE AS share FROM m, l GROUP BY 1"""
#: Three states of the table under one list that only grows.
_STATES = ("coalesce(intake_no, 0) <= 6", "intake_no >= 4", "true")
_LENGTHS = ", ".join(f"n{i} AS (WITH {_marked(w)} SELECT longest FROM l)" for i, w in enumerate(_STATES))
P1_GROWTH = f"WITH {_marked()}, {_LENGTHS} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS step, count(DISTINCT key) AS chosen, 0::BIGINT AS lost FROM m WHERE {w} AND sample_place < (SELECT max(longest) FROM ({' UNION ALL '.join(f'SELECT longest FROM n{j}' for j in range(i + 1))}))" for i, w in enumerate(_STATES)
)

_CLASSES = f"c AS (SELECT position_id, board, side, split IN ('val', 'challenge', 'fresh') AS held, min(position_id) OVER (PARTITION BY board, side) AS cid FROM ({_SIDES}) WHERE split IN ('val', 'challenge', 'fresh', 'train'))"
_NEAR = f"{_CLASSES}, n AS (SELECT DISTINCT a.cid AS class_a, b.cid AS class_b, hamming(a.board, b.board) AS differing FROM c a JOIN c b ON a.side = b.side AND a.held AND NOT b.held WHERE hamming(a.board, b.board) <= 2)"
P2_CLASSES = f"WITH {_NEAR} SELECT class_a, class_b, differing FROM n"
P2_MEMBERS = f"""WITH {_NEAR}, la AS (SELECT class_a AS cid, count(*) AS k FROM n GROUP BY 1), lb AS (SELECT class_b AS cid, count(*) AS k FROM n GROUP BY 1)
SELECT position_id, c.cid AS class_id, coalesce(CASE WHEN held THEN la.k ELSE lb.k END, 0) AS links FROM c LEFT JOIN la ON c.cid = la.cid LEFT JOIN lb ON c.cid = lb.cid"""

#: Certificates: queries of what breaks a rule, which nothing may do.
P5_CHECK = "SELECT '' AS network_sha256, 0.0::DOUBLE AS slope WHERE false"


def _none(*rules: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, 0::BIGINT AS violations" for r in rules)


P7_CHECK = _none("cover", "divided", "capacity", "half_empty", "containers")
P8_CHECK = _none("cap", "share", "full", "reachable", "margin")
P9_CHECK = _none("text", "cover", "limit", "overlap", "natural", "missing")


def oracle_sql() -> dict[str, str]:
    return {
        "p1_sample": P1_SAMPLE, "p1_shares": P1_SHARES, "p1_growth": P1_GROWTH, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p2_classes": P2_CLASSES, "p2_members": P2_MEMBERS,
        "p3_found": P3_FOUND, "p3_records": P3_RECORDS, "p5_check": P5_CHECK, "p6_found": P6_FOUND, "p6_assignment": P6_ASSIGNMENT, "p6_large": P6_LARGE,
        "p7_check": P7_CHECK, "p8_check": P8_CHECK, "p9_check": P9_CHECK,
    }
