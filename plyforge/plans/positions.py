"""Queries over positions and texts: keys, digests, deduplication, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.boards import fen_key, label, words
from plyforge.functions.hashing import bucket, content_identity, seeded_digest, sha256_text
from plyforge.operators import reconcile, sampling
from plyforge.plans.queries import query
from plyforge.session import table

#: The white space of Python's str.split() in DuckDB's pattern syntax.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SEED = "seed-2031"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}'), lambda w: w <> '')"


def sql_key(c: str) -> str:
    return f"CASE WHEN len({sql_words(c)}) >= 4 THEN array_to_string(list_slice({sql_words(c)}, 1, 4), ' ') END"


def sql_label(c: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace({c}, '^{WS}', ''), '{WS}$', '')), '')"


def sql_digest(c: str, seed: str = SEED) -> str:
    return f"sha256('{seed}' || chr(0) || {c})"


def sql_bucket(digest: str, total: int) -> str:
    return f"CAST(('0x' || substr({digest}, 1, 16))::UBIGINT % {total} AS INTEGER)"


def sql_split(c: str) -> str:
    b = sql_bucket(sql_digest(c), 20)
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL WHEN {b} < 1 THEN 'validation' WHEN {b} < 2 THEN 'holdout' ELSE 'train' END"


@query(f"SELECT position_id, {sql_key('fen')} AS fen_key FROM positions")
def fen_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positions").select("position_id", fen_key(F.col("fen")).alias("fen_key"))


@query(f"""SELECT key, position_id, fen FROM (
  SELECT {sql_key('fen')} AS key, position_id, fen, row_number() OVER (PARTITION BY {sql_key('fen')} ORDER BY position_id) AS n FROM positions)
WHERE n = 1 AND key IS NOT NULL""")
def first_seen_positions(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_seen(table(spark, d, "positions").select("position_id", "fen"), fen_key(F.col("fen")), ["position_id"])


@query(f"""SELECT count(*) AS total_input, count(DISTINCT k) AS unique_keys, count(k) - count(DISTINCT k) AS exact_duplicates_removed, count(*) - count(k) AS malformed_skipped
FROM (SELECT {sql_key('fen')} AS k FROM positions)""")
def dedupe_accounting(spark: SparkSession, d: str) -> DataFrame:
    return sampling.dedupe_report(table(spark, d, "positions"), fen_key(F.col("fen")))


@query(f"""SELECT position_id, array_to_string(list_slice(w, 1, 4), ' ') AS fen_key, w[2] AS side, TRY_CAST(w[5] AS INTEGER) AS halfmove, TRY_CAST(w[6] AS INTEGER) AS fullmove, sha256(fen) AS digest
FROM (SELECT position_id, fen, {sql_words('fen')} AS w FROM positions) WHERE len(w) = 6 AND w[2] IN ('w', 'b') AND regexp_full_match(w[5], '[0-9]+') AND regexp_full_match(w[6], '0*[1-9][0-9]*')""")
def decomposed_fens(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "positions").select("position_id", "fen", words(F.col("fen")).alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    out = p.select(
        "position_id", fen_key(F.col("fen")).alias("fen_key"), at(1).alias("side"), at(4).try_cast("int").alias("halfmove"),
        at(5).try_cast("int").alias("fullmove"), sha256_text(F.col("fen")).alias("digest"), F.size("w").alias("n")
    )
    return out.filter((F.col("n") == 6) & F.col("side").isin("w", "b") & (F.col("halfmove") >= 0) & (F.col("fullmove") >= 1)).drop("n")


@query(f"""SELECT position_id, {sql_digest('fen')} AS digest, {sql_bucket(sql_digest('fen'), 20)} AS bucket FROM positions""")
def seeded_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = seeded_digest(SEED, F.col("fen"))
    return table(spark, d, "positions").select("position_id", g.alias("digest"), bucket(g, 20).alias("bucket"))


@query(f"SELECT position_id, {sql_split(sql_key('fen'))} AS assigned_split FROM positions")
def split_by_position(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positions").select("position_id", sampling.split_of(fen_key(F.col("fen")), SEED).alias("assigned_split"))


@query(f"SELECT extract_id, {sql_split(sql_label('source'))} AS assigned_split FROM extracted_positions")
def split_by_source_family(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_by_family(table(spark, d, "extracted_positions"), label(F.col("source")), SEED).select("extract_id", "assigned_split")


@query(f"""SELECT count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation, count(*) FILTER (WHERE s = 'holdout') AS holdout
FROM (SELECT DISTINCT {sql_label('source')} AS f, {sql_split(sql_label('source'))} AS s FROM extracted_positions)""")
def split_family_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.split_by_family(table(spark, d, "extracted_positions"), label(F.col("source")), SEED)
    return sampling.split_counts(rows, unit=label(F.col("source")))


@query(f"""SELECT row_number() OVER (ORDER BY {sql_digest('fen')}, position_id) AS batch_index, {sql_digest('fen')} AS selection_sha256, position_id, fen
FROM positions WHERE fen IS NOT NULL ORDER BY 2, 3 LIMIT 25""")
def smallest_hash_batch(spark: SparkSession, d: str) -> DataFrame:
    return sampling.smallest_hashes(table(spark, d, "positions").select("position_id", "fen"), F.col("fen"), SEED, 25, ["position_id"])


@query(f"""SELECT row_number() OVER (ORDER BY {sql_digest('key', 'openings')}, key) AS draw, key, {sql_digest('key', 'openings')} AS digest
FROM (SELECT DISTINCT opening_ref AS key FROM parsed_games WHERE opening_ref IS NOT NULL AND opening_ref <> '') ORDER BY 1 LIMIT 20""")
def openings_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw_distinct(table(spark, d, "parsed_games"), F.col("opening_ref"), "openings", 20)


@query(f"""SELECT suite, lines, distinct_openings, lines - distinct_openings - malformed AS duplicates, malformed, distinct_openings >= 50 AS enough,
  round(CASE WHEN distinct_openings > 0 THEN 1 - exp(-(50.0 * 49) / (2 * distinct_openings)) END, 9) AS collision_probability
FROM (SELECT {sql_label('source')} AS suite, count(*) AS lines, count(DISTINCT {sql_key('fen')}) AS distinct_openings, count(*) - count({sql_key('fen')}) AS malformed
  FROM positions WHERE trim(fen) <> '' GROUP BY 1)""")
def suite_accounting(spark: SparkSession, d: str) -> DataFrame:
    r = sampling.suite_report(table(spark, d, "positions"), label(F.col("source")), F.col("fen"), fen_key(F.col("fen")), 50)
    return r.withColumn("collision_probability", F.round("collision_probability", 9))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def source_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(role_hint, '') AS role_hint, sha256('{"files":[' || string_agg('{"path":"' || path || '","sha256":"' || lower(trim(sha256)) || '","size_bytes":' || network_id || '}', ',' ORDER BY path) || '],"version":"v1"}' || chr(10)) AS identity
FROM networks WHERE path IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1""")
def content_identities(spark: SparkSession, d: str) -> DataFrame:
    """One identity for each role's set of network files."""
    n = table(spark, d, "networks").filter("path is not null and sha256 is not null")
    files = F.collect_list(F.struct("path", label(F.col("sha256")).alias("sha256"), F.col("network_id").alias("size_bytes")))
    return n.groupBy(F.coalesce("role_hint", F.lit("")).alias("role_hint")).agg(content_identity(files).alias("identity"))


@query(r"""SELECT network_id, coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) AS sha_ok, coalesce(regexp_full_match(name, '[A-Za-z0-9_-]+'), false) AS name_ok,
  coalesce(trim(description) <> '' AND NOT regexp_matches(description, '[\x00-\x1f\x7f]'), false) AS label_ok,
  coalesce(regexp_full_match(created_utc, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z'), false) AS utc_ok,
  coalesce(NOT regexp_matches(path, '[\x00-\x1f\x7f\\]') AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0, false) AS path_ok
FROM networks""")
def predicate_checks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "networks")
    return n.select(
        "network_id", reconcile.is_sha256(F.col("sha256")).alias("sha_ok"), reconcile.is_identifier(F.col("name")).alias("name_ok"),
        reconcile.is_label(F.col("description")).alias("label_ok"), reconcile.is_utc(F.col("created_utc")).alias("utc_ok"),
        reconcile.is_neutral_path(F.col("path")).alias("path_ok")
    )


@query("""SELECT position_id, source, created_utc, before FROM (
  SELECT position_id, source, created_utc, lag(created_utc) OVER (PARTITION BY source ORDER BY position_id) AS before FROM positions)
WHERE created_utc < before""")
def arrivals_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    from plyforge.operators.history import out_of_order

    return out_of_order(table(spark, d, "positions").select("position_id", "source", "created_utc"), ["source"], ["position_id"], "created_utc")
