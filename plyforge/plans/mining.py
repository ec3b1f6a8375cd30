"""Queries of the mining star, on a view of order lines as search evidence.

A position is an order; the candidate's ranked list are its lines by price, the
teacher's choice is the line of the largest quantity, and every line is also a
probe of the teacher and has static scores of both networks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.operators import mining
from plyforge.plans.queries import query
from plyforge.session import cut, table

_LINES = """SELECT l_orderkey AS position_id, l_orderkey % 7 AS run_id, 'm' || l_partkey AS move, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_returnflag AS f, l_linestatus AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS rank,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS pick,
  row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_shipdate) AS again FROM lineitem"""
_CP = "CASE WHEN s = 'O' THEN CAST(round(p) AS BIGINT) % 400 - 200 END"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    w = lambda *by: Window.partitionBy("l_orderkey").orderBy(*by)
    tie = ("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    again = Window.partitionBy("l_orderkey", "l_partkey").orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_linenumber", "l_shipdate")
    named = {"l_orderkey": "position_id", "l_quantity": "q", "l_extendedprice": "p", "l_discount": "d", "l_returnflag": "f", "l_linestatus": "s"}
    return table(spark, d, "lineitem").select(
        *[F.col(c).alias(n) for c, n in named.items()],
        (F.col("l_orderkey") % 7).alias("run_id"),
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("move"),
        F.row_number().over(w(F.desc("l_extendedprice"), *tie)).alias("rank"),
        F.row_number().over(w(F.desc("l_quantity"), *tie)).alias("pick"),
        F.row_number().over(again).alias("again"),
    )


def _job_id(tag: str) -> Column:
    return F.concat_ws("/", F.lit(tag), F.col("position_id"), *([F.col("move")] if tag == "p" else []))


def star(spark: SparkSession, d: str, faults: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, results, statics) of the view.

    With ``faults`` best moves of some candidates aren't their first, some
    second ranks are lost and some moves weren't probed.
    """
    x = cut(_lines(spark, d), "star")  # read by every part of the view
    probed = x.filter("again = 1 and round(d * 100) <> 5") if faults else x.filter("again = 1")
    move = F.col("move")

    def jobs_of(rows: DataFrame, tag: str, role: str, kind: str, restricted: Column, best: Column) -> DataFrame:
        return rows.select(
            "run_id", "position_id", _job_id(tag).alias("job_id"), F.lit(role).alias("engine_role"), F.lit(kind).alias("search_kind"),
            restricted.alias("restricted_move"), best.alias("bestmove")
        )

    own = F.when(F.col("f") == "A", "m0").otherwise(move) if faults else move
    jobs = jobs_of(x.filter("rank = 1"), "c", "candidate", "multipv", F.lit("ALL"), own)
    jobs = jobs.unionByName(jobs_of(x.filter("pick = 1"), "t", "teacher", "singlepv", F.lit("ALL"), F.when(F.col("d") < 0.1, move)))
    jobs = jobs.unionByName(jobs_of(probed, "p", "teacher", "searchmove", move, move))

    def results_of(rows: DataFrame, tag: str, rank: Column) -> DataFrame:
        w = (F.col("q") * 10).cast("bigint")
        return rows.select(
            _job_id(tag).alias("job_id"), rank.cast("bigint").alias("rank"), "move", F.lit("cp").alias("score_type"), (
                (F.round("p").cast("bigint") % 400) - 200
            ).alias("score_value"),
            F.when(F.col("s") == "O", "exact").otherwise("lowerbound").alias("bound"), w.alias("wdl_w"), F.lit(500).cast("bigint").alias("wdl_d"), (F.lit(500) - w).alias("wdl_l"), F.floor(F.col("q") / 10).alias("depth"),
        )

    ranked = x.filter("not (rank = 2 and q > 40)") if faults else x
    results = results_of(ranked, "c", F.col("rank")).unionByName(results_of(probed, "p", F.lit(1)))
    score = lambda k: (F.round("p").cast("bigint") % k).alias("score")
    status = F.when(F.col("f") == "R", "in_check").otherwise("ok").alias("status")
    networks = F.array(F.struct(F.lit("candidate").alias("role"), score(300)), F.struct(F.lit("official").alias("role"), score(170)))
    statics = x.filter("again = 1").select("run_id", "position_id", "move", status, F.explode(networks).alias("n"))
    return jobs, results, statics.select(
        "run_id", "position_id", F.col("n.role").alias("network_role"), "move", "status", F.col("n.score").alias("score_root_pov")
    )


_STAR = f"""WITH x AS ({_LINES}), probe AS (SELECT position_id, move, {_CP} AS cp, CASE WHEN s = 'O' THEN (CAST(q * 10 AS BIGINT) + 250.0) / 1000 END AS e,
  CASE WHEN f <> 'R' THEN CAST(round(p) AS BIGINT) % 300 END AS sc, CASE WHEN f <> 'R' THEN CAST(round(p) AS BIGINT) % 170 END AS so FROM x WHERE again = 1),
b AS (SELECT a.run_id, a.position_id, a.move AS candidate_bestmove, CASE WHEN t.d < 0.1 THEN t.move END AS teacher_bestmove FROM x a JOIN x t ON a.position_id = t.position_id AND a.rank = 1 AND t.pick = 1),
own AS (SELECT b.run_id, b.position_id, candidate_bestmove, teacher_bestmove, max(CASE WHEN rank = 1 THEN {_CP} END) - max(CASE WHEN rank = 2 THEN {_CP} END) AS margin, min(CASE WHEN x.move = teacher_bestmove THEN rank END) - 1 AS rank_error FROM b JOIN x ON b.position_id = x.position_id GROUP BY 1, 2, 3, 4),
m AS (SELECT own.*, candidate_bestmove = teacher_bestmove AS same, c.cp AS ccp, t.cp AS tcp, c.e AS ce, t.e AS te, c.sc AS csc, t.sc AS tsc, c.so AS cso, t.so AS tso FROM own LEFT JOIN probe c ON c.position_id = own.position_id AND c.move = candidate_bestmove LEFT JOIN probe t ON t.position_id = own.position_id AND t.move = teacher_bestmove),
met AS (SELECT run_id, position_id, candidate_bestmove, teacher_bestmove, CAST(margin AS DOUBLE) AS candidate_margin_internal, CAST(rank_error AS DOUBLE) AS rank_error, CASE WHEN same THEN 0.0 ELSE tcp - ccp END::DOUBLE AS deep_teacher_preference,
  CASE WHEN same THEN 0.0 WHEN tcp - ccp IS NOT NULL THEN greatest(0, tcp - ccp) END::DOUBLE AS teacher_regret_internal, round(CASE WHEN same THEN 0.0 WHEN te - ce IS NOT NULL THEN greatest(0.0, te - ce) END::DOUBLE, 6) AS teacher_regret_wdl_expected,
  CASE WHEN same THEN CASE WHEN csc IS NOT NULL THEN 0.0 END ELSE csc - tsc END::DOUBLE AS candidate_static_preference, CASE WHEN same THEN CASE WHEN cso IS NOT NULL THEN 0.0 END ELSE cso - tso END::DOUBLE AS official_static_preference,
  CASE WHEN teacher_bestmove IS NULL OR candidate_bestmove IS NULL THEN 'EVIDENCE_INCOMPLETE' WHEN same THEN 'AGREEMENT' ELSE 'MOVE_DISAGREEMENT' END AS primary_class FROM m)"""


#: Columns that are kept for metrics to come.
_RESERVED = ", ".join(f"NULL::DOUBLE AS {c}" for c in mining.RESERVED)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return mining.position_metrics(*star(spark, d))


@query(f"{_STAR} SELECT *, abs(candidate_static_preference - official_static_preference) AS static_disagreement, {_RESERVED} FROM met")
def mining_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).withColumn("teacher_regret_wdl_expected", F.round("teacher_regret_wdl_expected", 6))


@query(f"""{_STAR} SELECT run_id, position_id, primary_class AS class_name, 1.0::DOUBLE AS class_score FROM met UNION ALL SELECT run_id, position_id, 'TEACHER_OUTSIDE_CANDIDATE_TOPK', 1.0::DOUBLE FROM met WHERE primary_class = 'MOVE_DISAGREEMENT' AND rank_error IS NULL""")
def position_classes(spark: SparkSession, d: str) -> DataFrame:
    return mining.position_classes(_metrics(spark, d))


@query(f"{_STAR} SELECT run_id, position_id, teacher_regret_internal FROM met WHERE teacher_regret_internal IS NOT NULL ORDER BY teacher_regret_internal DESC, run_id, position_id LIMIT 50")
def worst_regrets(spark: SparkSession, d: str) -> DataFrame:
    return mining.worst_first(_metrics(spark, d), "teacher_regret_internal", 50).select("run_id", "position_id", "teacher_regret_internal")


@query(f"""WITH x AS ({_LINES}) SELECT run_id, count(DISTINCT position_id) AS positions, 2 * count(DISTINCT position_id) + count(*) FILTER (WHERE again = 1) AS jobs, count(*) + count(*) FILTER (WHERE again = 1) AS results, 2 * count(*) FILTER (WHERE again = 1) AS static_evals FROM x GROUP BY 1""")
def mining_read_back(spark: SparkSession, d: str) -> DataFrame:
    return mining.read_back(*star(spark, d))


_FAULTY = f"""x AS ({_LINES}), j AS (SELECT run_id, position_id, 'c/' || position_id AS job_id, true AS main, false AS probe, CASE WHEN f = 'A' THEN 'm0' ELSE move END AS best FROM x WHERE rank = 1
  UNION ALL SELECT run_id, position_id, 't/' || position_id, true, false, CASE WHEN d < 0.1 THEN move END FROM x WHERE pick = 1
  UNION ALL SELECT run_id, position_id, 'p/' || position_id || '/' || move, false, true, move FROM x WHERE again = 1 AND round(d * 100) <> 5),
r AS (SELECT 'c/' || position_id AS job_id, rank, move, {_CP} AS cp, s <> 'O' AS inexact, floor(q / 10) AS depth FROM x WHERE NOT (rank = 2 AND q > 40)
  UNION ALL SELECT 'p/' || position_id || '/' || move, 1, move, {_CP}, s <> 'O', floor(q / 10) FROM x WHERE again = 1 AND round(d * 100) <> 5),
g AS (SELECT job_id, count(*) AS n, count(DISTINCT rank) AS k, min(rank) AS lo, max(rank) AS hi, count(DISTINCT depth) AS depths, bool_or(inexact) AS inexact, max(cp) FILTER (WHERE rank = 1) - max(cp) FILTER (WHERE rank = 2) AS margin, max(move) FILTER (WHERE rank = 1) AS first FROM r GROUP BY 1),
q AS (SELECT run_id, count(*) AS missing FROM (SELECT run_id, position_id, best FROM j WHERE main AND best IS NOT NULL EXCEPT SELECT run_id, position_id, best FROM j WHERE probe) GROUP BY 1)"""


@query(f"""WITH {_FAULTY} SELECT j.run_id, count(*) FILTER (WHERE n <> k OR lo <> 1 OR hi <> k) AS bad_rank_sets, count(*) FILTER (WHERE depths > 1) AS mixed_depths, count(*) FILTER (WHERE inexact) AS not_exact,
  count(*) FILTER (WHERE margin < 0) AS negative_margins, count(*) FILTER (WHERE best <> first) AS bestmove_not_first, coalesce(max(missing), 0) AS missing_probes FROM j LEFT JOIN g ON j.job_id = g.job_id LEFT JOIN q ON j.run_id = q.run_id GROUP BY 1""")
def mining_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of fault counted, in a view with all of them."""
    jobs, results, _ = star(spark, d, faults=True)
    return mining.run_audit(jobs, results)


@query(f"WITH x AS ({_LINES}) SELECT DISTINCT run_id, position_id FROM x")
def mining_positions(spark: SparkSession, d: str) -> DataFrame:
    """The positions that a run has jobs for."""
    return mining.stored_positions(star(spark, d)[0])


_CHANGED = " UNION ALL ".join(
    f"SELECT pair, position_id, '{m}' AS what, a.{m} AS in_a, b.{m} AS in_b FROM ra a JOIN rb b USING (pair, position_id) WHERE a.{m} IS DISTINCT FROM b.{m}" for m in mining.METRICS
)


@query(f"""{_STAR}, every AS (SELECT *, abs(candidate_static_preference - official_static_preference) AS static_disagreement FROM met),
ra AS (SELECT * REPLACE (position_id // 7 AS position_id), run_id AS pair FROM every WHERE run_id < 6), rb AS (SELECT * REPLACE (position_id // 7 AS position_id), run_id - 1 AS pair FROM every WHERE run_id > 0)
{_CHANGED} UNION ALL SELECT pair, position_id, 'only_a', NULL, NULL FROM ra WHERE (pair, position_id) NOT IN (SELECT (pair, position_id) FROM rb)
UNION ALL SELECT pair, position_id, 'only_b', NULL, NULL FROM rb WHERE (pair, position_id) NOT IN (SELECT (pair, position_id) FROM ra)""")
def mining_run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the next, matched by the place of the position in its run, in every metric."""
    m = _metrics(spark, d).withColumn("teacher_regret_wdl_expected", F.round("teacher_regret_wdl_expected", 6))
    m = m.select("run_id", F.floor(F.col("position_id") / 7).alias("position_id"), *mining.METRICS)
    a = m.filter("run_id < 6").withColumn("pair", F.col("run_id"))
    b = m.filter("run_id > 0").withColumn("pair", F.col("run_id") - 1)
    return mining.run_diff(a, b, by=("pair", "position_id"))


@query(f"""WITH x AS ({_LINES}), r AS (SELECT position_id, max(move) FILTER (WHERE rank = 1) AS a, max(CASE WHEN pick = 1 AND d < 0.1 THEN move END) AS z, list(move ORDER BY rank) AS l FROM x GROUP BY 1),
u AS (SELECT position_id, unnest([a] || l || [z]) AS move, unnest(range(len(l) + 2)) AS k FROM r)
SELECT position_id, array_to_string(list(move ORDER BY k), ' ') AS moves FROM (SELECT position_id, move, min(k) AS k FROM u WHERE move IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def probe_unions(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "move"))), lambda s: s["move"])
    g = x.groupBy("position_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("move"))).alias("a"),
        F.max(F.when((F.col("pick") == 1) & (F.col("d") < 0.1), F.col("move"))).alias("z"), ranked.alias("l")
    )
    return g.select("position_id", F.array_join(mining.probe_moves(F.col("a"), F.col("l"), F.col("z")), " ").alias("moves"))


@query("SELECT o_custkey, o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def jobs_and_results(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey")
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_quantity")
    return mining.jobs_with_results(jobs, results).withColumnRenamed("job_id", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def results_of_run(spark: SparkSession, d: str) -> DataFrame:
    """Results whose job belongs to one run; a run is a status of orders."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_quantity")
    return mining.results_of_run(results, jobs, F.col("o_orderstatus") == "F").withColumnRenamed("job_id", "l_orderkey")


@query(f"""WITH x AS ({_LINES}), p AS (SELECT DISTINCT position_id // 7 AS k, run_id, move FROM x), a AS (SELECT run_id AS pair, k, list(move) AS m FROM p WHERE run_id < 6 GROUP BY 1, 2), b AS (SELECT run_id - 1 AS pair, k, list(move) AS m FROM p WHERE run_id > 0 GROUP BY 1, 2),
j AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.k, b.k) AS position_id, coalesce(a.m, []) AS m, coalesce(b.m, []) AS n FROM a FULL JOIN b ON a.pair = b.pair AND a.k = b.k)
SELECT pair, position_id, array_to_string(list_sort(list_filter(n, lambda v: NOT list_contains(m, v))), ' ') AS added, array_to_string(list_sort(list_filter(m, lambda v: NOT list_contains(n, v))), ' ') AS removed
FROM j WHERE len(list_filter(n, lambda v: NOT list_contains(m, v))) + len(list_filter(m, lambda v: NOT list_contains(n, v))) > 0""")
def probe_changes(spark: SparkSession, d: str) -> DataFrame:
    """Moves probed in one run and not in the next, position by position."""
    x = _lines(spark, d).groupBy("run_id", F.floor(F.col("position_id") / 7).alias("position_id")).agg(F.collect_set("move").alias("moves"))
    a, b = x.filter("run_id < 6").withColumn("pair", F.col("run_id")), x.filter("run_id > 0").withColumn("pair", F.col("run_id") - 1)
    diff = mining.probe_diff(a, b, ("pair", "position_id"))
    return diff.select("pair", "position_id", F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"))
