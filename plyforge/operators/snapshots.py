"""The coherent result of a search transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_exact(infos: DataFrame, by: list[str], line: str = "ln") -> DataFrame:
    """Per group the payload of the last exact line, else of the last line at all."""
    every = F.struct(*[c for c in infos.columns if c not in by])
    exact = F.when(F.col("bound") == "exact", F.col(line))
    return infos.groupBy(*by).agg(F.coalesce(F.max_by(every, exact), F.max_by(every, F.col(line))).alias("__p")).select(*by, "__p.*")


def coherent_snapshot(infos: DataFrame, job: list[str], expected: str = "expected", line: str = "ln") -> DataFrame:
    """The ranks of each job's last complete round, else the last exact or last line of each rank.

    Input: job columns, ``expected`` ranks, line order, ``rank``, ``depth``,
    ``bound`` and any payload. A round begins with a line of rank 1; it is
    complete when every rank from 1 to ``expected`` has an exact line of the
    depth with which the round began. A further rank freezes the round: what
    follows in it doesn't count. Adds ``round`` (null for the fallback).

    One shuffle by job serves all windows and the aggregation above them. A
    transcript is bounded by what one search prints; jobs are many.
    """
    w = Window.partitionBy(*job).orderBy(line)
    r = infos.withColumn("round", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(w))
    by_round = Window.partitionBy(*job, "round").orderBy(line)
    exact = F.col("bound") == "exact"
    r = r.withColumns({"__depth": F.first("depth").over(by_round), "__head": F.first(exact).over(by_round), "__n": F.col(expected)})
    fits = (F.col("round") > 0) & exact & F.col("__head") & (
        (F.col("__n") == 1) | (F.col("depth") == F.col("__depth"))
    ) & ((F.col("__n") > 1) | (F.col("rank") == 1))
    r = r.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    r = r.withColumn("__over", F.max(F.when(F.col("__fits") & (F.col("rank") > F.col("__n")), 1).otherwise(0)).over(by_round))
    payload = [c for c in infos.columns if c not in job]
    kept = r.filter(F.col("__fits") & (F.col("__over") == 0)).groupBy(*job, "round", "rank").agg(
        F.max_by(F.struct(*payload), F.col(line)).alias("__p")
    )
    rounds = kept.groupBy(*job, "round").agg(
        F.collect_list("__p").alias("__ps"), F.count(F.lit(1)).alias("__k"), F.max("__p." + expected).alias("__n")
    ).filter(F.col("__k") == F.col("__n"))
    last = rounds.groupBy(*job).agg(F.max_by("__ps", "round").alias("__ps"), F.max("round").alias("round"))
    whole = last.select(*job, "round", F.explode("__ps").alias("__p")).select(*job, "round", "__p.*")
    rest = last_exact(infos, [*job, "rank"], line).join(last.select(*job), job, "left_anti").withColumn("round", F.lit(None).cast("bigint"))
    return whole.unionByName(rest)


def picked_result(infos: DataFrame, ends: DataFrame, by: list[str], line: str = "ln") -> DataFrame:
    """Per group the last exact info, else the last, with the moves it played: the first two of its ``sf_pv``, else those of the ``bestmove`` line.

    Groups without any info keep null fields; ``ends`` has ``bestmove`` and
    ``ponder`` of each group's last bestmove line.
    """
    best = last_exact(infos.withColumnRenamed("sf_bound", "bound"), by, line).withColumnRenamed("bound", "sf_bound").drop(line)
    last = ends.groupBy(*by).agg(F.max_by(F.struct("bestmove", "ponder"), F.col(line)).alias("__e"))
    pv = F.filter(F.split("sf_pv", " "), lambda m: m != "")
    joined = last.join(best, by, "full")
    return joined.withColumns(
        {
            "sf_bestmove": F.coalesce(F.get(pv, F.lit(0)), F.when(F.coalesce(F.size(pv), F.lit(0)) <= 0, F.col("__e.bestmove")), F.lit("")),
            "sf_ponder": F.coalesce(F.get(pv, F.lit(1)), F.when(F.coalesce(F.size(pv), F.lit(0)) <= 0, F.col("__e.ponder")), F.lit(""))
        }
    ).drop("__e")
