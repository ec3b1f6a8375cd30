"""Metrics and classes of positions from search jobs, ranked results and static evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.stats import wdl_expectation
from plyforge.functions.vocabulary import POSITION_CLASSES

POSITION = ["run_id", "position_id"]
#: The metrics that a run may be compared by.
METRICS = (
    "candidate_margin_internal", "rank_error", "deep_teacher_preference", "teacher_regret_internal", "teacher_regret_wdl_expected",
    "candidate_static_preference", "official_static_preference", "static_disagreement"
)
RESERVED = ("topk_overlap", "search_amplification", "structural_persistence", "break_score")


def exact_cp(kind: Column, bound: Column, value: Column) -> Column:
    """A centipawn score that is no bound; null for any other."""
    return F.when((bound == "exact") & (kind == "cp"), value.cast("double"))


def jobs_with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return jobs.join(results, "job_id")


def results_of_run(results: DataFrame, jobs: DataFrame, run: Column) -> DataFrame:
    return results.join(jobs.filter(run).select("job_id"), "job_id", "left_semi")


def probe_moves(candidate_best: Column, ranked: Column, teacher_best: Column) -> Column:
    """Moves worth probing, first seen first: the candidate's, its ranked list, the teacher's; nulls and repeats dropped."""
    one = lambda c: F.array(c)
    return F.array_distinct(F.array_compact(F.concat(one(candidate_best), F.coalesce(ranked, F.array().cast("array<string>")), one(teacher_best))))


def _by_job(jobs: DataFrame, results: DataFrame, wanted: list, result: Column) -> DataFrame:
    """One row a job: its columns ``wanted`` as ``j`` and what it gave as ``rs``, in one shuffle by job.

    A search gives a handful of ranks, so the list is bounded. Jobs without
    results have an empty one; results without job are left out.
    """
    j = jobs.select("job_id", F.struct(*wanted).alias("j"))
    r = results.select("job_id", result.alias("r"))
    both = j.withColumn("r", F.lit(None).cast(r.schema["r"].dataType)).unionByName(r.withColumn("j", F.lit(None).cast(j.schema["j"].dataType)))
    return both.groupBy("job_id").agg(F.max("j").alias("j"), F.collect_list("r").alias("rs")).filter("j is not null")


def _of(list_: str, test, value, pick=F.array_max) -> Column:
    """The largest (or other pick) of a value among the entries of a list that pass a test; null if none does."""
    return pick(F.transform(F.filter(F.col(list_), test), value))


def position_metrics(jobs: DataFrame, results: DataFrame, statics: DataFrame) -> DataFrame:
    """One row per position of a run that has both main jobs.

    ``jobs``: run_id, position_id, job_id (unique), engine_role, search_kind,
    restricted_move, bestmove. ``results``: job_id, rank, move, score_type,
    score_value, bound, wdl_w, wdl_d, wdl_l. ``statics``: run_id, position_id,
    network_role, move, status, score_root_pov.

    Two shuffles serve every lookup: jobs meet their results by job, then all
    evidence of a position (both main jobs, probes, static scores) meets as one
    row with small lists, in which moves are looked up. The lists are bounded by
    the legal moves of a position. Of several main jobs of a role the one of the
    smallest ``job_id`` counts.
    """
    cp = exact_cp(F.col("score_type"), F.col("bound"), F.col("score_value"))
    hope = F.when(F.col("bound") == "exact", wdl_expectation(F.col("wdl_w"), F.col("wdl_d"), F.col("wdl_l")))
    result = F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("move").alias("move"), cp.alias("cp"), hope.alias("e"))
    per = _by_job(jobs, results, [*POSITION, "engine_role", "search_kind", "restricted_move", "bestmove"], result)
    j = lambda c: F.col(f"j.{c}")
    main = lambda role, kind: (j("engine_role") == role) & (j("search_kind") == kind) & (j("restricted_move") == "ALL")
    first = F.get(F.filter("rs", lambda r: r["rank"] == 1), F.lit(0))
    probe = F.when(
        (j("engine_role") == "teacher") & (j("search_kind") == "searchmove") & first.isNotNull(),
        F.struct(j("restricted_move").alias("move"), F.col("job_id"), first["cp"].alias("cp"), first["e"].alias("e"))
    )
    searched = per.select(
        *[j(c).alias(c) for c in POSITION],
        F.when(main("candidate", "multipv"), F.struct(F.col("job_id").alias("job"), j("bestmove").alias("best"), F.col("rs").alias("rs"))).alias("c"),
        F.when(main("teacher", "singlepv"), F.struct(F.col("job_id").alias("job"), j("bestmove").alias("best"))).alias("t"),
        probe.alias("p"),
    ).filter("c is not null or t is not null or p is not null")
    usable = F.when(F.col("status") == "ok", F.col("score_root_pov").cast("double"))
    static = statics.select(*POSITION, F.struct("network_role", "move", usable.alias("score")).alias("s"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    every = searched.select("*", none(static, "s")).unionByName(static.select(*POSITION, "s", *[none(searched, c) for c in "ctp"]))
    g = every.groupBy(*POSITION).agg(
        F.min_by("c", F.col("c.job")).alias("c"), F.min_by("t", F.col("t.job")).alias("t"), F.collect_list("p").alias("ps"), F.collect_list("s").alias("ss")
    ).filter("c is not null and t is not null")
    g = g.select(
        *POSITION, F.col("c.best").alias("candidate_bestmove"), F.col("t.best").alias("teacher_bestmove"), F.col("c.rs").alias("rs"), "ps",
        "ss"
    )

    a, b = F.col("candidate_bestmove"), F.col("teacher_bestmove")
    of_rank = lambda k: _of("rs", lambda r: r["rank"] == k, lambda r: r["cp"])
    probed = lambda m: _of("ps", lambda p: p["move"] == m, lambda p: F.struct(p["job_id"], p["cp"], p["e"]), F.array_min)
    seen = lambda m, role: _of("ss", lambda s: (s["move"] == m) & (s["network_role"] == role), lambda s: s["score"])
    g = g.select(
        *POSITION, "candidate_bestmove", "teacher_bestmove",
        (of_rank(1) - of_rank(2)).alias("candidate_margin_internal"),
        (_of("rs", lambda r: r["move"] == b, lambda r: r["rank"], F.array_min) - 1).cast("double").alias("rank_error"),
        probed(a).alias("candidate_p"), probed(b).alias("teacher_p"),
        *[seen(m, role).alias(f"{k}_{who}") for k, role in (("c", "candidate"), ("o", "official")) for who, m in (("candidate", a), ("teacher", b))],
    )

    both, same = a.isNotNull() & b.isNotNull(), a == b
    prefer = F.when(same, F.lit(0.0)).otherwise(F.col("teacher_p.cp") - F.col("candidate_p.cp"))
    gain = F.col("teacher_p.e") - F.col("candidate_p.e")
    never_negative = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))

    def preference(k: str) -> Column:
        own, other = F.col(f"{k}_candidate"), F.col(f"{k}_teacher")
        return F.when(both & same, F.when(own.isNotNull(), F.lit(0.0))).when(both, own - other)

    g = g.withColumns(
        {
            "deep_teacher_preference": prefer,
            "teacher_regret_internal": F.when(same, F.lit(0.0)).otherwise(never_negative(prefer)),
            "teacher_regret_wdl_expected": F.when(same, F.lit(0.0)).otherwise(never_negative(gain)),
            "candidate_static_preference": preference("c"),
            "official_static_preference": preference("o"),
        }
    )
    g = g.withColumn("static_disagreement", F.abs(F.col("candidate_static_preference") - F.col("official_static_preference")))
    g = g.withColumns({k: F.lit(None).cast("double") for k in RESERVED})
    incomplete, agreement, disagreement, _ = POSITION_CLASSES
    g = g.withColumn("primary_class", F.when(~both, incomplete).when(same, agreement).otherwise(disagreement))
    return g.select(*POSITION, "candidate_bestmove", "teacher_bestmove", *METRICS, *RESERVED, "primary_class")


def position_classes(metrics: DataFrame) -> DataFrame:
    """(run, position, ``class_name``, ``class_score``): the primary class, and whether the teacher's move lies outside the candidate's list."""
    outside = F.when((F.col("primary_class") == POSITION_CLASSES[2]) & F.col("rank_error").isNull(), POSITION_CLASSES[3])
    return metrics.select(
        *POSITION, F.explode(F.array_compact(F.array("primary_class", outside))).alias("class_name"), F.lit(1.0).alias("class_score")
    )


def worst_first(metrics: DataFrame, by: str, n: int, ascending: bool = False) -> DataFrame:
    """The top-k report of a run's positions by one metric; nulls never enter."""
    order = F.asc(by) if ascending else F.desc(by)
    return metrics.filter(F.col(by).isNotNull()).orderBy(order, *POSITION).limit(n)


def read_back(jobs: DataFrame, results: DataFrame, statics: DataFrame) -> DataFrame:
    """Per run: positions, jobs, results and static evaluations stored. Positions are counted one by one, never gathered."""
    per = _by_job(jobs, results, POSITION, F.lit(1)).select(
        "j.*", F.lit(1).alias("jobs"), F.size("rs").cast("bigint").alias("results"), F.lit(0).alias("static_evals")
    )
    s = statics.select(*POSITION, F.lit(0).alias("jobs"), F.lit(0).cast("bigint").alias("results"), F.lit(1).alias("static_evals"))
    by_position = per.unionByName(s).groupBy(*POSITION).agg(*[F.sum(c).alias(c) for c in ("jobs", "results", "static_evals")])
    return by_position.groupBy("run_id").agg(
        F.count_if((F.col("jobs") > 0) & F.col("position_id").isNotNull()).alias("positions"),
        *[F.sum(c).alias(c) for c in ("jobs", "results", "static_evals")]
    ).filter("jobs > 0")


def stored_positions(jobs: DataFrame) -> DataFrame:
    """The distinct positions of each run."""
    return jobs.select(*POSITION).distinct()


def run_audit(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: jobs with broken rank sets, mixed depths, non-exact lines, a negative margin, a best move that isn't rank 1, and main moves never probed.

    Three shuffles: by job, by position, by run.
    """
    cp = exact_cp(F.col("score_type"), F.col("bound"), F.col("score_value"))
    result = F.struct(
        F.col("rank").cast("bigint").alias("rank"), F.col("move").alias("move"), cp.alias("cp"), F.col("depth").alias("depth"),
        F.coalesce(F.col("bound") != "exact", F.lit(False)).alias("inexact")
    )
    per = _by_job(jobs, results, [*POSITION, "engine_role", "search_kind", "restricted_move", "bestmove"], result)
    ranks = F.transform("rs", lambda r: r["rank"])
    n, k = F.size("rs"), F.size(F.array_distinct(ranks))
    rank_of = lambda i, c: _of("rs", lambda r: r["rank"] == i, lambda r: r[c])
    best = F.col("j.bestmove")
    faults = {
        "bad_rank_sets": (n > 0) & ((n != k) | (F.array_min(ranks) != 1) | (F.array_max(ranks) != k)),
        "mixed_depths": F.size(F.array_distinct(F.array_compact(F.transform("rs", lambda r: r["depth"])))) > 1,
        "not_exact": F.exists("rs", lambda r: r["inexact"]),
        "negative_margins": rank_of(1, "cp") - rank_of(2, "cp") < 0,
        "bestmove_not_first": (n > 0) & best.isNotNull() & (best != rank_of(1, "move")),
    }
    probe = (F.col("j.engine_role") == "teacher") & (F.col("j.search_kind") == "searchmove")
    found = per.select(
        *[F.col(f"j.{c}").alias(c) for c in POSITION], *[F.coalesce(v, F.lit(False)).cast("int").alias(c) for c, v in faults.items()],
        F.when(F.col("j.restricted_move") == "ALL", best).alias("main"), F.when(probe, F.col("j.restricted_move")).alias("probed"),
    )
    by_position = found.groupBy(*POSITION).agg(
        *[F.sum(c).alias(c) for c in faults], F.size(F.array_except(F.collect_set("main"), F.collect_set("probed"))).alias("missing_probes")
    )
    return by_position.groupBy("run_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in (*faults, "missing_probes")])


def run_diff(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = METRICS, by: tuple[str, ...] = ("position_id",)) -> DataFrame:
    """(``by``, ``what``, ``in_a``, ``in_b``): positions of one side only, and metrics that changed between the two.

    One full outer join, then unpivoting inside the row; nulls equal nulls.
    """
    x = a.select(*by, F.struct(*metrics).alias("a"))
    y = b.select(*by, F.struct(*metrics).alias("b"))
    j = x.join(y, [*by], "full")
    entry = lambda what, p, q: F.struct(F.lit(what).alias("what"), p.alias("in_a"), q.alias("in_b"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = [F.when(there & ~F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")), entry(m, F.col(f"a.{m}"), F.col(f"b.{m}"))) for m in metrics]
    none = F.lit(None).cast("double")
    only = F.when(F.col("b").isNull(), entry("only_a", none, none)).when(F.col("a").isNull(), entry("only_b", none, none))
    return j.select(*by, F.explode(F.array_compact(F.array(only, *changed))).alias("d")).select(*by, "d.*")


def probe_diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("position_id",)) -> DataFrame:
    """(``by``, ``added``, ``removed``) where the probed moves (array ``moves``) of two sides differ."""
    none = F.array().cast("array<string>")
    j = a.select(*by, F.col("moves").alias("x")).join(b.select(*by, F.col("moves").alias("y")), [*by], "full")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    out = j.select(*by, F.array_sort(F.array_except(y, x)).alias("added"), F.array_sort(F.array_except(x, y)).alias("removed"))
    return out.filter((F.size("added") > 0) | (F.size("removed") > 0))
