"""Exact deduplication, seeded splits and samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.hashing import bucket, seeded_digest
from plyforge.functions.stats import collision_probability
from plyforge.operators.skew import numbered


#: Ranges of buckets of a split, for ever in this order.
SPLIT_WEIGHTS = {"validation": 1, "holdout": 1, "train": 18}


def checked_weights(weights: dict[str, int]) -> dict[str, int]:
    """Whole numbers of buckets for named splits, in the order of their ranges; the last must have one at least."""
    *_, last = weights or {"": 0}
    if weights.get(last, 0) < 1 or any(type(w) is not int or w < 0 for w in weights.values()):
        raise ValueError("weights are whole, none is negative, and that of the last split is positive")
    return weights


def first_seen(df: DataFrame, key: Column, order: list[Column | str], out: str = "key") -> DataFrame:
    """One row per key, the first by ``order``; rows of a null key are left out.

    The row travels as one struct through ``min_by``, which combines before
    the shuffle, so a key with a third of all rows is no hot task. Ties in
    ``order`` are broken by the whole row.
    """
    every = [c for c in df.columns if c != out]
    row = F.struct(*every)
    keyed = df.withColumn(out, key).filter(F.col(out).isNotNull())
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], row)
    return keyed.groupBy(out).agg(F.min_by(row, rank).alias("__row")).select(out, "__row.*")


def dedupe_report(df: DataFrame, key: Column) -> DataFrame:
    """One row: ``total_input``, ``unique_keys``, ``exact_duplicates_removed``, ``malformed_skipped`` (null keys)."""
    sizes = df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("k").isNotNull()
    sums = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_input"), F.count_if(known).alias("unique_keys"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("malformed_skipped")
    )
    return sums.select(
        "total_input", "unique_keys",
        (F.col("total_input") - F.col("unique_keys") - F.col("malformed_skipped")).alias("exact_duplicates_removed"), "malformed_skipped"
    )


def split_of(key: Column, seed: str, weights: dict[str, int] = SPLIT_WEIGHTS) -> Column:
    """The split whose range the key's bucket falls into; null for a null or empty key."""
    total = sum(checked_weights(weights).values())
    b = bucket(seeded_digest(seed, F.nullif(key, F.lit(""))), total)
    if total <= 1000:
        # by place in a constant array: the digest is computed once, not once for each range
        return F.get(F.lit([s for s, w in weights.items() for _ in range(w)]), b)
    upto, chosen = 0, None
    for s, w in weights.items():
        upto += w
        chosen = F.when(b < upto, s) if chosen is None else chosen.when(b < upto, s)
    return chosen


class NoFamily(ValueError):
    """Rows that name no family can't be kept with theirs."""


def split_by_family(
    df: DataFrame, family: Column, seed: str, weights: dict[str, int] = SPLIT_WEIGHTS, out: str = "assigned_split", unnamed: str = "null"
) -> DataFrame:
    """Every row with the split of its family: no family ever stands in two splits.

    The split is a function of the family's name, so nothing is shuffled or
    joined back. Of rows without a family, ``unnamed`` says whether they get no
    split (``null``) or make the plan fail before it gives any row (``error``).
    """
    if unnamed == "error" and df.filter(F.coalesce(family, F.lit("")) == "").limit(1).count():
        raise NoFamily("rows without a family")
    return df.withColumn(out, split_of(family, seed, weights))


def families_in_order(df: DataFrame, family: Column, order: list[str]) -> DataFrame:
    """(``family``, ``family_no`` from 1, first place): the families in the order in which their first row stands; nulls are none."""
    at = F.struct(*order)
    first = df.select(family.alias("family"), *order).filter("family is not null").groupBy("family").agg(F.min(at).alias("first"))
    return numbered(first, [F.asc("first"), F.asc("family")], "family_no").select("family", "family_no", "first.*")


def families_across(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families that stand in more than one split: none, if the assignment is sound."""
    per = df.filter(F.col(family).isNotNull() & F.col(split).isNotNull()).groupBy(family).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return per.filter("a != b").select(family)


def split_counts(df: DataFrame, split: str = "assigned_split", unit: Column | None = None, weights: dict[str, int] = SPLIT_WEIGHTS) -> DataFrame:
    """One row with the number of units (rows, or distinct ``unit``) of each split, zeros included."""
    src = df if unit is None else df.select(unit.alias("__u"), split).distinct()
    return src.agg(*[F.count_if(F.col(split) == s).alias(s) for s in weights])


class TooFew(ValueError):
    """Fewer rows than were asked for."""


def smallest_hashes(df: DataFrame, key: Column, seed: str, n: int, tie: list[str], strict: bool = False) -> DataFrame:
    """The ``n`` rows of the smallest seeded digests, with ``selection_sha256`` and ``batch_index`` from 1.

    Ordering plus limit is a top-k in every task and one merge of ``n`` rows a
    task; equal keys are ordered by ``tie``. Null keys are never selected. With
    ``strict`` fewer than ``n`` are refused.
    """
    if strict and (have := df.filter(key.isNotNull()).limit(n).count()) < n:
        raise TooFew(f"{have} rows can be selected, {n} are asked for")
    top = df.withColumn(
        "selection_sha256", seeded_digest(seed, key)
    ).filter(F.col("selection_sha256").isNotNull()).orderBy("selection_sha256", *tie).limit(n)
    return top.withColumn("batch_index", F.row_number().over(Window.orderBy("selection_sha256", *tie)).cast("bigint"))  # n rows


def draw_distinct(df: DataFrame, key: Column, seed: str, n: int, strict: bool = False) -> DataFrame:
    """``n`` distinct keys without replacement, by seeded digest and then key: (``draw``, ``key``, ``digest``).

    With ``strict`` a pool of fewer keys is refused.
    """
    pool = df.select(key.alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    out = pool.withColumn("digest", seeded_digest(seed, F.col("key"))).orderBy("digest", "key").limit(n)
    if strict and out.count() < n:
        raise TooFew(f"the pool has fewer than {n} distinct keys")
    return out.withColumn("draw", F.row_number().over(Window.orderBy("digest", "key")).cast("bigint"))  # n rows


def suite_report(df: DataFrame, suite: Column, line: Column, key: Column, pairs: int) -> DataFrame:
    """Per suite: non-blank lines, distinct, duplicate and malformed keys, whether ``pairs`` can be drawn, and how likely a draw with replacement repeats one."""
    rows = df.select(suite.alias("suite"), line.alias("l"), key.alias("k")).filter(F.trim("l") != "")
    sizes = rows.groupBy("suite", "k").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("k").isNotNull()
    out = sizes.groupBy("suite").agg(
        F.sum("n").alias("lines"), F.count_if(known).alias("distinct_openings"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("malformed")
    )
    distinct = F.col("distinct_openings")
    return out.withColumns(
        {
            "duplicates": F.col("lines") - distinct - F.col("malformed"), "enough": distinct >= pairs,
            "collision_probability": collision_probability(F.lit(pairs), distinct)
        }
    )


def suite_contracts(df: DataFrame, suite: Column, line: Column, key: Column, pairs: int, seed: str) -> DataFrame:
    """:func:`suite_report` with the record of how openings are selected, as one JSON text a suite; null where too few are there."""
    r = suite_report(df, suite, line, key, pairs)
    selection = F.struct(
        F.lit("seeded_sha256_without_replacement").alias("method"), F.lit(seed).alias("seed"), F.lit(pairs).alias("pairs"),
        F.col("distinct_openings").alias("pool")
    )
    return r.withColumn("selection", F.when(F.col("enough"), F.to_json(selection)))
