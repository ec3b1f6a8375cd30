"""Group minima and predecessors attached to rows, with hot groups kept off single tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.session import cut

#: Rows of one key from which the key counts as hot.
HOT_ROWS = 200_000
#: Hot keys up to which their results are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000


def hot_hashes(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Written table (``__h``) of the 64-bit hashes of keys that more than ``hot_rows`` rows hold; None if there are none.

    Counts combine before the shuffle. At most ``rows / hot_rows`` keys can be
    hot; a hash that two keys share can only make both count as hot.
    """
    counted = rows.groupBy(F.xxhash64(*keys).alias("__h")).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(counted.filter(F.col("n") > hot_rows).select("__h"), "hot")
    return hot if hot.limit(1).count() else None


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key), where any key may hold any share of ``rows``.

    Rows of the ``hot`` keys (:func:`hot_hashes`) aren't shuffled: the facts of
    those keys, which are as few as the keys, go to them, by broadcast up to
    ``BROADCAST_KEYS`` of them. All other rows take a plain join. ``how`` is
    ``inner`` or ``left``; null keys find nothing.
    """
    if hot is None:
        return rows.join(facts, keys, how)
    near = F.broadcast if hot.count() <= BROADCAST_KEYS else (lambda x: x)
    keyed = rows.withColumn("__h", F.xxhash64(*keys))
    few = facts.withColumn("__h", F.xxhash64(*keys)).join(near(hot), "__h", "left_semi").drop("__h")
    rest = keyed.join(near(hot), "__h", "left_anti").drop("__h").join(facts, keys, how)
    many = keyed.join(near(hot), "__h", "left_semi").drop("__h").join(near(few), keys, how)
    return rest.unionByName(many)


def numbered(rows: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``: the place from 1 of each row in the given order, without one task for all rows.

    Rows are range-partitioned, numbered within and offset by the parts before
    (one row for each part). The order must be total to be the same on every run.
    """
    spread = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "spread")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("bigint")
    # as many rows as shuffle partitions
    return spread.join(F.broadcast(offsets), "__part").withColumn(out, inside + F.col("__before")).drop("__part", "__before")


def with_group_min(
    rows: DataFrame, keys: list[str], value: str, out: str, count: str | None = None, hot_rows: int = HOT_ROWS, salts: int = 64,
    total: int | None = None
) -> DataFrame:
    """Add to every row the smallest ``value`` among the rows of equal ``keys`` (and their number).

    1. Hot keys are found exactly from partial counts of a 64-bit hash of the
       key; at most ``rows / hot_rows`` keys can be hot. A hash that two keys
       share can only make both take the hot path, which is just as exact.
    2. Rows of other keys go through one shuffle by that hash.
    3. Rows of hot keys stay where they are: minima and counts come from a
       salted two-level aggregation and are joined back, by broadcast if there
       are at most ``BROADCAST_KEYS`` of them, else by shuffle.

    Rows with a null in any key belong to no group: they keep ``out`` = their
    own value and a count of 1. ``total`` may say how many rows there are; no
    key can be hot if that is below ``hot_rows``. An empty input gives an
    empty result.
    """
    h, own = "__h", "__own"
    lone = F.lit(False)
    for k in keys:
        lone = lone | F.col(k).isNull()
    keyed = rows.withColumn(own, F.when(lone, F.col(value))).withColumn(
        h, F.when(lone, F.xxhash64(F.lit("alone"), value)).otherwise(F.xxhash64(*keys))
    )
    whole = Window.partitionBy(h, *keys, own)

    def shuffled(df: DataFrame) -> DataFrame:
        add = {out: F.when(lone, F.col(value)).otherwise(F.min(value).over(whole))}
        return df.withColumns(add | ({count: F.when(lone, F.lit(1)).otherwise(F.count(F.lit(1)).over(whole)).cast("bigint")} if count else {}))

    hot_n = 0
    if total is None or total > hot_rows:
        hot = cut(keyed.filter(~lone).groupBy(h).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(h), "hot")
        hot_n = hot.count()
    if not hot_n:
        return shuffled(keyed).drop(h, own)
    near = F.broadcast if hot_n <= BROADCAST_KEYS else (lambda x: x)
    rest, many = keyed.join(near(hot), h, "left_anti"), keyed.join(near(hot), h, "left_semi")
    salted = many.groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(salts)).alias("__s")).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("__n"))
    minima = cut(salted.groupBy(*keys).agg(F.min(out).alias(out), F.sum("__n").alias("__n")), "minima")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    add = [F.col(f"b.{out}")] + ([F.col("b.__n").alias(count)] if count else [])
    joined = many.alias("a").join(near(minima).alias("b"), same, "inner").select("a.*", *add)
    return shuffled(rest).unionByName(joined).drop(h, own)


def with_previous(
    rows: DataFrame, by: list[str], order: list[str], columns: dict[str, str], first: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add values of the row before, within equal ``by`` and in the order of ``order``.

    ``columns`` maps a column to the name its previous value gets; ``first``
    names a flag of rows without predecessor. Nulls in ``by`` are a group like
    any other; rows that tie in ``order`` follow each other in any order, so
    callers give a total one.

    Groups of up to ``hot_rows`` rows take one window. Larger ones would put a
    sorted run of any length into one task; their rows are spread by ranges of
    (``by``, ``order``) instead, predecessors are taken within each range, and
    the first row of a range gets its own from the last row of the range before
    (one row for each range).
    """
    h, seen = "__h", "__seen"
    flag = {first: F.col(seen).isNull()} if first else {}
    keyed = rows.withColumn(h, F.xxhash64(*by))
    hot = cut(keyed.groupBy(h).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(h), "hot")
    hot_n = hot.count()

    def lagged(df: DataFrame, w) -> DataFrame:
        return df.withColumns({new: F.lag(old).over(w) for old, new in columns.items()} | {seen: F.lag(F.lit(1)).over(w)})

    def plain(df: DataFrame) -> DataFrame:
        return lagged(df, Window.partitionBy(*by).orderBy(*order))

    if not hot_n:
        return plain(keyed).withColumns(flag).drop(h, seen)
    near = F.broadcast if hot_n <= BROADCAST_KEYS else (lambda x: x)
    rest = plain(keyed.join(near(hot), h, "left_anti"))
    many = keyed.join(near(hot), h, "left_semi")
    spread = cut(many.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = lagged(spread, Window.partitionBy("__part", *by).orderBy(*order))
    ends = spread.groupBy("__part", *by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    # groups and ranges follow the same order, so the range before is the nearest lower one that holds the group
    before = ends.withColumns(
        {
            "__last": F.lag("__last").over(Window.partitionBy(*by).orderBy("__part")),
            "__any": F.lag(F.lit(1)).over(Window.partitionBy(*by).orderBy("__part"))
        }
    )
    same = [F.col("i.__part") == F.col("e.__part"), *[F.col(f"i.{b}").eqNullSafe(F.col(f"e.{b}")) for b in by]]
    joined = inside.alias("i").join(F.broadcast(before).alias("e") if hot_n <= BROADCAST_KEYS else before.alias("e"), same)
    start = F.col(f"i.{seen}").isNull()
    filled = joined.select(
        *[F.col(f"i.{c}") for c in keyed.columns],
        *[F.when(start, F.col(f"e.__last.{old}")).otherwise(F.col(f"i.{new}")).alias(new) for old, new in columns.items()],
        F.coalesce(F.col(f"i.{seen}"), F.col("e.__any")).alias(seen)
    )
    return rest.unionByName(filled).withColumns(flag).drop(h, seen)
