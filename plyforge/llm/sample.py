"""Problem 1: a sample that reruns, repartitioning and growth leave in place.

Keys go permanently into fine buckets. The sample is the rows of a list of
buckets that follows one fixed permutation and is only ever appended to. How
far the list goes is kept in a manifest, a table that is only added to, so
that nothing that arrives, changes or goes later can shorten it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.session import cut, release

BUCKETS = 4096
#: Fixed odd factors and the shift of the permutation of bucket numbers.
FACTORS, SHIFT = (1637, 2741), 5
#: Standard deviations by which a split may fall short of its share before the list grows.
SLACK = 3.0


def bucket_of(key: Column, seed: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key for ever: the first 32 bits of SHA-256(seed, NUL, key)."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def place_of(bucket: Column, buckets: int = BUCKETS) -> Column:
    """Place of a bucket in the fixed permutation; ``buckets`` is a power of two, so each step is a bijection."""
    x = bucket * FACTORS[0] % buckets
    x = x.bitwiseXOR(F.shiftright(x, SHIFT))
    return x * FACTORS[1] % buckets


#: What a manifest holds: one row for each time a list was made or grew.
MANIFEST = "seed string, buckets int, share double, length int"


def kept_length(spark: SparkSession, manifest: str, seed: str, buckets: int, share: float) -> int:
    """The length to which the list of this seed, number of buckets and share has grown; 0 if there is none yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    rows = spark.read.schema(MANIFEST).parquet(manifest)
    same = rows.filter((F.col("seed") == seed) & (F.col("buckets") == buckets) & (F.col("share") == share))
    return same.agg(F.max("length")).first()[0] or 0


def keep_length(spark: SparkSession, manifest: str, seed: str, buckets: int, share: float, length: int) -> None:
    """Append the length to the manifest."""
    spark.createDataFrame([(seed, buckets, share, length)], MANIFEST).coalesce(1).write.mode("append").parquet(manifest)


def _falls_short(counts: DataFrame, length: int, share: float) -> bool:
    """Whether at some intake a split holds fewer keys in the first ``length`` buckets than its share of the keys known by then, beyond chance."""
    per = counts.groupBy("split", "intake").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("place") < length, F.col("n")).otherwise(0)).alias("inside")
    )
    upto = Window.partitionBy("split").orderBy("intake")  # a row for each intake
    total = F.sum("n").over(upto) * F.lit(share)
    want = F.floor(total - F.lit(SLACK) * F.sqrt(total))
    return bool(per.select((F.sum("inside").over(upto) < want).alias("short")).agg(F.max("short")).first()[0])


def needed_length(counts: DataFrame, share: float, buckets: int, least: int) -> int:
    """The shortest list, not below ``least``, under which no split falls short at any intake; found by halving."""
    if not _falls_short(counts, least, share):
        return least
    low, high = least, buckets
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _falls_short(counts, mid, share) else (low, mid)
    return high


def nested_sample(
    df: DataFrame, key: Column, split: Column, intake: Column, share: float = 0.05, seed: str = "sample-v1", buckets: int = BUCKETS,
    manifest: str | None = None
) -> DataFrame:
    """``df`` restricted to the sample, with ``sample_bucket`` and ``sample_place`` added.

    The list starts with ``ceil(share * buckets)`` buckets and is appended to
    when, at some intake, a split holds fewer chosen keys than ``share`` of
    the keys it had by then, by more than chance explains (``SLACK``). All rows
    of one key are chosen or left together, in whatever split they stand; so is
    every key of a bucket.

    ``manifest`` names a folder that keeps how far the list has grown. With it
    no key ever leaves the sample, whatever is added under any intake, known or
    null, changed or removed. Without it the length follows from the rows at
    hand; since it depends on every intake and those before it alone, keys stay
    as long as only later intakes come in. One writer at a time.

    Nulls: rows without key are never chosen (callers give them one); a null
    split is a split of its own; a null intake counts as the earliest. Row
    order, repeated rows, extra columns and partitioning have no effect. Empty
    input gives an empty sample.

    Cost: one shuffle of (split, 64-bit key hash) after partial aggregation;
    rows are only filtered. Only yes or no reaches the driver.
    """
    if buckets & (buckets - 1) or not 0 < share <= 1:
        raise ValueError("buckets must be a power of two and share in (0, 1]")
    spark = df.sparkSession
    marked = df.withColumn("sample_bucket", bucket_of(key, seed, buckets)).withColumn(
        "sample_place", place_of(F.col("sample_bucket"), buckets).cast("int")
    )
    named = marked.filter(F.col("sample_place").isNotNull()).select(
        F.coalesce(split, F.lit("")).alias("split"), F.xxhash64(key).alias("k"), F.col("sample_place").alias("place"), F.coalesce(intake.cast("bigint"), F.lit(-(2**62))).alias("intake")
    )
    first = named.groupBy("split", "place", "k").agg(F.min("intake").alias("intake"))
    counts = cut(first.groupBy("split", "intake", "place").agg(F.count(F.lit(1)).alias("n")), "counts")
    kept = kept_length(spark, manifest, seed, buckets, share) if manifest else 0
    longest = needed_length(counts, share, buckets, max(int(np.ceil(share * buckets)), kept))
    release(counts)
    if manifest and longest > kept:
        keep_length(spark, manifest, seed, buckets, share, longest)
    # one number decides; with it the sample is a filter of the scan
    return marked.filter(F.col("sample_place") < longest)


def growth(states: list[DataFrame], key: Column, split: Column, intake: Column, manifest: str, **kw) -> DataFrame:
    """(``step`` from 1, ``chosen``, ``lost``): keys chosen in each state of a table, and how many chosen before, still there, aren't any more.

    The states are taken in turn under one manifest. Nothing may ever be lost.
    """
    each = [nested_sample(s, key, split, intake, manifest=manifest, **kw).select(key.alias("key")).distinct() for s in states]
    out, ever = [], None
    for k, (state, chosen) in enumerate(zip(states, each, strict=True), 1):
        chosen = cut(chosen, "chosen")
        gone = chosen.limit(0) if ever is None else ever.join(chosen, "key", "left_anti").join(state.select(key.alias("key")), "key", "left_semi")
        marks = chosen.select(F.lit(1).alias("chosen"), F.lit(0).alias("lost")).unionByName(
            gone.select(F.lit(0).alias("chosen"), F.lit(1).alias("lost"))
        )
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        out.append(marks.agg(zero("chosen"), zero("lost")).select(F.lit(k).alias("step"), "chosen", "lost"))
        ever = chosen if ever is None else cut(ever.unionByName(chosen).distinct(), "ever")
    return reduce(DataFrame.unionByName, out)
