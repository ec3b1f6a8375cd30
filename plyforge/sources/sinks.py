"""Writers with the guarantees of the stores they stand for, on plain files.

Parquet has no upsert: a changed table is written as a new snapshot and moved
into place; append-only tables get new files. Concurrent writers must be kept
apart by the caller. Between the two renames of a swap there is no table under
its name; should a writer end there, :func:`recover`, which every writer calls
first and :func:`stored` before reading, puts the last whole snapshot back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.operators.history import repeated


class Conflict(ValueError):
    """What should be added contradicts what is stored."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was broken off, and remove what it left behind.

    Without a table, the new snapshot is taken if it was written whole (its
    success marker is there), else the old one.
    """
    p, fs = _fs(spark, path)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside = {kind: [s.getPath() for s in fs.globStatus(P(f"{path}.{kind}-*")) or []] for kind in ("new", "old")}
    whole = [x for x in beside["new"] if fs.exists(P(x, "_SUCCESS"))]
    if not fs.exists(p) and beside["old"]:
        fs.rename((whole or beside["old"])[0], p)
    for left in (*beside["new"], *beside["old"]):
        if fs.exists(p) and fs.exists(left):
            fs.delete(left, True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands, after a broken swap too."""
    recover(spark, path)
    return spark.read.parquet(path)


def _swap(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write beside, then rename twice."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(new)
    (p, fs), n, o = _fs(spark, path), _fs(spark, new)[0], _fs(spark, old)[0]
    if fs.exists(p):
        fs.rename(p, o)
    fs.rename(n, p)
    fs.delete(o, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file on the file system of its path, replacing what is there at once."""
    (new, fs), (p, _) = _fs(spark, path + ".new"), _fs(spark, path)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(new, p)


def insert_new(df: DataFrame, path: str, key: list[str], arrival: list[str]) -> None:
    """Append rows whose key isn't stored yet; of a key's new rows the first by ``arrival``."""
    row = F.struct(*df.columns)
    first = df.groupBy(*key).agg(F.min_by(row, F.struct(*arrival, row)).alias("__r")).select("__r.*")
    spark = df.sparkSession
    recover(spark, path)
    if _exists(spark, path):
        first = first.join(spark.read.parquet(path).select(*key), key, "left_anti")
    first.write.mode("append").parquet(path)


def upsert_latest(df: DataFrame, path: str, key: list[str], version: list[str], partition_by: list[str] | None = None) -> None:
    """A new snapshot that holds, of every key, the latest row by ``version`` among stored and new ones."""
    spark = df.sparkSession
    recover(spark, path)
    every = spark.read.parquet(path).select(*df.columns).unionByName(df) if _exists(spark, path) else df
    row = F.struct(*df.columns)
    latest = every.groupBy(*key).agg(F.max_by(row, F.struct(*version, row)).alias("__r")).select("__r.*")
    _swap(latest, path, partition_by or [])


def surviving_children(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Child rows of parent versions that are still stored."""
    return children.join(parents.select(*key), key, "left_semi")


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def create_immutable(df: DataFrame, path: str, key: list[str]) -> None:
    """Append rows of new keys; a key that is stored or comes several times must have the same values."""
    spark = df.sparkSession
    recover(spark, path)
    twice = df.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise Conflict(f"{key} {[twice[0][k] for k in key]} comes with several values")
    if _exists(spark, path):
        others = [c for c in df.columns if c not in key]
        stored = spark.read.parquet(path)
        same = F.lit(True)
        for c in others:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
        changed = df.alias("n").join(stored.alias("s"), key).filter(~same).limit(1).collect()
        if changed:
            raise Conflict(f"{key} {[changed[0][k] for k in key]} is stored with other values")
    insert_new(df, path, key, key)


def append_records(df: DataFrame, path: str, content_id: str = "record_id", name: str = "run_id") -> None:
    """Idempotent append: a stored content id is skipped, a stored name with another content id refused."""
    spark = df.sparkSession
    if repeated(df.dropDuplicates([content_id]), [name]).limit(1).count():
        raise Conflict(f"one {name} with several {content_id}")
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        clash = df.alias("n").join(stored.alias("s"), name).filter(F.col(f"n.{content_id}") != F.col(f"s.{content_id}")).limit(1).collect()
        if clash:
            raise Conflict(f"{name} {clash[0][name]} is stored with another {content_id}")
    insert_new(df, path, [content_id], [content_id])


def rebuild_index(flat: DataFrame, path: str, version: str = "v1") -> None:
    """The whole flat index anew, and beside it its record count and version."""
    _swap(flat, path, [])
    spark = flat.sparkSession
    n = spark.read.parquet(path).count()
    _swap(
        spark.createDataFrame([("ledger_schema_version", version), ("record_count", str(n))], "key string, value string"),
        path.rstrip("/") + "_metadata", []
    )


def finished_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with their final status: an error text, a best move, or no legal moves."""
    return jobs.withColumn(
        "status", F.when(F.col("error_text").isNotNull(), "error").when(F.col("bestmove").isNotNull(), "ok").otherwise("no_legal_moves")
    )


def write_tsv(df: DataFrame, path: str, first: list[str] | None = None, order: list[str] | None = None) -> None:
    """Tab-separated with header and LF, the columns of ``first`` in front; with ``order`` one file in that order."""
    names = [*(first or []), *[c for c in df.columns if c not in (first or [])]]
    if order:
        df = df.repartitionByRange(1, *order).sortWithinPartitions(*order)
    df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])
    df.write.mode("overwrite").csv(
        path, sep="\t", header=True, quote="", emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_lines(df: DataFrame, path: str, line: str, order: list[str]) -> None:
    """One text file, one line a row, in the given order; refuses an empty table."""
    if not df.limit(1).count():
        raise ValueError("nothing to write")
    ordered = df.select(*order, F.col(line).alias("__line")).repartitionByRange(1, *order).sortWithinPartitions(*order)
    ordered.select("__line").write.mode("overwrite").text(path)


def write_rescored(df: DataFrame, path: str, order: list[str], **meta: object) -> int:
    """Rescored rows as :func:`write_tsv`, and a sidecar with the true number of rows and what else is given."""
    import json

    write_tsv(df, path, order=order)
    n = df.count()
    write_text(df.sparkSession, path.rstrip("/") + ".meta.json", json.dumps({"rows": n, **meta}, sort_keys=True, indent=1))
    return n
