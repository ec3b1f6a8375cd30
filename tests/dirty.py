"""Copies of the test tables with nulls anywhere, repeated rows, no rows, or more columns."""

from pyspark.sql import functions as F

KINDS = ("nulls", "repeated", "empty", "more_columns")
#: Names that operators use for columns of their own.
CLASHING = ("key", "size", "item", "container", "piece", "n", "cid", "board", "left", "right", "keep_id", "copies", "u", "v", "m", "node", "component", "times", "share", "reason", "value", "h", "strength", "item_id", "n_tokens", "family_id", "same", "game")


def write(spark, source, target, tables, kind):
    for t in tables:
        df = spark.read.parquet(f"{source}/{t}.parquet")
        if kind == "nulls":
            df = df.select(*[F.when(F.pmod(F.xxhash64(F.lit(c), *df.columns), F.lit(6)) != 0, F.col(c)).alias(c) for c in df.columns])
        elif kind == "repeated":
            df = df.unionByName(df)
        elif kind == "empty":
            df = df.limit(0)
        else:
            df = df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
        df.repartition(3).write.parquet(f"{target}/{t}.parquet")
