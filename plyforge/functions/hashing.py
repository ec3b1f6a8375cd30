"""Digests, buckets and identities."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.session import ship


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def seeded_digest(seed: str, key: Column) -> Column:
    """Hex SHA-256 of seed, NUL, key; null for a null key."""
    return F.sha2(F.concat(F.encode(F.lit(seed), "UTF-8"), F.lit(bytearray(b"\0")), F.encode(key, "UTF-8")), 256)


def bucket(digest: Column, total: int) -> Column:
    """First 8 digest bytes, big-endian and unsigned, modulo ``total``."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(total)).cast("int")


def canonical_json(value: object) -> str:
    """Keys sorted, no blanks, UTF-8 unescaped, non-finite numbers refused, one line feed at the end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def canonical_documents(without: tuple[str, ...] = ()):
    """Arrow UDF: JSON object text to canonical text, less some top-level fields.

    Number spelling (1 or 1.0) is kept apart as JSON keeps it; null for text
    that is no JSON object or holds NaN or infinities.
    """

    if spark := SparkSession.getActiveSession():
        ship(spark)

    def refuse(x: str) -> None:
        raise ValueError(x)

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            try:
                doc = json.loads(t, parse_constant=refuse)
                out.append(canonical_json({k: v for k, v in doc.items() if k not in without}) if isinstance(doc, dict) else None)
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def document_identity(text: Column, without: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical_documents(without)(text), 256)


def content_identity(paths: Column) -> Column:
    """Identity of a file set: array of struct(path, sha256, size_bytes), in any order.

    Strings and whole numbers render alike in JSON everywhere, so no Python is needed.
    """
    files = F.transform(
        F.array_sort(paths), lambda f: F.struct(f["path"].alias("path"), f["sha256"].alias("sha256"), f["size_bytes"].alias("size_bytes"))
    )
    return F.sha2(F.concat(F.to_json(F.struct(files.alias("files"), F.lit("v1").alias("version"))), F.lit("\n")), 256)
