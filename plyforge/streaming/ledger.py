"""The ledger as a stream: new files are flattened, deduplicated and checked as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plyforge.operators.history import flatten
from plyforge.session import ship


def ledger_stream(spark: SparkSession, folder: str, late: str = "7 days", files: int = 100) -> DataFrame:
    """Flat records of the JSON lines in a growing folder, each ``record_id`` once.

    ``recorded_at`` is event time. State is bounded by the watermark: a repeat
    that comes later than ``late`` after the newest record is not recognised.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder).withColumnRenamed("value", "line")
    flat = flatten(lines).withColumn("recorded_time", F.try_to_timestamp(F.col("recorded_at")))
    return flat.filter(
        "record_id is not null and recorded_time is not null"
    ).withWatermark("recorded_time", late).dropDuplicatesWithinWatermark(["record_id"])


def results_per_window(records: DataFrame, width: str = "1 day") -> DataFrame:
    """Wins, losses and draws by window and opponent."""
    by = records.groupBy(F.window("recorded_time", width), "opponent_id")
    return by.agg(
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("draws").alias("draws"), F.count(F.lit(1)).alias("records")
    ).select(F.col("window.start").alias("start"), "opponent_id", "wins", "losses", "draws", "records")


def transition_violations(
    events: DataFrame, key: str, state: str, order: str, first: list[str], allowed: dict[str, list[str]], forget_ms: int | None = None
) -> DataFrame:
    """Events that can't follow the last state of their key, over any number of micro-batches.

    The state kept for a key is its last state. Within a batch events are taken
    in the order of ``order``; across batches in arrival. What a batch holds of
    a key is sorted in one task, so batches are bounded at the source
    (``maxFilesPerTrigger``). A key without events for ``forget_ms`` is
    forgotten and begins anew; without it state grows with the keys.
    """

    def check(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before = held.get[0] if held.exists else None
        bad = []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable").itertuples(index=False):
            now = getattr(row, state)
            if now not in (first if before is None else allowed.get(before, [])):
                bad.append((k[0], str(getattr(row, order)), before, now))
            before = now
        held.update((before,))
        if forget_ms:
            held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(bad, columns=["key", "at", "previous", "state"])

    ship(events.sparkSession)
    return events.select(key, state, order).groupBy(key).applyInPandasWithState(
        check, "key string, at string, previous string, state string", "state string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    )
