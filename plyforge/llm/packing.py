"""Problem 7: items into containers of fixed capacity.

Bounded-space online packing: each partition keeps a fixed number of open
windows, puts an item where it fits best, and when it fits nowhere closes the
fullest window. What is still open at the end of the partitions is packed in
the same way by ever fewer tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.tokens import VOCABULARY, with_token_counts
from plyforge.session import cut, map_arrow

#: Open windows of a partition, and partitions whose leftovers one task takes up.
WINDOWS, FAN_IN = 64, 16


def pack_stream(sizes: Iterator[tuple[object, int]], capacity: int, windows: int, still_open: dict[int, int]) -> Iterator[tuple[object, int, int]]:
    """(item, window, size) for every (item, size) with 0 <= size <= capacity.

    At most ``windows`` windows are open at once; they are numbered from 0 as
    they are opened. An item goes into the window that it leaves the least
    room in (of equal ones the oldest); if it fits in none, the fullest is
    closed and a new one opened. ``still_open`` gets what stays open at the
    end: window to room left.
    """
    free: list[tuple[int, int]] = []
    opened = 0
    for item, size in sizes:
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, w = free.pop(at)
        else:
            if len(free) >= windows:
                free.pop(0)
            room, w = capacity, opened
            opened += 1
        if room > size:
            insort(free, (room - size, w))
        yield item, w, size
    still_open.update({w: room for room, w in free})


def _pack(items: DataFrame, capacity: int, windows: int, level: int) -> DataFrame:
    """(item, window, size, open): where items go, and with ``open`` what each window left open holds.

    Window numbers are unique over levels and partitions. A task streams; it
    holds no more than the open windows.
    """
    schema = "item bigint, n_tokens bigint, window bigint, size bigint, open boolean"
    names = ["item", "n_tokens", "window", "size", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 57) | (TaskContext.get().partitionId() << 36)
        rest: dict[int, int] = {}

        def stream():
            for b in batches:
                ids, tokens, sizes = (c.to_pylist() for c in b.columns)
                yield from zip(zip(ids, tokens, strict=True), sizes, strict=True)

        got: list[tuple] = []
        batch = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.bool_()), strict=True)], names
        )
        for item, w, size in pack_stream(stream(), capacity, windows, rest):
            got.append((*item, base | w, size, False))
            if len(got) >= 20_000:
                yield batch(got)
                got = []
        got += [(None, None, base | w, capacity - room, True) for w, room in rest.items()]
        if got:
            yield batch(got)

    return map_arrow(items.select("item", "n_tokens", "size"), run, schema)


def pack(items: DataFrame, capacity: int, windows: int = WINDOWS, per_partition: int = 50_000) -> DataFrame:
    """(``item``, ``size``, ``container``): items (``item`` bigint, ``size`` 0..capacity) in containers.

    A column ``n_tokens`` goes along, so that rows of null or repeated ids
    needn't be found again.

    Items are spread by a hash of their id over ``ceil(items / per_partition)``
    partitions and taken in the order of that hash, so the result doesn't
    depend on how the input was partitioned. The windows left open by up to
    ``FAN_IN`` partitions are packed on as whole items, the largest first,
    until one task has taken up the last. A size of 0 or null takes no room
    but is placed as well; an empty input gives no containers.
    """
    named = [x for x in ("item", "n_tokens", "size") if x in items.columns]
    items = items.select(
        "item", (F.col("n_tokens") if "n_tokens" in named else F.lit(None)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size")
    )
    parts = max(1, -(-items.count() // per_partition))
    spread = F.xxhash64(F.lit("pack"), "item")
    placed = cut(_pack(items.repartition(parts, spread).sortWithinPartitions(spread, "item", "size", "n_tokens"), capacity, windows, 0), "placed")
    contents, moves, level, left = placed.filter("not open"), None, 0, placed.filter("open")
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        waiting = left.select(F.col("window").alias("item"), "n_tokens", "size")
        merged = cut(
            _pack(waiting.repartition(parts, F.xxhash64("item")).sortWithinPartitions(F.desc("size"), "item"), capacity, windows, level),
            "merged"
        )
        step = merged.filter("not open").select(F.col("item").alias("window"), F.col("window").alias("to"))
        if moves is None:
            moves = step
        else:
            then = step.select(F.col("window").alias("to"), F.col("to").alias("further"))
            moves = moves.join(then, "to", "left").select("window", F.coalesce("further", "to").alias("to"))
        left = merged.filter("open")
        if parts == 1:
            return contents.join(moves, "window", "left").select(*named, F.coalesce("to", "window").alias("container"))


def pack_documents(docs: DataFrame, capacity: int = 8192, windows: int = WINDOWS, per_partition: int = 50_000, path: str = VOCABULARY) -> DataFrame:
    """(``container``, ``doc_id``, ``piece``, ``token_start``, ``token_end``): what each container holds.

    Only a text of more tokens than ``capacity`` is divided: into full
    containers of their own and one remainder, which is packed like any
    other text; pieces are numbered from 0. Empty and null texts have no
    tokens and are placed with ``token_start = token_end``. Repeated texts are
    texts of their own, under repeated or null ids too: every row is placed once.
    Extra columns are ignored.
    """
    sized = cut(with_token_counts(docs.select("doc_id", "text"), path=path), "sized")
    whole = F.floor(F.col("n_tokens") / F.lit(capacity)).cast("bigint")
    rest = F.col("n_tokens") % F.lit(capacity)
    # rows of one id have containers of their own
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_tokens"))
    full = sized.filter(F.col("n_tokens") > capacity).withColumn("again", again).select(
        "doc_id", "again", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece")
    )
    full = full.select(
        F.concat_ws(
            ":", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece",
            F.when(F.col("again") > 1, F.col("again"))
        ).alias("container"),
        "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), ((F.col("piece") + 1) * capacity).alias("token_end")
    )
    small = sized.select(
        "doc_id", "n_tokens", F.when(F.col("n_tokens") <= capacity, F.col("n_tokens")).when(rest > 0, rest).alias("size")
    ).filter("size is not null")
    packed = pack(small.select(F.col("doc_id").alias("item"), "n_tokens", "size"), capacity, windows, per_partition)
    start = F.col("n_tokens") - F.col("size")
    rests = packed.select(
        F.concat_ws(":", F.lit("mixed"), "container").alias("container"), F.col("item").alias("doc_id"), F.floor(start / F.lit(capacity)).cast("bigint").alias("piece"), start.alias("token_start"), F.col("n_tokens").alias("token_end")
    )
    return full.unionByName(rests)


def container_fill(contents: DataFrame, capacity: int = 8192) -> DataFrame:
    """(``container``, ``texts``, ``tokens``, ``fill``) of every container."""
    tokens = F.sum(F.col("token_end") - F.col("token_start"))
    return contents.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), tokens.alias("tokens"), (tokens / F.lit(capacity)).alias("fill"))


def divided(contents: DataFrame) -> DataFrame:
    """(``doc_id``) of every text that had to be divided."""
    return contents.filter("piece = 1").select("doc_id")


def broken_rules(docs: DataFrame, contents: DataFrame, capacity: int = 8192, windows: int = WINDOWS, path: str = VOCABULARY) -> DataFrame:
    """(``rule``, ``violations``) of containers against the texts they hold, told apart by ``doc_id``, whose tokens are counted anew.

    ``cover``: texts whose pieces aren't the whole text, each token once.
    ``divided``: texts that fit a container and were divided. ``capacity``:
    containers of too many tokens. ``half_empty`` and ``containers``: by how
    many more than ``windows`` containers are less than half full, and by how
    many there are more than the fewest possible, a hundredth and ``windows``.
    """
    tokens = with_token_counts(docs.select("doc_id", "text"), path=path)
    end = F.least(F.col("n_tokens"), (F.col("piece") + 1) * capacity)
    right = (F.col("token_start") == F.col("piece") * capacity) & (F.col("token_end") == end)
    joined = contents.join(tokens, "doc_id", "right")
    per = joined.groupBy("doc_id", "n_tokens").agg(
        F.count("container").alias("pieces"), F.countDistinct("piece").alias("places"),
        F.count_if(F.coalesce(~right, F.lit(True))).alias("wrong")
    )
    due = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))
    whole = (F.col("pieces") == due) & (F.col("places") == due) & (F.col("wrong") == 0)
    texts = per.agg(
        F.count_if(~whole).alias("cover"), F.count_if((F.col("n_tokens") <= capacity) & (F.col("pieces") > 1)).alias("divided"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")
    )
    fill = container_fill(contents, capacity).agg(
        F.count_if(F.col("tokens") > capacity).alias("capacity"), F.count_if(F.col("fill") < 0.5).alias("half"),
        F.count(F.lit(1)).alias("n")
    )
    t, f = texts.first(), fill.first()
    least = -(-t.total // capacity)
    found = {
        "cover": t.cover, "divided": t.divided, "capacity": f.capacity, "half_empty": max(0, f.half - windows),
        "containers": max(0, f.n - least - least // 100 - windows)
    }
    return docs.sparkSession.createDataFrame([(k, int(v)) for k, v in found.items()], "rule string, violations bigint")
