"""Problem 6: splits that keep rows together which share a position or a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.boards import FIELDS, computed_once, label, position_text, with_record
from plyforge.operators.skew import HOT_ROWS, hot_hashes, looked_up, with_group_min
from plyforge.session import cut, release


def components(edges: DataFrame, hot_rows: int = HOT_ROWS, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) of every node of the edges (``u``, ``v``); the component is its smallest node.

    Alternating large-star and small-star: the first links every larger
    neighbour of a node to the smallest node around it, the second does so for
    the smaller ones and the node itself. Each halves the depth of what it
    sees, so rounds grow as the logarithm of the longest chain. Rounds are cut
    by written tables and end when the edges no longer change. Hubs are hot
    groups of :func:`with_group_min`. Self-loops only name their node; null
    ends are ignored; no edges give no rows. Nothing is collected but two
    numbers a round.
    """
    given = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).filter("u is not null and v is not null")
    given = cut(given, "edges")
    now = cut(_proper(given), "edges")
    state = _fingerprint(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = cut(_star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u", hot_rows, 2 * state[0]), "large")
        small = cut(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None, hot_rows, state[0]), "small")
        after = _fingerprint(small)
        release(now), release(large)
        now, done, state = small, after == state, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    # settled edges form stars: (node, centre) with one row a node
    return nodes.join(
        now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component")), "node", "left"
    ).withColumn("component", F.coalesce("component", "node"))


def _proper(edges: DataFrame) -> DataFrame:
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def _star(directed: DataFrame, which: str | None, hot_rows: int, total: int) -> DataFrame:
    """Link the chosen neighbours v of each u, and u itself for the small star, to the smallest of u and all v."""
    m = with_group_min(directed, ["u"], "v", "m", None, hot_rows, total=total).withColumn("m", F.least("u", "m"))
    out = m.filter(which).select("v", "m") if which else m.select(F.explode(F.array("u", "v")).alias("v"), "m")
    return _proper(out.select(F.col("v").alias("u"), F.col("m").alias("v")))


def position_families(positions: DataFrame, games: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``position_id``, ``split``, ``family_id``) of every row of ``positions``.

    Rows of the same position are one family; so are rows that occur in the
    same game, where a row occurs in a game of its own source that reached its
    position. The family is named after its smallest id. Rows without a
    readable position are families of their own; a null source occurs in no
    game; games without source, index or readable position join nothing. Plies
    (null or repeated) don't matter.
    """
    rows = with_record(
        positions.select("position_id", "fen", label(F.col("source")).alias("source"), label(F.col("split")).alias("split")), "fen",
        fields=FIELDS[:4]
    ).select("position_id", "source", "split", position_text().alias("position"))
    parsed = cut(rows, "parsed")
    # the same position: a star around its smallest id
    rows = cut(with_group_min(parsed, ["position"], "position_id", "same", "alike", hot_rows), "rows")
    release(parsed)
    named = games.filter("game_index is not null").select("fen", label(F.col("source")).alias("source"), F.col("game_index"))
    reached = with_record(named, "fen", fields=FIELDS[:4]).select("source", position_text().alias("position"), "game_index")
    reached = computed_once(reached, {c: F.col(c) for c in ("source", "position")}).filter("source is not null and position is not null")
    reached = cut(reached.distinct(), "reached")
    placed = rows.filter("source is not null and position is not null").select("source", "position", "same").distinct()
    # every game of a source may begin with one position
    hot = hot_hashes(reached, ["source", "position"], hot_rows) if reached.count() > hot_rows else None
    occurs = looked_up(reached, placed, ["source", "position"], hot=hot)
    occurs = cut(occurs.select("same", "source", "game_index"), "occurs")
    release(reached)
    # the same game, by its whole name: a star around its smallest position
    linked = with_group_min(
        occurs, ["source", "game_index"], "same", "first", None, hot_rows
    ).select(F.col("same").alias("u"), F.col("first").alias("v"))
    found = cut(components(linked, hot_rows), "components").select(F.col("node").alias("same"), "component")
    release(occurs)
    # as a position knows how often it stands there, hot ones needn't be counted again
    hot = cut(rows.filter((F.col("alike") > hot_rows) & F.col("position").isNotNull()).select(F.xxhash64("same").alias("__h")).distinct(), "hot")
    out = looked_up(rows.drop("alike"), found, ["same"], "left", hot if hot.limit(1).count() else None)
    return out.select("position_id", "split", F.coalesce("component", "same").alias("family_id"))


def broken_families(families: DataFrame) -> DataFrame:
    """(``position_id``, ``family_id``) of every row whose family stands in more than one split, null not being one."""
    spread = families.groupBy("family_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a != b").select("family_id")
    return families.join(spread, "family_id", "left_semi").select("position_id", "family_id")


def assign_splits(families: DataFrame, shares: dict[str, float], seed: str = "families-v1", pinned: DataFrame | None = None) -> DataFrame:
    """(``position_id``, ``family_id``, ``new_split``): one split for each family, near the shares in rows.

    A family goes where its hash falls in the ranges of the shares, which
    follow each other in the order given. So its split depends on its id alone:
    whatever else is added, a family that didn't merge stays. A family so large
    that it upsets the proportions (:func:`large_families`) is moved only by
    naming it in ``pinned`` (``family_id``, ``split``; each family once).
    """
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col("family_id").cast("string")), 256)
    u: Column = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    *others, last = shares
    at, chosen = 0.0, None
    for s in others:
        at += shares[s]
        chosen = F.when(u < at, s) if chosen is None else chosen.when(u < at, s)
    chosen = F.lit(last) if chosen is None else chosen.otherwise(last)
    if pinned is None:
        return families.select("position_id", "family_id", chosen.alias("new_split"))
    marked = families.join(pinned.select("family_id", F.col("split").alias("__to")), "family_id", "left")
    return marked.select("position_id", "family_id", F.coalesce("__to", chosen).alias("new_split"))


def large_families(assigned: DataFrame, share: float = 0.01) -> DataFrame:
    """(``family_id``, ``rows``, ``new_split``) of every family that holds more than ``share`` of all rows."""
    sizes = cut(assigned.groupBy("family_id").agg(F.count(F.lit(1)).alias("rows"), F.min("new_split").alias("new_split")), "sizes")
    every = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return sizes.filter(F.col("rows") > F.lit(share * every)).select("family_id", "rows", "new_split")
