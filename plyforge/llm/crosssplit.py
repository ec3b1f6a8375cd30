"""Problem 2: the same or nearly the same position on both sides of a split.

A weighted cosine join. A board is a vector of 64 terms, one for each square
with what stands on it; a term weighs the more the rarer it is among all
boards. Inverted lists are kept only for what a board's heaviest terms can
prove: two boards that differ on at most ``d`` squares share at least ``k`` of
the ``d + k`` heaviest terms of either (all boards order terms alike), so lists
are keyed by the ``k``-subsets of that prefix. Pairs of a list are pruned by the
norms of what lies behind the prefix, and by an 8-byte signature of the ranks
(boards that differ on ``d`` squares differ on at most ``d`` ranks), before any
board is fetched; those left get exact dot products and the exact number of
differing squares.

A list too long to compare is split by the next heaviest terms of its boards.
Boards that are still together then, nearly empty ones, meet in lists keyed by
the whole board with every choice of ``d`` ranks left out, and where that isn't
enough of ``d`` squares, whose lists hold but boards that differ nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.boards import label, with_record
from plyforge.operators.skew import BROADCAST_KEYS, HOT_ROWS, with_group_min
from plyforge.session import cut, map_arrow, scratch

PIECES = ".PNBRQKpnbrqk"
TERMS = 64 * len(PIECES)
_CODE = np.zeros(256, np.int64)
for _i, _x in enumerate(PIECES):
    _CODE[ord(_x)] = _i

#: Of a list, the pairs (left rows times right rows) from which it is split further.
HOT_PAIRS = 250_000
#: The ways lists are split, one after the other: by heaviest terms, or by leaving out blocks of so many.
STEPS = (("terms", 0), ("terms", 1), ("blocks", 8), ("blocks", 64))


def _matrix(boards: pa.Array) -> np.ndarray:
    """[n, 64] term numbers of an Arrow array of 64-character boards."""
    flat = np.frombuffer("".join(boards.to_pylist()).encode(), np.uint8).reshape(-1, 64)
    return _CODE[flat] + np.arange(64) * len(PIECES)


_MIX = np.array([[((f * 64 + c) * 0x9E3779B1 + 0x7F4A7C15) >> 7 & 0xFFFF for c in range(len(PIECES))] for f in range(8)], np.int64)


def signatures(terms: np.ndarray) -> np.ndarray:
    """A byte for each rank, equal for equal ranks, as one 64-bit number."""
    codes = (terms % len(PIECES)).reshape(-1, 8, 8)
    mixed = _MIX[np.arange(8), codes].sum(2) * 0x2545F491 >> 16 & 0xFF
    return (mixed.astype(np.uint64) << np.arange(0, 64, 8, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def ranks_apart(a: Column, b: Column) -> Column:
    """On how many ranks two signatures differ: the non-zero bytes of their difference."""
    x = a.bitwiseXOR(b)
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def term_counts(boards: DataFrame) -> np.ndarray:
    """How many of the boards hold each term; at most 832 sums a task leave the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_matrix(b.column(0)).ravel(), minlength=TERMS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(TERMS, np.int64)
    for r in map_arrow(boards.select("board"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def squared_weights(counts: np.ndarray) -> np.ndarray:
    """Inverse document frequency: ln(1 + boards / boards with the term)."""
    boards = max(1, counts.sum() // 64)
    return np.log1p(boards / np.maximum(counts, 1))


class Lists:
    """Turns boards into entries of inverted lists under fixed term weights."""

    def __init__(self, v: np.ndarray, differ: int, share: int):
        self.v, self.differ, self.share = v, differ, share
        order = np.lexsort((np.arange(TERMS), -v))
        self.rank = np.empty(TERMS, np.int64)
        self.rank[order] = np.arange(TERMS)
        self.by_rank = v[order]
        self.subsets = list(combinations(range(differ + share), share))

    def bounds(self, ranks: np.ndarray, norm: np.ndarray, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heaviest ranks not held, need, rest) of boards given by the ranks of their terms."""
        size = self.differ + self.share
        v = self.by_rank[ranks]
        need = norm - np.partition(v, 64 - self.differ, 1)[:, 64 - self.differ :].sum(1) if self.differ else norm
        if held is not None:
            ranks = np.where((ranks[:, :, None] == held[:, None, :]).any(2), TERMS, ranks)
        top = np.sort(np.partition(ranks, size - 1, 1)[:, :size], 1)
        rest = norm - np.append(self.by_rank, 0.0)[top].sum(1)
        return top, need, rest if held is None else rest - self.by_rank[held].sum(1)

    def keyed(self, step: tuple[str, int], boards: pa.Array, sides: pa.Array, held: pa.Array | None, outer: np.ndarray | None):
        """(keys [board, list], heaviest terms [board, list, share] or None, need, norm, rest, signatures) of boards.

        Keys are 64-bit. Those of the first lists are the terms themselves; in
        all others a clash only brings boards together that are told apart
        when compared.
        """
        kind, level = step
        terms = _matrix(boards)
        ranks = self.rank[terms]
        norm = self.by_rank[ranks].sum(1)
        side = np.frombuffer("".join(sides.to_pylist()).encode(), np.uint8) == ord("w")
        sig = signatures(terms)
        if kind == "blocks":
            zero = np.zeros(len(norm))
            return blanked(terms, side, level, self.differ), None, zero, zero, zero, sig
        fixed = np.stack([np.frombuffer(x, np.int16) for x in held.to_pylist()]).astype(np.int64) if level else None
        top, need, rest = self.bounds(ranks, norm, fixed)
        chosen = np.stack([top[:, s] for s in self.subsets], 1)
        flat = np.zeros(chosen.shape[:2], np.int64)
        for j in range(self.share):
            flat = flat * (TERMS + 1) + chosen[:, :, j]
        flat = flat * 2 + side[:, None]
        if level:
            flat = _mixed(flat.astype(np.uint64) + _mixed(outer.astype(np.uint64))[:, None]).view(np.int64)
            chosen = np.concatenate([np.repeat(fixed[:, None, :], len(self.subsets), 1), chosen], 2)
        return flat, chosen, need, norm, np.maximum(rest, 0), sig

    def entries(self, step: tuple[str, int], what: str):
        """Arrow function over (cid, board, side, left, right[, key, held]) of the boards that enter the lists of a step.

        ``what`` is ``rows`` (cid, key, need, norm, rest, sig), ``sizes`` (key,
        l, r: boards of either side, added up for each batch), or ``held``
        (cid, key, held: the terms that a list's boards share).
        """
        deep = step[0] == "terms" and step[1] > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                # lists of single squares are many: few boards at a time
                for at in range(0, whole.num_rows, 512 if step == ("blocks", 64) else 20_000):
                    b = whole.slice(at, 512 if step == ("blocks", 64) else 20_000)
                    keys, chosen, need, norm, rest, sig = self.keyed(
                        step, b.column(1), b.column(2), b.column(6) if deep else None, np.asarray(b.column(5)) if deep else None
                    )
                    each = keys.shape[1]
                    rep = lambda x, t: pa.array(np.repeat(np.asarray(x), each).astype(t))  # noqa: E731,B023
                    flat = keys.ravel()
                    if what == "sizes":
                        found, place = np.unique(flat, return_inverse=True)
                        count = lambda c: np.bincount(
                            place, np.repeat(np.asarray(b.column(c).to_pylist(), float), each), len(found)
                        ).astype(np.int64)  # noqa: E731,B023
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count(3)), pa.array(count(4))], ["key", "l", "r"])
                    elif what == "held":
                        terms = chosen.reshape(len(flat), -1).astype(np.int16)
                        yield pa.RecordBatch.from_arrays(
                            [rep(b.column(0), np.int64), pa.array(flat), pa.array([x.tobytes() for x in terms], pa.binary())],
                            ["cid", "key", "held"]
                        )
                    else:
                        cols = [
                            rep(b.column(0), np.int64), pa.array(flat), rep(need, np.float32), rep(norm, np.float32), rep(rest, np.float32),
                            rep(sig, np.int64)
                        ]
                        yield pa.RecordBatch.from_arrays(cols, ["cid", "key", "need", "norm", "rest", "sig"])

        return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def blanked(terms: np.ndarray, side: np.ndarray, blocks: int, differ: int) -> np.ndarray:
    """[board, choice] keys of boards with every choice of ``differ`` of their ``blocks`` left out."""
    code = _mixed(np.arange(1, TERMS + 1, dtype=np.uint64))
    of = code[terms].reshape(len(terms), blocks, 64 // blocks).sum(2, dtype=np.uint64)
    out = list(combinations(range(blocks), differ))
    gone = np.zeros((len(terms), len(out)), np.uint64)
    for j in range(differ):
        gone += of[:, [c[j] for c in out]]
    kept = of.sum(1, dtype=np.uint64)[:, None] - gone + _mixed(side.astype(np.uint64) + np.uint64(TERMS + 7))[:, None]
    return _mixed(kept ^ _mixed(np.arange(len(out), dtype=np.uint64) + np.uint64(1 << 40))[None, :]).view(np.int64)


#: What the bound may fall short by through 32-bit storage.
SLACK = 1e-2


def _pruned(left: DataFrame, right: DataFrame, differ: int) -> DataFrame:
    """Pairs of equal lists whose greatest possible dot product reaches what both need and whose ranks are near enough."""
    a, b = left.alias("a"), right.alias("b")
    front = F.least(F.col("a.norm") - F.col("a.rest"), F.col("b.norm") - F.col("b.rest"))
    bound = front + F.sqrt(F.col("a.rest") * F.col("b.rest")) + F.lit(SLACK)
    near = ranks_apart(F.col("a.sig"), F.col("b.sig")) <= differ
    pairs = a.join(b, [F.col("a.key") == F.col("b.key"), bound >= F.greatest("a.need", "b.need"), near])
    return pairs.select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b"))


def candidates(flat: DataFrame, lists: Lists, hot_pairs: int, sizes_seen: list[int] | None = None) -> DataFrame:
    """Pairs of boards that may be near: every near pair is among them.

    ``flat``: (``cid``, ``board``, ``side``, ``left``, ``right``). At each of
    the ``STEPS`` lists of up to ``hot_pairs`` pairs are compared and the boards
    of the others go on to the next; the last lists hold few boards by
    construction. ``sizes_seen`` gets the pairs of the longest list compared.
    """
    names = ["cid", "board", "side", "left", "right"]
    todo, found = flat, []
    for k, step in enumerate(STEPS):
        into = lambda what, schema, rows=todo, step=step: map_arrow(rows, lists.entries(step, what), schema)
        last = k + 1 == len(STEPS)
        hot, near = None, lambda x: x
        if not last or sizes_seen is not None:
            sizes = into("sizes", "key bigint, l bigint, r bigint").groupBy("key").agg((F.sum("l") * F.sum("r")).alias("pairs"))
            sizes = cut(sizes.filter(F.col("pairs") > 0), "sizes") if sizes_seen is not None else sizes
            if sizes_seen is not None:
                sizes_seen.append(sizes.filter(F.lit(last) | (F.col("pairs") <= hot_pairs)).agg(F.max("pairs")).first()[0] or 0)
        if not last:
            hot = cut(sizes.filter(F.col("pairs") > hot_pairs).select("key"), "hotlists")
            n_hot = hot.count()
            near = F.broadcast if n_hot <= BROADCAST_KEYS else (lambda x: x)
            hot = hot if n_hot else None
        schema = "cid bigint, key bigint, need float, norm float, rest float, sig bigint"
        side = lambda which: into("rows", schema, todo.filter(which))  # noqa: E731,B023
        left, right = side("left"), side("right")
        if hot is not None:
            left, right = left.join(near(hot), "key", "left_anti"), right.join(near(hot), "key", "left_anti")
        found.append(_pruned(left, right, lists.differ))
        if hot is None:
            break
        if STEPS[k + 1][0] == "terms":
            held = into("held", "cid bigint, key bigint, held binary").join(near(hot), "key", "left_semi")
            todo = cut(held.join(flat, "cid").select(*names, "key", "held"), "deeper")
        else:
            keys = into("rows", schema).join(near(hot), "key", "left_semi").select("cid").distinct()
            todo = cut(keys.join(flat, "cid").select(*names), "deeper")
    return reduce(DataFrame.unionByName, found)


def near_boards(classes: DataFrame, differ: int = 2, share: int = 3, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Pairs of boards (``cid_a`` of the left side, ``cid_b`` of the right) that differ on at most ``differ`` squares.

    ``classes``: (``cid`` bigint, ``board``, ``side``, ``left`` and ``right``
    booleans), one row for each distinct board and side. Adds ``differing`` and
    the exact weighted ``cosine``. A class that stands on both sides pairs with
    itself. A list that would give more than ``hot_pairs`` pairs is split
    further, which loses nothing (:func:`candidates`).
    """
    weights = squared_weights(term_counts(classes))
    flat = classes.select("cid", "board", "side", "left", "right")
    found = cut(candidates(flat, Lists(weights, differ, share), hot_pairs).distinct(), "candidates")
    return _verified(found, classes, weights, differ)


def _verified(pairs: DataFrame, classes: DataFrame, weights: np.ndarray, differ: int) -> DataFrame:
    a = classes.select(F.col("cid").alias("cid_a"), F.col("board").alias("board_a"))
    b = classes.select(F.col("cid").alias("cid_b"), F.col("board").alias("board_b"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            ta, tb = _matrix(x.column(2)), _matrix(x.column(3))
            same = ta == tb
            dot = np.where(same, weights[ta], 0).sum(1)
            cosine = dot / np.sqrt(weights[ta].sum(1) * weights[tb].sum(1))
            n = 64 - same.sum(1)
            keep = pa.array(n <= differ)
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), pa.array(n.astype(np.int32)), pa.array(cosine)], ["cid_a", "cid_b", "differing", "cosine"]
            ).filter(keep)

    joined = pairs.join(a, "cid_a").join(b, "cid_b").select("cid_a", "cid_b", "board_a", "board_b")
    return map_arrow(joined, exact, "cid_a bigint, cid_b bigint, differing int, cosine double")


def memberships(positions: DataFrame, left_splits: tuple[str, ...], right_splits: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the splits concerned with the class (smallest id of equal board and side) they belong to."""
    named = positions.select("position_id", "fen", label(F.col("source")).alias("source"), label(F.col("split")).alias("split"))
    rows = with_record(named.filter(F.col("split").isin(*left_splits, *right_splits)), "fen", fields=("board", "side"))
    rows = rows.select(
        "position_id", "source", "split", F.col("r_board").alias("board"), F.col("r_side").alias("side"),
        F.col("split").isin(*left_splits).alias("left")
    )
    # filtered only when written down: a filter on the board would parse every text twice
    return with_group_min(cut(rows, "boards").filter("board is not null"), ["board", "side"], "position_id", "cid", None, hot_rows)


def classes_of(members: DataFrame) -> DataFrame:
    """One row for each distinct board and side, with the sides of the split it stands on."""
    return members.groupBy("cid", "board", "side").agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right"))


def cross_split(
    positions: DataFrame, left_splits: tuple[str, ...] = ("val", "challenge", "fresh"), right_splits: tuple[str, ...] = ("train",),
    differ: int = 2, hot_rows: int = HOT_ROWS, hot_pairs: int = HOT_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs of classes): who holds which board, and which boards lie across the splits.

    Rows without a readable board or of other or null splits take no part;
    a null source is a source of its own. Repeated rows are members of one
    class, so copies are never compared with each other.
    """
    with scratch() as keep:
        members = keep(cut(memberships(positions, left_splits, right_splits, hot_rows), "members"))
        classes = cut(classes_of(members), "classes")
        return members, keep(cut(near_boards(classes, differ, hot_pairs=hot_pairs), "near"))


def overlap_pairs(members: DataFrame, near: DataFrame) -> DataFrame:
    """(``position_id_a`` < ``position_id_b``): all pairs of rows behind the pairs of classes. A row repeated under its id repeats its pairs."""
    a = members.filter("left").select(F.col("cid").alias("cid_a"), F.col("position_id").alias("x"))
    b = members.filter("not left").select(F.col("cid").alias("cid_b"), F.col("position_id").alias("y"))
    rows = near.select("cid_a", "cid_b").join(a, "cid_a").join(b, "cid_b")
    return rows.select(F.least("x", "y").alias("position_id_a"), F.greatest("x", "y").alias("position_id_b"))


def overlap_report(members: DataFrame, near: DataFrame) -> DataFrame:
    """Per split and source of the held-out row: pairs with train rows, by differing squares, counted without expanding copies."""
    held = members.filter("left").groupBy(
        F.col("cid").alias("cid_a"), "split", F.coalesce("source", F.lit("")).alias("source")
    ).agg(F.count(F.lit(1)).alias("n"))
    other = members.filter("not left").groupBy(F.col("cid").alias("cid_b")).agg(F.count(F.lit(1)).alias("m"))
    each = near.join(held, "cid_a").join(other, "cid_b")
    pairs = F.col("n") * F.col("m")
    exact = F.when(F.col("differing") == 0, pairs).otherwise(F.lit(0))
    per = each.groupBy("split", "source", "cid_a", "n").agg(F.sum(pairs).alias("p"), F.sum(exact).alias("e"))
    return per.groupBy("split", "source").agg(F.sum("n").alias("rows_hit"), F.sum("p").alias("pairs"), F.sum("e").alias("exact_pairs"))


def class_pairs(near: DataFrame) -> DataFrame:
    """(``class_a`` held out, ``class_b`` trained on, ``differing``): the pairs of boards, copies not expanded."""
    return near.select(F.col("cid_a").alias("class_a"), F.col("cid_b").alias("class_b"), F.col("differing").cast("bigint").alias("differing"))


def class_members(members: DataFrame, near: DataFrame) -> DataFrame:
    """(``position_id``, ``class_id``, ``links``): every row of the splits with the class of its board and the boards across the split that this is linked to."""
    ends = near.select(F.col("cid_a").alias("cid"), F.lit(True).alias("left")).unionByName(
        near.select(F.col("cid_b").alias("cid"), F.lit(False).alias("left"))
    )
    links = ends.groupBy("cid", "left").agg(F.count(F.lit(1)).alias("links"))
    rows = members.select("position_id", "cid", "left").join(links, ["cid", "left"], "left")
    return rows.select("position_id", F.col("cid").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
