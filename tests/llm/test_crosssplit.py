import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import crosssplit as cs

SCHEMA = "position_id bigint, fen string, source string, split string"


def fen(board, side="w"):
    out = "/".join(board[i : i + 8] for i in range(0, 64, 8))
    for n in range(8, 0, -1):
        out = out.replace("." * n, str(n))
    return f"{out} {side} - - 0 1"


def boards(n, seed=0, near=0.5, pieces=cs.PIECES):
    rng, out = random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < near:
            b = list(rng.choice(out))
            for _ in range(rng.randrange(4)):
                b[rng.randrange(64)] = rng.choice(pieces)
        else:
            b = [rng.choice("." * 6 + pieces) for _ in range(64)]
        out.append("".join(b))
    return out


def table(spark, n, seed=0, **kw):
    rng = random.Random(seed + 1)
    bs = boards(n, seed, **kw)
    rows = [(i, fen(b, rng.choice("ww" "b")), rng.choice(["a", " A", "b", None]), rng.choice(["train", "TRAIN ", "train", "val", "challenge", " Fresh", "other", None])) for i, b in enumerate(bs)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, differ=2):
    def grid(f):
        p = f.split()[0]
        for n in range(1, 9):
            p = p.replace(str(n), "." * n)
        return np.frombuffer(p.replace("/", "").encode(), np.uint8)

    side = lambda s: (s or "").strip().lower()
    left = [(i, grid(f), f.split()[1]) for i, f, _, s in rows if side(s) in ("val", "challenge", "fresh")]
    right = [(i, grid(f), f.split()[1]) for i, f, _, s in rows if side(s) == "train"]
    return {(min(i, j), max(i, j)) for i, a, x in left for j, b, y in right if x == y and (a != b).sum() <= differ}


def found(df, **kw):
    members, near = cs.cross_split(df, **kw)
    return members, near, {tuple(r) for r in cs.overlap_pairs(members, near).collect()}


@pytest.mark.parametrize("seed,hot_pairs,hot_rows", [(0, 10**6, 10**6), (1, 3, 10**6), (2, 10**6, 2), (3, 1, 1)])
def test_equals_brute_force(spark, seed, hot_pairs, hot_rows):
    rows, df = table(spark, 500, seed)
    want = brute(rows)
    assert len(want) > 20
    assert found(df, hot_pairs=hot_pairs, hot_rows=hot_rows)[2] == want


def test_hot_lists_of_nearly_empty_boards(spark):
    """Boards that share their rarest terms: every list is hot."""
    rng, bs = random.Random(4), []
    for _ in range(300):
        b = ["."] * 64
        b[0], b[63], b[7] = "k", "K", "q"
        for _ in range(rng.randrange(4)):
            b[rng.randrange(8, 60)] = rng.choice("Pp")
        bs.append("".join(b))
    rows = [(i, fen(b), "s", "train" if i % 3 else "val") for i, b in enumerate(bs)]
    assert found(spark.createDataFrame(rows, SCHEMA), hot_pairs=2)[2] == brute(rows)


def test_bound_of_other_distances(spark):
    rows, df = table(spark, 200, 7)
    for differ in (0, 1, 3):
        assert found(df, differ=differ)[2] == brute(rows, differ)


def test_copies_are_members_not_comparisons(spark):
    b = boards(1)[0]
    rows = [(i, fen(b), "s", "train" if i < 200 else "val") for i in range(300)]
    members, near, pairs = found(spark.createDataFrame(rows, SCHEMA), hot_rows=50)
    assert near.count() == 1 and len(pairs) == 200 * 100
    report = cs.overlap_report(members, near).collect()
    assert [(r.split, r.source, r.rows_hit, r.pairs, r.exact_pairs) for r in report] == [("val", "s", 100, 20000, 20000)]


def test_report_counts_pairs(spark):
    rows, df = table(spark, 400, 9)
    members, near, pairs = found(df)
    report = {(r.split, r.source): r for r in cs.overlap_report(members, near).collect()}
    assert sum(r.pairs for r in report.values()) == len(pairs)
    by = {i: ((s or "").strip().lower(), (c or "").strip().lower()) for i, _, c, s in rows}
    for key, r in report.items():
        assert r.pairs == sum(key in (by[a], by[b]) for a, b in pairs)


def test_exact_cosine(spark):
    rows, df = table(spark, 200, 3)
    _, near, _ = found(df)
    for r in near.collect():
        assert (r.cosine > 1 - 1e-9) == (r.differing == 0)
        assert 0 < r.cosine <= 1 + 1e-9


def test_nulls_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none)[2] == set()
    b = fen(boards(1)[0])
    rows = [(1, b, None, "val"), (2, b, None, "train"), (3, None, "s", "train"), (4, "junk", "s", "val"), (5, b, "s", None), (6, b + "x" * 100_000, "s", "val")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit("x")).withColumn("board", F.lit("y")).withColumn("left", F.lit(1))
    assert found(df)[2] == {(1, 2), (2, 6)}


def test_no_list_stays_hot(spark):
    """Thousands of boards with three or four pieces, which share nearly everything."""
    rng, seen = random.Random(11), set()
    while len(seen) < 2500:
        b = ["."] * 64
        for x in "kK" + "".join(rng.choice("Pp") for _ in range(rng.randrange(1, 3))):
            b[rng.randrange(24) if x in "kK" else rng.randrange(24, 64)] = x
        seen.add("".join(b))
    bs = sorted(seen)
    flat = spark.createDataFrame([(i, b, "w", i % 2 == 0, i % 2 == 1) for i, b in enumerate(bs)], "cid bigint, board string, side string, left boolean, right boolean")
    weights = cs.squared_weights(cs.term_counts(flat))
    longest, hot = [], 60
    pairs = {tuple(r) for r in cs.candidates(flat, cs.Lists(weights, 2, 3), hot, longest).collect()}
    assert len(longest) > 2 and max(longest[:-1]) <= hot and longest[-1] <= 169 * 169
    grid = np.stack([np.frombuffer(b.encode(), np.uint8) for b in bs])
    near = {(i, j) for i in range(0, len(bs), 2) for j in np.flatnonzero((grid != grid[i]).sum(1) <= 2).tolist() if j % 2}
    assert near <= pairs and len(near) > 1000


def test_classes_and_members(spark):
    rows, df = table(spark, 300, 5)
    members, near, pairs = found(df)
    per = {}
    for r in cs.class_members(members, near).collect():
        per[r.position_id] = r
    classes = {(r.class_a, r.class_b) for r in cs.class_pairs(near).collect()}
    side = {i: (s or "").strip().lower() for i, _, _, s in rows}
    expanded = {(min(a, b), max(a, b)) for a in per for b in per if side[a] != "train" and side[b] == "train" and (per[a].class_id, per[b].class_id) in classes}
    assert expanded == pairs
    for i, r in per.items():
        assert r.links == sum(c[0 if side[i] != "train" else 1] == r.class_id for c in classes)
