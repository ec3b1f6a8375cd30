import random

import pytest

from plyforge.llm import families as fam

P = "position_id bigint, fen string, source string, split string"
G = "source string, game_index bigint, ply int, fen string"


def fen(k):
    """Distinct positions by number."""
    return f"{'P' * (k // 64 % 8) or '8'}{8 - k // 64 % 8 if 0 < k // 64 % 8 < 8 else ''}/8/8/8/8/8/8/8 w - {'abcdefgh'[k % 8]}{k // 8 % 8 + 1}"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind,hot_rows", [("path", 10**6), ("random", 10**6), ("random", 3), ("star", 5), ("grid", 10)])
def test_components(spark, kind, hot_rows):
    rng = random.Random(2)
    if kind == "path":
        order = list(range(300))
        rng.shuffle(order)
        edges = list(zip(order, order[1:], strict=False))
    elif kind == "star":
        edges = [(7, i) for i in range(200)] + [(500, 501), (3, 3)]
    elif kind == "grid":
        edges = [(r * 20 + c, r * 20 + c + 1) for r in range(10) for c in range(19)] + [(r * 20 + 5, r * 20 + 25) for r in range(9)]
    else:
        edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    df = spark.createDataFrame(edges + [(None, 1)], "u bigint, v bigint").repartition(3)
    got = fam.components(df, hot_rows).collect()
    nodes = {n for e in edges for n in e}
    assert len(got) == len(nodes)
    assert {r.node: r.component for r in got} == roots(nodes, edges)


def test_no_edges(spark):
    assert fam.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def make(seed, n=250, games=60):
    rng = random.Random(seed)
    g = [(rng.choice(["s1", " S1", "s2", None]), rng.choice([*range(games), None]), k, fen(rng.randrange(400))) for k in range(400)]
    g += g[:20]
    p = [(i * 3 + 1, fen(rng.randrange(400)), rng.choice(["s1", "S1 ", "s2", "s3", None]), rng.choice(["train", " Train", "val", "other", None])) for i in range(n)]
    return p + [(5, None, "s1", "val"), (8, None, "s1", "train"), (11, "junk", None, None)], g + [("s1", 1, None, None), ("s1", 1, 4, "junk")]


def expected(p, g):
    norm = lambda s: s.strip().lower() if s else None
    nodes = [r[0] for r in p]
    edges, at, inside = [], {}, {}
    for s, k, _, f in g:
        if s and k is not None and f and "/" in f:
            inside.setdefault((norm(s), f), set()).add((norm(s), k))
    games = {}
    for i, f, s, _ in p:
        if not f or "/" not in f:
            continue
        if f in at:
            edges.append((at[f], i))
        at.setdefault(f, i)
        for x in inside.get((norm(s), f), ()):
            if x in games:
                edges.append((games[x], i))
            games.setdefault(x, i)
    return roots(nodes, edges)


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**6), (2, 4)])
def test_families(spark, seed, hot_rows):
    p, g = make(seed)
    out = fam.position_families(spark.createDataFrame(p, P).repartition(3), spark.createDataFrame(g, G), hot_rows)
    got = {r.position_id: r.family_id for r in out.collect()}
    want = expected(p, g)
    assert got == want
    splits = {}
    for i, _, _, s in p:
        splits.setdefault(want[i], set()).add(s.strip().lower() if s else None)
    broken = {(i, want[i]) for i in want if len(splits[want[i]] - {None}) > 1}
    assert {tuple(r) for r in fam.broken_families(out).collect()} == broken and broken


def test_assignment_keeps_families_and_proportions(spark):
    rows = [(i, "train", i // 4) for i in range(8000)]
    df = spark.createDataFrame(rows, "position_id bigint, split string, family_id bigint")
    shares = {"train": 0.9, "validation": 0.05, "test": 0.05}
    got = fam.assign_splits(df, shares).collect()
    by = {}
    for r in got:
        by.setdefault(r.family_id, set()).add(r.new_split)
    assert len(got) == 8000 and all(len(v) == 1 for v in by.values())
    for s, x in shares.items():
        assert abs(sum(r.new_split == s for r in got) / 8000 - x) < 0.015


def test_no_family_moves_when_others_come_or_grow(spark):
    shares = {"train": 0.9, "validation": 0.05, "test": 0.05}
    at = lambda rows: {r.family_id: r.new_split for r in fam.assign_splits(spark.createDataFrame(rows, "position_id bigint, split string, family_id bigint"), shares).collect()}
    rows = [(i, None, i // 4) for i in range(4000)]
    before, after = at(rows), at(rows + [(10_000 + i, None, 0 if i % 2 else 5000 + i) for i in range(6000)])
    assert all(after[f] == s for f, s in before.items()) and len(after) > len(before)


def test_large_families_are_told_and_moved_by_name(spark):
    rows = [(i, None, 3 if i % 3 == 0 else i) for i in range(9000)]
    df = spark.createDataFrame(rows, "position_id bigint, split string, family_id bigint")
    shares = {"train": 0.9, "validation": 0.05, "test": 0.05}
    free = fam.assign_splits(df, shares)
    assert [(r.family_id, r.rows) for r in fam.large_families(free).collect()] == [(3, 3000)]
    pinned = spark.createDataFrame([(3, "test"), (99_999, "test")], "family_id bigint, split string")
    bound = {(r.position_id, r.family_id): r.new_split for r in fam.assign_splits(df, shares, pinned=pinned).collect()}
    assert len(bound) == 9000
    for r in free.collect():
        assert bound[r.position_id, r.family_id] == ("test" if r.family_id == 3 else r.new_split)


def test_hot_beginning_of_every_game_of_a_source(spark):
    """A third of all rows reach one position, and one position holds a third of the rows."""
    games = spark.range(6000).selectExpr("'s' AS source", "id AS game_index", "1 AS ply", f"'{fen(0)}' AS fen")
    for k in (1, 2):
        games = games.unionByName(spark.range(6000).selectExpr("'s' AS source", "id AS game_index", f"{k + 1} AS ply", f"concat('{fen(0)[:-2]}', substr('abcdefgh', id % 8 + 1, 1), {k + 1}) AS fen"))
    rows = [(i, fen(0) if i % 3 == 0 else fen(0)[:-2] + "abcdefgh"[i % 8] + str(2 + i % 2), "s", "train") for i in range(900)]
    out = fam.position_families(spark.createDataFrame(rows, P), games, hot_rows=200).collect()
    assert len(out) == 900 and {r.family_id for r in out} == {0}


def test_empty_tables(spark):
    out = fam.position_families(spark.createDataFrame([], P), spark.createDataFrame([], G))
    assert out.collect() == [] and fam.broken_families(out).collect() == []
    assert fam.assign_splits(out, {"a": 1.0}).collect() == []
    with pytest.raises(ValueError):
        fam.assign_splits(out, {"a": 0.5})
