"""Transcripts, listings and games are read from texts of any kind, or of none."""

import pytest

from plyforge.plans import queries as core
from tests.compare import connect, same

LOG = "info depth 12 score cp 30 nodes 5 pv e2e4 e7e5\nbestmove e2e4 ponder e7e5"
ROW = "8/8/8/8/8/8/8/K1k5 w - - 0 1\tcp\t12\texact\ta1a2\t9"
GAME = '[White "a"]\n\n1. e4 e5 *'
KINDS = ("log", "table", "pgn", "mixed", "prose", None)
LINES = ("search_infos", "rescore_infos", "best_moves", "last_exact_infos", "picked_results", "rescored_rows")


@pytest.fixture
def notes(spark, tmp_path):
    text = f"Some words.\n\n{LOG}\n\n{ROW}\n\n{GAME}\n\n1. d4 *"
    spark.createDataFrame([(k, kind, text) for k, kind in enumerate(KINDS)], "doc_id bigint, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", LINES)
def test_lines_of_every_kind_of_text(spark, notes, name):
    df = core.queries()[name](spark, notes)
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == list(range(len(KINDS)))
    got, want = same(df, connect(notes), core.oracle_sql()[name])
    assert got == want


def test_games_of_every_kind_of_text(spark, notes):
    got = core.queries()["pgn_headers"](spark, notes).collect()
    # in a game text every section counts, elsewhere tags or a legal first move are asked for
    assert {k: [r.white for r in sorted(got, key=lambda r: r.game_index) if r.doc_id == k] for k in range(6)} == {k: [None] * 3 + ["a", None] if kind == "pgn" else ["a", None] for k, kind in enumerate(KINDS)}


def test_every_game_gives_all_positions_or_a_failure(spark, tmp_path):
    texts = [(1, "pgn", GAME), (2, "pgn", '[White "b"]\n\n1. e4 e5 2. Ke3 *'), (3, "mixed", f"Words.\n\n{GAME}\n\n1. d4 d5 2. Qd8 *"), (4, "pgn", '[White "c"]\n\n*')]
    spark.createDataFrame(texts, "doc_id bigint, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: core.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.game_index, r.ply) for r in run("pgn_positions")) == [(1, 1, 1), (1, 1, 2), (3, 1, 1), (3, 1, 2)]
    assert sorted(map(tuple, run("pgn_replays"))) == [(1, 1, 2, None, None), (2, 1, 0, 3, "Ke3"), (3, 1, 2, None, None), (3, 2, 0, 3, "Qd8"), (4, 1, 0, None, None)]
