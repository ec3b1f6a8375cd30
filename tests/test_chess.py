import pytest

from plyforge.functions.chess import IllegalMove, Position
from plyforge.operators.sampling import dedupe_report
from plyforge.functions.boards import fen_key
from plyforge.sources import pgn
from pyspark.sql import functions as F

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"


def count(p, depth):
    return 1 if not depth else sum(count(p.push(m), depth - 1) for m in p.legal_moves())


@pytest.mark.parametrize(
    "fen,want",
    [
        (f"{START} w KQkq - 0 1", [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]),
    ],
)
def test_published_move_counts(fen, want):
    assert [count(Position.from_fen(fen), d + 1) for d in range(len(want))] == want


def play(*moves, fen=None):
    p = Position.from_fen(fen) if fen else Position.from_fen()
    for m in moves:
        p = p.push(p.move_of(m))
    return p.fen()


def test_fen_output():
    assert play("e4") == "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"
    assert play("e4", "Nf6", "e5", "d5") == "rnbqkb1r/ppp1pppp/5n2/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3"
    assert play("e4", "Nf6", "e5", "d5", "exd6").startswith("rnbqkb1r/ppp1pppp/3P1n2/8/8/8/PPPP1PPP/RNBQKBNR b KQkq - 0 3")
    assert play("Nb1c3", "Ng8-f6", "Ra1b1") == "rnbqkb1r/pppppppp/5n2/8/8/2N5/PPPPPPPP/1RBQKBNR b Kkq - 3 2"
    assert play("e4", "e5", "Nf3", "Nc6", "Bc4", "Bc5", "O-O").endswith("b kq - 5 4")
    assert play("a8=Q+", fen="1k6/P7/8/8/8/8/8/K7 w - - 0 1") == "Qk6/8/8/8/8/8/8/K7 b - - 0 1"


def test_pinned_en_passant_is_not_shown():
    assert play("e4", fen="8/8/8/8/k2p3R/8/4P3/4K3 w - - 0 1").split()[3] == "-"


@pytest.mark.parametrize("san", ["e5", "Ke2", "O-O", "Nd2", "", "Qh5", "exd5", "e4e5", "a8=Q"])
def test_illegal(san):
    with pytest.raises(IllegalMove):
        Position.from_fen().move_of(san)


def test_ambiguous_needs_more():
    p = Position.from_fen("4k3/8/8/8/8/8/4K3/R6R w - - 0 1")
    with pytest.raises(IllegalMove):
        p.move_of("Rd1")
    assert p.push(p.move_of("Rad1")).fen().startswith("4k3/8/8/8/8/8/4K3/3R3R")


def test_leaves(spark):
    leaves = pgn.leaf_positions(spark, 3)
    r = dedupe_report(leaves, fen_key(F.col("fen"))).first()
    assert (r.total_input, r.malformed_skipped) == (8902, 0) and 5000 < r.unique_keys < 8902


def test_openings_are_reproducible_and_short_pools_refused(spark):
    a = pgn.clean_openings(spark, "ns", 2, 30).collect()
    assert a == pgn.clean_openings(spark, "ns", 2, 30).collect() and len(a) == 30
    with pytest.raises(ValueError):
        pgn.clean_openings(spark, "ns", 1, 21)
