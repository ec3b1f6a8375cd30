import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyforge.functions import boards

BOARD = "rnbqkb1r/pp2pppp/3p1n2/8/3NP3/2N5/PPP2PPP/R1BQKB1R"


def parse(spark, rows):
    df = spark.createDataFrame(rows, "fen string, h int, f int")
    out = boards.with_record(df, "fen", "h", "f").select("r_board", "r_side", "r_castling", "r_ep", "r_half", "r_full")
    return [tuple(r) for r in out.collect()]


def test_white_space_class_is_pythons(spark):
    code = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c), c) for c in code], "s string, c int")
    found = {r.c for r in df.filter(F.col("s").rlike(f"\\A{boards.WS_CLASS}\\z")).collect()}
    assert found == {c for c in code if chr(c).isspace()}
    assert set(map(ord, boards.WS_CHARS)) == found


def test_key_takes_four_fields_and_refuses_fewer(spark):
    df = spark.createDataFrame([("a b c d e",), (" a b c ",), ("",), (None,), ("x y\tz w",)], "s string")
    assert [r[0] for r in df.select(boards.fen_key(F.col("s"))).collect()] == ["a b c d", None, None, None, "x y z w"]


def test_spellings_of_one_record(spark):
    same = [
        f"{BOARD} w KQkq - 3 6",
        f"  {BOARD}\tW kqKQ - 3 6;",
        f"- w {BOARD} KQkq 3 6",
        f"KQkq - w {BOARD} 3 6",
        f'"{BOARD} w KQkq - 3 6"',
        f"{BOARD} w KQkq - hmvc 3; fmvn 6;",
        f"{BOARD} w KQkq - FMVN 6; HMVC 3;",
        f"{BOARD}|w|KQkq|-|3|6",
        f"{BOARD}_w_KQkq_-_3_6",
        f"stm: w, ep: -, castling: qkQK, halfmove: 3, placement: {BOARD}, fullmove: 6",
        f"FULLMOVE=6;CASTLING=KQkq;BOARD={BOARD};EP=-;HALFMOVE=3;TURN=W",
        f"{BOARD} w KQkq - [3 6]",
        f"{BOARD} w KQkq - (3,6)\r\n",
        f"{BOARD.replace('8', '44')} w KQkq - 03 06",
    ]
    got = parse(spark, [(s, None, None) for s in same] + [(f"{BOARD} w KQkq -", 3, 6)])
    assert len(set(got)) == 1
    assert got[0][1:] == ("w", "KQkq", "-", 3, 6)
    assert len(got[0][0]) == 64


def test_content_is_kept_apart(spark):
    base = f"{BOARD} w KQkq - 3 6"
    other = [base.replace("w KQkq", "b KQkq"), base.replace("KQkq", "KQk"), base.replace("KQkq -", "KQkq e6"), base.replace(" 3 6", " 4 6"), base.replace(" 3 6", " 3 7"), base.replace("rnbq", "Rnbq"), base.replace("KQkq", "-")]
    assert len(set(parse(spark, [(s, None, None) for s in [base, *other]]))) == 8


def test_unreadable_texts(spark):
    bad = [None, "", "   ", "hello", f"{BOARD}/8 w KQkq - 0 1", BOARD.replace("R1BQKB1R", "R1BQKB2R") + " w KQkq - 0 1", f"{BOARD} KQkq - 0 1"]
    got = parse(spark, [(b, 1, 2) for b in bad])
    assert all(r[:4] == (None,) * 4 for r in got)
    assert all(r[4:] == (1, 2) for r in got)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=20))
def test_any_text_is_survived(spark, texts):
    assert len(parse(spark, [(t, None, None) for t in texts] or [("", None, None)])) == max(1, len(texts))


def test_labels(spark):
    df = spark.createDataFrame([(" \tTrain ",), ("  ",), (None,), ("SHA256:ABC ",)], "s string")
    assert [r[0] for r in df.select(boards.label(F.col("s"))).collect()] == ["train", None, None, "sha256:abc"]
    assert [r[0] for r in df.select(boards.sha_label(F.col("s"))).collect()] == ["train", None, None, "abc"]


def test_random_separators_and_orders(spark):
    rng, rows = random.Random(1), []
    for order in itertools.permutations([BOARD, "b", "Kq", "e3"]):
        sep = rng.choice([" ", "  ", "\t", ", ", "; ", " | ", "|", ","])
        rows.append((sep.join([*order, "5", "40"]), None, None))
    got = set(parse(spark, rows))
    assert len(got) == 1 and next(iter(got))[1:] == ("b", "Kq", "e3", 5, 40)
