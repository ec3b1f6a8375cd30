import random

import pytest

from plyforge.sources import files, pgn

GAME = '[White "c"]\n[Black "o"]\n[Result "{r}"]\n[FEN "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"]\n\n1. e4 e5 2. Nf3 {{a [comment]\n[White "x"]\n\nhere}} Nc6 (2... d6 3. d4) 3. Bb5 $1 a6 {r}\n\n'


def scan(text):
    return list(pgn.scan_games(text))


def test_games_need_no_event_tag():
    got = scan(GAME.format(r="1-0") + GAME.format(r="0-1"))
    assert [h["Result"] for h, _ in got] == ["1-0", "0-1"]
    assert list(pgn.main_line(got[0][1])) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]


def test_odd_texts():
    assert scan("") == []
    assert scan("\n\n \n") == []
    whole, cut = scan(GAME.format(r="*") + '[White "cut')
    assert whole[0]["Result"] == "*" and cut == ({}, '[White "cut')
    assert scan("garbage \x00 bytes") == [({}, "garbage \x00 bytes")]
    assert scan('[Result "1-0"]')[0][0] == {"Result": "1-0"}
    assert scan('[White "Labs, \\"b\\""]\n\n*')[0][0]["White"] == 'Labs, "b"'
    assert scan(GAME.format(r="1-0").replace("\n", "\r\n"))[0][0]["White"] == "c"
    assert scan('[White "ИССЛЕДОВАТЕЛЬ"]\n\n1. e4 *')[0][0]["White"] == "ИССЛЕДОВАТЕЛЬ"


def test_positions(spark):
    texts = [(1, GAME.format(r="1-0") * 2), (2, '[White "a"]\n\n1. e4 e5 2. Ke3 *\n\n[White "b"]\n\n1. d4 *'), (3, None), (4, ""), (5, '[FEN "nonsense"]\n\n1. e4 *')]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    good, bad = pgn.positions_of(df, "doc_id", skip_first_n_plies=2)
    rows = [(r.doc_id, r.game_index, r.ply) for r in good.collect()]
    assert sorted(rows) == [(1, g, p) for g in (1, 2) for p in (3, 4, 5, 6)]
    assert sorted((r.doc_id, r.game_index, r.ply, r.token) for r in bad.collect()) == [(2, 1, 3, "Ke3"), (5, 1, 1, "nonsense")]


def odd_file(seed, n=400):
    """Lines of every kind in any order, so that braces, tags and blanks meet in every way."""
    rng = random.Random(seed)
    kinds = ['[White "a{b"]', '[Black "c}d"]', '[Event "x \\"y\\""]', '[White "second"]', "", "  ", "1. e4 e5", "{ open", "shut }", "{ both }", "} and {", "% skipped { line", "%", '  [Result "1-0"]  ', '[White "cut', "2. Nf3 {x} *", "plain words"]
    return "\n".join(rng.choice(kinds) for _ in range(n)) + ("\n" if seed % 2 else "")


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_are_read_in_splits(spark, tmp_path, small_splits):
    texts = {f"m{k}.pgn": odd_file(k) for k in range(4)} | {"real.pgn": GAME.format(r="1-0") * 9, "crlf.pgn": (GAME.format(r="0-1") * 9).replace("\n", "\r\n"), "empty.pgn": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = files.numbered_lines(spark, f"file://{tmp_path}/*.pgn").collect()
    for name, text in texts.items():
        got = [r.line for r in sorted((r for r in lines if r.file.endswith(name)), key=lambda r: r.ln)]
        want = text.replace("\r\n", "\n").split("\n")
        assert got == (want[:-1] if want[-1] == "" else want)
        assert sorted(r.ln for r in lines if r.file.endswith(name)) == list(range(1, len(got) + 1))
    games = pgn.read_games(spark, f"file://{tmp_path}/*.pgn").collect()
    for name, text in texts.items():
        got = sorted((r for r in games if r.file.endswith(name)), key=lambda r: r.game_index)
        assert [r.game_index for r in got] == list(range(1, len(got) + 1))
        assert [(r.headers, r.movetext) for r in got] == scan(text), name
        assert [r.white for r in got] == [h.get("White") for h, _ in scan(text)]


def test_positions_of_files(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(GAME.format(r="1-0") * 2 + '[White "b"]\n\n1. e4 e5 2. Ke3 *\n')
    games = pgn.read_games(spark, str(tmp_path / "a.pgn"))
    good, bad = pgn.positions_in(games, ["file", "game_index"])
    want = [(g, ply, f) for g, (h, m) in enumerate(scan((tmp_path / "a.pgn").read_text()), 1) if g < 3 for ply, f in enumerate(pgn.replay(h, m)[0], 1)]
    assert sorted((r.game_index, r.ply, r.fen) for r in good.collect()) == want
    assert [(r.game_index, r.ply, r.token) for r in bad.collect()] == [(3, 3, "Ke3")]
