import pytest

from plyforge.llm import copies

B = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
ROWS = [
    (9, f"{B} w KQkq - 0 1", 0, 1),
    (3, f"{B} W kqKQ - 0 1;", None, None),
    (5, f"{B} w KQkq -", 0, 1),
    (4, f"{B} w KQkq - 0 2", 0, 2),
    (1, f"{B} w KQkq -", 0, 2),
    (7, "no record", 1, 1),
    (6, " no   record ", 1, 1),
    (8, "no record", 1, 2),
    (10, None, 1, 1),
    (11, None, 1, 1),
    (12, "", 1, 1),
    (13, " ", 1, 1),
    (14, f"{B} w KQkq -", None, None),
    (15, f"{B} w KQkq -", None, None),
    (2, f"{B} b KQkq - 0 1", 0, 1),
]
SCHEMA = "position_id bigint, fen string, halfmove_clock int, fullmove_number int"


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_links(spark, hot_rows):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = {tuple(r) for r in copies.copy_links(df, hot_rows=hot_rows).collect()}
    assert got == {(3, 5), (3, 9), (1, 4), (6, 7), (14, 15)}
    counted = {r.keep_id: r.copies for r in copies.records(df, hot_rows=hot_rows).collect()}
    assert sum(counted.values()) == len(ROWS) and counted[3] == 3 and counted[10] == 1


def test_one_record_of_a_third_of_all_rows(spark):
    rows = [(i, f"{B} w KQkq - 0 1" if i % 3 == 0 else f"{B} w KQkq - 0 {i + 2}", None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = copies.copy_links(df, hot_rows=500)
    assert got.count() == 999 and got.filter("keep_id = 0").count() == 999


def test_repeated_rows_empty_and_clashing_columns(spark):
    assert copies.copy_links(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, f"{B} w - - 0 1", 0, 1, "a", "b"), (2, f"{B} w - - 0 1", 0, 1, "a", "b")], SCHEMA + ", copies string, keep_id string")
    assert [tuple(r) for r in copies.copy_links(df).collect()] == [(1, 2)]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "x " * 200_000, 0, 1), (2, "x  " * 200_000, 0, 1)], SCHEMA)
    assert [tuple(r) for r in copies.copy_links(df).collect()] == [(1, 2)]


def test_records_of_null_ids_are_told_apart(spark):
    a, b = "8/8/8/8/8/8/8/K6k w - - 0 1", "8/8/8/8/8/8/8/K5k1 w - - 0 1"
    rows = [(None, a, None, None), (None, a, None, None), (None, b, None, None), (None, None, None, None), (None, "", None, None), (4, b, None, None), (9, None, None, None)]
    df = spark.createDataFrame(rows, "position_id bigint, fen string, halfmove_clock int, fullmove_number int")
    got = sorted((r.keep_id or 0, r.copies) for r in copies.records(df).collect())
    assert got == [(0, 1), (0, 1), (0, 2), (4, 2), (9, 1)]
