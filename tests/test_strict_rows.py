import csv
import io
import random

from plyforge.functions.vocabulary import EXCLUSION_CODES
from plyforge.operators.strict_rows import COLUMNS, bad_lines, load_lines

FEN = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def line(index="1", white="a", black="b", result="1-0", termination="", fen=FEN, opening="o", role="white", outcome="win", reason=""):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([index, white, black, result, termination, fen, opening, role, outcome, reason])
    return out.getvalue()


CASES = [
    (line(), None),
    (line(index=" 7 ", result=" 0-1 "), None),
    (line(index="007"), None),
    (line(result=""), None),
    (line(result="*", fen=""), None),
    (line(white='x "y", z', termination="one\ntwo, three"), None),
    (line(reason="missing_result_header: said so"), None),
    (line(reason=EXCLUSION_CODES[3] + ": White='a, \"b\"'"), None),
    (line(fen="rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR b - -"), None),
    ('"1",a,b,1-0,,,o,white,win,""', None),
    (line() + ",", "columns"),
    (line().replace(",o,", ","), "columns"),
    ("", "columns"),
    ("   ", "columns"),
    (None, "columns"),
    (line().replace(",", "\t"), "columns"),
    ('1,a,b,1-0,,"open', "quoting"),
    ('1,"a"x,b,1-0,,,o,white,win,', "quoting"),
    ('1,a"b,b,1-0,,,o,white,win,', "quoting"),
    ('1,"a" ,b,1-0,,,o,white,win,', "quoting"),
    ('"', "quoting"),
    (line(index="0"), "value"),
    (line(index=""), "value"),
    (line(index="-3"), "value"),
    (line(index="1.0"), "value"),
    (line(index="+1"), "value"),
    (line(result="1:0"), "value"),
    (line(result="1/2"), "value"),
    (line(fen="8/8/8/8/8/8/8/8 w -"), "value"),
    (line(fen="9/8/8/8/8/8/8/8 w - -"), "value"),
    (line(fen="8/8/8/8/8/8/8 w - -"), "value"),
    (line(fen="8/8/8/8/8/8/8/7 w - -"), "value"),
    (line(fen="8/8/8/8/8/8/8/8 W - -"), "value"),
    (line(reason="no_such_code"), "value"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "line_id bigint, line string").repartition(3)
    got = {r.line_id: r.reason for r in bad_lines(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES) if c[1]}
    assert {r.line_id for r in load_lines(df).collect()} == {i for i, c in enumerate(CASES) if not c[1]}


def test_values_come_back(spark):
    rng = random.Random(3)
    alphabet = 'ab ,"\né'
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(i, line(index=str(i + 1), termination=t)) for i, t in enumerate(texts)], "line_id bigint, line string")
    got = {r.line_id: r for r in load_lines(df).collect()}
    assert len(got) == 200
    for i, t in enumerate(texts):
        assert got[i].game_index == i + 1
        assert got[i].termination == (t.strip() or None)


def test_empty_extra_columns_and_missing_numbers(spark):
    none = spark.createDataFrame([], "line_id bigint, line string")
    assert load_lines(none).collect() == [] and bad_lines(none).collect() == []
    clash = spark.createDataFrame([(None, line(), "x", "y"), (None, "bad", "x", "y"), (5, line(), "x", "y")], "line_id bigint, line string, result string, reason string")
    assert [tuple(r) for r in bad_lines(clash).collect()] == [(None, "columns", "bad")]
    assert load_lines(clash).columns == ["line_id", *COLUMNS] and load_lines(clash).count() == 2


def test_very_long_lines(spark):
    df = spark.createDataFrame([(1, line(termination='q"' * 100_000)), (2, '1,"' + 'x""' * 100_000)], "line_id bigint, line string")
    assert [(r.line_id, r.reason) for r in bad_lines(df).collect()] == [(2, "quoting")]


def test_a_number_that_good_and_bad_lines_share(spark):
    good = "1,a,b,1-0,t,,o,white,win,"
    df = spark.createDataFrame([(1, good), (1, "x"), (1, 'a"b'), (2, good)], "line_id bigint, line string")
    assert sorted((r.line_id, r.reason) for r in bad_lines(df).collect()) == [(1, "columns"), (1, "quoting")]
    assert sorted(r.line_id for r in load_lines(df).collect()) == [1, 2]
