"""Every query of the subpackage on tables with nulls anywhere, repeated rows, no rows, or clashing columns."""

import pytest

from plyforge.llm import queries as llm
from tests.dirty import KINDS, write

TABLES = ("positions", "extracted_positions", "records", "documents", "mix_targets")


@pytest.fixture(scope="module", params=KINDS)
def dirty(request, spark, small, tmp_path_factory):
    target = tmp_path_factory.mktemp(request.param)
    write(spark, small, target, TABLES, request.param)
    return request.param, str(target)


@pytest.mark.parametrize("name", ["p1_sample", "p2_found", "p2_report", "p2_members", "p3_found", "p3_records", "p5_strengths", "p5_check", "p6_found", "p6_assignment", "p7_contents", "p8_drawn", "p8_shares", "p9_pieces"])
def test_survives(spark, small, dirty, name):
    kind, at = dirty
    got = llm.queries()[name](spark, at)
    rows = got.collect()
    if kind == "empty":
        assert rows == []
    if kind == "more_columns":
        want = llm.queries()[name](spark, small)
        assert got.columns == want.columns
        assert sorted(map(str, rows)) == sorted(map(str, want.collect()))
    if kind == "repeated" and name in ("p3_records", "p6_assignment", "p1_sample"):
        once = llm.queries()[name](spark, small).count()
        assert len(rows) == once * (1 if name == "p3_records" else 2)
