import pytest

from plyforge.plans import queries as core
from tests.dirty import KINDS, write


@pytest.mark.parametrize("kind", KINDS)
def test_strict_loader_survives(spark, small, tmp_path, kind):
    write(spark, small, tmp_path, ["game_lines"], kind)
    bad, good = (core.queries()[n](spark, str(tmp_path)) for n in ("p4_found", "p4_loaded"))
    every = spark.read.parquet(f"{tmp_path}/game_lines.parquet").count()
    assert bad.count() + good.count() == every
    if kind == "more_columns":
        assert bad.count() == core.queries()["p4_found"](spark, small).count()
