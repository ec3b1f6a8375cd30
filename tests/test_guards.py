import math

import pytest
from pyspark.sql import functions as F

from plyforge.functions import guards, stats


@pytest.mark.parametrize("bad", [True, "1", None, math.nan, math.inf])
def test_numbers(bad):
    for check in (lambda: guards.finite("x", bad), lambda: guards.between("x", bad, 0, 1), lambda: guards.whole("x", bad)):
        with pytest.raises(ValueError, match="x must"):
            check()
    assert guards.finite("x", 2) == 2.0 and guards.whole("x", 0) == 0


def test_ranges():
    for bad in (0, 1, -0.5):
        with pytest.raises(ValueError):
            guards.between("x", bad, 0, 1)
    with pytest.raises(ValueError):
        guards.whole("x", 1.0)
    with pytest.raises(ValueError):
        guards.whole("x", 1, 2)
    with pytest.raises(ValueError):
        guards.truth("x", 1)
    assert guards.truth("x", False) is False


def test_a_contradiction_is_null_or_an_error(spark):
    df = spark.createDataFrame([("H1_ACCEPTED", False), ("H1_ACCEPTED", True)], "s string, f boolean")
    assert [r[0] for r in df.select(stats.verdict(F.col("s"), F.col("f"))).collect()] == ["SUPPORTED_PROGRESS", None]
    with pytest.raises(Exception, match="contradicts"):
        df.select(stats.verdict(F.col("s"), F.col("f"), strict=True)).collect()
    assert df.filter("not f").select(stats.verdict(F.col("s"), F.col("f"), strict=True)).first()[0] == "SUPPORTED_PROGRESS"
