import json

import pytest
from pyspark.sql import functions as F

from plyforge.functions import ids
from plyforge.operators import matches
from plyforge.sources.registry import Schemas, UnknownSchema


def test_ids(spark):
    df = spark.createDataFrame([("a", "b-c", 7, "AUDIT_V0003__run000012"), ("a b", "c", 0, "x__run0"), (None, "c", 12345, "x__run000")], "a string, b string, n bigint, r string")
    got = df.select(ids.audit_id(F.col("n")).alias("i"), ids.matchup_key(F.col("a"), F.col("b")).alias("m"), ids.run_id(F.col("a"), F.col("n")).alias("r"), ids.run_parts(F.col("r")).alias("p")).collect()
    assert [r.i for r in got] == ["AUDIT_V0007", None, "AUDIT_V12345"]
    assert [r.m for r in got] == ["a__b-c", None, None]
    assert [r.r for r in got] == ["a__run007", None, None]
    assert [(r.p.key, r.p.attempt) if r.p else None for r in got] == [("AUDIT_V0003", 12), None, None]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (" 12 ", "", None, "x", "1_000", "-3")], "s string")
    assert [r[0] for r in df.select(ids.int_or_null(F.col("s"))).collect()] == [12, None, None, None, None, -3]


def test_registry(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "thing.schema.json").write_text(json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}))
    (tmp_path / "v1" / "odd.schema.json").write_text(json.dumps({"type": "object", "oneOf": []}))
    s = Schemas(str(tmp_path))
    assert s.types() == [("odd", "v1"), ("thing", "v1")]
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}")], "k int, t string")
    assert [tuple(r) for r in s.violations(df, "k", "t", "thing", "v1").collect()] == [(2, "$.a", "required")]
    with pytest.raises(UnknownSchema):
        s.get("thing", "v2")
    with pytest.raises(ValueError):
        s.get("odd", "v1")


def test_documents_of_runs(spark):
    rows = [("r", 2, "black", "0-1", "o", None, None), ("r", 1, "white", "1-0", "o", "normal", None), ("r", 3, None, None, None, None, "missing_result_header")]
    df = spark.createDataFrame(rows, "run_id string, game_index bigint, candidate_role string, result string, opening_ref string, termination string, exclusion_reason string")
    doc = json.loads(matches.result_documents(df, ["run_id"]).first().document)
    assert [g["game_index"] for g in doc["games"]] == [1, 2] and doc["games"][0]["white_role"] == "candidate" and "termination" not in doc["games"][1]
