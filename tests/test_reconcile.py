import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plyforge.functions import hashing
from plyforge.operators import reconcile, rules, sampling

FILES = "path string, sha256 string, size_bytes bigint"


def test_predicates(spark):
    cases = [("a/b.txt", True), ("a", True), ("", False), ("/a", False), ("a//b", False), ("../a", False), ("a/..", False), ("C:/a", False), ("a\\b", False), ("a\nb", False), ("a/./b", False), (None, False)]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p string")
    assert [r[0] for r in df.select(reconcile.is_neutral_path(F.col("p"))).collect()] == [w for _, w in cases]
    utc = [("2031-01-01T00:00:00Z", True), ("2031-01-01T00:00:00.123Z", True), ("2031-02-30T00:00:00Z", False), ("2031-01-01T00:00:00", False), ("2031-01-01T00:00:00Z\n", False)]
    df = spark.createDataFrame([(p,) for p, _ in utc], "p string")
    assert [r[0] for r in df.select(reconcile.is_utc(F.col("p"))).collect()] == [w for _, w in utc]
    sha = [("0" * 64, True), ("0" * 64 + "\n", False), ("A" * 64, False), ("0" * 63, False)]
    df = spark.createDataFrame([(p,) for p, _ in sha], "p string")
    assert [r[0] for r in df.select(reconcile.is_sha256(F.col("p"))).collect()] == [w for _, w in sha]


def test_file_diff(spark):
    e = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1)], FILES)
    a = spark.createDataFrame([("a", "1", 1), ("b", "2", 9), ("c", "1", 2), ("x", "1", 1)], FILES)
    assert {r.path: r.status for r in reconcile.file_diff(e, a).collect()} == {"b": "sha256", "c": "size", "d": "missing", "x": "extra"}


def test_transport_compares_bytes_only_in_a_sound_set(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), FILES)
    listed, present, needed = df(("a", "1", 1), ("b", "1", 1)), df(("a", "2", 1), ("b", "1", 1)), df(("a", None, None))
    assert [tuple(r) for r in reconcile.transport_problems(listed, present, needed).collect()] == [("sha256_mismatch", "a")]
    got = {tuple(r) for r in reconcile.transport_problems(listed, df(("a", "2", 1), ("z", "1", 1)), df(("q", None, None))).collect()}
    assert got == {("listed_but_absent", "b"), ("present_but_unlisted", "z"), ("required_but_unlisted", "q")}


def test_bindings(spark):
    e = spark.createDataFrame([("r", "x", 1, {"a": "1", "b": "2"}), ("s", None, 1, {})], "run string, h string, n int, o map<string,string>")
    a = spark.createDataFrame([("r", "x", 2, {"b": "2", "a": "1"}), ("s", None, 1, {"a": "1"})], "run string, ah string, an int, ao map<string,string>")
    got = {r.run: (r.verified, r.mismatched) for r in reconcile.field_mismatches(e, a, "run", {"h": "ah", "n": "an", "o": "ao"}).collect()}
    assert got == {"r": (["h", "o"], ["n"]), "s": (["h", "n"], ["o"])}


def test_claims(spark):
    ev = spark.createDataFrame([("hash", "s1", "ok", "ok"), ("origin", "s1", "ok", "ok"), ("origin", "s2", "ok", "ok"), ("hash", "s3", "bad", "ok")], "kind string, subject_sha256 string, result string, expected string")
    art = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sha256 string")
    claims = spark.createDataFrame([("hash", "verified"), ("origin", "clean")], "kind string, claim string")
    got = {r.artifact_sha256: r.claims for r in reconcile.bound_claims(ev, art, claims, withheld="clean", needs="verified").collect()}
    assert got == {"s1": ["clean", "verified"], "s2": [], "s3": []}


def test_checksum_lists(spark):
    h = "a" * 64
    text = f"{h}  b.txt\n{h}  a.txt\n{h}  SUMS\n{h}  b.txt\n{h} c\n{h}  ../x\n{h}  z.txt\n"
    df = spark.createDataFrame([("dir/SUMS", bytearray(text.encode()))], "path string, content binary")
    got = [r.problem for r in reconcile.checksum_lines(df).orderBy("line_no").collect()]
    assert got == [None, "order", "own_name", "duplicate", "grammar", "path", None]
    files = spark.createDataFrame([("g", "b", h), ("g", "a", h)], "g string, path string, sha256 string")
    assert reconcile.checksum_text(files, ["g"]).first().text == f"{h}  a\n{h}  b\n"


SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["v", "files", "n"],
    "properties": {
        "v": {"type": "string", "enum": ["v1"]}, "n": {"type": "integer", "minimum": 1}, "x": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": ["string", "null"], "minLength": 2, "pattern": "^[a-z]+$"},
        "files": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["path", "sha256"], "properties": {"path": {"type": "string", "format": "relative-neutral-path"}, "sha256": {"type": "string", "format": "sha256-hex"}}}},
    },
}


def test_closed_schema_reports_every_error(spark):
    ok = {"path": "a", "sha256": "0" * 64}
    docs = [
        (json.dumps({"v": "v1", "n": 1, "x": 1.5, "b": True, "s": None, "files": [ok]}), set()),
        (json.dumps({"v": "v2", "n": 0, "files": []}), {("$.v", "enum"), ("$.n", "minimum")}),
        ('{"v": "v1", "n": 1.0, "files": {}}', {("$.n", "type"), ("$.files", "type")}),
        ('{"v": "v1", "n": true, "x": "1", "b": 1, "files": []}', {("$.n", "type"), ("$.x", "type"), ("$.b", "type")}),
        ('{"n": 2, "s": "A", "y": 1}', {("$.v", "required"), ("$.files", "required"), ("$.s", "minLength"), ("$.s", "pattern"), ("$", "additionalProperties")}),
        (json.dumps({"v": "v1", "n": 1, "files": [ok, {"path": "/a", "z": 1}, 5]}), {("$.files[1].path", "format"), ("$.files[1].sha256", "required"), ("$.files[1]", "additionalProperties"), ("$.files[2]", "type")}),
        ("[]", {("$", "type")}),
        ("{", {("$", "json")}),
        (None, {("$", "json")}),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(docs)], "i int, t string")
    got = {}
    for r in reconcile.schema_violations(df, "i", "t", SCHEMA).collect():
        got.setdefault(r.i, set()).add((r.path, r.rule))
    assert got == {i: w for i, (_, w) in enumerate(docs) if w}


def test_canonical_json(spark):
    docs = ['{"b": 1, "a": [1.0, 5e-6, "é"], "created_at": 1}', "[1]", '{"a": NaN}', "junk", None]
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = [r[0] for r in df.select(hashing.canonical_documents(("created_at",))(F.col("d"))).collect()]
    assert got == ['{"a":[1.0,5e-06,"é"],"b":1}\n', None, None, None, None]
    h = df.select(hashing.document_identity(F.col("d"), ("created_at",))).first()[0]
    assert h == hashlib.sha256(got[0].encode()).hexdigest()


def test_seeded_buckets(spark):
    keys = ["a", "ключ", "", "x" * 1000]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select(hashing.seeded_digest("s", F.col("k")).alias("h"), hashing.bucket(hashing.seeded_digest("s", F.col("k")), 20).alias("b")).collect()
    for k, r in zip(keys, rows, strict=True):
        d = hashlib.sha256(b"s\0" + k.encode())
        assert r.h == d.hexdigest() and r.b == int.from_bytes(d.digest()[:8], "big") % 20


def test_splits(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    a = {r.k: r.s for r in df.select("k", sampling.split_of(F.col("k"), "x").alias("s")).collect()}
    b = {r.k: r.s for r in df.select("k", sampling.split_of(F.col("k"), "x", {"validation": 100, "holdout": 100, "train": 1800}).alias("s")).collect()}
    assert 2500 < sum(v == "train" for v in a.values()) < 2900 and set(b.values()) == {"train", "validation", "holdout"}
    assert spark.createDataFrame([(None,), ("",)], "k string").select(sampling.split_of(F.col("k"), "x")).distinct().first()[0] is None
    for bad in ({}, {"a": 1, "train": 0}, {"a": -1, "train": 1}, {"a": 0.5, "train": 1}):
        with pytest.raises(ValueError):
            sampling.split_of(F.col("k"), "x", bad)
    other = {r[0] for r in df.select(sampling.split_of(F.col("k"), "x", {"red": 1, "blue": 3})).distinct().collect()}
    assert other == {"red", "blue"}


def test_families(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (0, None)], "n int, f string")
    got = sampling.families_in_order(df, F.col("f"), ["n"]).orderBy("family_no").collect()
    assert [(r.family, r.family_no, r.n) for r in got] == [("c", 1, 1), ("b", 2, 2)]
    split = sampling.split_by_family(df, F.col("f"), "x")
    assert sampling.families_across(split, "f", "assigned_split").count() == 0
    assert sampling.families_across(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "f string, s string"), "f", "s").count() == 1
    with pytest.raises(sampling.NoFamily):
        sampling.split_by_family(df, F.col("f"), "x", unnamed="error")
    assert sampling.split_by_family(df.filter("f is not null"), F.col("f"), "x", unnamed="error").count() == 3


def test_too_few_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, i int")
    assert sampling.smallest_hashes(df, F.col("k"), "s", 3, ["i"]).count() == 1
    with pytest.raises(sampling.TooFew):
        sampling.smallest_hashes(df, F.col("k"), "s", 2, ["i"], strict=True)


def test_suite_contracts(spark):
    df = spark.createDataFrame([("s", f"o{i} w - -") for i in range(5)] + [("t", "x w - -")], "suite string, line string")
    got = {r.suite: r.selection for r in sampling.suite_contracts(df, F.col("suite"), F.col("line"), F.col("line"), 3, "seed").collect()}
    assert json.loads(got["s"]) == {"method": "seeded_sha256_without_replacement", "seed": "seed", "pairs": 3, "pool": 5} and got["t"] is None


def test_rule_chain(spark):
    df = spark.createDataFrame([(1, None), (5, 1), (0, 0)], "a int, b int")
    chain = [(F.col("b") == 1, "b"), (F.col("a") > 0, "a")]
    assert [tuple(r) for r in df.select(rules.first_reason(chain), rules.all_reasons(chain)).collect()] == [("a", ["a"]), ("b", ["b", "a"]), (None, [])]
