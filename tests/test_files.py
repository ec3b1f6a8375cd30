import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from plyforge.operators.history import LEDGER
from plyforge.sources import files, sinks


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_epd(spark, tmp_path):
    p = write(tmp_path / "a.epd", "a b c d 0 1\n\n  a b c d \nbad line\r\nx y z w\u2028p q r s\n")
    got = [(r.ln, r.key) for r in files.read_epd(spark, p).orderBy("ln").collect()]
    assert got == [(1, "a b c d"), (3, "a b c d"), (4, None), (5, "x y z w"), (6, "p q r s")]


def test_tsv(spark, tmp_path):
    p = write(tmp_path / "t.tsv", "\ufefffen\tsf_error\tn\n\"a\t\t1\nb\tx\t2\n")
    rows = files.read_tsv(spark, p, ("fen", "sf_error")).drop("file").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [('"a', "", "1"), ("b", "x", "2")]
    with pytest.raises(files.MissingColumns):
        files.read_tsv(spark, p, ("fen", "nope"))
    numbered = files.read_tsv_numbered(spark, p, ("fen",)).orderBy("row_number").collect()
    assert [(r.row_number, r.fen, r.sf_error) for r in numbered] == [(2, '"a', ""), (3, "b", "x")]
    with pytest.raises(files.MissingColumns):
        files.read_tsv_numbered(spark, p, ("nope",))
    assert [r.fen for r in files.window_of_rows(files.read_tsv_numbered(spark, p), ["row_number"], 1, 1).collect()] == ["b"]


def test_transcripts(spark, tmp_path):
    write(tmp_path / "u" / "1.log", "info score cp 1 pv e2e4\r\nbestmove e2e4\n")
    write(tmp_path / "u" / "2.log", "junk\n")
    rows = files.read_transcripts(spark, str(tmp_path / "u")).collect()
    assert sorted((os.path.basename(r.file), r.ln, r.info is not None, r.best is not None) for r in rows) == [("1.log", 1, True, False), ("1.log", 2, False, True), ("2.log", 1, False, False)]


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "l.jsonl", '{"run_id": "a"}\n\n{bad\n{"run_id": "b"}')
    rows = files.read_jsonl(spark, p, LEDGER).orderBy("ln").collect()
    assert [(r.ln, r.problem) for r in rows] == [(1, None), (2, "blank"), (3, "json"), (4, "unfinished")]
    assert rows[0].record.run_id == "a"


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_splits_a_file(spark, tmp_path, small_splits):
    texts = [f"row {i} " + "x" * (i % 90) for i in range(60)]
    p = write(tmp_path / "a.txt", "\n".join(texts))
    assert [(r.ln, r.line) for r in files.numbered_lines(spark, p).orderBy("ln").collect()] == list(enumerate(texts, 1))
    j = write(tmp_path / "j.jsonl", "\n".join(json.dumps({"run_id": str(i)}) for i in range(40)))
    got = files.read_jsonl(spark, j, LEDGER).orderBy("ln").collect()
    assert [r.record.run_id for r in got] == [str(i) for i in range(40)] and [r.problem for r in got] == [None] * 39 + ["unfinished"]
    e = "a b c d\u2028b b c d\n" + "x y z w\n" * 9 + "p\u2028q\n" + "c b c d\n" * 9
    want = [(k, " ".join(x.split()[:4]) if len(x.split()) > 3 else None) for k, x in enumerate(e.splitlines(), 1)]
    assert [(r.ln, r.key) for r in files.read_epd(spark, write(tmp_path / "e.epd", e)).orderBy("ln").collect()] == want
    t = write(tmp_path / "t.tsv", "a\tb\n" + "".join(f"{i}\t{i * i}\n" for i in range(50)))
    assert [(r.row_number, r.a, r.b) for r in files.read_tsv_numbered(spark, t).orderBy("row_number").collect()] == [(i + 2, str(i), str(i * i)) for i in range(50)]


def test_manifests_and_first_rows(spark, tmp_path):
    p = write(tmp_path / "m.tsv", "fen\tn\nx\t2\ny\t1\n")
    m = files.read_manifest(spark, p, ("fen",))
    assert files.first_row(m, ["n"]).first().fen == "y"
    with pytest.raises(files.NoRows):
        files.read_manifest(spark, write(tmp_path / "e.tsv", "fen\tn\n"), ("fen",))


def test_ledgers_as_a_whole(spark, tmp_path):
    good = [{"run_id": f"r{i}", "record_id": f"i{i}"} for i in range(3)]
    p = write(tmp_path / "l.jsonl", "".join(json.dumps(g) + "\n" for g in [*good, {"run_id": "r1", "record_id": "i9"}, {"record_id": "i0"}]) + "{\n")
    got = files.ledger_problems(files.read_jsonl(spark, p, LEDGER), ("run_id", "record_id")).collect()
    assert sorted((r.ln, r.problem) for r in got) == [(4, "repeated run_id"), (5, "missing run_id"), (5, "repeated record_id"), (6, "json")]
    sound = write(tmp_path / "s.jsonl", "".join(json.dumps(g) + "\n" for g in good))
    assert files.ledger_problems(files.read_jsonl(spark, sound, LEDGER), ("run_id",)).collect() == []


def test_state_histories(spark, tmp_path):
    for name, text in (("run 1.jsonl", '{"run_id": "run 1", "state": "A"}\n{"run_id": "run 1", "state": "Z"}\n'), ("b.jsonl", '{"run_id": "c", "state": "A"}\n{"run_id": "b"}\n\n')):
        write(tmp_path / "st" / name, text)
    got = files.state_problems(files.read_jsonl(spark, str(tmp_path / "st"), "run_id string, state string"), ("A", "B")).collect()
    assert sorted((os.path.basename(r.file)[0], r.ln, r.problem) for r in got) == [("b", 1, "other run"), ("b", 2, "unknown state"), ("b", 3, "blank"), ("r", 2, "unknown state")]


def test_documents_and_inventory(spark, tmp_path):
    write(tmp_path / "d" / "a.json", '{"x": 1}')
    write(tmp_path / "d" / "s" / "b.json", '{"x": 1}\r\n')
    write(tmp_path / "d" / "c.json", b"\xff\xfe")
    write(tmp_path / "d" / "d.json", "{")
    root = str(tmp_path / "d")
    got = {os.path.basename(r.file): r.problem for r in files.read_documents(spark, root).collect()}
    assert got == {"a.json": None, "b.json": "carriage_return", "c.json": "utf8", "d.json": "json"}
    inv = {r.path: (r.sha256, r.size_bytes) for r in files.file_inventory(spark, root).collect()}
    assert inv["s/b.json"] == (hashlib.sha256(b'{"x": 1}\r\n').hexdigest(), 10) and len(inv) == 4
    assert files.odd_files(root) == []
    os.symlink("a.json", os.path.join(root, "link"))
    assert files.odd_files(root) == ["link"]


def test_insert_upsert_and_partitions(spark, tmp_path):
    p = str(tmp_path / "dim")
    df = lambda *r: spark.createDataFrame(list(r), "k string, v int, t int")
    sinks.insert_new(df(("a", 1, 2), ("a", 0, 1), ("b", 5, 1)), p, ["k"], ["t"])
    sinks.insert_new(df(("a", 9, 0), ("c", 7, 1)), p, ["k"], ["t"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [("a", 0), ("b", 5), ("c", 7)]
    q = str(tmp_path / "up")
    sinks.upsert_latest(df(("a", 1, 1), ("b", 1, 1)), q, ["k"], ["t"])
    sinks.upsert_latest(df(("a", 2, 2), ("b", 0, 0), ("c", 3, 1)), q, ["k"], ["t"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(q).collect()) == [("a", 2), ("b", 1), ("c", 3)]
    assert sinks.surviving_children(df(("a", 1, 1), ("x", 1, 1)), spark.read.parquet(q), ["k"]).count() == 1
    s = str(tmp_path / "parts")
    sinks.replace_partitions(df(("a", 1, 1), ("b", 2, 1)), s, ["k"])
    sinks.replace_partitions(df(("a", 9, 1)), s, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(s).collect()) == [("a", 9), ("b", 2)]


def test_immutable_and_append(spark, tmp_path):
    p = str(tmp_path / "runs")
    df = lambda *r: spark.createDataFrame(list(r), "run_id string, record_id string, n int")
    sinks.create_immutable(df(("r", "i", 1)), p, ["run_id"])
    sinks.create_immutable(df(("r", "i", 1), ("s", "j", None)), p, ["run_id"])
    assert spark.read.parquet(p).count() == 2
    for bad in (df(("r", "i", 2)), df(("z", "k", 1), ("z", "k", 2))):
        with pytest.raises(sinks.Conflict):
            sinks.create_immutable(bad, p, ["run_id"])
    q = str(tmp_path / "ledger")
    sinks.append_records(df(("r", "i", 1)), q)
    sinks.append_records(df(("r", "i", 1), ("s", "j", 1)), q)
    assert spark.read.parquet(q).count() == 2
    for bad in (df(("r", "other", 1)), df(("t", "k", 1), ("t", "l", 1))):
        with pytest.raises(sinks.Conflict):
            sinks.append_records(bad, q)
    sinks.rebuild_index(spark.read.parquet(q), str(tmp_path / "index"))
    meta = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "index_metadata")).collect()}
    assert meta == {"ledger_schema_version": "v1", "record_count": "2"}


def text_of(path):
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part"))


def test_text_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\"x", None), (1, "a", "q")], "n int, s string, e string")
    sinks.write_tsv(df, str(tmp_path / "o"), ["s"], ["n"])
    assert text_of(tmp_path / "o") == 's\tn\te\na\t1\tq\nb"x\t2\t\n'
    sinks.write_tsv(spark.createDataFrame([(" a ",)], "s string").coalesce(1), str(tmp_path / "b"))
    assert text_of(tmp_path / "b") == "s\n a \n"
    sinks.write_lines(df, str(tmp_path / "l"), "s", ["n"])
    assert text_of(tmp_path / "l") == 'a\nb"x\n'
    with pytest.raises(ValueError):
        sinks.write_lines(df.filter("n > 9"), str(tmp_path / "z"), "s", ["n"])
    assert sinks.write_rescored(df, str(tmp_path / "r"), ["n"], engine="e") == 2
    assert json.load(open(tmp_path / "r.meta.json")) == {"rows": 2, "engine": "e"}


def test_finished_jobs(spark):
    df = spark.createDataFrame([(None, "e2e4"), (None, None), ("boom", "e2e4")], "error_text string, bestmove string")
    assert [r.status for r in sinks.finished_jobs(df).collect()] == ["ok", "no_legal_moves", "error"]


def test_lines_of_texts(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "x\n\ny")], "k int, text string")
    assert sorted((r.k, r.ln, r.line) for r in files.lines_of(df, "k").collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "x"), (4, 2, ""), (4, 3, "y")]
    assert files.lines_of(df.filter(F.lit(False)), "k").count() == 0


def test_a_broken_swap_is_recovered(spark, tmp_path):
    p = str(tmp_path / "t")
    df = lambda n: spark.createDataFrame([("a", n, n)], "k string, v int, t int")
    sinks.upsert_latest(df(1), p, ["k"], ["t"])
    os.rename(p, p + ".old-1")
    df(2).write.parquet(p + ".new-1")
    os.remove(p + ".new-1/_SUCCESS")
    assert sinks.stored(spark, p).first().v == 1
    os.rename(p, p + ".old-2")
    df(2).write.parquet(p + ".new-2")
    sinks.upsert_latest(df(0), p, ["k"], ["t"])
    assert sinks.stored(spark, p).first().v == 2
    assert sorted(os.listdir(tmp_path)) == ["t"]
