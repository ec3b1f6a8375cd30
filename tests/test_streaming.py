import json

from plyforge.streaming import ledger


def line(i, at, opponent="o", wins=1):
    return json.dumps({"run_id": f"r{i}", "record_id": f"i{i}", "recorded_at": at, "opponent_id": opponent, "analysis_result": {"recomputed_wdl": {"wins": wins, "losses": 2, "draws": 3}}}) + "\n"


def test_ledger_stream_deduplicates_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.jsonl").write_text(line(1, "2031-01-01T00:00:00Z") + line(2, "2031-01-01T01:00:00Z") + "junk\n")
    q = ledger.ledger_stream(spark, str(src), files=1).writeStream.format("memory").queryName("ledger_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (src / "2.jsonl").write_text(line(2, "2031-01-01T01:00:00Z") + line(3, "2031-01-02T01:00:00Z"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.record_id for r in spark.table("ledger_rows").collect()) == ["i1", "i2", "i3"]


def test_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.jsonl").write_text("".join(line(i, f"2031-01-0{1 + i % 2}T00:00:00Z", wins=i) for i in range(4)))
    out = ledger.results_per_window(ledger.ledger_stream(spark, str(src)))
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (src / "2.jsonl").write_text(line(9, "2031-02-01T00:00:00Z"))
    q.processAllAvailable()
    (src / "3.jsonl").write_text(line(10, "2031-03-01T00:00:00Z"))
    q.processAllAvailable()
    q.stop()
    got = {r.start.day: (r.wins, r.records) for r in spark.table("windows").collect() if r.start.month == 1}
    assert got == {1: (2, 2), 2: (4, 2)}


def test_transitions_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    event = lambda k, s, n: json.dumps({"k": k, "s": s, "n": n}) + "\n"
    (src / "1.json").write_text(event("a", "R", 1) + event("b", "A", 1))
    stream = spark.readStream.schema("k string, s string, n string").option("maxFilesPerTrigger", 1).json(str(src))
    bad = ledger.transition_violations(stream, "k", "s", "n", ["R"], {"R": ["A"], "A": ["D"]})
    q = bad.writeStream.format("memory").queryName("bad_steps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (src / "2.json").write_text(event("a", "A", 2) + event("a", "A", 3) + event("b", "D", 2))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.key, r.previous, r.state) for r in spark.table("bad_steps").collect()) == [("a", "A", "A"), ("b", None, "A")]
