"""Sources, sinks and streams on files."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import attempts
from tallyframe.schemas import EVENT, INVOICE, USAGE
from tallyframe.sinks import tables
from tallyframe.sources import files, model
from tallyframe.streaming import events as stream


@pytest.fixture
def folder(tmp_path):
    for name, body in (("a.PDF", b"%PDF-one|two"), ("b.pdf", b"broken"), ("c.txt", b"%PDF-x")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF-")
    return tmp_path


def parser(content):
    if not content.startswith(b"%PDF-"):
        raise ValueError("unreadable")
    return [("text", p) for p in content[5:].decode().split("|")]


def test_scan(spark, folder):
    docs = files.find_documents(spark, str(folder))
    got = sorted((r.source_file, r.page_no, r.text, r.error_class) for r in files.scan_pages(docs, parser).collect())
    assert got == [("a.PDF", 1, "one", None), ("a.PDF", 2, "two", None), ("b.pdf", None, None, "ValueError")]
    bad = {r.path.rsplit("/", 1)[-1]: r.violation for r in files.check_uploads(docs).collect()}
    assert bad == {"b.pdf": "signature"}
    wanted = spark.createDataFrame([("a.PDF", [2, 9, 1])], "source_file string, pages array<int>")
    png = files.render_pages(docs, wanted, lambda c, n, dpi: b"png" if n <= 2 else None, limit=2).collect()
    assert [(r.page_no, bytes(r.png)) for r in png] == [(2, b"png")]


def test_usage_round_trip(spark, tmp_path):
    path = str(tmp_path / "usage")
    tables.write_usage_csv(spark.createDataFrame([], USAGE), path)
    assert files.read_usage(spark, path).count() == 0
    head = next((tmp_path / "usage").glob("*.csv")).read_text()
    assert head.strip().split(",") == USAGE.names
    row = {f.name: None for f in USAGE.fields} | {"run_id": "r", "cost_usd": Decimal("0.5"), "accepted": True}
    tables.write_usage_csv(spark.createDataFrame([tuple(row[f.name] for f in USAGE.fields)], USAGE), path)
    got = files.read_usage(spark, path).collect()[0]
    assert (got.run_id, float(got.cost_usd), got.accepted, got.route) == ("r", 0.5, True, None)
    assert files.read_usage(spark, str(tmp_path / "absent")).count() == 0
    assert tables.usage_path("/x/out.xlsx") == "/x/out.usage.csv"


def test_export(spark):
    line = (None, None, "Bolt", Decimal(1), Decimal(2), Decimal(2))
    invoice = tuple([None] * 11 + [Decimal("9.5"), None, [line, line]])
    schema = f"source_file string, invoice {INVOICE.simpleString()}, needs_review boolean, review_reason string"
    out = tables.export_tables(spark.createDataFrame([("b.pdf", invoice, True, "x"), ("a.pdf", tuple([None] * 13 + [[]]), False, None)], schema))
    assert [(r.invoice_id, r.source_file, r.total_amount) for r in out["Invoices"].orderBy("invoice_id").collect()] == [("INV-0001", "a.pdf", None), ("INV-0002", "b.pdf", 9.5)]
    assert [r.line_number for r in out["LineItems"].orderBy("line_number").collect()] == [1, 2] and out["NeedsReview"].count() == 1
    empty = tables.export_tables(spark.createDataFrame([], schema))
    assert [empty[k].count() for k in empty] == [0, 0, 0]


def test_staged_set_is_all_or_nothing(spark, tmp_path):
    (tmp_path / "x").write_text("old")
    with pytest.raises(RuntimeError):
        with tables.staged(spark, str(tmp_path)) as s:
            open(f"{s.removeprefix('file:')}/x", "w").write("new")
            raise RuntimeError
    assert (tmp_path / "x").read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["x"]
    with tables.staged(spark, str(tmp_path)) as s:
        open(f"{s.removeprefix('file:')}/x", "w").write("new")
    assert (tmp_path / "x").read_text() == "new"


def test_metadata_and_manifest(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"files": [{"source_file": "d/a.pdf", "elapsed_seconds": 1.0}, {"source_file": "a.pdf", "elapsed_seconds": 2.0}]}))
    assert [(r.file, r.elapsed_seconds) for r in files.read_run_metadata(spark, str(tmp_path / "run.json")).collect()] == [("a.pdf", 2.0)]
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"case_id": "b", "source_file": "x.pdf", "expected_outcome": "extracted"}, {"case_id": "b", "expected_outcome": "odd"}]}))
    bad = {(r.case_id, r.violation) for r in files.manifest_violations(files.read_manifest(spark, str(tmp_path / "m.json"))).collect()}
    assert bad == {("b", "repeated_case_id"), ("b", "no_source_file"), ("b", "unknown_outcome"), ("b", "unknown_document_type"), ("b", "no_ground_truth")}


def test_retry_and_ladder(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise model.CallError("rate_limited")
        return {"answer": "{}"}

    waits = []
    assert model.with_retry(flaky, sleep=waits.append) == {"answer": "{}"} and waits == [1.0, 2.0]
    with pytest.raises(model.CallError):
        model.with_retry(lambda: (_ for _ in ()).throw(model.CallError("client_error")), sleep=waits.append)
    assert waits == [1.0, 2.0]


def envelope(text, finish="stop"):
    return {"id": "g", "model": "served", "choices": [{"finish_reason": finish, "message": {"content": text}}], "usage": {"total_tokens": 3, "cost": 0.1}}


def test_ladder_with_repair(spark, tmp_path):
    def caller(name, prompt):
        if name == "a":
            return envelope("cut", "length")
        if name == "b":
            raise model.CallError("client_error", 418)
        return envelope('{"x": 1}' if "not valid JSON" in prompt else "sorry, no braces")

    requests = spark.createDataFrame([(1, "p")], "request_id bigint, prompt string")
    got = model.ask_models(requests, caller, ["a", "b", "c", "d"]).collect()
    assert [(r.requested_model, r.attempt_type, r.rejection, r.http_status) for r in got] == [
        ("a", "primary", "truncated", None), ("b", "escalation", "client_error", 418), ("c", "escalation", "malformed_json", None), ("c", "repair", None, None)]
    path = str(tmp_path / "attempts")
    assert model.asked_once(requests, path, caller, ["c"]).count() == 2

    def never(name, prompt):
        raise AssertionError("answered requests are not sent again")

    again = model.asked_once(requests, path, never, ["c"])
    assert again.count() == 2 and model.served(again).collect()[0].attempt_type == "repair"
    read = attempts.read_completions(again.where("raw is not null")).collect()
    assert {r.answer.actual_model for r in read} == {"served"} and float(read[0].answer.cost_usd) == 0.1


def test_envelopes_never_fail(spark):
    rows = [None, "", "[]", "1", '{"choices": [1]}', '{"choices": [{"message": {"content": 5}}]}', '{"error": {"code": 404}}', '{"error": "x"}', '{"choices": [{"message": null}]}', json.dumps(envelope("ok"))]
    got = attempts.read_completions(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()
    bad = "malformed_envelope"
    assert [r.rejection for r in got] == [bad, bad, bad, bad, bad, bad, "model_unavailable", bad, "empty", None]


def test_documents_and_status(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"b": 0.5, "a": 1, "__doc__": "x"}')
    assert [tuple(r) for r in files.read_thresholds(spark, str(tmp_path / "t.json")).collect()] == [("a", 1.0), ("b", 0.5)]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="must be a JSON object"):
        files.read_document(spark, str(tmp_path / "l.json"))
    assert files.read_status(spark, str(tmp_path)) is None
    for state in ("running", "completed"):
        tables.write_status(spark, str(tmp_path), "j1", state, artifacts=["b", "a"])
    status = files.read_status(spark, str(tmp_path))
    assert status["state"] == "completed" and status["artifacts"] == ["a", "b"]
    jobs = spark.createDataFrame([("j1", "completed"), ("j3", "running"), ("j2", "failed")], "job_id string, state string")
    assert files.newest_finished(jobs).collect()[0].job_id == "j2" and files.newest_finished(jobs.limit(0)).count() == 0


def test_report_and_events_are_written(spark, tmp_path):
    summary = spark.createDataFrame([("num_cases", "2")], "metric string, value string")
    tables.write_report({"Summary": summary, "Errors": summary.limit(0)}, str(tmp_path / "report"))
    assert json.loads((tmp_path / "report" / "summary.json").read_text()) == {"num_cases": "2"} and spark.read.parquet(str(tmp_path / "report" / "Errors")).count() == 0
    made = spark.createDataFrame([("j", 1, "2025-01-01T00:00:00Z", "file_started", 1, "a.pdf", None, None, None)], EVENT)
    tables.append_events(made, str(tmp_path / "log"))
    tables.append_events(made.withColumn("seq", F.col("seq") + 1), str(tmp_path / "log"))
    read = files.read_events(spark, str(tmp_path / "log"))
    assert [r.line for r in stream.event_lines(read).orderBy("seq").collect()] == ["File 1: a.pdf", "File 1: a.pdf"]


EVENTS = [("j", 0, "job_started", None, None), ("j", 1, "file_started", 1, "a.pdf"), ("j", 1, "file_started", 1, "copy.pdf"), ("j", 2, "file_finished", 1, "a.pdf"), ("j", 3, "file_started", 2, "b.pdf"), ("k", 0, "job_started", None, None)]


def write_events(path, rows):
    path.mkdir(exist_ok=True)
    for i, (job, seq, event, index, name) in enumerate(rows):
        row = {"job_id": job, "seq": seq, "ts": f"2025-01-01T00:00:{i:02d}Z", "event": event, "file_index": index, "file_name": name}
        (path / f"{i:03d}.json").write_text(json.dumps({k: v for k, v in row.items() if v is not None}) + "\n")


def test_event_log(spark, tmp_path):
    write_events(tmp_path / "log", EVENTS)
    (tmp_path / "log" / "999.json").write_text('{"torn": ')
    got = files.read_events(spark, str(tmp_path / "log")).collect()
    assert [(r.job_id, r.seq) for r in got] == [("j", 0), ("j", 1), ("j", 2), ("j", 3), ("k", 0)]
    assert files.last_events(files.read_events(spark, str(tmp_path / "log")), 2).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    write_events(tmp_path / "log", EVENTS)
    events = stream.deduplicated(stream.event_stream(spark, str(tmp_path / "log")))
    run = stream.progress(events).writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r.job_id: r.asDict() for r in spark.sql("select * from progress order by n_events").collect()}
    once = spark.createDataFrame([(j, s, None, e, i, n, None, None, None) for k, (j, s, e, i, n) in enumerate(EVENTS) if k != 2], EVENT)
    batch = {r.job_id: r.asDict() for r in stream.batch_progress(once).collect()}
    assert last == batch


def test_failing_consumer_does_not_stop(spark):
    seen = []
    stream.guarded(lambda df, n: 1 / 0, seen.append)(spark.range(1), 0)
    assert isinstance(seen[0], ZeroDivisionError)
