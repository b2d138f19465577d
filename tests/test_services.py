"""Commands, polled jobs, hosted stores, and streams into buckets."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from quillon.schemas import BackendUnavailableError, InvalidRequestError, ParserTimeoutError
from quillon.sources import acquire, services
from quillon.streaming import ingest


def test_commands_parse_files(spark):
    shout = services.CommandParser("shout", [sys.executable, "-c", "import sys; t = open(sys.argv[-1]).read(); sys.exit(3) if t == 'bad' else print(t.upper() if t != 'mute' else '')"])
    d = acquire.inline(spark.createDataFrame([("one\n\ntwo",), ("bad",), ("mute",)], "t string"), "t")
    out = acquire.parse(d, [shout, None]).collect()
    assert sorted((r.provider_id, r.blocks) for r in out) == [("internal", ["bad"]), ("shout", ["ONE", "TWO"]), ("shout", ["mute"])]
    assert services.CommandParser("python", [sys.executable]).healthy() and not services.CommandParser("none", ["/no/such/command"]).healthy()
    with pytest.raises(BackendUnavailableError):
        services.CommandParser("none", [])


def test_parsers_by_configuration():
    made = services.parser_registry({"docling": {"enabled": True}, "deepdoc": {"enabled": False}, "mineru": {"base_url": "http://x"}, "marker_mcp": {"base_url": " "}, "transformers": {"base_url": "u"}}, {"mineru": lambda c: services.CommandParser("mineru", ["x"]), "marker_mcp": None})
    assert made.ids() == ["docling", "mineru"]


def job(answers, **how):
    now, seen, cancelled = [0.0], [], []

    def sleep(s):
        now[0] += s

    left = list(answers)
    out = services.run_job(lambda: "j", lambda _: left.pop(0) if len(left) > 1 else left[0], lambda j: {"output": f"of {j}"}, cancelled.append, clock=lambda: now[0], sleep=sleep, tell=seen.append, **how)
    return out, seen, cancelled


def test_polled_jobs():
    out, seen, _ = job([{"status": "queued"}, {"status": "Done "}])
    assert out == {"output": "of j"} and [s["status"] for s in seen] == ["queued", "Done "]
    assert job([{"completed": True, "success": True, "text": "t"}])[0]["text"] == "t"
    with pytest.raises(InvalidRequestError, match="why"):
        job([{"status": "failed", "error": "why"}])
    with pytest.raises(ParserTimeoutError, match="20.0s"):
        job([{"status": "running"}], most_s=20)
    assert services.ended({"completed": True, "success": False}) is None and services.answer_of("[1]") == {} and services.answer_of("x") == {}


def test_hosted_store(spark, tmp_path):
    out = str(tmp_path)

    def call(method, path, body):
        if path == "/health":
            return 200, {}, ""
        if path.endswith("/search"):
            return (500, {}, "") if "broken" in path else (200, {"X-VDB-Backend": "Qdrant"}, json.dumps({"result": [{"id": "a", "score": body["top_k"]}]}))
        if method == "DELETE":
            return (404 if path.endswith("none") else 204), {}, ""
        import pathlib
        import uuid

        pathlib.Path(out, uuid.uuid4().hex).write_text(str(len(body["records"])))
        return 200, {}, ""

    s = services.HostedStore(spark, call)
    assert s.health_check() and [(r.id, r.score) for r in s.search("c", {"top_k": 2}).collect()] == [("a", 2.0)]
    with pytest.raises(RuntimeError, match="search for broken"):
        s.search("broken", {})
    assert s.delete_record("c", "a") and not s.delete_record("c", "none")
    assert s.upsert_records("c", spark.range(5).coalesce(1).select(F.col("id").cast("string").alias("record_id")), 2) == 5
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["1", "2", "2"]
    with services.trace_span("a span", spark):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "a span"


def test_stream_into_buckets(spark, tmp_path):
    kind = "record_id string, content string, source_uri string, doc_id string, chunk_index int, seq bigint, supersedes string"
    rows = lambda *v: spark.createDataFrame(list(v), kind)
    store, source, cp = str(tmp_path / "store"), str(tmp_path / "in"), str(tmp_path / "cp")

    def send(df):
        df.coalesce(1).write.mode("append").parquet(source)
        ingest.bucketed_upserts(ingest.file_stream(spark, source, kind), store, cp, "2026-01-01T00:00:00Z", 4).awaitTermination()

    send(rows(("o", "old", "file://a", "d", 0, 1, None), ("x", "other", "file://b", "e", 0, 2, None)))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    send(rows(("n", "new", "file://a", "d", 0, 3, None)))
    out = {r.record_id: (r.lifecycle_state, r.supersedes) for r in spark.read.parquet(store).collect()}
    assert out == {"o": ("superseded", "n"), "n": ("active", None), "x": ("active", None)}
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert any(kept.get(p) == t for p, t in before.items())  # the other document's bucket is as it was
