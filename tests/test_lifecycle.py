from pyspark.sql import functions as F

from quillon.operators import catalog, history, lifecycle, search
from quillon.sources import acquire, payloads
from quillon.streaming import ingest

STORE = "record_id string, content string, doc_id string, chunk_index int, seq bigint, lifecycle_state string, is_latest boolean, supersedes string"


def store(spark, *rows):
    return spark.createDataFrame(list(rows), STORE)


def test_upsert_supersedes_the_same_document(spark):
    old = store(spark, ("old-1", "a", "d", 0, 1, "active", True, None), ("x", "b", "e", 0, 2, "active", True, None))
    out = {r.record_id: r for r in lifecycle.upsert(old, store(spark, ("new-1", "c", "d", 0, 3, "active", True, None), ("new-2", "c", "d", 1, 4, "active", True, None))).collect()}
    assert (out["old-1"].lifecycle_state, out["old-1"].is_latest, out["old-1"].supersedes) == ("superseded", False, "new-1")
    assert out["new-1"].is_latest and out["new-2"].is_latest and out["x"].lifecycle_state == "active"


def test_upsert_of_the_same_record_keeps_its_place(spark):
    old = store(spark, ("a", "1", "d", 0, 1, "active", True, None))
    out = lifecycle.upsert(old, store(spark, ("a", "2", "d", 0, 8, "active", True, None), ("a", "3", "d", 0, 9, "active", True, None))).collect()
    assert [(r.content, r.seq, r.lifecycle_state) for r in out] == [("3", 1, "active")]


def test_upsert_with_empty_tables_and_nulls(spark):
    none, rows = store(spark), store(spark, (None, None, None, None, None, None, None, None))
    assert lifecycle.upsert(none, none).count() == 0
    assert lifecycle.upsert(rows, none).count() == 1
    assert lifecycle.upsert(none, rows).count() == 1


def test_delete_and_count(spark):
    s = store(spark, ("a", "", "d", 0, 1, "active", True, None), ("b", "", "d", 0, 2, "deleted", False, None), ("c", "", "d", 0, 3, None, None, None))
    after, n = lifecycle.delete_by_filter(s, {"lifecycle_state": "active"})
    assert n.first().deleted == 1 and after.where("lifecycle_state = 'deleted'").count() == 2
    assert lifecycle.count(s).first().n == 2
    assert lifecycle.delete_by_filter(s, {})[1].first().deleted == 3


def test_expiry(spark):
    df = spark.createDataFrame([("2026-04-09T12:00:00Z", 1), ("2026-04-12T11:00:00", 0), ("2026-04-12T11:00:00", None), ("bad", 1), (None, 1), ("2026-04-12T11:00:00Z", -5)], "c string, t int")
    assert [r[0] for r in df.select(lifecycle.ttl_expired(F.col("c"), F.col("t"), "2026-04-12T12:00:00Z")).collect()] == [True, True, False, False, False, True]
    p = spark.createDataFrame([("active", True), (" Deleted", False), ("deleted", None)], "s string, l boolean")
    assert [r[0] for r in p.select(lifecycle.purge_safe(F.col("s"), F.col("l"))).collect()] == [False, True, False]


def test_normalised_fills_defaults_and_strips_nul(spark):
    df = spark.createDataFrame([("alpha\x00beta", "http://u", None, None, None, None, None, None, None, None)], "content string, source_uri string, chunk_index int, doc_id string, record_id string, source_hash string, content_hash string, lifecycle_state string, is_latest boolean, created_at string")
    r = lifecycle.normalised(df, "2026-01-01T00:00:00Z").first()
    assert r.content == "alphabeta" and r.lifecycle_state == "active" and r.is_latest and len(r.doc_id) == 64 and len(r.record_id) == 64


def test_update_keeps_provenance(spark):
    df = spark.createDataFrame([("a", "old", "deepdoc"), ("b", "old", None)], "record_id string, content string, parser_provider string")
    new = spark.createDataFrame([("a", "new", "mineru"), ("b", None, "mineru"), ("z", "q", "q")], "record_id string, content string, parser_provider string")
    assert {tuple(r) for r in lifecycle.update(df, new).collect()} == {("a", "new", "deepdoc"), ("b", "old", "mineru")}
    assert lifecycle.update(df, new, insert_absent=True).count() == 3


def updates(spark, rows):
    return spark.createDataFrame(rows, "update_id bigint, record_id string, supersedes string, is_latest boolean, lifecycle_state string, ingested_at string, received_at timestamp, at string, s string, v string")


def row(n, rec, state, at, latest=True, sup=None):
    import datetime

    return (n, rec, sup, latest, state, at, datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=n), "x", "y", "z")


def test_history_versions(spark):
    rows = [row(1, "r", "active", "2024-01-01T00:00:00Z"), row(2, "r", " ACTIVE ", "2024-01-02T00:00:00Z", sup=""), row(3, "r", "deleted", "2024-01-03T01:00:00+01:00"), row(4, "r", "archived", "2024-01-03T00:00:00Z"), row(5, "r", "active", "not yet"), row(6, None, "active", "2024-01-01T00:00:00Z"), row(7, "q", None, "2024-01-01T00:00:00Z", None), row(8, "r", "x", None)]
    out = {(r.record_id, r.version_no): r for r in history.metadata_history(updates(spark, rows + rows)).collect()}
    assert set(out) == {("r", 1), ("r", 2), ("q", 1)}
    assert out["r", 2].lifecycle_state == "archived" and out["r", 1].valid_to_us == out["r", 2].valid_from_us and out["r", 2].valid_to_us is None
    assert history.metadata_history(updates(spark, [])).count() == 0


def test_history_in_chunks_is_the_same(spark):
    import random

    random.seed(3)
    rows = [row(n, random.choice("aaaab"), random.choice(["active", "active", "deleted"]), f"2024-{random.randint(1, 12):02}-{random.randint(1, 28):02}T0{random.randint(0, 9)}:00:00Z") for n in range(600)]
    u = updates(spark, rows)
    whole, parts = (sorted(map(tuple, history.metadata_history(u, n).collect())) for n in (2_000, 7))
    assert whole == parts


def test_exact_and_compat_search(spark):
    s = spark.createDataFrame([(str(i), [float(10 - i), 0.0], "active") for i in range(6)] + [("none", None, "active")], "id string, embedding array<float>, lifecycle_state string")
    r = spark.createDataFrame([(str(i), "superseded" if i < 2 else "active") for i in range(6)] + [("none", "active")], "record_id string, lifecycle_state string")
    assert [h.id for h in search.search(s, r, [1.0, 0.0], 3).collect()] == ["2", "3", "4"]
    assert [h.id for h in search.search(s, r, [1.0, 0.0], 3, mode="compat").collect()] == ["2"]


def test_batch_topk_leaves_out_unusable_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0])], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query bigint, vector array<double>")
    assert [(r.id, r["rank"]) for r in search.batch_topk(df, q, 2).orderBy("rank").collect()] == [(1, 1), (6, 2)]
    assert search.batch_topk(df.limit(0), q, 2).count() == 0


def test_plan_clamps():
    assert search.plan(1000, {"a": 1}, search.MATRIX["infinity"])["top_k"] == 500
    assert search.plan(0, None, search.MATRIX["weaviate"]) == {"mode": "hybrid", "top_k": 1, "filters": {}}


def test_payloads(spark):
    bad = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}")], "payload_id int, payload string")
    for d in payloads.DIALECTS:
        assert payloads.normalised(bad, d).count() == 0


def test_catalog(spark):
    specs = spark.createDataFrame([("b", "n", 4, "cosine", {"k": "1"}), ("a", "n", 4, "l2", None)], "name string, namespace string, embedding_dim int, distance_metric string, metadata map<string,string>")
    out = catalog.patched(specs, "b", dim=8, metadata={"k": "2", "j": "3"})
    assert out.where("name = 'b'").first().metadata == {"k": "2", "j": "3"} and [r.name for r in catalog.listed(out).collect()] == ["a", "b"]
    assert catalog.create(specs, specs.where("name = 'a'")).count() == 2 and catalog.dropped(specs, "a").count() == 1


def test_files_are_parsed(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één\n\ntwee".encode())
    (tmp_path / "b%20c.html").write_bytes("x".encode("utf-16"))
    out = {r.source_uri.rsplit("/", 1)[1]: r for r in acquire.parse(acquire.files(spark, str(tmp_path)), [None]).collect()}
    assert out["a.txt"].blocks == ["één", "twee"] and len(out) == 2


def test_stream_of_upserts(spark, tmp_path):
    schema = STORE + ", source_uri string, source_hash string, content_hash string, created_at string"
    batch = spark.createDataFrame([("r1", "hello", None, 0, 1, None, None, None, "file://a", None, None, None)], schema)
    batch.write.parquet(str(tmp_path / "in"))
    kept = [store(spark)]
    ingest.upserts(ingest.file_stream(spark, str(tmp_path / "in"), schema), lambda: kept[-1], lambda df: kept.append(spark.createDataFrame(df.collect(), STORE)), str(tmp_path / "cp"), "2026-01-01T00:00:00Z").awaitTermination()
    assert kept[-1].first().lifecycle_state == "active" and kept[-1].count() == 1


def test_insertion_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"))
    assert all(r.seq == r.k for r in lifecycle.in_order(df, "k").collect())
