"""Stores, the client over them, ingestion, catalog versions, parsers and reports."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import catalog, dialects, ingest, lifecycle, store
from quillon.schemas import ConfigError
from quillon.sources import acquire, parsers, payloads

NOW = "2025-01-01T00:00:00Z"


def client(spark, *providers):
    registry = store.StoreRegistry()
    for p in providers or ("chroma",):
        registry.register(p, store.build(spark, p))
    return store.Client(spark, registry, (providers or ("chroma",))[0], NOW)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, content string, metadata map<string,string>")


@pytest.mark.parametrize("provider", store.PROVIDERS)
def test_every_store_keeps_the_contract(spark, provider):
    s = store.build(spark, provider)
    assert store.conforms(s) and s.initialize() and s.create_collection(store.sample_collection())["created"] and not s.create_collection(store.sample_collection())["created"]
    s.add_documents("docs", docs(spark, ("a", "alpha", {"k": "1"}), ("b", "beta", None), ("a", "gamma", {"k": "1"})))
    assert s.count_documents("docs") == 2 and s.count_documents("docs", {"k": 1}) == 1
    assert [h.id for h in s.search("docs", "gamma", 1).collect()] == ["a"] and s.search("docs", "", 5, {"k": "2"}).count() == 0
    t = store.TRAITS[provider]
    assert s.delete_document("docs", "none") is t.absent_delete and s.delete_document("docs", "b") and s.count_documents("docs") == 1
    assert s.update_document("docs", "new", "x") is t.update_inserts and s.update_document("docs", "a", "delta")
    assert s.get_collection("docs")["name"] == "docs" and s.get_collection("none") is None and s.delete_collection("docs") and not s.delete_collection("docs")


def test_registry_and_factory(spark):
    r = store.StoreRegistry()
    r.register("qdrant", store.build(spark, "qdrant"))
    r.register("chroma", store.build(spark, "chroma"))
    assert r.ids() == ["chroma", "qdrant"]
    with pytest.raises(KeyError):
        r.get("pgvector")
    with pytest.raises(ValueError, match="unsupported"):
        store.build(spark, "other")
    with pytest.raises(ValueError, match="no enabled"):
        store.configured(spark, {}, NOW)
    c = store.configured(spark, {"vector_stores": {"qdrant": {"enabled": True}, "infinity": {"enabled": True}}}, NOW)
    assert c.default == "infinity" and c.health_check("qdrant")


def test_provider_settings():
    p = store.provider_config("qdrant", {"host": "h", "port": "6", "tls": "yes", "auth_token": "k"}, {"provider": "Own", "own": {"model": "m"}, "base_url": "u", "model": "x"})
    assert (p.base_url, p.api_key, p.embedding_model, p.embedding_base_url, p.timeout_seconds) == ("https://h:6", "k", "m", "u", 30.0)
    assert store.provider_config("qdrant", {"url": "http://x", "timeout_seconds": 5}).base_url == "http://x"


def test_collections_and_their_versions(spark):
    c = client(spark)
    m = store.CollectionManager(c)
    m.create(store.Spec("b", "n", 4, metadata={"embedding_model": "m"}, metadata_schema={"x": "string"}))
    m.create(store.Spec("a"))
    assert [x["name"] for x in m.list()] == ["a", "b"] and c.versions.of["b"].version == 1
    assert m.update("b", {"embedding_dim": 8, "metadata": {"k": "v"}, "distance_metric": "l2"})["distance_metric"] == "cosine" and c.versions.of["b"].version == 2
    assert m.update("none", {}) is None and m.get("b")["metadata"] == {"embedding_model": "m", "k": "v"}
    with pytest.warns(RuntimeWarning, match="dimension mismatch: expected 4, actual 8"):
        assert c.versions.mismatch("b", 4)
    assert not c.versions.mismatch("b", 8, "m") and not c.versions.mismatch("none", 1)
    plan = c.versions.plan_migration("b", 8, ["x", "y"], "other")
    assert plan["from_version"] == 2 and plan["to_version"] == 3 and plan["reembed_required"] and plan["metadata_changed"] and not plan["dimension_changed"]
    with pytest.raises(ValueError, match="not registered"):
        c.versions.plan_migration("none", 1, [], "m")
    assert m.delete("b") and m.get("b") is None and c.versions.of["b"].version == 3
    with pytest.raises(ConfigError):
        m.create(store.Spec(" "))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "record_id string, content string, source_uri string, doc_id string, chunk_index int, tenant_id string")


def test_records_through_a_client(spark):
    c = client(spark)
    c.create_collection(store.sample_collection())
    assert sorted(r[0] for r in c.upsert_records("docs", rows(spark, ("o1", "old one", "file://a", "d", 0, "t"), ("o2", "old two", "file://a", "d", 1, "t"))).collect()) == ["o1", "o2"]
    # the last of a chunk follows, else the batch's first of the document
    c.upsert_records("docs", rows(spark, ("n1", "x", "file://a", "d", 0, "t"), ("n2", "y", "file://a", "d", 0, "u")))
    o1, o2 = c.get_record("docs", "o1"), c.get_record("docs", "o2")
    assert (o1.lifecycle_state, o1.supersedes, o2.supersedes) == ("superseded", "n2", "n1") and c.get_record("docs", "none") is None
    n1 = c.get_record("docs", "n1")
    assert (n1.collection, n1.namespace, n1.chunk_id, n1.embedding_model, n1.chunker_version, n1.lifecycle_state) == ("docs", "test", "0", "unspecified", "v1", "active")
    assert [h.id for h in c.search("docs", "old one", 1).collect()] in (["n1"], ["n2"]) and c.search("docs", "old one", 1, mode="compat").count() == 0
    assert len(list(c.search_stream("docs", "x", 5, raw={"tenant_id": "u"}))) == 1 and "metadata" not in c.search("docs", "x", include_metadata=False).columns
    assert c.count_documents("docs") == 4 and c.count_documents("docs", {"tenant_id": "t"}) == 3
    assert c.delete_record("docs", "n1") and not c.delete_record("docs", "none") and c.count_documents("docs") == 3
    assert c.update_record("docs", "n2", "new", {"tenant_id": "w", "created_at": NOW}) and c.get_record("docs", "n2").content == "new" and not c.update_record("docs", "none", "")
    assert c.delete_by_filter("docs", {"tenant_id": "w"}) == 1 and c.delete_by_filter("docs", {}) == 4 and c.delete_by_filter("none", {}) == 0
    assert c.list_records("docs", {"tenant_id": "t"}, 1, 0).count() == 2
    assert store.run_search(c, "docs", "new", top_k=500, raw={"lifecycle_state": "deleted"}).count() == 4


def test_one_bad_record_keeps_the_batch_out(spark):
    c = client(spark)
    with pytest.raises(ValueError, match="missing: doc_id, source_uri"):
        c.upsert_records("docs", rows(spark, ("a", "x", "file://a", None, 0, "t"), ("b", "y", None, None, 0, "t")))
    with pytest.raises(ValueError, match="no number"):
        c.upsert_records("docs", rows(spark, ("a", "x", "file://a", None, None, "t")).withColumn("chunk_id", F.lit("x")))
    with pytest.raises(ValueError, match="metadata_too_large"):
        c.upsert_records("docs", rows(spark, ("a", "x", "file://a", None, 0, "ü" * 11_000)))
    assert c.records("docs") is None
    with pytest.raises(ValueError, match="invalid created_at"):
        c.upsert_records("docs", rows(spark, ("a", "x", "file://a", None, 0, "t")))
        c.update_record("docs", "a", "x", {"created_at": "yesterday"})


def test_size_of_metadata(spark):
    values = [{"a": "x", "b": "ü\n\"", "c": "😀: , "}, {}, {"k": "a\\"}]
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=False, separators=(",", ":")),) for v in values] + [(None,)], "j string")
    assert [r[0] for r in df.select(lifecycle.json_bytes(F.col("j"))).collect()] == [len(json.dumps(v)) for v in values] + [0]


def test_documents_are_ingested(spark):
    c, heard = client(spark), []
    d = spark.createDataFrame([("file://x/a%20b.md", "inline.txt", bytearray("Ein\n\nZwei".encode()), "d1"), ("", "document.bin", bytearray(b"three"), "d2"), (None, "c.html", bytearray(), "d3")], "source_uri string, filename string, data binary, profile string")
    assert ingest.ingest_documents(c, "docs", d, prefix=F.col("profile"), on_checkpoint=lambda *x: heard.append(x)).count() == 3
    assert heard == [("acquire", 0), ("acquire", 3), ("parse", 0), ("parse", 3), ("chunk", 0), ("chunk", 3), ("upsert", 0), ("upsert", 3)]
    r = c.get_record("docs", "d1-1")
    assert (r.content, r.filename, r.mime_type, r.source_type, r.parser_provider, r.ocr_mode, r.tenant_id, r.chunk_index) == ("Zwei", "a b.md", "text/markdown", "file", "internal", "disabled", "default", 1)
    assert c.get_record("docs", "d2-0").source_uri == "file://document.bin"
    with pytest.raises(RuntimeError, match="all parser providers failed: no data|internal:no data"):
        ingest.ingest_documents(c, "docs", d.withColumn("data", F.lit(None).cast("binary")))
    t = spark.createDataFrame([("a b  c",), ("",)], "text string")
    assert ingest.ingest_text(c, "texts", t, lambda x: T.chunk_fixed(x, 3), T.convert_whitespace, F.concat(F.lit("t"), F.char_length("text"))).count() == 3


def test_parser_chain_and_options():
    o = ingest.Options(parser_chain=("marker", "mineru"), parser_provider="mineru", quality=" Fast ", ocr_enabled=True, page_fallback_max_pages=0, parser_options={"mineru": {"table_enable": True}})
    chain = ingest.effective_chain(o)
    assert chain == ["mineru", "marker", "internal"] and ingest.effective_chain(ingest.Options(parser_chain=())) == ["internal"]
    got = ingest.effective_options(o, chain)
    assert got["mineru"] == ingest.PRESETS["fast"] | {"table_enable": True, "parse_method": "ocr", "page_fallback_max_pages": 1} and got["marker"] == {} and "internal" not in got


def picky():
    # made in a function, so that it travels to the workers by value
    class Picky(acquire.Parser):
        name, version = "picky", "7"

        def parse(self, batches):
            for b in batches:
                out = b[["row"]].copy()
                out["text"] = [bytes(x).decode() for x in b["data"]]
                out["error"] = [None if t.startswith("good") else "bad" for t in out["text"]]
                yield out

    return Picky()


def test_each_document_is_parsed_once(spark):
    d = acquire.inline(spark.createDataFrame([("good one",), ("other",), ("good one",), (None,)], "t string"), "t")
    out = acquire.parse(d.where("data IS NOT NULL"), ["none", "picky", None], acquire.Registry(picky()))
    assert sorted((r.provider_id, r.blocks) for r in out.collect()) == [("internal", ["other"]), ("picky", ["good one"]), ("picky", ["good one"])]
    failed = acquire.parse(d.where("data IS NOT NULL"), ["none", picky()]).where("error IS NOT NULL").collect()
    assert [r.error for r in failed] == ["all parser providers failed: none:not_registered | picky:bad"] and acquire.Registry(picky()).ids() == ["picky"]


def shout():
    # made in a function, so that it travels to the workers by value
    class Shout(acquire.OcrProvider):
        name = "shout"

        def extract(self, batches):
            for b in batches:
                yield b.assign(text=[bytes(x).decode().upper() for x in b["data"]], confidence=1.0)[["row", "text", "confidence"]]

    return Shout()


def test_recognition_plug_in(spark):
    assert shout().recognised(spark.createDataFrame([(1, bytearray(b"a"))], "row bigint, data binary")).first() == (1, "A", 1.0) and shout().healthy()


def test_answers_of_parsers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(parsers.answer_text(F.lit('{"text":"t","output":" ","result":{"output":"r"}}'))) == "t" and one(parsers.answer_text(F.lit('{"result":{"output":"r"}}'))) == "r"
    assert [r.ref for r in one(parsers.answer_images(F.lit('{"images":{"a.png":"data:image/png;base64,QUJD","b":"*","c":"QQ"}}')))] == ["a.png"]
    assert one(parsers.toc_blocks(F.lit('{"metadata":{},"result":{"metadata":{"table_of_contents":[{"title":"x"}]}}}'))) == []
    assert one(parsers.envelope(F.lit("data: {\"a\":1}\ndata: broken"))) == '{"a":1}' and one(parsers.envelope(F.lit("nothing"))) == "{}"
    assert parsers.form_options({"page_range": "1-2", "paginate_output": "no"}) == {"output_format": "markdown", "paginate_output": "false", "page_range": "1-2"}
    assert len(parsers.requests("pipeline", "auto", {"return_md": True, "other": 1})) == 5 and "other" not in parsers.requests("pipeline", "auto", {"other": 1})[0]
    assert [parsers.service_url("http://b", v) for v in ("", "/p", "p", "https://x")] == ["", "http://b/p", "http://b/p", "https://x"]


def test_shapes_of_payloads(spark):
    def one(dialect, payload):
        return [(r.id, r.score, r.content, r.metadata) for r in payloads.normalised(spark.createDataFrame([(1, payload)], "payload_id int, payload string"), dialect).orderBy("pos").collect()]

    assert one("portable", '[{"id":"a"}, 5]') == [("a", 0.0, "", "{}")] and one("qdrant", '{"result":{"points":[{"id":"a","score":0.5}]}}') == [("a", 0.5, "", "{}")]
    assert one("weaviate", '{"data":{"Get":{}},"objects":[{"external_id":"b"}]}') == [("b", 0.0, "", "{}")] and one("chroma", '{"ids":[["a","b"]],"distances":[[0.25]]}') == [("a", 0.75, "", "{}"), ("b", 0.0, "", "{}")]
    assert one("pgvector", '{"rows":[{"id":"a","metadata":"text"}]}') == [("a", 0.0, "", "{}")]


def test_values_of_dialects(spark):
    assert dialects.where_clause({"a": 1}) == {"a": 1} and dialects.where_clause({"a": 1, "b": 2}) == {"$and": [{"a": 1}, {"b": 2}]} and dialects.must_clause({}) == {}
    assert dialects.expression({"id": "o'x", "is_latest": True, "zz": 1}) == "record_id = 'o''x' and is_latest = True" and dialects.expression({}) == "record_id = record_id" and dialects.metric_name("l2") == "L2"
    j = spark.createDataFrame([('{"a":1,"b":{"c":["x",2]},"t":true,"n":null}',), (None,), ("bad",), ('{"a":"1"}',)], "j string")
    hit = lambda asked: [r[0] for r in j.select(dialects.json_contains(F.col("j"), asked)).collect()]
    assert hit({"a": 1.0, "b": {"c": ["x"]}, "t": True, "n": None}) == [True, False, False, False] and hit({"a": "1"}) == [False, False, False, True] and hit({}) == [True, False, False, True] and hit({"b": {"c": [3]}}) == [False] * 4
    row = spark.range(1).select(dialects.output_rows(F.lit('[{"metadata_json":"{}"},[{"a":1}],3]')).alias("r"))
    assert row.select(F.size("r"), dialects.row_metadata(F.col("r")[0], F.lit("k")), dialects.row_metadata(F.col("r")[1], F.lit("k")), dialects.space_score(F.lit(None).cast("double"))).first() == (2, "{}", "k", 0.0)
    assert dialects.bulk_lines(docs(spark, ("a", "x", None)), "i").first().line == '{"index":{"_index":"i","_id":"a"}}\n{"content":"x"}\n'
    assert [r.v for r in spark.createDataFrame([(["a"],), (None,)], "a array<string>").select(dialects.flat_value(F.col("a"), "array<string>").alias("v")).collect()] == ['["a"]', ""]


def test_metadata_patches(spark):
    assert spark.range(1).select(lifecycle.provenance_patch({"a": F.lit("x"), "b": F.lit(""), "c": F.lit(None).cast("int"), "page": F.lit(3)})).first()[0] == {"a": "x", "page": "3"}
    ids = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", " "],), ([],), (None,), ([None],)], "i array<string>")
    assert [r[0] for r in ids.select(catalog.ids_verified(F.col("i"))).collect()] == [True, False, False, False, False, False] and ids.select(catalog.enough_ids(F.col("i"), 3)).first()[0] is False


def test_update_takes_the_last(spark):
    df = spark.createDataFrame([("a", "old")], "record_id string, content string")
    new = spark.createDataFrame([("a", "2", 2), ("a", "3", 3), ("a", "1", 1)], "record_id string, content string, n int")
    assert lifecycle.update(df, new, order="n").first().content == "3"
    t = spark.createDataFrame([("2026-01-01T00:00:00Z", "abc"), ("2026-01-01T00:00:00Z", "1")], "c string, t string")
    assert [r[0] for r in t.select(lifecycle.ttl_expired(F.col("c"), F.col("t"), "2027-01-01T00:00:00Z")).collect()] == [False, True]


def test_report(spark, tmp_path):
    cases = spark.createDataFrame([("a", "d1", "c", "ok", "sync", 5, 1.5, 1.0, None), ("b", "d1", "c", "error", None, None, None, None, "why"), ("", "d2", "c", "ok", None, None, None, None, None)], "provider_id string, document_id string, category string, status string, execution_mode string, text_chars int, parse_time_ms double, quality_invariant_pass_rate double, reason string")
    j, m = catalog.report(cases, NOW, str(tmp_path / "out"), "r")
    got = json.loads(j.read_text())
    assert got["summary"]["a"]["success_ratio"] == 1.0 and got["summary"]["b"]["ok"] == 0 and len(got["cases"]) == 3
    assert "| a | 1 | 1 | 1.000 | 1.50 | 1.000 |" in m.read_text() and "| b | d1 | c | error |  | 0 | 0 | 0 | 0.00 | why |" in m.read_text()


def test_rows_are_sent_in_batches(spark, tmp_path):
    out = str(tmp_path)

    def send(batch):
        import pathlib
        import uuid

        pathlib.Path(out, uuid.uuid4().hex).write_text(str(len(batch)))

    store.written(spark.range(7).coalesce(1), send, 3)
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["1", "3", "3"]
    with pytest.raises(ConfigError):
        store.written(spark.range(1), send, 0)


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert acquire.texts(spark, [str(tmp_path / "a.txt")]).first().text == "one\n\ntwo" and acquire.ParserCapabilities().max_document_bytes == 67_108_864
