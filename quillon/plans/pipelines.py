"""More queries of the core: writing, ingestion, stores and their dialects, parsers' answers, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import catalog as C
from ..operators import dialects as D
from ..operators import history, ingest, lifecycle, search, store
from ..sources import acquire, parsers, payloads
from ..streaming import ingest as stream
from .queries import _BM25, _CELLS, _DOCS, _HEAD, _LIVE, _P3, _PARA, _UTC_RX, NOW, _dialect, _kb, _parts_sql, _records, _tables, _text, _unnested, _uri_sql, query, read, strip_sql

# writing

_CHASH = f"coalesce(nullif(content_hash, ''), sha256({strip_sql('text')}))"
_NORMAL = f"""WITH c AS (SELECT *, coalesce(content, '') AS text FROM incoming_batches), h AS (SELECT *, {_CHASH} AS ch FROM c), b AS (SELECT *, coalesce(nullif(source_hash, ''), ch) AS basis FROM h),
d AS (SELECT *, coalesce(nullif(doc_id, ''), sha256({_uri_sql('source_uri')} || '|' || lower({strip_sql('basis')}))) AS doc FROM b)"""


@query(
    _NORMAL
    + f""", e AS (SELECT *, list_filter([CASE WHEN coalesce(doc, '') = '' THEN 'doc_id' END, CASE WHEN coalesce({strip_sql('source_uri')}, '') = '' THEN 'source_uri' END], lambda x: x IS NOT NULL) AS mi FROM d)
SELECT incoming_id, doc AS doc_id, sha256(doc || '|' || coalesce(chunk_index, 0)) AS record_id, ch AS content_hash, coalesce(source_hash, basis) AS source_hash, '0' AS chunk_id, coalesce(chunk_index, 0) AS chunk_index, 'kb' AS collection, 'unspecified' AS embedding_model,
array_to_string(list_filter([CASE WHEN len(mi) > 0 THEN 'missing: ' || array_to_string(mi, ', ') END, CASE WHEN coalesce({strip_sql('ingested_at')}, '') <> '' AND NOT (regexp_matches({strip_sql('ingested_at')}, '{_UTC_RX}') AND try_cast({strip_sql('ingested_at')} AS TIMESTAMPTZ) IS NOT NULL) THEN 'invalid ingested_at (must be UTC RFC3339)' END,
CASE WHEN NOT regexp_matches({strip_sql('ch')}, '^[0-9a-fA-F]+$') THEN 'invalid content_hash (must be hex)' END, CASE WHEN {strip_sql('coalesce(source_hash, basis)')} <> '' AND NOT regexp_matches({strip_sql('coalesce(source_hash, basis)')}, '^[0-9a-fA-F]+$') THEN 'invalid source_hash (must be hex)' END], lambda x: x IS NOT NULL), '; ') AS errors FROM e"""
)
def normalise_records(spark, d):
    rows = lifecycle.normalised(read(spark, d, "incoming_batches"), NOW, "kb", "n")
    return rows.select("incoming_id", "doc_id", "record_id", "content_hash", "source_hash", "chunk_id", "chunk_index", "collection", "embedding_model", F.array_join(lifecycle.errors_of(rows), "; ").alias("errors"))


@query(f"""WITH h AS (SELECT *, sha256({strip_sql('content')}) AS own FROM incoming_batches WHERE content IS NOT NULL), s AS (SELECT *, coalesce(nullif(source_hash, ''), nullif(content_hash, ''), own) AS src FROM h),
d AS (SELECT *, coalesce(nullif(doc_id, ''), sha256({_uri_sql('source_uri')} || '|' || lower({strip_sql('src')}))) AS doc FROM s)
SELECT incoming_id, doc AS doc_id, sha256(doc || '|' || chunk_index) AS record_id, chunk_index::VARCHAR AS chunk_id, own AS content_hash, src AS source_hash, length(content)::INT AS token_count, true AS is_latest FROM d""")
def chunk_metadata(spark, d):
    rows = read(spark, d, "incoming_batches").where("content IS NOT NULL")
    m = {c: F.col(c) for c in ("source_hash", "content_hash", "doc_id", "source_uri")} | {"chunk_id": F.lit(None).cast("string"), "is_latest": F.lit(None).cast("boolean")}
    out = lifecycle.chunk_metadata(m, F.col("chunk_index"), F.col("content"), F.char_length("content"))
    return rows.select("incoming_id", *[out[c].alias(c) for c in ("doc_id", "record_id", "chunk_id", "content_hash", "source_hash", "token_count", "is_latest")])


_MARKDOWN = f"array_to_string(list_concat(['| ' || array_to_string({_CELLS.format(r='h')}, ' | ') || ' |', '| ' || array_to_string(list_transform(h, lambda x: '---'), ' | ') || ' |'], list_transform(t.rows, lambda r: '| ' || array_to_string(list_transform(range(len(h)), lambda i: coalesce(r[i + 1], '')), ' | ') || ' |')), chr(10))"
_RENDERED = f"""WITH tb AS (SELECT ir_id, pos, {_MARKDOWN} AS shown FROM (SELECT *, {_HEAD} AS h FROM (SELECT ir_id, unnest(range(len(table_blocks)))::INT AS pos, unnest(table_blocks) AS t FROM document_irs))),
ts AS (SELECT ir_id, list(shown ORDER BY pos) AS shown FROM tb GROUP BY 1),
r AS (SELECT i.*, {strip_sql("array_to_string(list_filter(list_concat([" + strip_sql("array_to_string(list_filter(list_transform(text_blocks, lambda b: b.text), lambda t: " + strip_sql('t') + " <> ''), chr(10) || chr(10))") + "], coalesce(shown, [])), lambda x: " + strip_sql('x') + " <> ''), chr(10) || chr(10))")} AS text FROM document_irs i LEFT JOIN ts USING (ir_id)) """


def _irs(spark, d) -> DataFrame:
    irs = read(spark, d, "document_irs")
    return irs.select("ir_id", "source_uri", F.col("provider_id").alias("parser_provider"), F.col("provider_version").alias("parser_version"), "text_blocks", "table_blocks", "quality")


@query(_RENDERED + "SELECT ir_id, text AS rendered FROM r")
def render_document(spark, d):
    return _irs(spark, d).select("ir_id", ingest.rendered(F.col("text_blocks"), F.col("table_blocks")).alias("rendered"))


@query(_RENDERED + f""", k AS (SELECT *, {_parts_sql("CASE WHEN len(" + _PARA + ") > 1 THEN " + _PARA + " WHEN length(text) <= 800 THEN [text] ELSE list_transform(range((length(text) + 799) // 800), lambda i: substr(text, (i * 800 + 1)::BIGINT, 800)) END")} AS c FROM r),
u AS (SELECT *, unnest(range(len(c)))::INT AS i, unnest(c) AS content FROM k)
SELECT ir_id, 'd' || ir_id || '-' || i AS record_id, i::VARCHAR AS chunk_id, sha256({strip_sql('content')}) AS content_hash, CASE WHEN lower(source_uri) LIKE 'http://%' OR lower(source_uri) LIKE 'https://%' THEN 'web' WHEN lower(source_uri) LIKE 'file://%' THEN 'file' WHEN lower(source_uri) LIKE 'api://%' THEN 'api' ELSE 'other' END AS source_type,
coalesce(length(text) < 200 AND coalesce(quality['scanned_ratio'], 0) >= 0.5, false) AS ocr_applied, 'auto' AS ocr_mode, 'table_as_markdown' AS table_policy, provider_id AS parser_provider, 'default' AS tenant_id FROM u""")
def ingest_document(spark, d):
    """Parsed documents as the records an ingestion writes, normalised."""
    rows = ingest.chunk_records(_irs(spark, d), ingest.Options(ocr_mode="auto"), NOW, F.concat(F.lit("d"), "ir_id"))
    return lifecycle.normalised(rows, NOW).select("ir_id", "record_id", "chunk_id", "content_hash", "source_type", "ocr_applied", "ocr_mode", "table_policy", "parser_provider", "tenant_id")


@query(f"SELECT 'd' || doc_id || '-' || i AS record_id, 'ingestion://kb/d' || doc_id || '/' || i AS source_uri, substr(t, i * 300 + 1, 300) AS content FROM (SELECT doc_id, t, unnest(range(greatest((length(t) + 299) // 300, 1)))::INT AS i FROM (SELECT doc_id, {strip_sql("regexp_replace(text, '[" + chr(92) + "x{09}-" + chr(92) + "x{0D}" + chr(92) + "x{1C}-" + chr(92) + "x{20}" + chr(92) + "x{85}" + chr(92) + "x{A0}" + chr(92) + "x{1680}" + chr(92) + "x{2000}-" + chr(92) + "x{200A}" + chr(92) + "x{2028}" + chr(92) + "x{2029}" + chr(92) + "x{202F}" + chr(92) + "x{205F}" + chr(92) + "x{3000}]+', ' ', 'g')")} AS t {_DOCS}))")
def ingest_text(spark, d):
    out = ingest.text_records(_text(spark, d), "kb", lambda c: T.chunk_fixed(c, 300), T.convert_whitespace, NOW, F.concat(F.lit("d"), "doc_id"))
    return out.select("record_id", "source_uri", "content")


@query(_P3.replace("SELECT record_id, (row_number()", "SELECT record_id, lead(us) OVER (PARTITION BY record_id ORDER BY us) AS valid_to_us, state AS lifecycle_state, (row_number()"))
def p3_versions(spark, d):
    """Versions of each record's lifecycle attributes, with their values and ends."""
    return history.metadata_history(read(spark, d, "metadata_updates")).select("record_id", F.col("version_no").cast("int").alias("version_no"), "valid_from_us", "valid_to_us", "lifecycle_state")


@query(f"SELECT metadata.tenant_id AS tenant_id, count(*) > 0 AND count(*) FILTER (coalesce({strip_sql('record_id')}, '') = '') = 0 AND count(DISTINCT record_id) = count(*) AS verified FROM records GROUP BY 1")
def id_verification(spark, d):
    return lifecycle.verified_ids(_records(spark, d), "tenant_id", "record_id")


@query("SELECT event_id, false AS purge_0, 1000000 - event_id > 5 * 86400 AS purge_5 FROM events")
def should_purge(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", lifecycle.should_purge(F.lit(0), F.lit(0), F.lit(-3)).alias("purge_0"), lifecycle.should_purge(e, F.lit(1_000_000), F.lit(5)).alias("purge_5"))


@query("SELECT metadata.collection AS collection, least(count(*), 100) AS n FROM records GROUP BY 1")
def emulated_counts(spark, d):
    r = read(spark, d, "records").select(F.col("metadata.collection").alias("collection"))
    return r.groupBy("collection").agg(lifecycle.capped(F.count("*"), 100).alias("n"))


# dialects


@query("""SELECT id FROM stored_documents WHERE json_contains(metadata, '{"collection": "kb_articles", "lifecycle_state": "active"}')""")
def json_containment(spark, d):
    return read(spark, d, "stored_documents").where(D.json_contains(F.col("metadata"), {"collection": "kb_articles", "lifecycle_state": "active"})).select("id")


@query("SELECT dialect, count(*) AS n FROM records, (SELECT unnest(['where', 'must', 'term']) AS dialect) WHERE metadata.tenant_id = 'tnt-wexcombe' AND lifecycle_state = 'active' AND metadata.is_latest GROUP BY 1")
def clause_dialects(spark, d):
    asked, r = {"tenant_id": "tnt-wexcombe", "lifecycle_state": "active", "is_latest": True}, _records(spark, d)
    made = {"where": D.where_clause(asked), "must": D.must_clause(asked), "term": D.term_clauses(asked)}
    one = r.select(F.explode(F.array_compact(F.array(*[F.when(D.of_clause(c), F.lit(n)) for n, c in made.items()]))).alias("dialect"))
    return one.groupBy("dialect").agg(F.count("*").alias("n"))


@query("SELECT record_id FROM records WHERE metadata.tenant_id = 'tnt-quenby' AND lifecycle_state = 'active'")
def filter_expression(spark, d):
    return _records(spark, d).where(D.expression({"tenant_id": "tnt-quenby", "lifecycle_state": "active", "chunk_index": 3})).select("record_id")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, d):
    return read(spark, d, "embeddings").select("vec_id", D.vector_literal(F.col("embedding")).alias("literal"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '{\"n\":' || label || '}' ELSE '{}' END AS metadata FROM embeddings")
def metadata_objects(spark, d):
    m = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit('{"n":'), "label", F.lit("}"))).when(F.col("vec_id") % 3 == 1, F.lit("[1]")).otherwise(F.lit("{broken"))
    return read(spark, d, "embeddings").select("vec_id", D.metadata_object(m).alias("metadata"))


_STATIC = ", ".join(f"coalesce(CAST(metadata.{c} AS VARCHAR), '') AS {c}" for c in D.STATIC_COLUMNS)


@query(f"SELECT record_id, content, {_STATIC} FROM records")
def static_rows(spark, d):
    r = read(spark, d, "records")
    return D.static_row(r, lifecycle.flattened(F.col("metadata"))).drop("metadata_json")


@query("SELECT vec_id, 'v' || vec_id AS record_id, 'b' AS kind, label::VARCHAR AS label FROM embeddings")
def merged_output_rows(spark, d):
    s = F.struct
    parts = F.concat(F.lit("[["), F.to_json(s(F.concat(F.lit("v"), "vec_id").alias("record_id"), F.lit("a").alias("kind"))), F.lit(","), F.to_json(s(F.lit("b").alias("kind"), F.col("label").alias("label"))), F.lit("],7]"))
    m = F.element_at(D.output_rows(parts), 1)
    return read(spark, d, "embeddings").select("vec_id", m["record_id"].alias("record_id"), m["kind"].alias("kind"), m["label"].alias("label"))


_FIELDS = [f.split(" ", 1) for f in lifecycle.METADATA.split(", ")][:-1]


@query("SELECT record_id, content, " + " + ".join(f"(CASE WHEN {'len(metadata.' + n + ') > 0' if t.startswith('array') else 'coalesce(CAST(metadata.' + n + chr(32) + 'AS VARCHAR), ' + chr(39) * 2 + ') <> ' + chr(39) * 2} THEN 1 ELSE 0 END)" for n, t in _FIELDS) + " + (CASE WHEN metadata.extras IS NULL THEN 0 ELSE len(list_filter(map_values(metadata.extras), lambda v: coalesce(v, '') <> '')) END) AS n_fields, metadata.token_count AS token_count FROM records")
def metadata_maps(spark, d):
    """Metadata as a map and back, and records as other frameworks' documents and back."""
    r = read(spark, d, "records").withColumn("m", lifecycle.flattened(F.col("metadata")))
    back = payloads.from_text(payloads.to_text(payloads.from_page_content(payloads.to_page_content(r.select(F.coalesce("content", F.lit("")).alias("content"), F.struct("record_id", "m", F.col("content").isNull().alias("none")).alias("metadata"))))))
    return back.select("metadata.record_id", F.when(~F.col("metadata.none"), F.col("content")).alias("content"), F.size("metadata.m").alias("n_fields"), lifecycle.canonical(F.col("metadata.m"))["token_count"].alias("token_count"))


@query("SELECT payload_id, pos, id, score, content, metadata, dialect || ':' || shape AS dialect FROM (SELECT vec_id AS payload_id, 0 AS pos, 'v' || vec_id AS id, round(label / 16.0, 6) AS score, 'text ' || label AS content, '{\"n\":' || label || '}' AS metadata FROM embeddings), (VALUES ('portable', 'list'), ('chroma', 'list'), ('opensearch', 'list'), ('pgvector', 'list'), ('qdrant', 'points'), ('weaviate', 'Get')) s(dialect, shape)")
def payload_shapes(spark, d):
    st, ar = F.struct, F.array
    one = lambda v, s, t, m: ar(st(v.alias("id"), s.alias("score"), t.alias("content"), m.alias("metadata")))
    shapes = {n: ("list", one) for n in ("portable", "chroma", "opensearch", "pgvector")} | {
        "qdrant": ("points", lambda v, s, t, m: st(st(ar(st(v.alias("id"), s.alias("score"), st(t.alias("text"), m.alias("metadata")).alias("payload"))).alias("points")).alias("result"))),
        "weaviate": ("Get", lambda v, s, t, m: st(st(st(ar(st(t.alias("text"), m.alias("metadata"), st(v.alias("id"), (1 - s).alias("distance")).alias("_additional"))).alias("Docs")).alias("Get")).alias("data"))),
    }
    out = None
    for n, (shape, make) in shapes.items():
        part = _dialect(spark, d, n, make).withColumn("dialect", F.lit(f"{n}:{shape}"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT vec_id AS payload_id, dialect, 'v' || vec_id AS record_id, 'text ' || label AS content, CASE WHEN dialect = 'pgvector' THEN 'archived' WHEN label % 2 = 0 THEN 'deleted' ELSE 'active' END AS lifecycle_state FROM embeddings, (SELECT unnest(['portable', 'pgvector']) AS dialect)")
def single_records(spark, d):
    e, v, t = read(spark, d, "embeddings"), F.concat(F.lit("v"), "vec_id"), F.concat(F.lit("text "), "label")
    shapes = {"portable": F.struct(v.alias("record_id"), t.alias("content"), F.when(F.col("label") % 2 == 0, F.lit("deleted")).alias("lifecycle_state")), "pgvector": F.struct(v.alias("id"), t.alias("content"), F.struct(F.lit("archived").alias("lifecycle_state")).alias("metadata"))}
    parts = [payloads.record(e.select(F.col("vec_id").alias("payload_id"), F.to_json(s).alias("payload")), n).withColumn("dialect", F.lit(n)).drop("metadata") for n, s in shapes.items()]
    return parts[0].unionByName(parts[1])


_MATRIX = ", ".join(f"('{n}', {str(c.hybrid).lower()}, {str(c.delete_by_filter).lower()}, {c.max_metadata_bytes}, {c.max_batch_size})" for n, c in [("chroma", search.Capabilities()), ("qdrant", search.Capabilities(delete_by_filter=True)), ("weaviate", search.Capabilities(hybrid=True)), ("opensearch", search.Capabilities(hybrid=True, delete_by_filter=True)), ("pgvector", search.Capabilities(delete_by_filter=True))])


@query(f"SELECT * FROM (VALUES {_MATRIX}, ('infinity', false, true, 65536, 500)) m(store, hybrid, delete_by_filter, max_metadata_bytes, max_batch_size)")
def capability_matrix(spark, d):
    return spark.createDataFrame([(n, c.hybrid, c.delete_by_filter, c.max_metadata_bytes, c.max_batch_size) for n, c in search.MATRIX.items()], "store string, hybrid boolean, delete_by_filter boolean, max_metadata_bytes int, max_batch_size int")


@query("SELECT * FROM (VALUES ('chroma', 'hnsw_m', '4'), ('chroma', 'hnsw_space', 'cosine'), ('qdrant', 'hnsw_ef', '16'), ('weaviate', 'ef', '16'), ('opensearch', 'ef_search', '16'), ('pgvector', 'probes', '1'), ('pgvector', 'lists', '100')) m(store, name, value)")
def search_options(spark, d):
    """Options with overrides below their least values."""
    low = {"hnsw_m": 1, "hnsw_ef": 1, "ef": 1, "ef_search": 1, "probes": 0}
    asked = [("chroma", "hnsw_m"), ("chroma", "hnsw_space"), ("qdrant", "hnsw_ef"), ("weaviate", "ef"), ("opensearch", "ef_search"), ("pgvector", "probes"), ("pgvector", "lists")]
    return spark.createDataFrame([(s, k, str(C.options(s, {x: v for x, v in low.items() if x in C.OPTIONS[s]})[k])) for s, k in asked], "store string, name string, value string")


# searches

_OCTET = "list_transform(range(8), lambda i: (((('0x' || substr(sha256(encode({t}) || unhex('00000000')), i * 8 + 1, 8))::UBIGINT)::DOUBLE / 2147483648.0 - 1.0)::FLOAT)::DOUBLE)"


@query(f"SELECT (row_number() OVER (ORDER BY score DESC))::INT AS rank, round(score, 6) AS score FROM (SELECT list_inner_product({_OCTET.format(t='text')}, {_OCTET.format(t=chr(39) + 'archive' + chr(39))}) AS score {_DOCS} AND doc_id % 2 = 1 ORDER BY 1 DESC LIMIT 10)")
def client_search(spark, d):
    """Documents written through a client (the even ones deleted again by filter), then searched."""
    registry = store.StoreRegistry()
    registry.register("pgvector", store.build(spark, "pgvector"))
    c = store.Client(spark, registry, "pgvector", NOW)
    c.create_collection(store.Spec("docs", embedding_dim=8))
    rows = _text(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("content"), F.concat(F.lit("file://"), "doc_id").alias("source_uri"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("profile"))
    c.upsert_records("docs", rows)
    c.delete_by_filter("docs", {"profile": "even"})
    hits = store.run_search(c, "docs", "archive", top_k=10)
    return search.rank_scores(hits, 11, [F.desc("score")]).select((12 - F.col("score")).cast("int").alias("rank"), "id").join(hits.select("id", F.round("score", 6).alias("score")), "id").select("rank", "score")


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, CASE WHEN vec_id % 100 = 7 THEN list_inner_product(q.v, q.v) ELSE list_inner_product(embedding::DOUBLE[], q.v) END AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def missing_embedding(spark, d):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return search.topk(e.withColumn("embedding", F.when(F.col("vec_id") % 100 != 7, F.col("embedding"))), q, 10, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(_LIVE.replace(", h AS", ", h0 AS").rstrip() + ", v AS (SELECT id, list_cosine_similarity(s.embedding::DOUBLE[], q.v) AS vector FROM s, q ORDER BY 2 DESC, id LIMIT 50), " + _BM25.removeprefix("WITH ").replace("SELECT doc_id AS id, regexp_extract_all(lower(text)", "SELECT id, regexp_extract_all(lower(content)").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT DISTINCT ON (id) id, content FROM stored_documents WHERE id IN (SELECT id FROM s) ORDER BY id)").replace("\nSELECT id, round(", ", bm AS (SELECT id, (").replace(", 6) AS lexical", ") AS lexical") + ") SELECT id, round(coalesce(lexical, 0) + coalesce(vector, 0), 6) AS score FROM bm FULL JOIN v USING (id) ORDER BY coalesce(lexical, 0) + coalesce(vector, 0) DESC, id LIMIT 10")
def hybrid_scores(spark, d):
    s, _, q = _kb(spark, d)
    docs = read(spark, d, "stored_documents").groupBy("id").agg(F.min("content").alias("content")).join(s, "id")
    return search.hybrid(docs, "archive checkpoint", q, 10).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%x', (('0x' || substr(h, 17, 1))::INT & 3) | 8) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('kb:' || id)) AS h FROM stored_documents)")
def named_points(spark, d):
    return read(spark, d, "stored_documents").select("id").distinct().select("id", store.point_id("weaviate", "kb", F.col("id")).alias("point_id"))


# texts, tables, parsers


@query(_unnested("list_filter(string_split(list_reduce(list_concat([''], " + _parts_sql("string_split(replace(text, chr(10), ' '), '.')") + "), lambda a, x: regexp_replace(a, '[^\\x01]*$', '') || CASE WHEN length(trim(regexp_extract(a, '[^\\x01]*$') || '. ' || x, '. ')) >= 120 THEN trim(regexp_extract(a, '[^\\x01]*$') || '. ' || x, '. ') || chr(1) ELSE trim(regexp_extract(a, '[^\\x01]*$') || '. ' || x, '. ') END), chr(1)), lambda x: x <> '')").replace("AS c FROM documents", "AS c0, text FROM documents").replace("FROM (SELECT doc_id, list_filter", "FROM (SELECT doc_id, CASE WHEN len(c0) > 0 THEN c0 ELSE [text] END AS c FROM (SELECT doc_id, list_filter").rstrip() + ")")
def chunk_semantic_sized(spark, d):
    return _text(spark, d).select("doc_id", F.posexplode(T.chunk_semantic(F.col("text"), 120)).alias("chunk_index", "chunk"))


_KEYS = "list_transform(range(len(r)), lambda i: coalesce(nullif(coalesce(t.headers, [])[i + 1], ''), 'col_' || i))"
_OBJECT = "'{' || array_to_string(list_transform(list_filter(range(len(r)), lambda i: NOT list_contains({k}[(i + 2):], {k}[i + 1])), lambda i: to_json({k}[i + 1])::VARCHAR || ':' || coalesce(to_json(r[i + 1])::VARCHAR, 'null')), ',') || '}'".replace("{k}", _KEYS)
_ENDS = "',\"page\":' || coalesce(t.page::VARCHAR, 'null') || ',\"locator\":' || coalesce(to_json(t.locator)::VARCHAR, 'null') || '}'"


@query(f"SELECT ir_id, pos, '{{\"records\":[' || array_to_string(list_transform(t.rows, lambda r: {_OBJECT}), ',') || ']' || {_ENDS} AS records, '{{\"headers\":[' || array_to_string(list_transform(coalesce(t.headers, []), lambda h: to_json(coalesce(h, ''))::VARCHAR), ',') || '],\"rows\":[' || array_to_string(list_transform(t.rows, lambda r: '[' || array_to_string(list_transform(r, lambda c: coalesce(to_json(c)::VARCHAR, 'null')), ',') || ']'), ',') || ']' || {_ENDS} AS rows_cols FROM (SELECT ir_id, unnest(range(len(table_blocks)))::INT AS pos, unnest(table_blocks) AS t FROM document_irs)")
def table_records(spark, d):
    return _tables(spark, d).select("ir_id", "pos", T.render_table(F.col("t"), "table_as_json").alias("records"), T.render_table(F.col("t"), "table_as_json", "rows_cols").alias("rows_cols"))


@query("SELECT doc_id, mode, CASE mode WHEN 'force' THEN true WHEN 'disabled' THEN false ELSE coalesce(n_chars < 200, false) END AS enabled, CASE mode WHEN 'force' THEN 'mode_force' WHEN 'disabled' THEN 'mode_disabled' ELSE CASE WHEN n_chars < 200 THEN 'auto_triggered' ELSE 'auto_not_required' END END AS reason, coalesce(n_chars <= 500, false) AS within FROM documents, (SELECT unnest(['force', 'disabled', 'auto']) AS mode)")
def ocr_modes(spark, d):
    docs = read(spark, d, "documents")
    made = F.array(*[T.ocr_decision(m, F.col("n_chars"), F.lit(0.5)) for m in ("force", "disabled", "anything")])
    return docs.select("doc_id", F.coalesce(T.within_budget(F.col("n_chars"), F.lit(500)), F.lit(False)).alias("within"), F.explode(made).alias("o")).select("doc_id", "o.mode", "o.enabled", "o.reason", "within")


@query("SELECT event_id, event_id % 3 = 0 AS enabled, CASE WHEN event_id % 2 = 0 THEN 50.0 ELSE greatest(least(greatest((event_id % 500) * 2.5, 90.0), 900.0), 0.0) END AS timeout, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS first_parser, event_id % 4 = 1 AS running, event_id % 4 >= 2 AS terminal FROM events")
def runtime_settings(spark, d):
    i = F.col("event_id")
    word = F.when(i % 3 == 0, F.when(i % 2 == 0, " YES ").otherwise("1")).otherwise("off")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "cancelled"))), (i % 4 + 1).cast("int"))
    chain = C.fallback_chain(F.array(F.lit("a"), F.lit("b")), F.when(i % 2 == 0, "a").otherwise("z"))
    return read(spark, d, "events").select("event_id", I.truthy(word).alias("enabled"), C.provider_timeout(F.when(i % 2 == 0, 50.0), (i % 500).cast("double")).alias("timeout"), C.first_available(chain, F.array(F.lit("b"), F.lit("a"))).alias("first_parser"), C.is_running(status).alias("running"), C.is_terminal(status).alias("terminal"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'busy' WHEN event_id % 3 > 0 THEN 'busy' WHEN event_id % 2 = 0 THEN 'busy' ELSE 'ready' END AS state, event_id % 7 = 0 AS probed_busy, event_id * 1000 / 250000.0 > 30 AS goes_async, 'text ' || event_id AS layout, '{\"n\":' || event_id || '}' AS envelope, event_id % 2 = 0 AS by_page FROM events")
def parser_decisions(spark, d):
    i = F.col("event_id")
    health = F.to_json(F.struct(F.when(i % 5 == 0, "overloaded").otherwise("ok").alias("status"), (i % 3).alias("waiting"), (2 - i % 2).alias("inflight"), F.lit(2).alias("max_concurrent")))
    probe = F.to_json(F.struct((i % 14 == 0).alias("busy"), F.when(i % 7 == 0, "Busy").otherwise("ok").alias("status")))
    t = F.concat(F.lit("text "), i)
    layout = F.to_json(F.struct(F.when(i % 2 == 0, t).alias("text"), F.struct(F.struct(F.lit(" ").alias("md_content"), t.alias("markdown")).alias("f")).alias("results")))
    stream_ = F.concat(F.lit('event: x\ndata: {"n":'), i, F.lit("}\ndata: [DONE]\n\n"))
    return read(spark, d, "events").select("event_id", parsers.health_state(health).alias("state"), parsers.probe_busy(probe).alias("probed_busy"), parsers.goes_async(i * 1000, 30).alias("goes_async"), parsers.layout_text(layout).alias("layout"), parsers.envelope(stream_).alias("envelope"), parsers.pages_apply(F.when(i % 4 == 0, "A.PDF").otherwise("a.txt"), F.when(i % 4 == 2, "application/pdf")).alias("by_page"))


@query("SELECT doc_id, to_base64(encode(text)) AS data_base64, octet_length(encode(text))::BIGINT AS byte_size, text AS answer FROM documents WHERE trim(text) <> '' AND regexp_matches(text, '[a-z]')")
def parser_answers(spark, d):
    """Texts as a service's answer and as images with a data: prefix (broken ones beside them)."""
    docs = _text(spark, d).where(F.col("text").rlike("[a-z]"))
    b64 = F.base64(F.encode("text", "UTF-8"))
    payload = F.to_json(F.struct(F.struct(F.col("text").alias("output"), F.struct(F.concat(F.lit("data:image/png;base64,"), F.replace(b64, F.lit("\r\n"), F.lit(""))).alias("a"), F.lit("!").alias("b")).alias("images")).alias("result")))
    image = F.explode(parsers.answer_images(payload))
    return docs.select("doc_id", image.alias("i"), parsers.answer_text(payload).alias("answer")).select("doc_id", "i.data_base64", "i.byte_size", "answer")


@query(_unnested(_parts_sql("string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))")))
def internal_parse(spark, d):
    """Bytes in two encodings, decoded and cut into blocks."""
    data = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    docs = _text(spark, d).where("text <> ''").select("doc_id", F.lit("inline://").alias("source_uri"), F.lit("inline.txt").alias("filename"), F.lit("text/plain").alias("mime_type"), data.alias("data"))
    return acquire.parse(docs, ["absent", None]).select("doc_id", F.posexplode("blocks").alias("chunk_index", "chunk"))


@query(f"""WITH x AS (SELECT *, array_to_string(list_filter(list_transform(text_blocks, lambda b: b.text), lambda t: {strip_sql('t')} <> ''), chr(10) || chr(10)) AS text0 FROM document_irs), y AS (SELECT *, {strip_sql('text0')} AS body FROM x)
SELECT ir_id, provider, length(text0)::INT AS text_chars, len(list_filter(text_blocks, lambda b: b.kind = 'heading' OR coalesce(starts_with({strip_sql('b.text')}, '#') AND length({strip_sql('b.text')}) > 1, false)))::INT AS heading_count, coalesce(len(table_blocks), 0)::INT AS table_count, coalesce(len(artefact_refs), 0)::INT AS image_count,
CASE WHEN body = '' THEN 0 ELSE len({_parts_sql('CASE WHEN len(' + _PARA.replace('text', 'body') + ') > 1 THEN ' + _PARA.replace('text', 'body') + ' WHEN length(body) <= 800 THEN [body] ELSE list_transform(range((length(body) + 799) // 800), lambda i: substr(body, (i * 800 + 1)::BIGINT, 800)) END')})::INT END AS chunk_count FROM y, (SELECT unnest(['a', 'b']) AS provider)""")
def comparison_cases(spark, d):
    irs = C.cases(read(spark, d, "document_irs"), ["a", "b"])
    n = C.counts(F.col("text_blocks"), F.col("table_blocks"), F.col("artefact_refs"))
    return irs.select("ir_id", F.col("provider_id").alias("provider"), *[v.alias(k) for k, v in n.items()])


@query("SELECT DISTINCT event_type AS provider_id FROM events WHERE event_type <> ''")
def providers_sorted(spark, d):
    return C.providers_of(read(spark, d, "events").select(F.col("event_type").alias("provider_id")))


@query("SELECT '2025-06-01T00:00:00Z' AS timestamp, event_type AS action, 'u' || user_id AS target, 'system' AS actor, CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'success' END AS outcome, 0 AS n_details FROM events")
def audit_events(spark, d):
    a = read(spark, d, "events").select(F.col("event_type").alias("action"), F.concat(F.lit("u"), "user_id").alias("target"), F.when(F.col("event_id") % 2 == 0, "failure").alias("outcome"))
    return C.audited(a, NOW).withColumn("n_details", F.size("details")).drop("details")


@query("SELECT 'j' || event_id AS job_id, CASE WHEN event_id = 5 THEN 'cancelled' WHEN event_id % 2 = 0 THEN 'completed' ELSE 'queued' END AS status, event_id = (SELECT min(event_id) FROM events WHERE event_id % 2 = 1 AND event_id <> 5) AS next FROM events")
def job_queue(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "completed").otherwise("queued").alias("status"))
    jobs = C.cancelled(C.submitted(e.withColumn("status", F.lit("old")), e), "j5")
    nxt = C.next_job(jobs).select("job_id", F.lit(True).alias("next"))
    return jobs.join(F.broadcast(nxt), "job_id", "left").select("job_id", "status", F.coalesce("next", F.lit(False)).alias("next"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id, ts) * FROM events) GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return stream.tumbling(read(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))
